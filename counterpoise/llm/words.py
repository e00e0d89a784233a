"""Words and word windows of whole texts as 64-bit hashes, one Arrow batch at a time.

A word is a maximal run of bytes other than space and tab to carriage return;
UTF-8 never uses those bytes inside a character. All work is on the batch's
byte buffer. Hashes are exact functions of the bytes (no seed of the process),
so every worker and every retry gives the same ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

_SLICE = 1 << 20
_RATIO = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def _splitmix(x: np.ndarray) -> np.ndarray:
    """Finaliser of the splitmix64 generator: a bijection that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _splitmix(x + np.uint64(_RATIO))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = mix(np.arange(256, dtype=np.uint64))
_LOWER = np.arange(256)
_LOWER[0x41:0x5B] += 0x20
_LOWER_BYTE = _BYTE[_LOWER]
_powers: list[np.ndarray] = []


def _power_tables() -> tuple[np.ndarray, np.ndarray]:
    """r^i and r^-i modulo 2^64 for i <= _SLICE (r is odd, so it has an inverse)."""
    if not _powers:
        for r in (_RATIO, pow(_RATIO, -1, 1 << 64)):
            steps = np.full(_SLICE + 1, r & _MASK, np.uint64)
            steps[0] = 1
            _powers.append(np.multiply.accumulate(steps))
    return _powers[0], _powers[1]


def _long_word(data: np.ndarray, table: np.ndarray) -> np.uint64:
    """The polynomial of a word longer than the tables, a block at a time."""
    power, _ = _power_tables()
    total = np.zeros(1, np.uint64)
    for at in range(0, len(data), _SLICE):
        block = table[data[at : at + _SLICE]]
        block *= power[: len(block)]
        total += block.sum(dtype=np.uint64) * np.uint64(pow(_RATIO, at, 1 << 64))
    return total[0]


class Words(NamedTuple):
    """``hashes[first[i]:first[i + 1]]`` are the words of text i, which is ``data[at[i]:at[i + 1]]``."""

    hashes: np.ndarray
    first: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    data: np.ndarray
    at: np.ndarray


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts (null: none) and where each text begins."""
    texts = texts.cast(pa.large_string()).fill_null("")
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if len(at) == 0 or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]]
    return data, at - at[0]


def words_of(texts: pa.Array, lower: bool = False) -> Words:
    """Words of every text; ``lower`` folds A-Z only."""
    data, at = text_bytes(texts)
    n = len(data)
    inside = ~_SPACE[data]
    starts = at[:-1][at[:-1] < n]
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    before[starts] = False
    begin = np.flatnonzero(inside & ~before)
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    after[starts[starts > 0] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    hashes = np.empty(len(begin), np.uint64)
    table = _LOWER_BYTE if lower else _BYTE
    i = 0
    with np.errstate(over="ignore"):
        while i < len(begin):
            j = max(i + 1, int(np.searchsorted(end, begin[i] + _SLICE, "right")))
            low, high = int(begin[i]), int(end[j - 1])
            if high - low > _SLICE:  # one word
                hashes[i] = mix(_long_word(data[low:high], table) + np.uint64(high - low))
                i = j
                continue
            power, inverse = _power_tables()
            sums = np.zeros(high - low + 1, np.uint64)
            np.cumsum(table[data[low:high]] * power[: high - low], out=sums[1:])
            b, e = begin[i:j] - low, end[i:j] - low
            # the polynomial of the word alone, whatever stands before it, and its length
            hashes[i:j] = mix((sums[e] - sums[b]) * inverse[b] + (e - b).astype(np.uint64))
            i = j
    return Words(hashes, np.searchsorted(begin, at), begin, end, data, at)


def windows_of(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words inside one text, and where each text's begin."""
    count = np.maximum(np.diff(words.first) - size + 1, 0)
    first = np.concatenate([[0], np.cumsum(count)])
    h = words.hashes
    if len(h) < size:
        return np.zeros(0, np.uint64), first
    with np.errstate(over="ignore"):
        total = np.zeros(len(h) - size + 1, np.uint64)
        for k in range(size):
            total = mix(total ^ h[k : len(h) - size + 1 + k])
    place = np.arange(len(total)) + size  # a window may not run past its text
    owner = np.searchsorted(words.first, np.arange(len(total)), "right") - 1
    return total[place <= words.first[owner + 1]], first


def sequence_hash(h: np.ndarray) -> np.uint64:
    """One hash of a whole sequence of words, its length included."""
    total = np.full(1, len(h), np.uint64)
    for x in h:
        total = mix(total ^ x)
    return total[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``limit`` bytes of text, cut between rows."""
    i = batch.schema.get_field_index(column)
    _, at = text_bytes(batch.column(i))
    row = 0
    while row < batch.num_rows:
        stop = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
        yield batch.slice(row, stop - row)
        row = stop
