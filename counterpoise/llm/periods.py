"""Runs of repeated word sequences, by Lyndon arrays from Baier's grouping.

A run is a maximal stretch of words with smallest period q, here of at least
max(least, repeats * q) words. Every run holds a Lyndon root: under the order of
words in which the word behind the run is smaller than the one a period before
it, the longest Lyndon word that starts at the root is the root itself (Bannai
et al., "The runs theorem"). So the lengths of the longest Lyndon words at all
positions, under an order and its reverse, name every run by a place and a
period; extending the place to both sides as far as words a period apart agree
(LCE) gives the run.

The Lyndon arrays come from phase one of Baier's suffix sorter: positions are
grouped by the Lyndon word known to start there, groups are taken from the
greatest to the least, and each position of a group is appended to the nearest
position before it that is in a lower group. When a group is taken, its word is
the longest Lyndon word of its positions; no suffix is sorted.

Before that, words that no run can hold are left out: each three consecutive
words of a run stand in it three times at least (if ``repeats`` is 4 and ``least``
is 6 or more; below, whole texts are looked at), so a place whose three words are
rarer in its stretch ends a stretch. This counts
hashes of a whole batch at once; equal hashes of different words only leave
more to look at, since the stretches themselves are compared word by word.

Defined results: a null, empty or blank text has no words, no runs and an empty
collapsed text; rows are independent of each other, so repeated rows give equal
rows, an empty table an empty one, and null keys are kept; very long texts take
memory in proportion to the text, one text at a time; runs are ordered by start,
then period (several runs may share words); columns other than key and text are
not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from counterpoise.llm.words import Words, mix, slices, words_of

LEAST = 6
REPEATS = 4
_PASSES = 16
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def lyndon_lengths(w: list[int], letters: int) -> list[int]:
    """Length of the longest Lyndon word at each place; letters are 0 .. ``letters`` - 1.

    Groups are linked from the greatest to the least. A position that gains m
    copies of the current word goes to a new group directly above its old one;
    more copies stand higher.
    """
    n = len(w)
    where: list[list[int]] = [[] for _ in range(letters)]
    for i, c in enumerate(w):
        where[c].append(i)
    group = list(w)
    length = [1] * letters
    lower = list(range(-1, letters - 1))
    upper = [*range(1, letters), -1]
    before = [-1] * n  # the nearest position in a lower group, once it is known
    done = bytearray(n)
    out = [0] * n
    g = letters - 1
    while g >= 0:
        size = length[g]
        gains: dict[int, int] = {}
        for i in where[g]:
            if group[i] != g:
                continue  # it has gone to a higher group
            done[i] = 1
            out[i] = size
            p = i - 1
            steps = 0
            while p >= 0 and done[p]:
                p = before[p]
                steps += 1
            before[i] = p
            if steps > 2:  # all that was passed is passed at once from now on
                q = i - 1
                while q != p:
                    onward = before[q]
                    before[q] = p
                    q = onward
            if p >= 0:
                gains[p] = gains.get(p, 0) + 1
        moved: dict[tuple[int, int], list[int]] = {}
        for p, m in gains.items():
            moved.setdefault((m, group[p]), []).append(p)
        for m, f in sorted(moved, reverse=True):
            if len(where[f]) == 1:  # alone in its group: the place in the order stays
                length[f] += m * size
                continue
            new, above = len(length), upper[f]
            length.append(length[f] + m * size)
            where.append(moved[m, f])
            lower.append(f)
            upper.append(above)
            upper[f] = new
            if above >= 0:
                lower[above] = new
            for p in moved[m, f]:
                group[p] = new
        g = lower[g]
    return out


def common_extension(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading elements of the two agree, looking at growing blocks."""
    n, at, step = min(len(a), len(b)), 0, 16
    while at < n:
        stop = min(n, at + step)
        apart = np.flatnonzero(a[at:stop] != b[at:stop])
        if len(apart):
            return at + int(apart[0])
        at, step = stop, 2 * step
    return n


def runs_of(w: np.ndarray, least: int = LEAST, repeats: int = REPEATS) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a sequence of numbers 0, 1, ..., by start and period.

    ``repeats`` is 3 or more: a run then holds two whole roots one after the other.
    """
    n, letters = len(w), int(w.max(initial=-1)) + 1
    found = []
    whole = max(2, repeats - 1)  # roots that stand whole in a run
    for order in (w, letters - 1 - w):
        root = np.array(lyndon_lengths(order.tolist(), letters), np.int64)
        place = np.arange(n)
        likely = place + whole * root <= n
        for k in range(1, whole):
            likely[likely] = root[place[likely] + k * root[likely]] == root[likely]
        place = place[likely]
        period = root[place]
        by_period = np.lexsort((place, period))
        last, end = 0, 0  # the period looked at, and how far its stretches are known
        for i, q in zip(place[by_period].tolist(), period[by_period].tolist()):
            if q == last and i + q <= end:
                continue
            start = i - common_extension(w[:i][::-1], w[: i + q][::-1])
            last, end = q, i + q + common_extension(w[i:], w[i + q :])
            if end - start >= max(least, repeats * q):
                found.append((start, end - start, q))
    return sorted(set(found), key=lambda r: (r[0], r[2]))


def stretches(words: Words, least: int = LEAST, repeats: int = REPEATS) -> np.ndarray:
    """(first, last + 1) word numbers, within the batch, of the stretches that may hold runs."""
    h = words.hashes
    if repeats < 4 or least < 6 or len(h) < 4:
        whole = np.stack([words.first[:-1], words.first[1:]], axis=1)
        return whole[whole[:, 0] < whole[:, 1]]
    triple = mix(mix(mix(h[:-2]) ^ h[1:-1]) ^ h[2:])
    owner = np.searchsorted(words.first, np.arange(len(triple)), "right") - 1
    at = np.flatnonzero(np.arange(len(triple)) + 3 <= words.first[owner + 1])
    stretch = owner[at]
    for _ in range(_PASSES):
        if len(at) == 0:
            break
        order = np.lexsort((triple[at], stretch))
        t, s = triple[at][order], stretch[order]
        fresh = np.append(True, (t[1:] != t[:-1]) | (s[1:] != s[:-1]))
        often = np.empty(len(at), bool)
        often[order] = np.bincount(np.cumsum(fresh) - 1)[np.cumsum(fresh) - 1] >= 3
        held = at[often]
        opens = np.append(True, (np.diff(held) != 1) | (np.diff(stretch[often]) != 0))[: len(held)]
        part = np.cumsum(opens) - 1
        long = np.bincount(part)[part] >= 4 if len(held) else np.zeros(0, bool)
        settled = len(held) == len(at) and long.all()
        at, stretch = held[long], part[long]
        if settled:
            break
    if len(at) == 0:
        return np.zeros((0, 2), np.int64)
    opens = np.flatnonzero(np.append(True, (np.diff(at) != 1) | (np.diff(stretch) != 0)))
    closes = np.append(opens[1:], len(at)) - 1
    return np.stack([at[opens], at[closes] + 3], axis=1)


def _numbers(words: Words, first: int, last: int) -> np.ndarray:
    """The words of a stretch as numbers, equal words alike."""
    data = words.data[words.begin[first] : words.end[last - 1]].tobytes()
    low = int(words.begin[first])
    number: dict[bytes, int] = {}
    ends = zip((words.begin[first:last] - low).tolist(), (words.end[first:last] - low).tolist())
    return np.array([number.setdefault(data[b:e], len(number)) for b, e in ends], np.int64)


def _collapsed(text: str, runs: list[tuple[int, int, int]]) -> str:
    """The words joined by blanks, without those behind the first period of a run."""
    words = text.encode().split()  # of bytes: at blanks and tab to carriage return only
    if runs:
        drop = np.zeros(len(words), bool)
        for start, length, period in runs:
            drop[start + period : start + length] = True
        words = [words[i] for i in np.flatnonzero(~drop).tolist()]
    return b" ".join(words).decode()


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, repeats: int = REPEATS) -> DataFrame:
    """(key, n_words, runs, collapsed) of every row: its runs, and the text with every run cut to one period."""
    if repeats < 3:
        raise ValueError("runs of fewer than 3 repeats are not looked for")
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for whole in batches:
            for batch in slices(whole, "text"):
                words = words_of(batch.column("text"))
                runs: list[list[tuple[int, int, int]]] = [[] for _ in range(batch.num_rows)]
                for first, last in stretches(words, least, repeats).tolist():
                    owner = int(np.searchsorted(words.first, first, "right")) - 1
                    shift = first - int(words.first[owner])
                    for start, length, period in runs_of(_numbers(words, first, last), least, repeats):
                        runs[owner].append((start + shift, length, period))
                texts = [_collapsed(t or "", r) for t, r in zip(batch.column("text").to_pylist(), runs)]
                named = [[dict(zip(("start", "length", "period"), r)) for r in of] for of in runs]
                arrays = [batch.column("key"), pa.array(np.diff(words.first), pa.int64()), pa.array(named, runs_type), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, ["key", "n_words", "runs", "collapsed"])

    found = rows.mapInArrow(run, f"key {kind}, n_words bigint, runs {RUNS}, collapsed string")
    return found.withColumnRenamed("key", key)


def most_repeated(runs: Column) -> Column:
    """The run of greatest length / period, compared exactly; the earlier one of equals; null if there is none."""
    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    more = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    return F.aggregate(runs, none, lambda best, r: F.when(more(best, r), r).otherwise(best))
