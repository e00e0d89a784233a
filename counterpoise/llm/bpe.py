"""Byte-level BPE encoding and decoding by tree concatenation.

Long text is halved again and again, at any character, down to leaves of a
bounded size. The tokenizers library encodes the leaves of a batch in parallel;
neighbours are then concatenated up the tree. Around each join a window of a few
tokens of either side is encoded anew, and grows until its tokens agree with
those of both sides; the window's tokens stand between the places of agreement.

Why that is exact. Byte-level BPE first cuts a text into words by a pattern that
is matched from left to right and looks at most two characters beyond a match,
then merges bytes inside each word.

* Inside a word, a sequence of tokens is the encoding of its bytes exactly if
  every two neighbours encode to themselves: the first merge across a border
  would depend on these two alone. Neighbours in an encoding of any longer text
  have that property, so two encodings may be exchanged at a token they share.
* Two scans of the pattern that share the start of a word go on alike. Inside a
  word they have to be inside the same run of letters, digits, other signs or
  blanks; after four characters that hold the same tokens and the same starts of
  words they are, as the pattern's fixed alternatives (contractions) are shorter.

So agreement means: tokens equal in place, id and in whether they open a word,
over ``MARGIN`` bytes, and ``MARGIN`` bytes away from the end of the text that was
cut there. A window that has reached the beginning of its left side, or the end
of its right side, needs no agreement there.

Added tokens of the tokenizer (such as an end-of-text mark written in a text) are
found first, as the library does, and text is halved only between them.

Defined results: a null text counts as empty where a result must not be null
(``verify``), and gives null ids in ``encode``; an empty text has no ids; repeated
rows give equal rows, an empty table an empty one, null keys are kept; very long
texts, with or without blanks, are encoded whole, in memory proportional to the
text; columns other than the named ones are not touched. Ids outside the
vocabulary decode to nothing, null lists to null.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from counterpoise.llm.words import slices

LEAF = 8_192
WINDOW = 24
MARGIN = 16
THREADS = 2
CHUNK = 256
BATCH_BYTES = 4 << 20


class Tokens(NamedTuple):
    """Encoded text: ids, the byte each token begins at (and the end), and whether it opens a word."""

    ids: np.ndarray
    at: np.ndarray
    opens: np.ndarray

    def part(self, first: int, last: int) -> Tokens:
        return Tokens(self.ids[first:last], self.at[first : last + 1], self.opens[first:last])


def _joined(parts: list[Tokens]) -> Tokens:
    ends = [p.at[:-1] for p in parts[:-1]] + [parts[-1].at]
    return Tokens(np.concatenate([p.ids for p in parts]), np.concatenate(ends), np.concatenate([p.opens for p in parts]))


def halves(data: bytes, leaf: int) -> list[int]:
    """Borders of the leaves: ``data`` halved until no part is longer than ``leaf``, between characters."""
    depth = 0
    while len(data) > leaf << depth:
        depth += 1
    borders = [len(data) * k >> depth for k in range((1 << depth) + 1)]
    for k, at in enumerate(borders):
        while at < len(data) and data[at] & 0xC0 == 0x80:
            at += 1
        borders[k] = at
    return borders


def agreement(side: Tokens, window: Tokens, low: int, high: int) -> tuple[int, int] | None:
    """(token of the side, token of the window) at the first place from which both agree for ``MARGIN`` bytes within [low, high]."""
    _, i, j = np.intersect1d(side.at[:-1], window.at[:-1], assume_unique=True, return_indices=True)
    same = (side.ids[i] == window.ids[j]) & (side.opens[i] == window.opens[j]) & (side.at[i + 1] == window.at[j + 1])
    same &= (side.at[i] >= low) & (side.at[i + 1] <= high)
    i, j = i[same], j[same]
    if len(i) == 0:
        return None
    begin, end = side.at[i], side.at[i + 1]
    opens = np.append(True, begin[1:] != end[:-1])  # stretches of neighbouring tokens
    first = np.flatnonzero(opens)
    last = np.append(first[1:], len(i)) - 1
    enough = np.flatnonzero(end[last] - begin[first] >= MARGIN)
    if len(enough) == 0:
        return None
    return int(i[first[enough[0]]]), int(j[first[enough[0]]])


@dataclass
class Join:
    """Two neighbouring parts of a text, and the window of tokens around their border."""

    data: bytes
    left: Tokens
    right: Tokens
    first: int = 0  # the window's first token in left, and the last + 1 in right
    last: int = 0
    step: int = WINDOW

    def __post_init__(self) -> None:
        self.first, self.last = len(self.left.ids), 0
        self.grow(True, True)

    def grow(self, leftward: bool, rightward: bool) -> None:
        """More tokens on the sides that do not agree yet, to the next border of a character."""
        if leftward:
            self.first = max(0, self.first - self.step)
            while self.first and self._inside(self.left.at[self.first]):
                self.first -= 1
        if rightward:
            self.last = min(len(self.right.ids), self.last + self.step)
            while self.last < len(self.right.ids) and self._inside(self.right.at[self.last]):
                self.last += 1
        self.step *= 2

    def _inside(self, at: int) -> bool:
        return self.data[at] & 0xC0 == 0x80

    @property
    def span(self) -> tuple[int, int]:
        return int(self.left.at[self.first]), int(self.right.at[self.last])

    def settle(self, window: Tokens) -> Tokens | None:
        """The tokens of both parts, or nothing, after which the window has grown."""
        low, high = self.span
        border = int(self.left.at[-1])
        head, tail = (0, 0), (len(self.right.ids), len(window.ids))
        if self.first:
            near = self.left.part(self.first, len(self.left.ids))
            head = agreement(near, window, low, border - MARGIN)
        if self.last < len(self.right.ids):
            tail = agreement(self.right.part(0, self.last), window, border, high - MARGIN)
        if head is None or tail is None:
            self.grow(head is None, tail is None)
            return None
        kept = self.left.part(0, self.first + head[0]) if self.first else self.left.part(0, 0)
        middle = window.part(head[1], tail[1])
        return _joined([kept, middle, self.right.part(tail[0], len(self.right.ids))])


def _byte_of_sign() -> dict[str, int]:
    """The sign that stands for each byte in byte-level vocabularies: itself if printable, else from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in plain}
    rest = [b for b in range(256) if chr(b) not in out]
    return out | {chr(256 + k): b for k, b in enumerate(rest)}


class Codec:
    """Encodes and decodes batches in one worker."""

    def __init__(self, data: bytes, leaf: int = LEAF, threads: int = THREADS):
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ["RAYON_NUM_THREADS"] = str(threads)  # read when the pool is made, at first use
        from tokenizers import Tokenizer

        self.leaf = max(leaf, 4 * MARGIN)
        spec = json.loads(data)
        self._require(spec)
        self.library = Tokenizer.from_str(data.decode())
        self.library.no_truncation()
        self.library.no_padding()
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.added = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None
        signs = _byte_of_sign()
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.pieces = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for token, number in vocabulary.items():
            plain = token not in added and all(c in signs for c in token)
            self.pieces[number] = bytes(signs[c] for c in token) if plain else token.encode()
        self.width = np.array([len(p) for p in self.pieces], np.int64)
        self.numbers = [str(i) for i in range(len(self.pieces))]

    @staticmethod
    def _require(spec: dict) -> None:
        """Raises unless the tokenizer is plain byte-level BPE."""
        cut, model = spec.get("pre_tokenizer") or {}, spec["model"]
        odd = {
            "normalizer": spec.get("normalizer"),
            "pre_tokenizer": cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True),
            "decoder": (spec.get("decoder") or {}).get("type") != "ByteLevel",
            "model": model.get("type") != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"),
            "added_tokens": any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]),
        }
        if wrong := [name for name, found in odd.items() if found]:
            raise ValueError(f"not plain byte-level BPE: {', '.join(wrong)}")

    def _tokens(self, texts: list[str], begins: list[int]) -> list[Tokens]:
        """Each text (without added tokens) by itself; ``begins`` is the byte it stands at."""
        out = []
        for start in range(0, len(texts), CHUNK):
            found = self.library.encode_batch(texts[start : start + CHUNK], add_special_tokens=False)
            for e, begin in zip(found, begins[start : start + CHUNK]):
                ids, word = np.array(e.ids, np.int32), np.array(e.word_ids, np.int64)
                at = begin + np.concatenate([[0], np.cumsum(self.width[ids])])
                out.append(Tokens(ids, at, np.append(True, word[1:] != word[:-1])[: len(ids)]))
        return out

    def trees(self, parts: list[str]) -> list[np.ndarray]:
        """Ids of long parts without added tokens, all joins of a level in one batch."""
        data = [p.encode() for p in parts]
        borders = [halves(d, self.leaf) for d in data]
        spans = [(k, a, b) for k, cut in enumerate(borders) for a, b in zip(cut[:-1], cut[1:])]
        leaves = iter(self._tokens([data[k][a:b].decode() for k, a, b in spans], [a for _, a, _ in spans]))
        level = [[next(leaves) for _ in cut[1:]] for cut in borders]
        while any(len(nodes) > 1 for nodes in level):
            joins = {(k, i): Join(data[k], nodes[i], nodes[i + 1]) for k, nodes in enumerate(level) for i in range(0, len(nodes) - 1, 2)}
            done: dict[tuple[int, int], Tokens] = {}
            while joins:
                where = [(k, *join.span) for (k, _), join in joins.items()]
                windows = self._tokens([data[k][a:b].decode() for k, a, b in where], [a for _, a, _ in where])
                settled = {name: join.settle(window) for (name, join), window in zip(joins.items(), windows)}
                done |= {name: tokens for name, tokens in settled.items() if tokens is not None}
                joins = {name: join for name, join in joins.items() if settled[name] is None}
            level = [[done.get((k, i), nodes[i]) for i in range(0, len(nodes), 2)] for k, nodes in enumerate(level)]
        return [nodes[0].ids for nodes in level]

    def _fits(self, text: str) -> bool:
        """Whether a text is a leaf; most characters have one byte, none more than four."""
        return 4 * len(text) <= self.leaf or (len(text) <= self.leaf and len(text.encode()) <= self.leaf)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts, short ones as they are and long ones by trees."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        plain, slots, long, long_slots = [], [], [], []
        for k, text in enumerate(texts):
            parts = [text] if self._fits(text) or self.added is None else self.added.split(text)
            for part in filter(None, parts):
                fits = self._fits(part)
                (plain if fits else long).append(part)
                (slots if fits else long_slots).append((k, len(out[k])))
                out[k].append(np.zeros(0, np.int32))
        for start in range(0, len(plain), CHUNK):
            for (k, i), e in zip(slots[start:], self.library.encode_batch_fast(plain[start : start + CHUNK], add_special_tokens=False)):
                out[k][i] = np.array(e.ids, np.int32)
        for (k, i), ids in zip(long_slots, self.trees(long)):
            out[k][i] = ids
        return [np.concatenate([np.zeros(0, np.int32), *of]) for of in out]

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids; bytes that are no UTF-8 become replacement characters."""
        known = ids[(ids >= 0) & (ids < len(self.pieces))]
        return b"".join(map(self.pieces.__getitem__, known.tolist())).decode("utf-8", "replace")

    def listed(self, ids: np.ndarray) -> str:
        """The ids as decimal numbers joined by commas."""
        return ",".join(map(self.numbers.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def _codec(data: bytes, leaf: int, threads: int) -> Codec:
    return Codec(data, leaf, threads)


def model_bytes(path: str | None = None) -> bytes:
    """The tokenizer's file; by default the public byte-level vocabulary of 50,257 ids."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, "rb") as file:
        return file.read()


def encode(docs: DataFrame, data: bytes, text: str = "text", ids: str = "ids", leaf: int = LEAF, threads: int = THREADS) -> DataFrame:
    """``docs`` with the column ``ids`` (array of int) in place of any column of that name."""
    kept = [F.col(f"`{c}`") for c in docs.columns if c != ids]
    rows = docs.select(F.struct(*kept).alias("row"), F.col(f"`{text}`").alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(data)  # a vocabulary file, of bounded size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(sent.value, leaf, threads)
        for whole in batches:
            for batch in slices(whole, "text", BATCH_BYTES // 4):
                texts = batch.column("text").to_pylist()
                found = codec.encode([t or "" for t in texts])
                lists = pa.array([None if t is None else x for t, x in zip(texts, found)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("row"), lists], ["row", "ids"])

    done = rows.mapInArrow(run, rows.select("row").schema.add("ids", T.ArrayType(T.IntegerType())))
    return done.select("row.*", F.col("ids").alias(ids))


def decode(df: DataFrame, data: bytes, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with the texts of its ids in the column ``text``."""
    kept = [F.col(f"`{c}`") for c in df.columns if c != text]
    rows = df.select(F.struct(*kept).alias("row"), F.col(f"`{ids}`").cast("array<int>").alias("ids"))
    sent = df.sparkSession.sparkContext.broadcast(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(sent.value, LEAF, THREADS)
        for batch in batches:
            lists = batch.column("ids").to_pylist()
            texts = [None if x is None else codec.decode(np.array([-1 if i is None else i for i in x], np.int64)) for x in lists]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], ["row", "text"])

    done = rows.mapInArrow(run, rows.select("row").schema.add("text", T.StringType()))
    return done.select("row.*", F.col("text").alias(text))


def verify(docs: DataFrame, data: bytes, key: str = "doc_id", text: str = "text", leaf: int = LEAF, threads: int = THREADS) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256, round_trip) of every row, encoded and decoded in one pass."""
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(data)
    names = ["key", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(sent.value, leaf, threads)
        for whole in batches:
            for batch in slices(whole, "text", BATCH_BYTES):
                texts = [t or "" for t in batch.column("text").to_pylist()]
                n, numbers, back, same = [], [], [], []
                for t, ids in zip(texts, codec.encode(texts)):
                    text_again = codec.decode(ids)
                    n.append(len(ids))
                    numbers.append(hashlib.sha256(codec.listed(ids).encode()).hexdigest())
                    back.append(hashlib.sha256(text_again.encode()).hexdigest())
                    same.append(text_again == t)
                columns = [pa.array(n, pa.int64()), pa.array(numbers, pa.string()), pa.array(back, pa.string()), pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays([batch.column("key"), *columns], names)

    out = rows.mapInArrow(run, f"key {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, round_trip boolean")
    return out.withColumnRenamed("key", key)
