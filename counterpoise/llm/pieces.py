"""SentencePiece models run by the tokenizers library, checked against the original.

The model file is a protobuf message; its few fields are read here from the wire
format: pieces with scores and kinds, the trainer's model type and byte
fallback, and the normaliser. From them the same tokenizer is rebuilt:
character map, dummy prefix and the marker that stands for a blank, byte
fallback, and either unigram scores or BPE merges ordered by score.

Texts are encoded in Arrow batches. If no piece of a BPE model has the marker
behind another character, a merge never crosses the start of a marker run, so a
text's ids are those of its parts cut there, one after the other; then only the
distinct parts of a batch are encoded, decoded and verified. Otherwise whole
texts are. The model's bytes (of a bounded vocabulary) are broadcast.

Defined results: a null text has null ids and 0 tokens; an empty text has no
ids; repeated rows get equal results; texts are never cut short; other columns
are not touched; piece kinds that the rebuilt tokenizer cannot match
(user-defined, unused) raise an error when the model is loaded.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from counterpoise.llm.common import lean
from counterpoise.llm.words import slices

# The marker for a blank, kinds of pieces and of models in the file format.
MARKER = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
THREADS = 2
BATCH_BYTES = 8 << 20
CHUNK = 4_096


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of each field of a protobuf message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 0x7F) << shift
            at += 1
            shift += 7
            if byte < 0x80:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            size, at = varint(at)
            value, at = data[at : at + size], at + size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"not a model file: wire type {kind}")
        yield tag >> 3, value


@dataclass(frozen=True)
class Model:
    """What the file says, with the format's defaults where it says nothing."""

    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze_blanks: bool = True
    escape_blanks: bool = True
    marker_behind: bool = False

    @property
    def unknown(self) -> int:
        return self.kinds.index(UNKNOWN)

    @property
    def cuts_at_markers(self) -> bool:
        """Whether encoding a text is encoding its parts between marker runs."""
        plain = self.model_type == BPE and not self.charsmap and self.dummy_prefix and self.escape_blanks
        if not plain or self.squeeze_blanks or self.marker_behind:
            return False
        return not any(MARKER in piece.lstrip(MARKER) for piece in self.pieces)


def parse_model(data: bytes) -> Model:
    """Reads the protobuf message of a SentencePiece model."""
    pieces, scores, kinds, more = [], [], [], {}
    for number, value in _fields(data):
        if number == 1:
            piece = {1: b"", 2: b"\0\0\0\0", 3: NORMAL} | dict(_fields(value))
            pieces.append(piece[1].decode())
            scores.append(struct.unpack("<f", piece[2])[0])
            kinds.append(piece[3])
        elif number == 2:
            trainer = dict(_fields(value))
            more["model_type"] = trainer.get(3, UNIGRAM)
            more["byte_fallback"] = bool(trainer.get(35, 0))
            more["marker_behind"] = bool(trainer.get(24, 0))
        elif number == 3:
            rules = dict(_fields(value))
            more["charsmap"] = rules.get(2, b"")
            more["dummy_prefix"] = bool(rules.get(3, 1))
            more["squeeze_blanks"] = bool(rules.get(4, 1))
            more["escape_blanks"] = bool(rules.get(5, 1))
    model = Model(pieces, scores, kinds, **more)
    if model.model_type not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models are read")
    if model.marker_behind or not model.escape_blanks:
        raise ValueError("the blank has to be escaped, in front of words")
    if USER_DEFINED in kinds or UNUSED in kinds:
        raise ValueError("user-defined and unused pieces are not supported")
    return model


def _merges(model: Model) -> list[tuple[str, str]]:
    """Every way to put a piece together from two pieces, best scores first."""
    usable = {p for p, kind in zip(model.pieces, model.kinds) if kind == NORMAL}
    found = []
    for i, piece in enumerate(model.pieces):
        if model.kinds[i] == NORMAL:
            for k in range(1, len(piece)):
                if piece[:k] in usable and piece[k:] in usable:
                    found.append((-model.scores[i], i, piece[:k], piece[k:]))
    return [(left, right) for _, _, left, right in sorted(found, key=lambda m: m[:2])]


def build_tokenizer(model: Model, whole_texts: bool = True):
    """The tokenizers-library twin of the model.

    ``whole_texts=False`` leaves out the dummy prefix and its removal: for parts
    that begin with their own blank.
    """
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    if model.model_type == BPE:
        vocabulary = {p: i for i, p in enumerate(model.pieces)}
        core = models.BPE(
            vocab=vocabulary,
            merges=_merges(model),
            unk_token=model.pieces[model.unknown],
            fuse_unk=True,
            byte_fallback=model.byte_fallback,
        )
    else:
        # control and byte pieces are no part of a text; they stay for their ids only
        low = min((s for s, k in zip(model.scores, model.kinds) if k == NORMAL), default=0.0) - 1_000
        scored = [(p, s if k == NORMAL else low) for p, s, k in zip(model.pieces, model.scores, model.kinds)]
        core = models.Unigram(scored, unk_id=model.unknown, byte_fallback=model.byte_fallback)
    tokenizer = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.squeeze_blanks:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix and whole_texts:
        steps.append(normalizers.Prepend(MARKER))
    steps.append(normalizers.Replace(" ", MARKER))
    tokenizer.normalizer = normalizers.Sequence(steps)
    back = [decoders.Replace(MARKER, " "), decoders.ByteFallback(), decoders.Fuse()]
    if model.dummy_prefix and whole_texts:
        back.append(decoders.Strip(" ", 1, 0))
    tokenizer.decoder = decoders.Sequence(back)
    return tokenizer


class Codec:
    """Encodes, decodes and verifies batches in one worker."""

    def __init__(self, data: bytes, threads: int = THREADS):
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ["RAYON_NUM_THREADS"] = str(threads)  # read when the pool is made, at first use
        self.data = data
        self.model = parse_model(data)
        self.threads = threads
        self.byte_piece = np.array([k == BYTE for k in self.model.kinds])

    @cached_property
    def original(self):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_proto=self.data)

    @cached_property
    def whole(self):
        return build_tokenizer(self.model)

    @cached_property
    def part(self):
        return build_tokenizer(self.model, whole_texts=False)

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of whole texts."""
        held = self.whole.encode_batch_fast([t for t in texts if t], add_special_tokens=False)
        found = iter(held)
        return [next(found).ids if t else [] for t in texts]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.whole.decode_batch(ids, skip_special_tokens=False)

    def _parts(self, parts: pa.Array, check: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all parts, their numbers, if to be checked whether the original agrees and the text comes back).

        Parts begin with a blank. A chunk at a time, as the library's results
        are far larger than the ids.
        """
        ids, sizes, good = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros((0, 2), bool)]
        blank = [self.model.pieces.index(MARKER)] if MARKER in self.model.pieces else None
        for start in range(0, len(parts), CHUNK):
            texts = [b.decode() for b in parts.slice(start, CHUNK).to_pylist()]
            ours = [e.ids for e in self.part.encode_batch_fast(texts, add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, ours), np.int64, len(ours)))
            ids.append(np.fromiter((i for x in ours for i in x), np.int32, int(sizes[-1].sum())))
            if not check:
                good.append(np.ones((len(ours), 2), bool))
                continue
            # the original puts the blank in front itself; alone it would get none for an empty text
            theirs = self.original.encode([t[1:] for t in texts], num_threads=self.threads)
            back = self.part.decode_batch(ours, skip_special_tokens=False)
            agree = [(a == b or (t == " " and a == blank), d == t) for a, b, d, t in zip(ours, theirs, back, texts)]
            good.append(np.array(agree, bool))
        return np.concatenate(ids), np.concatenate(sizes), np.concatenate(good)

    def run(self, texts: pa.Array, check: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's begin, if to be checked (parity, round trip) of each text)."""
        filled = texts.cast(pa.large_string()).fill_null("")
        if not self.model.cuts_at_markers:
            plain = filled.to_pylist()
            ids = self.encode(plain)
            good = np.ones((len(ids), 2), bool)
            if check:
                theirs = self.original.encode(plain, num_threads=self.threads)
                back = self.decode(ids)
                wanted = self.original.decode(theirs)
                good = np.array([(a == b, c == d) for a, b, c, d in zip(ids, theirs, back, wanted)], bool)
            first = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
            return np.array([i for x in ids for i in x], np.int32), first, good.reshape(-1, 2)
        return self._run_parts(filled, check)

    def _run_parts(self, texts: pa.Array, check: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        # the marker itself in a text is read as a blank
        plain = pc.replace_substring(texts, MARKER, " ")
        blank, none = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
        marked = pc.if_else(pc.equal(plain, none), none, pc.binary_join_element_wise(blank, plain, none))
        at = np.frombuffer(marked.buffers()[1], np.int64)[marked.offset : marked.offset + len(marked) + 1]
        low, high = int(at[0]), int(at[-1])
        data = np.frombuffer(marked.buffers()[2], np.uint8)[low:high] if high > low else np.zeros(0, np.uint8)
        at = at - low
        is_blank = data == 0x20
        opens = is_blank.copy()
        opens[1:] &= ~is_blank[:-1]
        opens[at[:-1][at[:-1] < len(data)]] = True
        cut = np.append(np.flatnonzero(opens), len(data)).astype(np.int64)
        parts = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(cut) - 1, [None, pa.py_buffer(cut), pa.py_buffer(np.ascontiguousarray(data))]
        ).dictionary_encode()
        flat, sizes, good = self._parts(parts.dictionary, check)
        begin = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        index = parts.indices.to_numpy()
        length = sizes[index]
        first_id = np.concatenate([[0], np.cumsum(length)])
        # position of every id of every part in the table of distinct parts
        source = np.repeat(begin[index] - first_id[:-1], length)
        source += np.arange(first_id[-1])
        part_of = np.searchsorted(cut[:-1], at)
        agree = np.ones((len(texts), 2), bool)
        wrong = np.flatnonzero(~good.all(axis=1)[index])
        if len(wrong):
            owner = np.searchsorted(part_of, wrong, "right") - 1
            np.logical_and.at(agree, owner, good[index[wrong]])
        changed = pc.match_substring(texts, MARKER).to_numpy(zero_copy_only=False).astype(bool)
        agree[changed, 1] = False  # a marker comes back as a blank
        return flat[source], first_id[part_of], agree


@lru_cache(maxsize=2)
def _codec(data: bytes, threads: int) -> Codec:
    return Codec(data, threads)


def model_bytes(path: str | None = None) -> bytes:
    """The model file; by default the public BPE model with byte fallback."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as file:
        return file.read()


def encode(docs: DataFrame, data: bytes, text: str = "text", ids: str = "ids", threads: int = THREADS) -> DataFrame:
    """``docs`` with the column ``ids`` (array of int) in place of any column of that name."""
    kept = [F.col(f"`{c}`") for c in docs.columns if c != ids]
    rows = docs.select(F.struct(*kept).alias("row"), F.col(f"`{text}`").alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(sent.value, threads)
        for whole in batches:
            for batch in slices(whole, "text", BATCH_BYTES // 4):
                texts = batch.column("text")
                found, first, _ = codec.run(texts, check=False)
                lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(found, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("row"), pc.if_else(texts.is_valid(), lists, None)], ["row", "ids"])

    done = rows.mapInArrow(lean(run), rows.select("row").schema.add("ids", T.ArrayType(T.IntegerType())))
    return done.select("row.*", F.col("ids").alias(ids))


def decode(df: DataFrame, data: bytes, ids: str = "ids", text: str = "decoded", threads: int = THREADS) -> DataFrame:
    """``df`` with the texts of its ids; null ids give a null text."""
    sent = df.sparkSession.sparkContext.broadcast(data)

    @F.pandas_udf("string")
    def run(column):
        codec = _codec(sent.value, threads)
        texts = codec.decode([[] if x is None else [int(i) for i in x] for x in column])
        return pd.Series([None if x is None else t for x, t in zip(column, texts)], index=column.index)

    return df.withColumn(text, run(F.col(f"`{ids}`")))


def verify(docs: DataFrame, data: bytes, key: str = "doc_id", text: str = "text", threads: int = THREADS) -> DataFrame:
    """(key, n_chars, n_tokens, n_byte_tokens, ids_crc32, parity, round_trip) of every row.

    ``ids_crc32`` is the checksum of the ids as little-endian 32-bit numbers.
    ``parity``: the original library gives the same ids. ``round_trip``:
    decoding gives the text back.
    """
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(data)
    names = ["key", "n_chars", "n_tokens", "n_byte_tokens", "ids_crc32", "parity", "round_trip"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(sent.value, threads)
        for whole in batches:
            for batch in slices(whole, "text", BATCH_BYTES):
                texts = batch.column("text")
                ids, first, good = codec.run(texts)
                in_bytes = np.flatnonzero(codec.byte_piece[ids])
                crc = [zlib.crc32(ids[a:b].astype("<i4").tobytes()) for a, b in zip(first[:-1], first[1:])]
                arrays = [
                    batch.column("key"),
                    pc.utf8_length(texts.fill_null("")).cast(pa.int64()),
                    pa.array(np.diff(first)),
                    pa.array(np.diff(np.searchsorted(in_bytes, first))),
                    pa.array(crc, pa.int64()),
                    pa.array(good[:, 0]),
                    pa.array(good[:, 1]),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names)

    counts = ", ".join(f"{n} bigint" for n in names[1:5])
    out = rows.mapInArrow(lean(run), f"key {kind}, {counts}, parity boolean, round_trip boolean")
    return out.withColumnRenamed("key", key)
