import hashlib
import json
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from counterpoise.llm import bpe, queries

SCHEMA = "doc_id bigint, text string, ids string, row int"


@pytest.fixture(scope="module")
def data():
    return bpe.model_bytes()


@pytest.fixture(scope="module")
def library(data):
    return Tokenizer.from_str(data.decode())


ALPHABETS = [
    "ab", "a", " ", " \n", "'s're", "don't we'll x", "é日本語 \U0001f600", "0123456789", "!?#'", "abcdefghij klmnop", " \t\n\r 　x", "aA1!'é\n ",
]


def _texts(seed=1, n=120):
    rng = random.Random(seed)
    words = "the of and to in is that it was for on are with as his they be at one have this from or had by".split()
    out = []
    for _ in range(n):
        pick = rng.choice(ALPHABETS)
        size = rng.randint(1, 900)
        kind = rng.randrange(4)
        if kind == 0:
            out.append("".join(rng.choice(pick) for _ in range(size)))
        elif kind == 1:
            out.append(" ".join(rng.choice(words) for _ in range(size)))
        elif kind == 2:
            out.append("".join(rng.choice(words) for _ in range(size)))  # no blanks at all
        else:
            out.append("".join(rng.choice(ALPHABETS) for _ in range(size // 4)))
    return out


SPECIAL = ["", " ", "<|endoftext|>", "x" * 150 + "<|endoftext|>" + " y" * 200, "<|endo" * 60, "<|endoftext|>" * 30, "\x00" * 300, "'" * 400 + "ll" * 100, "''ll" * 120]


@pytest.mark.parametrize("leaf", [64, 100, 400])
def test_trees_agree_with_the_library(data, library, leaf):
    texts = _texts(leaf) + SPECIAL
    codec = bpe.Codec(data, leaf=leaf)
    for text, ids in zip(texts, codec.encode(texts)):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, repr(text[:200])
        assert codec.decode(ids) == library.decode(ids.tolist(), skip_special_tokens=False) == text


def test_very_long_texts(data, library):
    rng = random.Random(5)
    prose = " ".join(_texts(7, 400))
    texts = ["a" * 100_000, "ab" * 70_000, "".join(rng.choice("abcdefgh") for _ in range(200_000)), prose, " " * 50_000 + "x", "é" * 40_001]
    codec = bpe.Codec(data)
    for text, ids in zip(texts, codec.encode(texts)):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_halves_stand_between_characters():
    data = "é日\U0001f600a".encode() * 500
    cut = bpe.halves(data, 64)
    assert cut[0] == 0 and cut[-1] == len(data) and len(cut) > 64
    assert "".join(data[a:b].decode() for a, b in zip(cut[:-1], cut[1:])).encode() == data


def test_any_ids_decode_as_the_library_does(data, library):
    rng = np.random.default_rng(3)
    codec = bpe.Codec(data)
    for _ in range(200):
        ids = rng.integers(0, 50_257, 30)
        assert codec.decode(ids) == library.decode(ids.tolist(), skip_special_tokens=False)
    assert codec.decode(np.array([-1, 60_000])) == ""


def test_other_tokenizers_are_refused(data):
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "Whitespace"}}):
        with pytest.raises(ValueError):
            bpe.Codec(json.dumps(json.loads(data) | change).encode())


def test_tables(spark, data, library):
    rows = [(1, "one two", "z", 2), (1, "one two", "z", 2), (None, None, "z", 2), (3, "", "z", 2), (4, "ab" * 40_000, "z", 2)]
    docs = spark.createDataFrame(rows, SCHEMA)
    coded = bpe.encode(docs, data)
    assert coded.columns == ["doc_id", "text", "row", "ids"]
    back = bpe.decode(coded, data, text="row")
    assert back.columns == ["doc_id", "text", "ids", "row"]
    assert all(r.row == r.text and (r.ids is None) == (r.text is None) for r in back.collect())
    found = bpe.verify(docs, data)
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"]
    assert sorted((r.doc_id or 0, r.n_tokens) for r in found.collect()) == sorted((k or 0, len(library.encode(t or "").ids)) for k, t, *_ in rows)
    for f in (bpe.encode, bpe.verify):
        assert f(docs.limit(0), data).count() == 0
    assert bpe.decode(coded.limit(0), data).count() == 0


def test_the_query(spark, sf, library):
    found = {r.doc_id: r for r in queries.op11_byte_bpe(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        got = found[r.doc_id]
        assert (got.n_tokens, got.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert got.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
