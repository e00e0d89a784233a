import struct

import pyarrow as pa
import pytest
import sentencepiece

from counterpoise.llm import pieces

TEXTS = [
    "",
    " ",
    "   ",
    " a  b\n\tc ",
    "<s> x </s> <0x41> ▁",
    "aaaaaaa aaaa a",
    "日本\x00語 \U0001f600",
    "a▁b",
    "The committee met in the large hall, and then the members spoke.",
    "word " * 30_000,
]


def _field(number, kind, body):
    return bytes([number << 3 | kind]) + body


def _size(n):
    out = b""
    while n > 0x7F:
        out += bytes([n & 0x7F | 0x80])
        n >>= 7
    return out + bytes([n])


def _message(number, body):
    tag = number << 3 | 2
    return _size(tag) + _size(len(body)) + body


def small_model(kind, squeeze=True, byte_fallback=True):
    """A model file made by hand: nothing is trained."""
    rows = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    rows += [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)] if byte_fallback else []
    words = ["▁", "a", "b", "c", "ab", "bc", "▁a", "▁ab", "abc", "▁b", "cc"]
    rows += [(w, -1.0 - 0.37 * i, 1) for i, w in enumerate(words)]
    out = b""
    for piece, score, sort in rows:
        body = _message(1, piece.encode()) + _field(2, 5, struct.pack("<f", score)) + _field(3, 0, bytes([sort]))
        out += _message(1, body)
    trainer = _field(3, 0, bytes([kind])) + _size(35 << 3) + bytes([int(byte_fallback)])
    rules = _message(1, b"identity") + _field(3, 0, b"\1") + _field(4, 0, bytes([int(squeeze)])) + _field(5, 0, b"\1")
    return out + _message(2, trainer) + _message(3, rules)


def test_public_model_agrees_with_the_original():
    data = pieces.model_bytes()
    original = sentencepiece.SentencePieceProcessor(model_proto=data)
    codec = pieces.Codec(data, 1)
    assert codec.model.cuts_at_markers
    ids, first, good = codec.run(pa.array(TEXTS + [None]))
    for i, text in enumerate(TEXTS):
        assert ids[first[i] : first[i + 1]].tolist() == original.encode(text) == codec.encode([text])[0]
        assert codec.decode([original.encode(text)])[0] == original.decode(original.encode(text))
    assert good[:, 0].all() and first[-1] == first[-2]
    assert [bool(g) for g in good[:, 1]] == ["▁" not in t for t in TEXTS] + [True]


@pytest.mark.parametrize("kind", [pieces.UNIGRAM, pieces.BPE])
@pytest.mark.parametrize("squeeze", [False, True])
@pytest.mark.parametrize("byte_fallback", [False, True])
def test_hand_made_models(kind, squeeze, byte_fallback):
    data = small_model(kind, squeeze, byte_fallback)
    original = sentencepiece.SentencePieceProcessor(model_proto=data)
    codec = pieces.Codec(data, 1)
    texts = ["abc ab", "a  bcc", "", "xabc", "cab bac ccc", "ab ab ab"]
    ids, first, good = codec.run(pa.array(texts))
    for i, text in enumerate(texts):
        assert ids[first[i] : first[i + 1]].tolist() == original.encode(text), text
    assert good[:, 0].all()


def test_unsupported_pieces_are_refused():
    data = pieces.model_bytes()
    odd = data + _message(1, _message(1, b"x") + _field(3, 0, b"\4"))
    with pytest.raises(ValueError):
        pieces.parse_model(odd)


def test_frames(spark):
    data = pieces.model_bytes()
    docs = spark.createDataFrame([(i, t, "x", i) for i, t in enumerate(TEXTS)] + [(None, None, "x", 0)] * 2, "doc_id bigint, text string, ids string, row int")
    original = sentencepiece.SentencePieceProcessor(model_proto=data)
    coded = pieces.encode(docs, data)
    assert coded.columns == ["doc_id", "text", "row", "ids"]
    rows = pieces.decode(coded, data).collect()
    for r in rows:
        assert r.ids == (None if r.text is None else original.encode(r.text))
        assert r.decoded == (None if r.text is None else r.text.replace("▁", " "))
    seen = pieces.verify(docs, data).collect()
    assert len(seen) == len(rows) and all(r.parity for r in seen)
    assert {r.doc_id: r.n_tokens for r in seen}[None] == 0
    assert pieces.verify(docs.limit(0), data).count() == 0
