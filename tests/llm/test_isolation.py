import collections
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Row

from counterpoise.llm import isolation
from counterpoise.llm.words import slices, windows_of, words_of

WORD = "[^\x20\x09-\x0d]+"
TEXTS = [
    "",
    None,
    "one",
    "a b c d e a b c d e f",
    "Line one\nLine one\n\n \nLine one \n",
    "été à la plage | # $$$ <b> x y\x1cz",
    "und " * 3000,
    "x" * 3_000_000 + " y",
    "\t\n",
    "same words here again and then same words here again and then",
]


def brute(text):
    text = text or ""
    words = re.findall(WORD, text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = collections.Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(5)}
    lines = [line for line in text.split("\n") if re.search(WORD, line)]
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return [len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)]


def test_counts_match_brute_force():
    counts, ratios = isolation.text_statistics(pa.array(TEXTS))
    assert [[int(counts[c][i]) for c in isolation.COUNTS] for i in range(len(TEXTS))] == [brute(t) for t in TEXTS]
    assert np.isfinite(ratios).all()


def test_words_do_not_depend_on_what_stands_before():
    texts = ["alpha beta", "xx alpha beta", "ALPHA beta", "z" * 2_000_000 + " alpha beta"]
    w = words_of(pa.array(texts))
    alpha, beta = w.hashes[0], w.hashes[1]
    assert list(w.hashes[2:]) [1:3] == [alpha, beta]
    assert w.hashes[5] != alpha and words_of(pa.array(texts), lower=True).hashes[5] == alpha
    assert list(w.hashes[-2:]) == [alpha, beta]
    pairs, first = windows_of(w, 2)
    assert list(np.diff(first)) == [1, 2, 1, 2] and pairs[0] == pairs[2]


def test_slices_cover_all_rows():
    batch = pa.RecordBatch.from_pydict({"t": TEXTS, "i": list(range(len(TEXTS)))})
    assert [i for b in slices(batch, "t", 100) for i in b.column(1).to_pylist()] == list(range(len(TEXTS)))


def _docs(spark):
    plain = [Row(doc_id=i, text=" ".join(f"word{(i * 7 + k * k) % 997}" for k in range(60)), kept="x", _key=1) for i in range(400)]
    odd = [Row(doc_id=1000 + i, text=" ".join(f"W{i}{k}$$$" for k in range(60)), kept="x", _key=1) for i in range(12)]
    return spark.createDataFrame(plain + odd)


def test_forest_finds_the_odd_ones(spark):
    docs = _docs(spark)
    labels = docs.selectExpr("doc_id", "int(doc_id < 1000) AS quality", "1 AS text")
    model = isolation.fit(docs, labels)
    rows = {r.doc_id: r for r in isolation.judge(docs, model).collect()}
    assert len(rows) == 412 and not any(r.base_failed for r in rows.values())
    assert not any(r.kept for i, r in rows.items() if i >= 1000)
    assert sum(r.kept for i, r in rows.items() if i < 1000) >= 398
    again = isolation.fit(docs.repartition(7), labels)
    assert again.threshold == model.threshold
    kept = isolation.keep_good(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in rows.items() if r.kept}


def test_threshold_comes_from_all_labels(spark):
    """The share of good rows that goes is kept over all labelled rows, not over those the trees were drawn from."""
    docs = _docs(spark)
    labels = docs.selectExpr("doc_id", "int(doc_id < 1000) AS quality")
    for max_false in (0.005, 0.05, 0.3):
        model = isolation.fit(docs, labels, sample_rows=60, max_false=max_false)
        rows = isolation.judge(docs, model).filter("doc_id < 1000").collect()
        scores = sorted((r.score for r in rows), reverse=True)
        assert model.threshold == scores[int(max_false * 400)]


def test_nulls_repeats_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "a b c d e f g h i j")], "doc_id bigint, text string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    model = isolation.fit(docs, labels)
    assert model.forest is None
    rows = isolation.judge(docs, model).orderBy("doc_id").collect()
    assert [r.kept for r in rows] == [False, False, False, True]
    assert isolation.judge(docs.limit(0), model).count() == 0
    assert isolation.keep_good(docs.limit(0), model).count() == 0
