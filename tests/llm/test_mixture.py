import math

import pytest
from pyspark.sql import functions as F

from counterpoise.llm import mixture

SCHEMA = "doc_id bigint, text string, source string, copies int, row string"


def _docs(spark):
    rows = [(i, "x" * (20 + i % 7), "big" if i % 3 else f"s{i % 4}", 1, "r") for i in range(3_000)]
    rows += [(10_000 + i, "y" * 15, None, 1, "r") for i in range(50)]
    rows += [(None, "z" * 9, "s1", 1, "r"), (7, "same", "s1", 1, "r"), (7, "same", "s1", 1, "r"), (8, None, "none", 1, "r"), (9, "", "none", 1, "r")]
    return spark.createDataFrame(rows, SCHEMA), rows


@pytest.mark.parametrize("rate", [0.0, 0.3, 1.0, 7.5, 900.0])
def test_counts_invert_the_distribution(spark, rate):
    us = [0.0, 1e-9, 0.01, 0.25, 0.5, 0.75, 0.99, 1 - 1e-9]
    found = {r.u: r.n for r in spark.createDataFrame([(u,) for u in us], "u double").select("u", mixture.poisson_count(F.col("u"), F.lit(rate)).alias("n")).collect()}
    for u in us:
        total, k = 0.0, -1
        while rate and total <= u:
            k += 1
            total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
        assert found[u] == max(k, 0)


def test_a_rate_of_a_million(spark):
    n = spark.range(3).select(mixture.poisson_count((F.col("id") + 1) / 4, F.lit(1e6)).alias("n")).collect()
    assert [round((r.n - 1e6) / 1e3, 1) for r in n] == [-0.7, 0.0, 0.7]


def test_counts_follow_the_rates(spark):
    docs, rows = _docs(spark)
    weights = {"big": 0.2, "s1": 0.3, "s2": 0.5}
    rates = mixture.source_rates(docs, weights=weights, budget=60_000)
    table = {r.source: r for r in rates.collect()}
    assert sum(r.rate * r.bytes for r in table.values()) == pytest.approx(60_000)
    assert table["none"].rate == table[None].rate == table["s3"].rate == 0
    out = mixture.mix(docs, rates, carry=docs.columns).collect()
    size = {}
    for r in out:
        size[r.source] = size.get(r.source, 0) + len(r.row.text)
    for name, w in weights.items():
        assert size[name] == pytest.approx(60_000 * w, rel=0.12)
    assert set(size) == set(weights)


def test_copies_and_order(spark):
    docs, rows = _docs(spark)
    rates = mixture.source_rates(docs)
    one = mixture.mix(docs, rates, carry=["text", "copies"]).collect()
    two = mixture.mix(docs.repartition(9), rates, carry=["text", "copies"]).collect()
    assert sorted(map(repr, one)) == sorted(map(repr, two))
    assert sorted(r.position for r in one) == list(range(len(one)))
    by_key = {}
    for r in one:
        by_key.setdefault((r.doc_id, r.row.text), []).append(r)
    for (key, text), copies in by_key.items():
        n = sum(k == key and t == text for k, t, *_ in rows)
        assert sorted(c.copy for c in copies) == sorted(list(range(1, copies[0].copies + 1)) * n)
    first = [r.source for r in sorted(one, key=lambda r: r.position)[: len(one) // 2]]
    assert first.count("big") == pytest.approx(sum(r.source == "big" for r in one) / 2, rel=0.15)


def test_empty_table(spark):
    docs, _ = _docs(spark)
    none = docs.limit(0)
    assert mixture.mix(none, mixture.source_rates(none)).count() == 0
