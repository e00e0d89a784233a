import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from counterpoise.llm import negatives

SCHEMA = "vec_id bigint, embedding array<float>, label int, row string, block int"


def _rows(seed=1, hot=False):
    rng = random.Random(seed)
    rows = [(i, [rng.choice([0.0, rng.uniform(0, 1), rng.uniform(-1, 1)]) for _ in range(20)], 1 if hot and i % 3 else rng.randrange(5), "r", 1) for i in range(400)]
    rows += [(400 + i, [0.5] * 20, i % 2, "r", 1) for i in range(40)]  # ties
    rows += [(900, [1.0, None], 1, "r", 1), (1000, [math.nan] * 20, 1, "r", 1), (1100, None, 1, "r", 1), (1200, [0.5] * 20, None, "r", 1)]
    rows += [(None, [0.5] * 20, 1, "r", 1), (1300, [], 1, "r", 1), (1400, [2.0], 0, "r", 1), (1401, [3.0, -1.0], 0, "r", 1), (1402, [2.5], 2, "r", 1)]
    return rows


def brute(spark, rows, low=80, high=100):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.createDataFrame(rows, SCHEMA).collect()]  # 32-bit numbers
    usable = [(i, [math.floor(256 * x) for x in v], k) for i, v, k in rows if i is not None and k is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, w, own in usable:
        if q % 100:
            continue
        scored = [(-sum(a * b for a, b in zip(w, v)), i, k) for i, v, k in usable]
        for s, i, _ in sorted(x for x in scored if x[2] == own and x[1] != q)[:5]:
            band = sorted(x for x in scored if x[2] != own and low * -s <= 100 * -x[0] <= high * -s)[:5]
            out += [(q, i, n, j, -s, -t) for n, (t, j, _) in enumerate(band, 1)]
    return sorted(out)


@pytest.mark.parametrize("hot, block", [(False, negatives.ANCHOR_BLOCK), (True, 2)])
def test_against_brute_force(spark, hot, block):
    rows = _rows(hot=hot)
    vectors = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = negatives.mine(vectors, F.col("id") % 100 == 0, anchor_block=block)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    wanted = brute(spark, rows)
    assert len(wanted) > 50 and sorted(map(tuple, found.collect())) == wanted


def test_other_bands_and_none(spark):
    rows = _rows(2)
    vectors = spark.createDataFrame(rows, SCHEMA)
    found = negatives.mine(vectors, F.col("id") % 100 == 0, low_percent=50, high_percent=90)
    assert sorted(map(tuple, found.collect())) == brute(spark, rows, 50, 90)
    for few in (vectors.limit(0), vectors.filter("vec_id = 1"), vectors.filter("vec_id = 100")):
        assert negatives.mine(few, F.col("id") % 100 == 0).count() == 0


def test_repeated_rows_are_answered_once_each(spark):
    rows = [(0, [1.0, 1.0], 1, "r", 1)] * 2 + [(1, [1.0, 0.5], 1, "r", 1), (2, [1.0, 0.25], 2, "r", 1), (2, [1.0, 0.25], 2, "r", 1)]
    found = negatives.mine(spark.createDataFrame(rows, SCHEMA), F.col("id") % 100 == 0).collect()
    score = 256 * 256 + 256 * 128
    assert sorted(map(tuple, found)) == sorted([(0, 1, r, 2, score, 256 * 256 + 256 * 64) for r in (1, 2)] * 2)


@pytest.mark.parametrize("top", [1, 2, 300, 2**40])
def test_scores_are_inner_products(top):
    rng = np.random.default_rng(top % 97)
    a = rng.integers(-top, top + 1, (7, 24))
    c = rng.integers(-top, top + 1, (50, 16))
    product = np.einsum("nd,ad->na", c, a[:, :16])  # wraps as longs do
    assert np.array_equal(negatives.scores(negatives.bit_planes(c), a), product)
    assert not negatives.scores(negatives.bit_planes(np.zeros((3, 8), np.int64)), a).any()
    least = np.full((2, 8), -(2**40), np.int64)
    assert np.array_equal(negatives.scores(negatives.bit_planes(least), np.ones((1, 8), np.int64)), np.full((2, 1), -(2**43)))


def test_subset_sums():
    w = np.arange(1, 17).reshape(1, 16)
    table = negatives.subset_sums(w)
    assert table.shape == (2, 256, 1)
    assert table[0, 0b10000101, 0] == 1 + 3 + 8 and table[1, 255, 0] == sum(range(9, 17))
