import math
import random

import pytest
from pyspark.sql import functions as F

from counterpoise.llm import topk

SCHEMA = "vec_id bigint, embedding array<float>, rank int, id string"


def _rows(seed=1):
    rng = random.Random(seed)
    rows = [(i, [rng.choice([0.0, 0.0, rng.uniform(-1, 1)]) for _ in range(12)], 1, "x") for i in range(300)]
    rows += [(400 + i, [0.5] * 12, 1, "x") for i in range(30)]  # ties
    rows += [(50, [1.0, None] + [0.0] * 10, 1, "x"), (100, [math.nan] * 12, 1, "x"), (450, [math.inf] + [0.0] * 11, 1, "x")]
    rows += [(500, None, 1, "x"), (None, [1.0] * 12, 1, "x"), (600, [], 1, "x"), (650, [2.0], 1, "x"), (700, [0.25] * 12, 1, "x"), (700, [0.25] * 12, 1, "x")]
    return rows


def brute(spark, rows, k=5):
    # the table holds 32-bit numbers
    rows = [(r.vec_id, r.embedding) for r in spark.createDataFrame(rows, SCHEMA).collect()]
    usable = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, w in usable:
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(w, v)), i) for i, v in usable if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return sorted(out)


@pytest.mark.parametrize("query_block, candidate_block", [(1_024, 8_192), (3, 20)])
def test_against_brute_force(spark, query_block, candidate_block):
    rows = _rows()
    vectors = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = topk.search(vectors, F.col("id") % 50 == 0, query_block=query_block, candidate_block=candidate_block)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, found.collect())) == brute(spark, rows)


def test_few_candidates_and_none(spark):
    rows = [(0, [1.0, 2.0], 1, "x"), (3, [1.0, -2.0], 1, "x"), (7, [0.0, 0.0], 1, "x")]
    vectors = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, topk.search(vectors, F.col("id") % 50 == 0).collect())) == brute(spark, rows)
    assert topk.search(vectors.limit(0), F.col("id") % 50 == 0).count() == 0
    assert topk.search(vectors.filter("vec_id > 0"), F.col("id") % 50 == 0).count() == 0
    assert topk.search(vectors.filter("vec_id = 0"), F.col("id") % 50 == 0).count() == 0
