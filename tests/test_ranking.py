import random

import pytest
from pyspark.sql import functions as F

from counterpoise.functions.hashing import fast_uniform, hash_bits, uniform
from counterpoise.operators import lookup, ranking


def test_uniform_ignores_partitioning(spark):
    a = spark.range(0, 500, 1, 3).select("id", uniform(7, "x", F.col("id")).alias("u"))
    b = spark.range(0, 500, 1, 11).select("id", uniform(7, "x", F.col("id")).alias("u"))
    assert {tuple(r) for r in a.collect()} == {tuple(r) for r in b.collect()}
    row = spark.range(20_000).select(
        F.avg(uniform(1, "m", F.col("id"))), F.avg(fast_uniform(1, "m", F.col("id"))), F.max(fast_uniform(1, "m", F.col("id")))
    ).first()
    assert abs(row[0] - 0.5) < 0.01 and abs(row[1] - 0.5) < 0.01 and row[2] < 1


def test_cutoffs_take_exactly_n(spark):
    df = spark.range(50_000)
    bits = hash_bits(1, "s", F.col("id"))
    cuts = ranking.rank_cutoffs(df, bits, F.col("id"), [0, 1, 17, 4_000, 49_999, 50_000, 60_000])
    taken = {n: df.filter(c.admits(bits, F.col("id"))).count() for n, c in cuts.items()}
    assert taken == {0: 0, 1: 1, 17: 17, 4_000: 4_000, 49_999: 49_999, 50_000: 50_000, 60_000: 50_000}


@pytest.mark.parametrize("rows", [30, 3_000])
def test_cutoffs_count_the_rows_of_a_repeated_key(spark, rows):
    df = spark.range(rows).select(F.lit(1).alias("k"))
    cut = ranking.rank_cutoffs(df, hash_bits(1, "s", F.col("k")), F.col("k"), [5])[5]
    assert (cut.ties, cut.inside, cut.exact) == (rows, 5, False)


@pytest.mark.parametrize("window_rows", [10**6, 64])
def test_hashed_rank_is_a_permutation_in_hash_order(spark, monkeypatch, window_rows):
    monkeypatch.setattr(ranking, "WINDOW_ROWS", window_rows)
    df = spark.range(2_000).withColumn("g", (F.col("id") < 1_700).cast("int"))
    bits = hash_bits(3, "r", F.col("id"))
    rows = ranking.hashed_rank(df, ["g"], bits, F.col("id"), "rank").withColumn("h", bits).collect()
    for g, n in ((0, 300), (1, 1_700)):
        mine = sorted((r for r in rows if r["g"] == g), key=lambda r: (r["h"], r["id"]))
        assert [r["rank"] for r in mine] == list(range(1, n + 1))


@pytest.mark.parametrize("window_rows", [10**6, 50])
def test_running_sum_small_and_partitioned(spark, window_rows):
    rnd = random.Random(5)
    data = [("a" if i < 400 else "b", i, rnd.randint(0, 9)) for i in range(600)]
    df = spark.createDataFrame(data, "g string, o int, v int").repartition(5)
    out = ranking.running_sum(df, ["g"], ["o"], {"s": "v"}, window_rows=window_rows)
    got = {(r["g"], r["o"]): r["s"] for r in out.collect()}
    want, total = {}, {}
    for g, o, v in data:
        total[g] = total.get(g, 0) + v
        want[g, o] = total[g]
    assert got == want


def test_row_keys_number_copies(spark):
    df = spark.createDataFrame([(1, "a")] * 7 + [(None, "b"), (2, None), (2, None)], "x int, y string")
    keyed = ranking.with_row_key(df, block=3)
    assert keyed.count() == 10 and keyed.select("row_key").distinct().count() == 10
    again = {r["row_key"] for r in ranking.with_row_key(df.repartition(4), block=3).collect()}
    assert again == {r["row_key"] for r in keyed.collect()}


def test_row_keys_spread_rows_that_repeat(spark):
    """Few different rows, each repeated very often, are not numbered in one task."""
    keyed = ranking.with_row_key(spark.range(400_000).select((F.col("id") % 3).alias("x")))
    sizes = [r["count"] for r in keyed.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 400_000 and max(sizes) < 200_000


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_lookup_equals_plain_join(spark, how):
    df = spark.range(3_000).select("id", F.when(F.col("id") < 2_000, 1).otherwise(F.col("id") % 40).alias("k"))
    side = spark.range(30).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    side = side.unionByName(side.withColumn("v", F.col("v") + 1))
    salted = lookup.lookup_join(df, side, ["k"], how, small=False, hot_rows=300)
    plain = df.join(side, ["k"], how)
    assert sorted(map(str, salted.select("id", "k", "v").collect())) == sorted(map(str, plain.select("id", "k", "v").collect()))


def test_broadcast_only_when_measured_small(spark):
    assert lookup.fits_broadcast(spark.range(100), rows=100)
    assert not lookup.fits_broadcast(spark.range(101), rows=100)
    wide = spark.range(10).select(F.repeat(F.lit("x"), 1_000).alias("s"))
    assert not lookup.fits_broadcast(wide, bytes_=5_000)
