import pytest
from pyspark.sql import functions as F

from counterpoise.operators import sampling as S


def labelled(spark, few=60, many=240, nulls=0):
    rows = [(i, "f" if i < few else "m") for i in range(few + many)] + [(10_000 + i, None) for i in range(nulls)]
    return spark.createDataFrame(rows, "id bigint, y string")


def test_profile_and_ties(spark):
    p = S.class_profile(labelled(spark, nulls=3), "y")
    assert (p.minority, p.majority, p.n_minority, p.n_majority, p.n_null) == ("f", "m", 60, 240, 3)
    assert S.class_profile(labelled(spark, 5, 5), "y").minority == "f"


@pytest.mark.parametrize("values", [["a"], ["a", "b", "c"], ["a", "b", "c", "d", "e"], [None]])
def test_profile_needs_two_classes(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "y string")
    with pytest.raises(ValueError, match="exactly 2"):
        S.class_profile(df, "y")


def test_missing_target_and_bad_proportion(spark):
    with pytest.raises(ValueError, match="not in the table"):
        S.class_profile(labelled(spark), "z")
    for p in (0, 1, -0.2, 1.5):
        with pytest.raises(ValueError, match="between 0 and 1"):
            S.check_proportion(p)


def test_plan_numbers(spark):
    df = labelled(spark, few=165, many=168)
    plan = S.rebalance_plan(df, "y", [0.02, 0.05, 0.1, 0.2, 0.25, 0.3]).orderBy("p").collect()
    assert [(r["pct"], r["keep"], r["synth"]) for r in plan] == [
        (2, 3, 165), (5, 8, 160), (10, 18, 150), (20, 42, 126), (25, 56, 112), (30, 72, 96)
    ]
    assert all(r["feasible"] for r in plan)
    assert [S.percent(p) for p in (0.29, 0.57)] == [29, 57]


def test_sample_sizes_nesting_and_refusal(spark):
    df = labelled(spark)
    small = {r["id"] for r in S.exact_sample(df, 40, "id").collect()}
    large = {r["id"] for r in S.exact_sample(df.repartition(7), 90, "id").collect()}
    assert len(small) == 40 and len(large) == 90 and small < large
    assert S.exact_sample(df, 300, "id").count() == 300 and S.exact_sample(df, 0, "id").count() == 0
    with pytest.raises(ValueError, match="without replacement"):
        S.exact_sample(df, 301, "id")


def test_split_sizes(spark):
    df = spark.range(333)
    sizes = {r["split"]: r["count"] for r in S.train_test_split(df, "id").groupBy("split").count().collect()}
    assert sizes == {"train": 266, "test": 67}
    near = S.train_test_split(spark.range(20_000), "id", exact=False).filter("split = 'test'").count()
    assert abs(near - 4_000) < 300


def test_null_targets_stay_with_the_majority(spark):
    df = labelled(spark, nulls=4)
    rare, rest = S.split_by_class(df, "y", "f")
    assert (rare.count(), rest.count()) == (60, 244)
    _, rest = S.split_by_class(df, "y", "f", drop_null_target=True)
    assert rest.count() == 240


def test_sweep_matches_plan(spark):
    df = labelled(spark, nulls=4)
    out = S.sweep_samples(df, "y", [0.05, 0.1], "id")
    got = {(r["pct"], r["y"]): r["count"] for r in out.groupBy("pct", "y").count().collect()}
    # null targets count as majority: 244 * .05 / .95 = 12.8 and 244 * .1 / .9 = 27.1
    assert got == {
        (5, "f"): 12, (5, "m"): 240, (5, None): 4, (10, "f"): 27, (10, "m"): 240, (10, None): 4
    }


def test_sweep_refuses_what_is_not_there(spark):
    with pytest.raises(ValueError, match="only 60 exist"):
        S.sweep_samples(labelled(spark), "y", [0.3], "id")
    with pytest.raises(ValueError, match="larger than the majority"):
        S.sweep_samples(labelled(spark, 1_000, 1_001), "y", [0.6], "id", profile=S.ClassProfile("f", "m", 9_999, 1_001, 0))


def test_complete_cases(spark):
    df = spark.createDataFrame([(1, "a"), (2, "."), (3, None), (None, "b")], "x int, y string")
    assert S.complete_cases(df).count() == 2
    assert [r["x"] for r in S.complete_cases(df, missing=".").collect()] == [1]
    assert S.complete_cases(spark.createDataFrame([], "x int, y string"), missing=".").count() == 0


@pytest.mark.parametrize("n", [1, 10, 777, 5_001, 99_999])
def test_exact_sample_on_repeated_and_null_keys(spark, n):
    """2,000 keys of 50 rows each, among them equal rows and a null key."""
    key = F.when(F.col("id") % 2_000 != 0, F.col("id") % 2_000)
    df = spark.range(100_000).select(key.alias("k"), (F.col("id") % 3).alias("v"))
    part = S.exact_sample(df, n, "k")
    assert part.count() == n
    left = df.exceptAll(part)
    assert left.count() == 100_000 - n  # nothing that was not there


def test_exact_split_on_one_key(spark):
    df = spark.range(1_000).select(F.lit("same").alias("k"), (F.col("id") % 4).alias("v"))
    sizes = {r["split"]: r["count"] for r in S.train_test_split(df, "k", 0.2).groupBy("split").count().collect()}
    assert sizes == {"test": 200, "train": 800}
    none = df.withColumn("k", F.lit(None).cast("string"))
    sizes = {r["split"]: r["count"] for r in S.train_test_split(none, "k", 0.333).groupBy("split").count().collect()}
    assert sizes == {"test": 333, "train": 667}
