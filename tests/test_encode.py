import math

import pytest
from pyspark.sql import functions as F

from counterpoise.operators import encode as E
from counterpoise.operators import evaluate as V


def test_codes_are_ascending_and_unseen_is_first(spark):
    train = spark.createDataFrame([("b", "x"), ("a", "y"), ("ü", "x"), ("Z", "x")], "c string, d string")
    enc = E.LabelEncoder.fit(train, ["c", "d"])
    assert enc.sizes == {"c": 4, "d": 2}
    got = [tuple(r) for r in enc.transform(train).collect()]
    assert sorted(got) == [(0, 0), (1, 1), (2, 0), (3, 0)]
    test = spark.createDataFrame([("nope", "y"), (None, "x")], "c string, d string")
    assert sorted(tuple(r) for r in enc.transform(test).collect()) == [(0, 0), (0, 1)]


def test_large_domain_path(spark, monkeypatch):
    df = spark.range(500).select(F.format_string("%05d", "id").alias("c"))
    enc = E.LabelEncoder.fit(df, ["c"])
    enc.small = False
    monkeypatch.setattr("counterpoise.operators.lookup.BROADCAST_ROWS", 10)
    monkeypatch.setattr("counterpoise.operators.lookup.fits_broadcast", lambda *a, **k: False)
    coded = enc.transform(df)
    assert sorted(r["c"] for r in coded.collect()) == list(range(500))
    assert sorted(r["c"] for r in enc.decode(coded).collect()) == [f"{i:05d}" for i in range(500)]


def test_half_codes(spark):
    df = spark.createDataFrame([(0, 0.5), (1, 1.5), (2, 2.5), (3, -0.2), (4, 9.7)], "i int, x double")
    got = [r[0] for r in df.orderBy("i").select(E.nearest_code(F.col("x"), 3)).collect()]
    assert got == [0, 2, 2, 0, 2]


def test_scaler_population_and_constant(spark):
    df = spark.createDataFrame([(1.0, 5), (3.0, 5)], "x double, k int")
    out = E.StandardScaler.fit(df, ["x", "k"]).transform(df)
    assert sorted(tuple(r) for r in out.collect()) == [(-1.0, 0.0), (1.0, 0.0)]


def test_auc_ties_and_single_class(spark):
    df = spark.createDataFrame(
        [("a", 0.1, 0), ("a", 0.4, 0), ("a", 0.4, 1), ("a", 0.8, 1), ("b", 0.3, 1)], "g string, s double, y int"
    )
    got = {r["g"]: r["auc"] for r in V.roc_auc(df, "s", "y", ["g"]).collect()}
    assert got["a"] == pytest.approx(0.875) and math.isnan(got["b"])


def test_auc_matches_pairs_in_both_paths(spark, monkeypatch):
    df = spark.range(400).select(
        F.floor(F.rand(1) * 60).alias("s"), (F.rand(2) < 0.3).cast("int").alias("y")
    ).cache()
    rows = df.collect()
    pos, neg = [r["s"] for r in rows if r["y"]], [r["s"] for r in rows if not r["y"]]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert V.roc_auc(df, "s", "y").first()["auc"] == pytest.approx(want)
    from counterpoise.operators import ranking

    plain = ranking.running_sum
    monkeypatch.setattr(V, "running_sum", lambda *a, **k: plain(*a, **k, window_rows=9))
    assert V.roc_auc(df, "s", "y").first()["auc"] == pytest.approx(want)


def test_folds_are_even_per_class(spark):
    df = spark.range(103).withColumn("y", (F.col("id") < 13).cast("int"))
    out = V.stratified_folds(df, "y", "id")
    sizes = {}
    for r in out.groupBy("y", "fold").count().collect():
        sizes.setdefault(r["y"], []).append(r["count"])
    assert all(len(v) == 5 and max(v) - min(v) <= 1 for v in sizes.values())
    assert V.stratified_folds(df.filter("id = 0 or id > 20"), "y", "id") is None
    three = V.stratified_folds(df.filter("id < 3 or id > 20"), "y", "id")
    assert three.select("fold").distinct().count() == 3


def test_nan_handling_differs_between_folds_and_runs(spark):
    nan = float("nan")
    df = spark.createDataFrame([("m", 0.5), ("m", 0.7), ("m", nan), ("n", nan)], "model string, auc double")
    cv = {r["model"]: (r["cv_mean"], r["cv_std"]) for r in V.cv_summary(df, ["model"]).collect()}
    assert cv["m"] == (pytest.approx(0.6), pytest.approx(0.1)) and math.isnan(cv["n"][0])
    runs = V.score_summary(df.withColumnRenamed("auc", "test_roc"), ["model"]).collect()
    assert all(math.isnan(r["roc_mean"]) for r in runs)
