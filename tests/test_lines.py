"""Learners over lines that stand for several equal rows."""

import uuid

import numpy as np
from pyspark.sql import functions as F

from counterpoise.operators import boosting, forest, logistic
from counterpoise.operators import evaluate as V
from counterpoise.operators.training_sets import TABLE, training_sets


def _lines(seed=3, n=160):
    rng = np.random.default_rng(seed)
    x = np.unique(rng.integers(0, 9, (n, 2)).astype(float), axis=0)
    y = (x[:, 0] + rng.normal(0, 3, len(x)) > 4).astype(float)
    return x, y, rng.integers(1, 9, len(x))


def test_a_line_counts_as_its_rows():
    x, y, n = _lines()
    bins = boosting.binned(x, [boosting.bin_edges(x[:, j]) for j in range(2)])
    whole = boosting.fit_rows(np.repeat(bins, n, axis=0), np.repeat(y, n), bins, 6, 5)
    assert np.allclose(boosting.fit_rows(bins, y, bins, 6, 5, n), whole, atol=1e-12)
    seeds = forest.tree_seed(1, 2, 3, np.arange(40))
    for many in (1, 5, 400):
        drawn = forest.bootstrap(seeds, np.arange(2000), np.full(2000, many))
        assert abs(drawn.mean() / many - 1) < 0.02 and abs(drawn.var() / many - 1) < 0.05


def test_logistic_sums_of_lines(spark):
    x, y, n = _lines()
    rows = [(0, 0, 0, float(b), [float(c) for c in a], int(m)) for a, b, m in zip(x, y, n)]
    lines = spark.createDataFrame(rows, "v bigint, row bigint, part int, label double, x array<double>, n bigint")
    each = lines.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).drop("n", "_i")
    at, weights = {(0, -1): np.array([0.2, -0.1, 0.3])}, {(0, -1): (1.0, 2.0)}
    a, b = ({r["i"]: r["value"] for r in logistic.newton_sums(df, at, weights).collect()} for df in (lines, each))
    assert a.keys() == b.keys() and all(abs(a[i] - b[i]) < 1e-6 for i in a)


def _repeated(spark, n=900):
    rng = np.random.default_rng(8)
    rows = [(i, 0, "abc"[int(rng.integers(0, 3))], float(rng.integers(0, 8))) for i in range(n)]
    rows = [(*r, "m" if r[3] + rng.normal(0, 2) > 4 else "f") for r in rows]
    return spark.createDataFrame(rows, f"id bigint, {TABLE} bigint, isle string, depth double, sex string")


def test_equal_rows_are_one_line(spark):
    tables = _repeated(spark)
    sets = training_sets(tables, tables.drop(TABLE).filter("id < 200"), "sex", key="id")
    assert sets.rows.count() <= 3 * 8 * 2 * 6 and sets.rows.agg(F.sum("n")).first()[0] == 1100 == sets.total[0]
    folds = {r["part"]: r["n"] for r in sets.rows.groupBy("part").agg(F.sum("n").alias("n")).collect()}
    assert folds[-1] == 200 and max(folds[f] for f in range(5)) - min(folds[f] for f in range(5)) <= 2


def test_jobs_of_large_tables_of_few_lines_do_not_grow_with_the_rounds(spark):
    tables = _repeated(spark)
    test = tables.drop(TABLE).filter("id < 200")

    def jobs(rounds):
        group = uuid.uuid4().hex
        spark.sparkContext.setJobGroup(group, "count")
        found = V.score_tables(tables, test, "sex", ["hist_gradient"], key="id", rounds=rounds, local_rows=10)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)), found[0]["hist_gradient"]

    (few, _), (many, scores) = jobs(2), jobs(12)
    assert many <= few + 2 and scores[2] > 0.7


def test_packs_of_clusters_are_not_merged_by_size(spark):
    from counterpoise.operators import minibatch

    rows = [(f"d{i // 4}", i, 1, [97, 98], [0.6, 0.8], 2) for i in range(8000)]
    named = spark.createDataFrame(rows, "file string, id bigint, weight bigint, codes array<int>, vec array<double>, k int")
    assert minibatch._packed(named, 8000, 42, 256, 2).rdd.getNumPartitions() >= 8
