"""Training and scoring over datasets, variants and repeated runs."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from counterpoise.operators.evaluate import MODELS, SCORES, score_summary, score_tables, train_and_score
from counterpoise.operators.training_sets import TABLE, training_sets
from counterpoise.sources.tables import ORIGINAL

# The datasets evaluated when none are named, with their target columns.
TARGETS = {"penguins": "sex", "fitness": "is_fit"}


def _frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, SCORES)


def evaluate_datasets(
    spark: SparkSession, path: str, targets: Mapping[str, str] = TARGETS, fmt: str = "parquet", **options
) -> DataFrame:
    """Scores on the stored original splits of each dataset; one that is not stored is skipped."""
    rows = []
    for dataset, target in targets.items():
        base = f"{path}/{ORIGINAL}/dataset={dataset}"
        try:
            reader = spark.read.option("header", True).option("inferSchema", True).format(fmt)
            parts = [reader.load(f"{base}/split={s}") for s in ("train", "test")]
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                continue
            raise
        rows += train_and_score(*parts, target, dataset, **options)
    return _frame(spark, rows)


def repeat_runs(
    train: DataFrame, test: DataFrame, target: str, dataset: str, runs: int = 1, seed: int = 42, **options
) -> DataFrame:
    """The same split scored ``runs`` times with different seeds."""
    rows = []
    for run in range(runs):
        rows += train_and_score(train, test, target, dataset, run=run, seed=seed + run, **options)
    return _frame(train.sparkSession, rows)


def evaluate_variants(
    variants: DataFrame, test: DataFrame, target: str, dataset: str, runs: int = 1, seed: int = 42, models: Sequence[str] = MODELS, **options
) -> DataFrame:
    """Each (method, pct) variant trained, and scored on the untouched test rows.

    All variants go through the same jobs; only their names pass the driver.
    ``variants`` is the stored or computed output of a rebalance sweep.
    """
    extra = [c for c in ("dataset", "method", "pct", "p", "is_synthetic") if c in variants.columns]
    names = sorted((r["method"], r["pct"]) for r in variants.select("method", "pct").distinct().collect())
    spark = variants.sparkSession
    listed = spark.createDataFrame([(m, p, i) for i, (m, p) in enumerate(names)], f"method string, pct int, {TABLE} bigint")
    tables = variants.join(F.broadcast(listed), ["method", "pct"]).drop(*extra)  # a row for each variant
    rows = []
    for run in range(runs):
        found = score_tables(tables, test, target, models, seed=seed + run, **options)
        nothing = {m: (math.nan, math.nan, math.nan, "no complete rows") for m in models}
        rows += [(dataset, m, p, run, name, *found.get(i, nothing)[name]) for i, (m, p) in enumerate(names) for name in models]
    return _frame(spark, rows)


def variant_folds(variants: DataFrame, test: DataFrame, target: str, max_splits: int = 5, seed: int = 42) -> DataFrame:
    """(method, pct, part, n_rows, n_pos): what each fold of each variant scores; part -1 is the test rows."""
    names = variants.select("method", "pct").distinct().orderBy("method", "pct").collect()
    spark = variants.sparkSession
    listed = F.broadcast(spark.createDataFrame([(r["method"], r["pct"], i) for i, r in enumerate(names)], f"method string, pct int, {TABLE} bigint"))
    extra = [c for c in ("dataset", "method", "pct", "p", "is_synthetic") if c in variants.columns]
    sets = training_sets(variants.join(listed, ["method", "pct"]).drop(*extra), test, target, seed=seed, max_splits=max_splits)
    counted = sets.rows.groupBy("v", "part").agg(F.sum("n").alias("n_rows"), F.sum(F.col("label") * F.col("n")).cast("bigint").alias("n_pos"))
    return counted.join(listed, counted["v"] == listed[TABLE]).select("method", "pct", "part", "n_rows", "n_pos")


def tabulate(scores: DataFrame, by: Sequence[str] = ("model", "method", "pct")) -> DataFrame:
    """Mean and deviation over runs, in order."""
    return score_summary(scores, by).orderBy(*by)
