"""Reduce the minority to a proportion, then fill it up to 50-50 with synthetic rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from counterpoise.operators.generate import MODES, synthesize
from counterpoise.operators.lineage import materialise, side_by_side
from counterpoise.operators.sampling import (
    class_profile,
    complete_cases,
    is_class,
    kept_rows,
    percent,
    sweep_samples,
)
from counterpoise.operators.smote import smote

METHODS = (*MODES, "smote")
# The proportions of the minority class that are tried.
PROPORTIONS = (0.02, 0.05, 0.1, 0.2, 0.25, 0.3)


def rebalance_sweep(
    df: DataFrame,
    target: str,
    proportions: Sequence[float] = PROPORTIONS,
    method: str = "independent",
    key: str = "id",
    seed: int = 42,
    categorical_cols: Sequence[str] = (),
    k: int = 5,
    drop_null_target: bool = False,
    parallelism: int = 4,
    **options,
) -> DataFrame:
    """Balanced variants for all proportions in one table.

    Columns of ``df`` plus ``method, pct, p, is_synthetic``. The kept rows of all
    variants come from one scan. ``key`` identifies source rows; it is not
    modelled, and null in synthetic ones. SMOTE works on complete rows; the
    other methods keep incomplete ones, and count null targets as majority
    unless ``drop_null_target`` is set.
    """
    if method not in METHODS:
        raise ValueError(f"method {method!r}: use one of {METHODS}")
    if method == "smote":
        df = complete_cases(df)
    columns = df.columns
    profile = class_profile(df, target)
    # cut-offs are scalars by now, so the kept rows are a filter on the scan; only the rare ones are written
    real = sweep_samples(df, target, proportions, key, seed, drop_null_target, profile)
    majority = profile.majority_rows(drop_null_target)
    rare = is_class(target, profile.minority)
    features = [c for c in columns if c != key]
    variants = [real.withColumn("is_synthetic", F.lit(False))]
    kept = None if method == "smote" else materialise(real.filter(rare).select("pct", *features))

    def synthetic(p: float) -> DataFrame:
        pct = percent(p)
        needed = majority - kept_rows(majority, p)
        if method == "smote":
            mine = real.filter(F.col("pct") == pct).select(*columns)
            made = smote(mine, target, needed, k, seed, categorical_cols, key).filter("is_synthetic")
        else:
            source = kept.filter(F.col("pct") == pct).select(*features)
            made = synthesize(source, needed, method, seed, categorical_cols=categorical_cols, **options)
        tags = {"pct": F.lit(pct), "p": F.lit(float(p)), "is_synthetic": F.lit(True)}
        return made.select(*features).withColumns(tags)

    variants += side_by_side(df.sparkSession, synthetic, proportions, parallelism)
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), variants)
    return out.withColumn("method", F.lit(method)).select(*columns, "method", "pct", "p", "is_synthetic")


def rebalance(df: DataFrame, target: str, p: float, **options) -> DataFrame:
    """:func:`rebalance_sweep` for one proportion."""
    return rebalance_sweep(df, target, [p], **options)
