"""Threshold sweep over several inputs at once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from counterpoise.operators.neardup import NearDuplicates

# Similarities that are tried.
THRESHOLDS = (0.9, 0.95, 0.97, 0.99, 1.0)


def threshold_sweep(inputs: Mapping[str, DataFrame], thresholds: Sequence[float] = THRESHOLDS, **options) -> DataFrame:
    """(input, t, num_rows, to_remove), e.g. for original and synthetic lines side by side.

    Each input is one corpus (its files keep apart inside it). Similarities are
    computed once for the lowest threshold.
    """
    tagged = [df.withColumn("file", F.concat_ws("/", F.lit(name), "file")) for name, df in inputs.items()]
    report = NearDuplicates(reduce(DataFrame.unionByName, tagged), thresholds, **options).report()
    return report.groupBy(F.substring_index("file", "/", 1).alias("input"), "t").agg(
        F.sum("num_rows").alias("num_rows"), F.sum("to_remove").alias("to_remove")
    )
