"""Joining a big table to a table of facts, whatever the size or skew."""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from counterpoise.operators.lineage import Written, materialise, row_bytes

BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20
HOT_ROWS = 2_000_000
NULL_SALTS = 4_096


def fits_broadcast(table: DataFrame | Written, rows: int = BROADCAST_ROWS, bytes_: int = BROADCAST_BYTES) -> bool:
    """Whether the table is small: as measured when written, or by reading at most ``rows + 1`` rows."""
    if isinstance(table, Written):
        return table.rows <= rows and table.bytes <= bytes_
    seen = (
        table.limit(rows + 1)
        .agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(row_bytes(table)), F.lit(0)).alias("size"))
        .first()
    )
    return seen["n"] <= rows and seen["size"] <= bytes_


def lookup_join(
    df: DataFrame,
    table: DataFrame | Written,
    on: Sequence[str],
    how: str = "inner",
    small: bool | None = None,
    hot_rows: int = HOT_ROWS,
    rows_per_key: DataFrame | None = None,
) -> DataFrame:
    """Join ``df`` (any size, any skew) to ``table`` on ``on``.

    A table measured to be small is broadcast. A larger one is shuffled, and
    keys that hold more than ``hot_rows`` rows of ``df`` are salted: their rows
    are spread by a hash of the row, and the matching ``table`` rows repeated
    once per salt. The salt is a function of the row, so a retry cannot move it.
    ``small=True`` is for tables whose size is bounded by construction;
    ``rows_per_key`` (``on``, ``_rows``) spares counting ``df`` per key again.
    """
    on = list(on)
    if how not in ("inner", "left"):
        raise ValueError("lookup_join keeps the left side: 'inner' or 'left'")
    if small is None:
        small = fits_broadcast(table)
    if isinstance(table, Written):
        table = table.df
    if small:
        return df.join(F.broadcast(table), on, how)
    if rows_per_key is None:
        rows_per_key = df.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows"))
    hot = rows_per_key.filter(F.col("_rows") > hot_rows).select(
        *on, F.ceil(F.col("_rows") / F.lit(hot_rows)).cast("int").alias("_salts")
    )
    # at most (rows of df) / hot_rows keys, so this side is small by construction; both joins
    # below use it, and a plan that counts df stays out of theirs
    hot = F.broadcast(materialise(hot))
    row = F.xxhash64(*[F.col(c) for c in df.columns if df.schema[c].dataType.typeName() not in ("map", "variant")])
    spread = F.pmod(row, F.col("_salts")).cast("int")
    # a null key finds nothing, so its rows may go anywhere: they are spread over negative salts
    lost = functools.reduce(operator.or_, [F.col(c).isNull() for c in on])
    nowhere = -1 - F.pmod(row, F.lit(NULL_SALTS)).cast("int")
    salt = F.when(lost, nowhere).otherwise(F.coalesce(spread, F.lit(0)))
    left = df.join(hot, on, "left").withColumn("_salt", salt).drop("_salts")
    right = (
        table.join(hot, on, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts") - 1, F.lit(0)))))
        .drop("_salts")
    )
    return left.join(right, [*on, "_salt"], how).drop("_salt")
