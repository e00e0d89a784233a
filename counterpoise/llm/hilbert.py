"""Shards cut from a Hilbert curve over several metadata columns.

Each column is quantised into 2^bits cells of about equal numbers of rows, the
cells of a row are one point of a grid, and rows are sorted by the point's
place on the Hilbert curve. Points near on the curve are near in every
dimension, so a run cut from it covers a small box and the minima and maxima of
a shard let a reader skip it for a filter on any of the columns (Skilling,
"Programming the Hilbert curve", 2004).

Law ``rows``: runs are cut at equal numbers of rows, so shard sizes differ by at
most one row. Equal points are ordered by the text's checksum, then by key, so
copies stand together, and a group of copies larger than a shard is cut like any
other run. Rows equal in all three fall into one range of the sort, since nothing
tells them apart; any others are spread.

Defined results: a null or NaN cell counts below every value; a null text has
size 1 and checksum 0; very long texts only give their size and checksum;
repeated rows get a slot each; an empty table gives no rows; other columns may have any names, as rows are carried as one struct.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from counterpoise.llm.common import ranked
from counterpoise.operators.lineage import materialise
from counterpoise.operators.ranking import running_sum

BITS = 5
SHARDS = 16
ACCURACY = 10_000


def curve_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of ``cells`` (n x d, values below 2^bits)."""
    axes = [cells[:, i].astype(np.int64) for i in range(cells.shape[1])]
    head = axes[0]
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i, axis in enumerate(axes):
            upper = (axis >> b & 1).astype(bool)
            swap = np.where(upper, 0, (head ^ axis) & low)
            head = np.where(upper, head ^ low, head ^ swap)
            axes[0] = head
            if i:
                axes[i] = axis ^ swap
    for i in range(1, len(axes)):
        axes[i] = axes[i] ^ axes[i - 1]
    flip = np.zeros(len(cells), np.int64)
    for b in range(bits - 1, 0, -1):
        flip ^= np.where(axes[-1] >> b & 1, (1 << b) - 1, 0)
    out = np.zeros(len(cells), np.int64)
    for b in range(bits - 1, -1, -1):
        for axis in axes:
            out = out << 1 | (axis ^ flip) >> b & 1
    return out


def _ordered(df: DataFrame, name: str) -> tuple[Column, bool]:
    """The column in a type whose order counts, and whether it is text."""
    col, kind = F.col(f"`{name}`"), df.schema[name].dataType
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return F.nanvl(col.cast("double"), F.lit(None).cast("double")), False
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return col.cast("timestamp").cast("double"), False
    if isinstance(kind, T.BinaryType):
        return F.hex(col), True  # hexadecimal digits are in the order of the bytes
    if isinstance(kind, T.StringType):
        return col.cast("string"), True
    return F.xxhash64(col).cast("double"), False


def text_edges(values: DataFrame, cells: int) -> list[str]:
    """Lower borders of all cells but the first, from the whole column ``value``.

    Values are counted once each and summed in their order, range by range, so
    the borders are quantiles whatever the values have in common.
    """
    counts = values.filter("value IS NOT NULL").groupBy("value").agg(F.count(F.lit(1)).alias("n")).withColumn("_all", F.lit(0))
    upto = materialise(running_sum(counts, ["_all"], ["value"], {"upto": "n"}))
    total = upto.agg(F.max("upto")).first()[0] or 0
    if not total:
        return []
    before = F.col("upto") - F.col("n")
    at = F.floor(before * cells / F.lit(total))
    # at most a row for each cell; a border is repeated where a value before it fills several cells
    found = sorted((r["at"], r["edge"]) for r in upto.groupBy(at.alias("at")).agg(F.min("value").alias("edge")).filter("at > 0").collect())
    return [edge for k, (place, edge) in enumerate(found) for _ in range(place - (found[k - 1][0] if k else 0))]


def quantile_edges(df: DataFrame, dims: Sequence[str], bits: int) -> list[list]:
    """Lower cell borders of every column, from all rows: numbers in one aggregate of fixed size, texts by their counts."""
    cells = 1 << bits
    at = F.array(*[F.lit(i / cells) for i in range(1, cells)])
    columns = [_ordered(df, d) for d in dims]
    numbers = {i: col for i, (col, is_text) in enumerate(columns) if not is_text}
    found: list[list] = [[] for _ in dims]
    if numbers:
        row = df.select(*[c.alias(f"d{i}") for i, c in numbers.items()]).agg(*[F.percentile_approx(f"d{i}", at, F.lit(ACCURACY)).alias(f"d{i}") for i in numbers]).first()
        for i in numbers:
            found[i] = list(row[f"d{i}"] or [])
    for i, (col, is_text) in enumerate(columns):
        if is_text:
            found[i] = text_edges(df.select(col.alias("value")), cells)
    return found


def _borders_passed(col: Column, edges: Sequence) -> Column:
    return F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= col)) if len(edges) else F.lit(0)


def curve_column(df: DataFrame, dims: Sequence[str], bits: int = BITS) -> Column:
    if not 1 <= bits * len(dims) <= 62:
        raise ValueError("bits times dimensions must fit a long")
    cells = []
    for (col, _), edges in zip([_ordered(df, d) for d in dims], quantile_edges(df, dims, bits)):
        cells.append(F.when(col.isNotNull(), _borders_passed(col, edges)).otherwise(0))

    def place(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in parts:
            columns = columns if isinstance(columns, tuple) else (columns,)  # one dimension comes by itself
            yield pd.Series(curve_index(np.stack([c.to_numpy() for c in columns], axis=1), bits))

    return F.pandas_udf(place, "bigint")(*cells)


def shard(
    docs: DataFrame,
    dims: Sequence[str],
    shards: int = SHARDS,
    key: str = "doc_id",
    text: str = "text",
    carry: Sequence[str] = (),
    bits: int = BITS,
) -> DataFrame:
    """(key, size, text_crc32, curve, law, shard, slot, row): row is a struct of ``carry``.

    ``slot`` numbers the rows of a shard from 0 in curve order.
    """
    body = F.col(f"`{text}`").cast("binary")
    narrow = docs.select(
        F.col(f"`{key}`").alias("key"),
        (F.coalesce(F.length(body), F.lit(0)).cast("bigint") + 1).alias("size"),
        F.crc32(F.coalesce(body, F.lit(b""))).alias("text_crc32"),
        curve_column(docs, dims, bits).alias("curve"),
        F.struct(*[F.col(f"`{c}`") for c in carry] or [F.lit(None).alias("none")]).alias("row"),
    )
    placed, total = ranked(narrow, ["curve", "text_crc32", "key"], "place")
    cut = F.expr(f"int(place * {shards} div {max(total, 1)})")
    start = F.expr(f"bigint((shard * bigint({total}) + {shards} - 1) div {shards})")
    out = placed.withColumn("shard", cut).withColumn("slot", F.col("place") - start)
    return out.select(F.col("key").alias(key), "size", "text_crc32", "curve", F.lit("rows").alias("law"), "shard", "slot", "row")


def write_shards(docs: DataFrame, dims: Sequence[str], path: str, shards: int = SHARDS, key: str = "doc_id", text: str = "text", bits: int = BITS) -> DataFrame:
    """Writes whole rows as ``path/shard=N`` and returns the manifest.

    The manifest has a row for each shard with its row count, bytes, and the
    minimum and maximum of every dimension, for pruning.
    """
    cut = shard(docs, dims, shards, key, text, docs.columns, bits)
    rows = cut.select("shard", "slot", "row")
    rows.repartitionByRange(shards, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    back = docs.sparkSession.read.parquet(path)
    ends = [F.struct(F.min(f"row.`{d}`").alias("low"), F.max(f"row.`{d}`").alias("high")).alias(d) for d in dims]
    size = F.sum(F.coalesce(F.octet_length(f"row.`{text}`"), F.lit(0)) + 1).alias("bytes")
    return back.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), size, F.struct(*ends).alias("bounds"))


def shards_meeting(manifest: DataFrame, dim: str, low, high) -> DataFrame:
    """Shards that may hold a row with ``low <= dim <= high``."""
    bounds = F.col(f"bounds.`{dim}`")
    return manifest.filter((bounds["low"] <= F.lit(high)) & (bounds["high"] >= F.lit(low))).select("shard")
