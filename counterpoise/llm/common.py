"""Shared folder and global order for the operators of this package."""

from __future__ import annotations

import ctypes
import functools
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from counterpoise.operators.lineage import ensure_checkpoint_dir, materialise, write_down

RANK_ROWS = 200_000


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, and then what the partition took goes back to the system.

    Workers are reused and idle ones keep what their allocators have freed; on an
    executor that runs many stages that adds up.
    """

    @functools.wraps(run)
    def lean_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
        if trim is not None:
            trim(0)

    return lean_run


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder inside the checkpoint folder, which every executor can reach."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{name}-{uuid.uuid4().hex}"


def ranked(df: DataFrame, order: Sequence[str | Column], name: str = "rank", rows_per_part: int = RANK_ROWS) -> tuple[DataFrame, int]:
    """``df`` with every row's 0-based place in the order, and the number of rows.

    Rows are range partitioned and sorted inside the partitions; a row's place
    is its place in its partition plus the rows of the partitions before. The only
    window is over one count for each partition.
    """
    spark = df.sparkSession
    written = write_down(df)
    parts = max(1, -(-written.rows // rows_per_part))
    parts = max(parts, min(spark.sparkContext.defaultParallelism, written.rows // 1_000 + 1))
    in_order = written.df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # the id is (partition, place in it); it is written down before it is used twice
    placed = materialise(in_order.withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    table = counts.select("_part", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    joined = placed.withColumn("_part", part).join(F.broadcast(table), "_part")  # a row for each partition
    return joined.withColumn(name, place).drop("_place", "_part", "_before"), written.rows
