"""Where long jobs cut their lineage, and how large what they wrote is."""

from __future__ import annotations

import tempfile
import threading
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_cleaning: dict[str, tuple[int, str]] = {}  # session: writers under way, and the setting to go back to
_guard = threading.Lock()


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go when it ends, not when the driver happens to collect its garbage."""
    name = spark._jsparkSession.sessionUUID()
    with _guard:
        writers, before = _cleaning.get(name, (0, None))
        if writers == 0:
            before = spark.conf.get(_CLEANUP)
            spark.conf.set(_CLEANUP, "true")
        _cleaning[name] = (writers + 1, before)
    try:
        yield
    finally:
        with _guard:
            writers, before = _cleaning.pop(name)
            if writers > 1:
                _cleaning[name] = (writers - 1, before)
            else:
                spark.conf.set(_CLEANUP, before)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the session names; only a local session may make its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="counterpoise-"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the checkpoint folder and read it from there.

    The copy is on shared storage, so a lost executor costs a re-read and not a
    recomputation, and row numbering based on it cannot change between jobs.
    What was shuffled on the way is deleted.
    """
    ensure_checkpoint_dir(df.sparkSession)
    with _shuffles_dropped(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def discard(*tables: DataFrame | Written) -> None:
    """Delete the copies behind results of :func:`materialise` or :func:`write_down`.

    Only for tables that no DataFrame still to be computed reads.
    """
    for table in tables:
        df = table.df if isinstance(table, Written) else table
        file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if file.isDefined():
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file.get())
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


@dataclass(frozen=True)
class Written:
    """A materialised table whose size was taken while it was written."""

    df: DataFrame
    rows: int
    bytes: int


def _cell_bytes(name: str, kind: T.DataType) -> Column:
    col = F.col(f"`{name}`")
    if isinstance(kind, (T.StringType, T.BinaryType)):
        size = F.octet_length(col)
    elif isinstance(kind, T.ArrayType):
        wide = isinstance(kind.elementType, (T.StringType, T.StructType, T.ArrayType))
        size = F.size(col) * (40 if wide else 8)
    elif isinstance(kind, T.MapType):
        size = F.size(col) * 40
    elif isinstance(kind, T.StructType):
        size = F.lit(8 * len(kind))
    else:
        size = F.lit(8)
    return F.coalesce(F.greatest(size, F.lit(0)), F.lit(0)).cast("bigint") + 8


def row_bytes(df: DataFrame) -> Column:
    """Rough width of a row."""
    total = F.lit(16).cast("bigint")
    for f in df.schema.fields:
        total = total + _cell_bytes(f.name, f.dataType)
    return total


def write_down(df: DataFrame) -> Written:
    """:func:`materialise`, measuring rows and bytes in the same job."""
    seen = Observation()
    n = F.count(F.lit(1)).alias("rows")
    size = F.coalesce(F.sum(row_bytes(df)), F.lit(0)).alias("bytes")
    out = materialise(df.observe(seen, n, size))
    return Written(out, seen.get["rows"], seen.get["bytes"])


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fan_out(df: DataFrame, *by: str) -> DataFrame:
    """Spread a scan of few splits over all cores before expensive row-wise work.

    A table with more splits than cores is left as it is. For plain scans: it
    asks for the partitions, which would run the shuffles of a larger plan.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *by) if df.rdd.getNumPartitions() < cores else df


def side_by_side(spark: SparkSession, fn: Callable, tasks: Iterable, parallelism: int) -> list:
    """``fn`` of each task, with the Spark jobs of several tasks submitted at a time."""
    run = inheritable_thread_target(spark)(fn)
    with ThreadPoolExecutor(max(1, parallelism)) as pool:
        return list(pool.map(run, tasks))
