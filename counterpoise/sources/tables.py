"""Labelled tables: reading, and the partitioned layout of splits and variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MISSING = "."  # fixed value: the cell that stands for "no value"
ORIGINAL, VARIANTS = "original", "variants"


def read_table(spark: SparkSession, path: str, schema: StructType | str | None = None, missing: str | None = None, fmt: str | None = None) -> DataFrame:
    """A Parquet folder/file, or CSV with a header.

    ``fmt`` is 'parquet' or 'csv'; without it a path ending in ``.parquet`` is
    Parquet and any other CSV.
    ``missing`` is read as null at the scan, so a numeric column holding it
    stays numeric.
    """
    fmt = fmt or ("parquet" if path.rstrip("/").endswith(".parquet") else "csv")
    if fmt not in ("parquet", "csv"):
        raise ValueError(f"no such format: {fmt}")
    if fmt == "parquet":
        return spark.read.parquet(path)
    reader = spark.read.option("header", True)
    if missing is not None:
        reader = reader.option("nullValue", missing)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)


def read_folder(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """Every ``*.csv`` of a folder, with the dataset's name (file stem) as ``dataset``.

    The files must share a schema; tables of different schemas are read one by one.
    """
    reader = spark.read.option("header", True).option("pathGlobFilter", "*.csv")
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.csv$", 1)
    return reader.csv(path).withColumn("dataset", name)


def write_split(df: DataFrame, path: str, dataset: str, fmt: str = "parquet") -> None:
    """``split`` ('train' / 'test') of one dataset, under ``path/original/dataset=../split=..``."""
    _write(df.withColumn("dataset", F.lit(dataset)), f"{path}/{ORIGINAL}", ["dataset", "split"], fmt)


def write_variants(df: DataFrame, path: str, dataset: str, method: str, fmt: str = "parquet") -> None:
    """All proportions of one (dataset, method) in one job, under ``path/variants/dataset=/method=/pct=``."""
    tagged = df.withColumns({"dataset": F.lit(dataset), "method": F.lit(method)})
    _write(tagged, f"{path}/{VARIANTS}", ["dataset", "method", "pct"], fmt)


def _write(df: DataFrame, path: str, by: list[str], fmt: str) -> None:
    # only the partitions at hand are replaced, so datasets and methods are stored one after another
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by)
    writer.option("header", True).format(fmt).save(path)


def _stored(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    return spark.read.option("header", True).option("inferSchema", True).format(fmt).load(path)


def read_split(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return _stored(spark, f"{path}/{ORIGINAL}", fmt)


def read_variants(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Every stored variant, the originals apart; filters on dataset, method and pct prune folders."""
    return _stored(spark, f"{path}/{VARIANTS}", fmt)


def variant_parts(file: Column, dataset: str) -> tuple[Column, Column]:
    """(method, pct) out of a path ``{dataset}/{method}/minority_{pct}pct...``."""
    pattern = rf"{dataset}/([^/]+)/minority_(\d+)pct"
    method = F.nullif(F.regexp_extract(file, pattern, 1), F.lit(""))
    return method, F.nullif(F.regexp_extract(file, pattern, 2), F.lit("")).cast("int")
