"""Train/test splits of every table in a folder."""

from __future__ import annotations

from pyspark.errors import AnalysisException, SparkRuntimeException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from counterpoise.functions.hashing import hash_bits
from counterpoise.operators.lineage import materialise, write_down
from counterpoise.operators.lookup import lookup_join
from counterpoise.operators.ranking import hashed_rank, with_row_key
from counterpoise.operators.sampling import train_test_split
from counterpoise.sources.files import write_files
from counterpoise.sources.tables import ORIGINAL, read_table, write_split
from counterpoise.sources.text import scan_lines


def split_folder(
    spark: SparkSession, folder: str, out: str, test_size: float = 0.2, seed: int = 42, fmt: str = "parquet"
) -> DataFrame:
    """Split each ``*.csv`` of ``folder`` into train and test under ``out``.

    Returns (dataset, n_train, n_test, error); a table that fails is reported
    and the others go on.
    """
    listing = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder)
    done = []
    for (path,) in sorted(listing.select("path").collect()):
        name = path.rsplit("/", 1)[-1][: -len(".csv")]
        try:
            # keys come from the content, so rows are numbered once and the split is the same on any cluster
            rows = write_down(with_row_key(read_table(spark, path), "_key")).df
            parts = train_test_split(rows, "_key", test_size, seed).drop("_key")
            write_split(parts, out, name, fmt)
            sizes = {r["split"]: r["n"] for r in parts.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
            done.append((name, sizes.get("train", 0), sizes.get("test", 0), None))
        except (AnalysisException, SparkRuntimeException, ValueError) as e:
            done.append((name, None, None, f"{type(e).__name__}: {e}"))
    return spark.createDataFrame(done, "dataset string, n_train bigint, n_test bigint, error string")


def split_csv_files(spark: SparkSession, folder: str, out: str, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """Split every ``*.csv`` under ``folder`` into ``out/<name>/original/train.csv`` and ``test.csv``.

    All files go through the same jobs, whatever their number and columns: rows
    are lines, ranked inside their file by a hash of their content, and keep
    their order. Both parts begin with the file's header. Returns (dataset,
    n_train, n_test, error); a file without rows, or with a quoted cell that
    runs over several lines, is reported and not written.
    """
    lines = materialise(scan_lines(spark, folder, ["csv"], bare=False).withColumn("dataset", F.regexp_extract("file", r"^(.*)\.csv$", 1)))
    open_quote = F.length(F.regexp_replace("line", '[^"]', "")) % 2 == 1
    sizes = lines.groupBy("dataset").agg(
        (F.count(F.lit(1)) - 1).alias("n"), F.max(open_quote).alias("_broken"), F.max(F.when(F.col("line_no") == 0, F.col("line"))).alias("_header")
    )
    error = F.when(F.col("_broken"), "a quoted cell runs over several lines").when(F.col("n") == 0, "no rows")
    n_test = F.ceil(F.col("n") * F.lit(test_size))
    sizes = write_down(sizes.select("dataset", "n", n_test.alias("n_test"), "_header", error.alias("error")))
    rows = lookup_join(lines.filter("line_no > 0"), sizes, ["dataset"]).filter("error IS NULL")
    # equal lines are told apart by their place
    ranked = hashed_rank(rows, ["dataset"], hash_bits(seed, "split", F.col("line")), F.col("line_no"), "_rank")
    split = F.when(F.col("_rank") <= F.col("n_test"), "test").otherwise("train")
    name = F.concat_ws("/", "dataset", F.lit(ORIGINAL), F.concat(split, F.lit(".csv")))
    body = ranked.select(name.alias("file"), "line_no", "line")
    heads = sizes.df.filter("error IS NULL").select("dataset", "_header", F.explode(F.array(F.lit("train"), F.lit("test"))).alias("split"))
    heads = heads.select(F.concat_ws("/", "dataset", F.lit(ORIGINAL), F.concat("split", F.lit(".csv"))).alias("file"), F.lit(0).cast("bigint").alias("line_no"), F.col("_header").alias("line"))
    write_files(body.unionByName(heads), out)
    fine = F.col("error").isNull()
    return sizes.df.select(
        "dataset", F.when(fine, F.col("n") - F.col("n_test")).alias("n_train"), F.when(fine, F.col("n_test")).alias("n_test"), "error"
    )
