from pyspark.sql import functions as F

from counterpoise.operators.lookup import lookup_join


def test_null_keys_are_spread(spark):
    """90 % null keys: the shuffled branch keeps them, and not in one place."""
    df = spark.range(20_000).select(F.when(F.col("id") % 10 == 0, F.col("id") % 50).alias("k"), "id")
    table = spark.range(50).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = lookup_join(df, table, ["k"], "left", small=False, hot_rows=100).cache()
        parts = [r["count"] for r in out.filter("k IS NULL").groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert out.count() == 20_000 and out.filter("v = 2 * k").count() == 2_000
        assert len(parts) > 1 and max(parts) < 2 * 18_000 / len(parts)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
