"""Headline timings as one JSON line.

Folder from $BENCH_SF_DIR, cores from $BENCH_CPUS; names given as arguments
restrict the run. Every query is run once, results go to the noop sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from counterpoise.catalog.queries import QUERIES  # noqa: E402

HEADLINE = (
    "class_profile",
    "sweep_sample",
    "train_test_split",
    "label_encode",
    "standard_scale",
    "attribute_histogram",
    "independent_sample",
    "mutual_information",
    "correlated_sample",
    "smote_neighbors",
    "smote_rows",
    "rebalance_rows",
    "rebalance_smote",
    "char_tfidf",
    "neardup_report",
    "neardup_corpus_report",
    "neardup_sweep",
    "stratified_folds",
    "roc_auc_large",
    "train_and_score",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.driver.memory", "20g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1_000).selectExpr("sum(id)").collect()  # the session is up before the clock starts
    names = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": folder.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
