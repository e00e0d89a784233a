"""name -> (spark, folder) -> DataFrame. Each reads whole tables."""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from counterpoise.operators import boosting, descent, logistic
from counterpoise.operators import describe as D
from counterpoise.operators import encode as E
from counterpoise.operators import evaluate as V
from counterpoise.operators import generate as G
from counterpoise.operators import neardup as N
from counterpoise.operators import ranking as R
from counterpoise.operators import sampling as S
from counterpoise.operators import smote as K
from counterpoise.operators.lineage import ensure_checkpoint_dir, fan_out, materialise, shuffle_partitions
from counterpoise.plans import evaluation
from counterpoise.plans.evaluation import evaluate_variants, tabulate
from counterpoise.plans.rebalance import METHODS, PROPORTIONS, rebalance_sweep
from counterpoise.plans.sweep import threshold_sweep
from counterpoise.sources.tables import read_split, read_variants, variant_parts, write_split, write_variants
from counterpoise.sources.text import corpus_lines, read_lines, text_column_lines, write_survivor_files, write_survivors

KEYS_PER_TASK = 1_000_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{name}-{uuid.uuid4().hex}"


def documents(spark, folder) -> DataFrame:
    """documents without their text, with the binary target is_en."""
    docs = table(spark, folder, "documents")
    return docs.select("doc_id", "lang", "source", "n_chars", (F.col("lang") == "en").alias("is_en"))


def labelled(spark, folder) -> DataFrame:
    """documents that carry labels, with counts as features."""
    docs = table(spark, folder, "documents").select(
        "doc_id",
        "lang",
        "source",
        "n_chars",
        F.size(F.split("text", " ")).alias("n_blanks"),
        F.size(F.split("text", "\n")).alias("n_lines"),
    )
    return docs.join(table(spark, folder, "labels").select("doc_id", "toxic"), "doc_id")


# --- profile, sampling, splitting -----------------------------------------------


def class_profile(spark, folder):
    parts = []
    for name, df, target in (
        ("documents", documents(spark, folder), "is_en"),
        ("labels", table(spark, folder, "labels"), "toxic"),
    ):
        counts = S.class_counts(df, target)
        parts.append(counts.select(F.lit(name).alias("name"), F.col("label").cast("string").alias("label"), "n"))
    return parts[0].unionByName(parts[1])


def rebalance_plan(spark, folder):
    a = S.rebalance_plan(documents(spark, folder), "is_en", PROPORTIONS).withColumn("name", F.lit("documents"))
    b = S.rebalance_plan(table(spark, folder, "labels"), "toxic", PROPORTIONS).withColumn("name", F.lit("labels"))
    return a.unionByName(b)


def minority_sample(spark, folder):
    docs = documents(spark, folder)
    profile = S.class_profile(docs, "is_en")
    rare, _ = S.split_by_class(docs, "is_en", profile.minority)
    return S.exact_sample(rare, S.kept_rows(profile.n_majority, 0.2), "doc_id").select("doc_id", "lang")


def sweep_sample(spark, folder):
    return S.sweep_samples(documents(spark, folder), "is_en", PROPORTIONS, "doc_id").select("pct", "doc_id", "is_en")


def train_test_split(spark, folder):
    return S.train_test_split(table(spark, folder, "orders").select("o_orderkey"), "o_orderkey")


def sample_repeated_key(spark, folder):
    """A third of lineitem by a key that repeats: exactly so many rows, counted by key."""
    items = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    sample = S.exact_sample(items, items.count() // 3, "l_orderkey")
    return sample.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


def split_stored(spark, folder):
    """The split of orders, written as partitions and read back."""
    out = scratch(spark, "split")
    write_split(train_test_split(spark, folder), out, "orders")
    return read_split(spark, out).select("o_orderkey", "split")


def variants_stored(spark, folder):
    """The kept rows of all variants, written by dataset, method and proportion, and read back."""
    out = scratch(spark, "variants")
    write_variants(sweep_sample(spark, folder), out, "documents", "kept")
    return read_variants(spark, out).select("dataset", "method", "pct", "doc_id", "is_en")


def survivors_stored(spark, folder):
    """Deduplicated files as they are on disk: lines of each file that lost some."""
    out = scratch(spark, "survivors")
    write_survivors(N.NearDuplicates(_by_document(spark, folder), [0.99]).lines(0.99), out)
    return spark.read.text(out).groupBy("file").agg(F.count(F.lit(1)).alias("n_lines"))


def survivor_files(spark, folder):
    """Deduplicated files under their own names in a mirrored tree, read back as text."""
    out = scratch(spark, "files")
    lines = N.NearDuplicates(_by_document(spark, folder), [0.99]).lines(0.99)
    name = F.concat(F.lit("d"), F.substring("file", 1, 1), F.lit("/"), "file", F.lit(".txt"))
    write_survivor_files(lines.withColumn("file", name), out)
    # Spark reads a folder of files; the place of a file is its name
    back = read_lines(spark, out)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    return back.groupBy("file").agg(F.count(F.lit(1)).alias("n_lines"), F.md5(text).alias("digest"))


def null_safe_split(spark, folder):
    joined = documents(spark, folder).select("doc_id").join(table(spark, folder, "labels"), "doc_id", "left")
    rare, rest = S.split_by_class(joined.select("doc_id", "toxic"), "toxic", 1)
    return rare.withColumn("side", F.lit("minority")).unionByName(rest.withColumn("side", F.lit("majority")))


def complete_cases(spark, folder):
    joined = documents(spark, folder).join(table(spark, folder, "labels"), "doc_id", "left")
    return S.complete_cases(joined).select("doc_id", "lang", "quality", "toxic")


def missing_marker(spark, folder):
    orders = table(spark, folder, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "P", ".").otherwise(F.col("o_orderstatus")).alias("status")
    )
    return S.complete_cases(orders, missing=".")


def row_keys(spark, folder):
    items = table(spark, folder, "lineitem").select("l_quantity", "l_returnflag", "l_linestatus")
    # keys are all different, so a task's table of them is as large as its share of the rows
    parts = max(shuffle_partitions(spark), -(-items.count() // KEYS_PER_TASK))
    keyed = R.with_row_key(items).repartition(parts, "row_key")
    return keyed.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("row_key").alias("n_keys"))


# --- encoding and scaling -------------------------------------------------------


def label_encode(spark, folder):
    part = table(spark, folder, "part").select("p_partkey", "p_brand", "p_type")
    return E.LabelEncoder.fit(part, ["p_brand", "p_type"]).transform(part)


def unseen_fallback(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("cust"), "o_orderdate")
    early = F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz")
    encoder = E.LabelEncoder.fit(orders.filter(early), ["cust"])
    return encoder.transform(orders.filter(~early).select("o_orderkey", "cust"))


def standard_scale(spark, folder):
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    items = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", *cols)
    scaled = E.StandardScaler.fit(items, cols).transform(items)
    return scaled.withColumns({c: F.round(c, 6) for c in cols})


def round_clip_decode(spark, folder):
    part = table(spark, folder, "part").select("p_partkey", "p_type", (F.col("p_size") * 0.5 - 2).alias("x"))
    encoder = E.LabelEncoder.fit(part, ["p_type"])
    return encoder.decode(part.select("p_partkey", F.col("x").alias("p_type")))


# --- attribute models -----------------------------------------------------------


def column_typing(spark, folder):
    kinds = [
        (name, a.name, a.kind, a.distinct if a.kind == "categorical" else None, a.missing)
        for name, df in (
            ("customer", table(spark, folder, "customer")),
            ("part", table(spark, folder, "part")),
        )
        for a in D.column_kinds(df)
    ]
    return spark.createDataFrame(kinds, "name string, attr string, kind string, n_categories bigint, missing bigint")


def _customer(spark, folder):
    return table(spark, folder, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")


def attribute_histogram(spark, folder):
    df = _customer(spark, folder).drop("c_custkey")
    dist = D.attribute_distribution(df, D.column_kinds(df))
    return dist.select("attr", "bin", "value", "n", *[F.round(c, 6).alias(c) for c in ("prob", "lo", "hi")])


def histogram_missing(spark, folder):
    """NaN counts as missing, and decimals and short integers are numbers."""
    value = F.when(F.col("value") < 0.05, F.lit(float("nan"))).otherwise(F.col("value"))
    events = table(spark, folder, "events").select(value.alias("value"))
    items = table(spark, folder, "lineitem")
    items = items.select(F.col("l_extendedprice").cast("decimal(15,2)").alias("price"), F.col("l_quantity").cast("smallint").alias("quantity"))
    parts = []
    for df in (events, items):
        kinds = D.column_kinds(df)
        missing = F.create_map(*[x for a in kinds for x in (F.lit(a.name), F.lit(a.missing))])
        counts = D.attribute_counts(df, kinds)
        parts.append(counts.select("attr", "bin", "n", missing[F.col("attr")].alias("missing")))
    return parts[0].unionByName(parts[1])


def laplace_noise(spark, folder):
    df = _customer(spark, folder).drop("c_custkey")
    dist = D.attribute_distribution(df, D.column_kinds(df), epsilon=0.5)
    return dist.select("attr", "bin", "value", F.round("prob", 6).alias("prob"))


def independent_sample(spark, folder):
    df = _customer(spark, folder)
    out = G.synthesize(df, df.count(), "independent", key_cols=["c_custkey"])
    return out.withColumn("c_acctbal", F.round("c_acctbal", 6))


def _orders_binned(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderstatus", "o_totalprice", "o_orderpriority")
    return D.bin_table(orders, D.column_kinds(orders))


def mutual_information(spark, folder):
    return D.mutual_information(_orders_binned(spark, folder)).withColumn("mi", F.round("mi", 6))


def bayes_network(spark, folder):
    edges = D.learn_network(_orders_binned(spark, folder)).frame(spark)
    return edges.withColumn("parents", F.concat_ws(",", "parents"))


PART_NETWORK = D.Network([("p_brand", ()), ("p_type", ("p_brand",)), ("p_retailprice", ("p_brand", "p_type"))])


def _part(spark, folder):
    return table(spark, folder, "part").select("p_partkey", "p_brand", "p_type", "p_retailprice")


def conditional_table(spark, folder):
    part = _part(spark, folder).drop("p_partkey")
    table_ = D.bin_table(part, D.column_kinds(part))
    cpt = D.conditional_tables(table_, PART_NETWORK)
    return cpt.select("attr", "parent_key", "bin", "n", F.round("prob", 6).alias("prob"))


def correlated_sample(spark, folder):
    part = _part(spark, folder)
    out = G.synthesize(part, part.count(), "correlated", key_cols=["p_partkey"], network=PART_NETWORK)
    return out.withColumn("p_retailprice", F.round("p_retailprice", 6))


def correlated_learned(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    return G.synthesize(orders, orders.count(), "correlated", key_cols=["o_orderkey"])


# --- SMOTE ----------------------------------------------------------------------


def _vectors(spark, folder):
    rows = table(spark, folder, "embeddings")
    return rows.select(F.col("vec_id").alias("key"), F.col("embedding").cast("array<double>").alias("vec"), "label")


def smote_neighbors(spark, folder):
    near = K.nearest_neighbours(_vectors(spark, folder).select("key", "vec"), 5)
    return near.withColumn("dist", F.round("dist", 6))


def descent_recall(spark, folder):
    """Neighbours of all embeddings by descent against the exact search: rows, and whether nine in ten are found."""
    rows = table(spark, folder, "embeddings").filter("embedding IS NOT NULL").select(F.col("vec_id").alias("key"), F.col("embedding").cast("array<double>").alias("vec"))
    exact = K.nearest_neighbours(rows, 5).select("key", "neighbour", F.lit(1).alias("hit"))
    found = descent.descend(rows, 5).join(exact, ["key", "neighbour"], "left")
    counted = found.agg(F.count_distinct("key").alias("n_rows"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
    return counted.select("n_rows", (F.col("recall") >= 0.9).alias("nine_in_ten"))


def smote_rows(spark, folder):
    """Interpolated vectors of the rarest label, as many as the table has rows."""
    rows = _vectors(spark, folder)
    rare = S.class_counts(rows, "label").agg(F.min(F.struct("n", "label")).alias("low")).first()["low"]["label"]
    new = K.interpolate(rows.filter(F.col("label") == rare).select("key", "vec"), rows.count(), 5)
    return new.select(
        "seq", "base", "neighbour", F.round("gap", 6).alias("gap"), F.posexplode("vec").alias("pos", "x")
    ).withColumn("x", F.round("x", 6))


def smote_table(spark, folder):
    """Mixed columns: codes, whole numbers and the label, brought to balance."""
    return K.smote(labelled(spark, folder), "toxic", categorical_cols=["lang", "source"], key="doc_id")


# --- rebalance ------------------------------------------------------------------


def _balance(spark, folder, method):
    """All six proportions of is_en: rows of each class, and a sum over the real ones that tells which they are."""
    df = documents(spark, folder).drop("lang")
    out = rebalance_sweep(df, "is_en", PROPORTIONS, method, "doc_id", categorical_cols=["source"])
    real = F.when(~F.col("is_synthetic"), F.col("doc_id") * F.col("n_chars"))
    low, high = F.min("n_chars"), F.max("n_chars")
    bounds = df.groupBy("is_en").agg(low.alias("low"), high.alias("high"))
    inside = F.col("n_chars").between(F.col("low"), F.col("high"))
    out = out.join(F.broadcast(bounds), "is_en")  # two rows
    return out.groupBy("method", "pct", "is_en", "is_synthetic").agg(
        F.count(F.lit(1)).alias("n"), F.sum(real).cast("bigint").alias("checksum"), F.min(inside).alias("in_range")
    )


def rebalance_independent(spark, folder):
    return _balance(spark, folder, "independent")


def rebalance_correlated(spark, folder):
    return _balance(spark, folder, "correlated")


def rebalance_smote(spark, folder):
    return _balance(spark, folder, "smote")


def rebalance_rows(spark, folder):
    """All six proportions of is_en, independent mode, row by row."""
    return rebalance_sweep(documents(spark, folder).drop("lang"), "is_en", PROPORTIONS, "independent", "doc_id", categorical_cols=["source"])


# --- near-duplicate lines -------------------------------------------------------


def _texts(spark, folder, name, key):
    return fan_out(table(spark, folder, name).select(key, "text"), key)


def _by_document(spark, folder):
    return text_column_lines(_texts(spark, folder, "documents", "doc_id"), "text", "doc_id")


def _benchmark(spark, folder):
    return corpus_lines(_texts(spark, folder, "benchmark", "item_id"), "text", "item_id", "benchmark")


def _corpus(spark, folder):
    return corpus_lines(_texts(spark, folder, "documents", "doc_id"), "text", "doc_id", "documents")


def line_clean(spark, folder):
    return _by_document(spark, folder)


def char_tfidf(spark, folder):
    return N.char_tfidf(_by_document(spark, folder)).withColumn("weight", F.round("weight", 6))


def neardup_pairs(spark, folder):
    found = N.NearDuplicates(_by_document(spark, folder), 0.99).pairs()
    return found.withColumn("sim", F.round("sim", 6))


def neardup_corpus_pairs(spark, folder):
    """Pairs over all lines of all documents as one file, counted per first line."""
    counted = lambda found: found.groupBy("src").agg(F.count(F.lit(1)).alias("n_profiles"), F.sum("n_pairs").alias("n_pairs"))
    found = N.NearDuplicates(_corpus(spark, folder), 0.99).pairs(counted)
    return found.groupBy("src").agg(F.sum("n_profiles").alias("n_profiles"), F.sum("n_pairs").alias("n_pairs"))


def neardup_groups(spark, folder):
    return N.NearDuplicates(_by_document(spark, folder), 0.95).groups().drop("t")


def neardup_report(spark, folder):
    report = N.NearDuplicates(_by_document(spark, folder), 0.99).report()
    return report.drop("compute_time").withColumn("estimated_n", F.round("estimated_n", 6))


def neardup_totals(spark, folder):
    return N.report_totals(N.NearDuplicates(_by_document(spark, folder), [0.97, 1.0]).report())


def neardup_corpus_report(spark, folder):
    return N.NearDuplicates(_corpus(spark, folder), 0.99).report().drop("compute_time")


def neardup_kmeans(spark, folder):
    return N.NearDuplicates(_by_document(spark, folder), 0.95, blocking="kmeans").report().drop("compute_time")


def kmeans_invariants(spark, folder):
    """Per document: lines in its clusters, clusters asked for, whether used ones are as few, pairs that exact search does not find."""
    lines = _by_document(spark, folder)
    near = N.NearDuplicates(lines, 0.95, blocking="kmeans")
    found = near.pairs().select("file", "src", "dst")
    strays = found.join(N.NearDuplicates(lines, 0.95).pairs(), ["file", "src", "dst"], "left_anti")
    strays = strays.groupBy("file").agg(F.count(F.lit(1)).alias("strays"))
    used = near.cells().groupBy("file").agg(F.sum("weight").alias("num_rows"), F.count_distinct("cell").alias("used"))
    used = used.withColumn("num_clusters", N.cluster_count(F.col("num_rows")))
    out = used.join(strays, "file", "left")
    return out.select("file", "num_rows", "num_clusters", (F.col("used") <= F.col("num_clusters")).alias("within"), F.coalesce("strays", F.lit(0).cast("bigint")).alias("strays"))


def dedup_lines(spark, folder):
    return N.NearDuplicates(_by_document(spark, folder), 0.99).survivors()


def neardup_sweep(spark, folder):
    return threshold_sweep({"benchmark": _benchmark(spark, folder), "documents": _by_document(spark, folder)})


# --- evaluation -----------------------------------------------------------------


def stratified_folds(spark, folder):
    return V.stratified_folds(table(spark, folder, "labels").select("doc_id", "toxic"), "toxic", "doc_id")


def roc_auc_by_group(spark, folder):
    docs = documents(spark, folder).join(table(spark, folder, "labels"), "doc_id")
    a = V.roc_auc(docs, "n_chars", "toxic", ["lang"]).withColumnRenamed("lang", "name")
    customer = table(spark, folder, "customer").withColumn("label", (F.col("c_acctbal") > 4000).cast("int"))
    b = V.roc_auc(customer, "c_nationkey", "label", ["c_mktsegment"]).withColumnRenamed("c_mktsegment", "name")
    return a.unionByName(b).withColumn("auc", F.round("auc", 6))


def roc_auc_large(spark, folder):
    items = table(spark, folder, "lineitem").select("l_extendedprice", (F.col("l_linestatus") == "O").cast("int").alias("label"))
    return V.roc_auc(items, "l_extendedprice", "label").withColumn("auc", F.round("auc", 6))


def _scores(spark, folder):
    value = F.when(F.col("value") < 0.05, F.lit(float("nan"))).otherwise(F.col("value"))
    return table(spark, folder, "events").select("event_type", "user_id", value.alias("auc"))


def cv_summary(spark, folder):
    out = V.cv_summary(_scores(spark, folder), ["event_type", "user_id"])
    return out.withColumns({c: F.round(c, 6) for c in ("cv_mean", "cv_std")})


def run_summary(spark, folder):
    out = tabulate(_scores(spark, folder).withColumnRenamed("auc", "test_roc"), ["event_type", "user_id"])
    return out.withColumns({c: F.round(c, 6) for c in ("roc_mean", "roc_std")})


def variant_paths(spark, folder):
    part = table(spark, folder, "part")
    path = F.concat_ws("", F.lit("data/"), "p_name", F.lit("/"), "p_type", F.lit("/minority_"), F.col("p_size").cast("string"), F.lit("pct_smote.csv"))
    method, pct = variant_parts(path, "data/[a-z ]+")
    return part.select("p_partkey", method.alias("method"), pct.alias("pct"))


def train_and_score(spark, folder):
    # texts are read once: what follows needs their counts many times
    rows = S.train_test_split(materialise(labelled(spark, folder)), "doc_id")
    train, test = (rows.filter(F.col("split") == s).drop("split") for s in ("train", "test"))
    scores = V.train_and_score(train, test, "toxic", "documents", key="doc_id")
    return spark.createDataFrame(scores, V.SCORES)


def _shipments(spark, folder) -> tuple[DataFrame, dict]:
    """lineitem as training sets: four tables by supplier, three folds by line, open lines the positive class."""
    items = table(spark, folder, "lineitem").select(
        F.pmod("l_suppkey", F.lit(4)).cast("bigint").alias("v"),
        F.xxhash64("l_orderkey", "l_linenumber").alias("row"),
        F.pmod("l_linenumber", F.lit(3)).cast("int").alias("part"),
        (F.col("l_linestatus") == "O").cast("double").alias("label"),
        F.array(*[F.col(c).cast("double") / s for c, s in (("l_quantity", 50), ("l_discount", 0.1), ("l_tax", 0.1))]).alias("x"),
    )
    items = materialise(items)
    counted = items.groupBy("v", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("label").cast("int").alias("positive")).collect()
    sizes = {}
    for r in counted:
        for f in {-1, 0, 1, 2} - {r["part"]}:
            n, positive = sizes.get((r["v"], f), (0, 0))
            sizes[r["v"], f] = (n + r["n"], positive + r["positive"])
    return items, sizes


def logistic_sums(spark, folder):
    """Loss, gradient and Hessian of every training set of lineitem at given coefficients."""
    items, sizes = _shipments(spark, folder)
    found = logistic.newton_sums(items, dict.fromkeys(sizes, np.array([0.5, -0.25, 0.1, 0.2])), dict.fromkeys(sizes, (1.0, 2.0)))
    return found.select("v", "f", F.col("i").cast("int").alias("i"), F.round("value", 4).alias("value"))


def boosting_roots(spark, folder):
    """The first split of the first tree of every training set of lineitem."""
    items, sizes = _shipments(spark, folder)
    found = boosting.root_splits(items, sizes, 3)
    out = spark.createDataFrame(found, "v bigint, f int, feature int, edge double, gain double")
    return out.withColumns({c: F.round(c, 4) for c in ("edge", "gain")})


def _variants(spark, folder) -> tuple[DataFrame, DataFrame]:
    """Every method and proportion of is_en, without the key, and the untouched test rows."""
    rows = materialise(S.train_test_split(documents(spark, folder).drop("lang"), "doc_id"))
    train, test = (rows.filter(F.col("split") == s).drop("split") for s in ("train", "test"))
    variants = [rebalance_sweep(train, "is_en", PROPORTIONS, m, "doc_id", categorical_cols=["source"]) for m in METHODS]
    return materialise(reduce(lambda a, b: a.unionByName(b), variants)).drop("doc_id"), test.drop("doc_id")


def score_variants(spark, folder):
    """Every method and proportion of is_en, scored by all three models."""
    return tabulate(evaluate_variants(*_variants(spark, folder), "is_en", "documents"))


def variant_folds(spark, folder):
    """Rows and positive rows that each fold of each variant scores, and the test rows."""
    return evaluation.variant_folds(*_variants(spark, folder), "is_en")


QUERIES = {
    f.__name__: f
    for f in (
        class_profile,
        rebalance_plan,
        minority_sample,
        sweep_sample,
        train_test_split,
        sample_repeated_key,
        split_stored,
        variants_stored,
        survivors_stored,
        survivor_files,
        null_safe_split,
        complete_cases,
        missing_marker,
        row_keys,
        label_encode,
        unseen_fallback,
        standard_scale,
        round_clip_decode,
        column_typing,
        attribute_histogram,
        histogram_missing,
        laplace_noise,
        independent_sample,
        mutual_information,
        bayes_network,
        conditional_table,
        correlated_sample,
        correlated_learned,
        smote_neighbors,
        descent_recall,
        smote_rows,
        smote_table,
        rebalance_independent,
        rebalance_correlated,
        rebalance_smote,
        rebalance_rows,
        line_clean,
        char_tfidf,
        neardup_pairs,
        neardup_corpus_pairs,
        neardup_groups,
        neardup_report,
        neardup_totals,
        neardup_corpus_report,
        neardup_kmeans,
        kmeans_invariants,
        dedup_lines,
        neardup_sweep,
        stratified_folds,
        roc_auc_by_group,
        roc_auc_large,
        cv_summary,
        run_summary,
        variant_paths,
        train_and_score,
        score_variants,
        variant_folds,
        logistic_sums,
        boosting_roots,
    )
}
