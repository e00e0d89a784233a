import math
import uuid

import pytest
from pyspark.sql import functions as F

from counterpoise.operators import evaluate as V
from counterpoise.operators.lineage import ensure_checkpoint_dir
from counterpoise.plans import evaluation, rebalance, split, sweep
from counterpoise.sources import files, tables


@pytest.fixture(scope="module")
def field(spark):
    u = F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000
    return (
        spark.range(400)
        .select(
            "id",
            F.when(u < 0.4, "f").otherwise("m").alias("sex"),
            F.element_at(F.array(F.lit("n"), F.lit("s"), F.lit("e")), (F.pmod("id", F.lit(3)) + 1).cast("int")).alias("isle"),
            (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(100)) + F.when(u < 0.4, 40).otherwise(0)).alias("size"),
            (u * 3).alias("depth"),
        )
        .cache()
    )


SMALL = {"trees": 5, "rounds": 2, "max_splits": 2}


@pytest.mark.parametrize("method", rebalance.METHODS)
def test_rebalance_is_balanced(spark, field, method):
    out = rebalance.rebalance_sweep(field, "sex", [0.05, 0.3], method, "id", categorical_cols=["isle"]).cache()
    n = {(r["pct"], r["sex"], r["is_synthetic"]): r["count"] for r in out.groupBy("pct", "sex", "is_synthetic").count().collect()}
    majority = field.filter("sex = 'm'").count()
    for pct, p in ((5, 0.05), (30, 0.3)):
        keep = int(p * majority / (1 - p))
        assert (n[pct, "m", False], n[pct, "f", False], n[pct, "f", True]) == (majority, keep, majority - keep)
        assert (pct, "m", True) not in n
    assert out.columns == [*field.columns, "method", "pct", "p", "is_synthetic"]
    assert out.filter("is_synthetic and id is not null").isEmpty()
    assert dict(out.dtypes)["size"] == "bigint"


def test_rebalance_rejects_unknown_method(field):
    with pytest.raises(ValueError, match="use one of"):
        rebalance.rebalance(field, "sex", 0.1, method="x", key="id")


def test_null_targets_in_each_method(spark, field):
    holes = field.withColumn("sex", F.when(F.col("id") >= 12, F.col("sex")))
    known = holes.filter("sex is not null")
    majority = known.filter("sex = 'm'").count()
    out = rebalance.rebalance(holes, "sex", 0.1, method="independent", key="id", categorical_cols=["isle"])
    assert out.filter("sex is null").count() == 12
    assert out.filter("sex = 'f'").count() == majority + 12
    out = rebalance.rebalance(holes, "sex", 0.1, method="smote", key="id")
    assert out.filter("sex is null").isEmpty() and out.filter("sex = 'f'").count() == majority


def test_store_and_read_variants(spark, field, tmp_path):
    path = str(tmp_path / "store")
    for method in ("independent", "smote"):
        out = rebalance.rebalance_sweep(field, "sex", [0.29, 0.3], method, "id", categorical_cols=["isle"])
        tables.write_variants(out, path, "birds", method)
    split = field.withColumn("split", F.when(F.col("id") % 5 == 0, "test").otherwise("train"))
    tables.write_split(split, path, "birds")
    stored = tables.read_variants(spark, path)
    seen = {(r["method"], r["pct"]) for r in stored.select("method", "pct").distinct().collect()}
    assert seen == {("independent", 29), ("independent", 30), ("smote", 29), ("smote", 30)}
    plan = stored.filter("method = 'smote' and pct = 29")._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and stored.filter("pct = 29").count() > 0


def test_csv_with_missing_marker(spark, tmp_path):
    (tmp_path / "d.csv").write_text("a,b\n1.5,x\n.,y\n2,.\n")
    df = tables.read_table(spark, str(tmp_path / "d.csv"), missing=tables.MISSING)
    assert dict(df.dtypes) == {"a": "double", "b": "string"}
    assert df.filter("a is null").count() == 1 and df.filter("b is null").count() == 1
    (tmp_path / "e.csv").write_text("a,b\n3,z\n")
    (tmp_path / "skip.txt").write_text("no\n")
    both = tables.read_folder(spark, str(tmp_path), schema="a string, b string")
    assert {r["dataset"]: r["count"] for r in both.groupBy("dataset").count().collect()} == {"d": 3, "e": 1}


def test_variant_parts(spark):
    df = spark.createDataFrame([("x/data/p/smote/minority_5pct_smote.csv",), ("data/p/a/other.csv",)], "f string")
    method, pct = tables.variant_parts(F.col("f"), "data/p")
    assert [tuple(r) for r in df.select(method, pct).collect()] == [("smote", 5), (None, None)]


def test_training_scores(spark, field):
    train, test = field.filter("id % 4 > 0"), field.filter("id % 4 = 0").withColumn("isle", F.when(F.col("id") > 380, "new").otherwise(F.col("isle")))
    scores = V.train_and_score(train, test, "sex", "birds", key="id", **SMALL)
    assert [s[4] for s in scores] == list(V.MODELS)
    for *_, cv_mean, cv_std, test_roc, error in scores:
        assert error is None and 0.5 < cv_mean <= 1 and cv_std >= 0 and 0.5 < test_roc <= 1
    one = V.train_and_score(train, test.filter("sex = 'm'"), "sex", "birds", key="id", models=["logistic"], max_splits=2)
    assert math.isnan(one[0][7]) and one[0][5] > 0.5
    few = train.filter("sex = 'm'").limit(40).unionByName(train.filter("sex = 'f'").limit(1))
    lone = V.train_and_score(few, test, "sex", "birds", key="id", models=["logistic"], max_splits=2)
    assert math.isnan(lone[0][5]) and lone[0][7] >= 0
    broken = V.train_and_score(train, test, "nothing", "birds", models=["logistic"], max_splits=2)
    assert math.isnan(broken[0][7]) and "nothing" in broken[0][8]


def test_fit_per_fold(spark, field):
    trained = V.train_models(field, "sex", key="id", models=["logistic"], fit_per_fold=True, max_splits=3, parallelism=3)
    assert trained.folds.count() == 3 and not trained.errors


def test_datasets_variants_and_table(spark, field, tmp_path):
    path = str(tmp_path / "data")
    split = field.drop("id").withColumn("split", F.when(F.col("depth") * 1000 % 5 < 1, "test").otherwise("train"))
    tables.write_split(split, path, "birds")
    done = evaluation.evaluate_datasets(spark, path, {"birds": "sex", "absent": "y"}, models=["logistic"], max_splits=2)
    assert [r["dataset"] for r in done.collect()] == ["birds"]
    variants = rebalance.rebalance_sweep(field, "sex", [0.2, 0.3], "independent", "id", categorical_cols=["isle"]).drop("id")
    out = evaluation.evaluate_variants(variants, field.drop("id"), "sex", "birds", runs=2, models=["logistic"], max_splits=2)
    assert out.count() == 4
    table = evaluation.tabulate(out).collect()
    assert [(r["model"], r["method"], r["pct"]) for r in table] == [("logistic", "independent", 20), ("logistic", "independent", 30)]
    assert all(r["roc_std"] >= 0 for r in table)
    runs = evaluation.repeat_runs(field, field, "sex", "birds", runs=1, models=["logistic"], key="id", max_splits=2)
    assert V.score_summary(runs, ["dataset", "model"]).first()["roc_std"] == 0


def test_threshold_sweep_over_inputs(spark):
    a = spark.createDataFrame([("f", 0, "aab"), ("f", 1, "aba"), ("f", 2, "zzz")], "file string, line_no bigint, line string")
    out = sweep.threshold_sweep({"original": a, "synthetic": a.filter("line_no > 0")}, [0.9, 1.0])
    got = {(r["input"], r["t"]): r["to_remove"] for r in out.collect()}
    assert got == {("original", 0.9): 1, ("original", 1.0): 1, ("synthetic", 0.9): 0, ("synthetic", 1.0): 0}


def test_checkpoint_folder_is_named_by_the_session(spark):
    ensure_checkpoint_dir(spark)
    assert spark.sparkContext.getCheckpointDir()


def test_split_folder(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "one.csv").write_text("a,b\n" + "".join(f"{i % 3},x\n" for i in range(33)))
    (source / "two.csv").write_text("c\n" + "".join(f"{i}\n" for i in range(10)))
    (source / "note.txt").write_text("no\n")
    got = {r["dataset"]: (r["n_train"], r["n_test"], r["error"]) for r in split.split_folder(spark, str(source), str(tmp_path / "out")).collect()}
    assert got == {"one": (26, 7, None), "two": (8, 2, None)}
    two = spark.read.parquet(f"{tmp_path}/out/original/dataset=two")
    assert sorted(r["c"] for r in two.collect()) == list(range(10)) and two.filter("split = 'test'").count() == 2


def test_many_csv_files_in_the_same_jobs(spark, tmp_path):
    def folder(name, files):
        (tmp_path / name / "sub").mkdir(parents=True)
        for k in range(files):
            (tmp_path / name / f"{'sub/' if k % 2 else ''}t {k}.csv").write_text(f"a{k},b\n" + "".join(f"{i % 3},x{k}\n" for i in range(10 + k)))
        return str(tmp_path / name)

    def jobs(name, files):
        group = uuid.uuid4().hex
        spark.sparkContext.setJobGroup(group, "count")
        found = split.split_csv_files(spark, folder(name, files), str(tmp_path / f"{name}-out")).collect()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return found, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    few, jobs_few = jobs("few", 2)
    many, jobs_many = jobs("many", 30)
    assert jobs_many == jobs_few and len(many) == 30
    for r in many:
        k = int(r.dataset.split()[-1])
        train, test = ((tmp_path / "many-out" / r.dataset / "original" / f"{s}.csv").read_text().splitlines() for s in ("train", "test"))
        assert train[0] == test[0] == f"a{k},b" and len(test) - 1 == r.n_test == math.ceil((10 + k) * 0.2)
        assert sorted(train[1:] + test[1:]) == sorted(f"{i % 3},x{k}" for i in range(10 + k)) and r.error is None
    assert not list((tmp_path / "many-out").glob("_staging*"))


def test_csv_files_that_cannot_be_split_are_named(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "good.csv").write_text("h\n" + "v\n" * 9 + "\n")
    (tmp_path / "in" / "head.csv").write_text("h\n")
    (tmp_path / "in" / "quoted.csv").write_text('h\n"a\nb"\nc\n')
    found = {r.dataset: (r.n_train, r.n_test, r.error) for r in split.split_csv_files(spark, str(tmp_path / "in"), str(tmp_path / "o")).collect()}
    assert found["good"] == (7, 2, None) and found["head"] == (None, None, "no rows") and "quoted" in found["quoted"][2]
    assert sorted(p.name for p in (tmp_path / "o").iterdir()) == ["good"]
    assert split.split_csv_files(spark, str(tmp_path / "nothing"), str(tmp_path / "o")).count() == 0


def test_files_are_written_whole_or_not_at_all(spark, tmp_path):
    rows = [(f"f {n}/x=%2F{n}.txt", i, f"line {i}") for n in range(3) for i in range(50)]
    lines = spark.createDataFrame(rows, "file string, line_no bigint, line string").repartition(7)
    out = tmp_path / "out"
    assert files.write_files(lines, str(out)) == 3
    names = {str(p.relative_to(out)) for p in out.rglob("*") if p.is_file() and not p.name.startswith(".")}
    assert names == {f for f, _, _ in rows}
    assert (out / rows[0][0]).read_text().splitlines() == [f"line {i}" for i in range(50)]
    broken = lines.withColumn("line", F.when(F.col("line_no") == 49, F.raise_error(F.lit("no"))).otherwise(F.lit("new")))
    with pytest.raises(Exception, match="no"):
        files.write_files(broken, str(out))
    assert (out / rows[0][0]).read_text().startswith("line 0") and files.write_files(lines.limit(0), str(out)) == 0
