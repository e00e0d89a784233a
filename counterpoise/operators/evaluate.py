"""Folds, exact ROC AUC, and training and scoring of three classifiers."""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from statistics import fmean, pstdev

from pyspark.errors import AnalysisException, IllegalArgumentException
from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from counterpoise.functions.hashing import hash_bits, uniform
from counterpoise.operators.encode import LabelEncoder, StandardScaler, numeric_columns, string_columns
from counterpoise.operators.lineage import ensure_checkpoint_dir, side_by_side, write_down
from counterpoise.operators.ranking import hashed_rank, running_sum, with_row_key
from counterpoise.operators.sampling import complete_cases, require_column
from counterpoise.operators.training_sets import TABLE, fold_count, model_scores, training_sets

# Names of the models in result tables.
MODELS = ("logistic", "random_forest", "hist_gradient")


def stratified_folds(df: DataFrame, target: str, key: str, max_splits: int = 5, seed: int = 42) -> DataFrame | None:
    """Adds ``fold``: rows of each class dealt out evenly in a seeded random order."""
    smallest = df.groupBy(target).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n")).first()[0] or 0
    k = fold_count(smallest, max_splits)
    if k is None:
        return None
    ranked = hashed_rank(df, [target], hash_bits(seed, "fold", F.col(key)), F.col(key), "_rank")
    return ranked.withColumn("fold", F.pmod(F.col("_rank") - 1, F.lit(k)).cast("int")).drop("_rank")


def roc_auc(df: DataFrame, score: str, label: str, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """(by, n_pos, n_neg, auc): exact area under the ROC curve, a tie counting one half.

    A row stands for ``weight`` equal rows, if that column is named.

    Rows are first counted per distinct score, so a score shared by much of the
    table is one row from there on. NaN when a class is missing.
    """
    by = list(by)
    scope = by or ["_all"]
    rows = df if by else df.withColumn("_all", F.lit(0))
    positive, many = F.col(label).cast("bigint"), F.col(weight) if weight else F.lit(1)
    counts = rows.groupBy(*scope, F.col(score).alias("_s")).agg(
        F.sum(positive * many).alias("_pos"), F.sum((1 - positive) * many).alias("_neg")
    )
    summed = running_sum(counts, scope, ["_s"], {"_upto": "_neg"})
    below = F.col("_upto").cast("double") - F.col("_neg") / 2
    out = summed.groupBy(*scope).agg(
        F.sum("_pos").alias("n_pos"), F.sum("_neg").alias("n_neg"), F.sum(F.col("_pos") * below).alias("_won")
    )
    pairs = F.col("n_pos").cast("double") * F.col("n_neg")
    auc = F.when(pairs > 0, F.col("_won") / F.nullif(pairs, F.lit(0.0))).otherwise(F.lit(float("nan")))
    return out.select(*by, "n_pos", "n_neg", auc.alias("auc"))


def nan_ignoring(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def cv_summary(folds: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean and population deviation over folds; NaN folds are left out, all-NaN stays NaN."""
    x = nan_ignoring(F.col("auc"))
    nan = F.lit(float("nan"))
    return folds.groupBy(*by).agg(
        F.coalesce(F.avg(x), nan).alias("cv_mean"), F.coalesce(F.stddev_pop(x), nan).alias("cv_std")
    )


def score_summary(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean and population deviation of ``test_roc`` over runs; here a NaN makes its group NaN."""
    return scores.groupBy(*by).agg(F.avg("test_roc").alias("roc_mean"), F.stddev_pop("test_roc").alias("roc_std"))


# --- models ---------------------------------------------------------------------


@dataclass
class Preprocessor:
    """Scaling and encoding fitted on training rows, reused as it is on test rows."""

    target: str
    features: list[str]
    scaler: StandardScaler
    encoder: LabelEncoder | None
    target_encoder: LabelEncoder

    @classmethod
    def fit(cls, train: DataFrame, target: str, skip: Sequence[str] = ()) -> Preprocessor:
        features = [c for c in train.columns if c != target and c not in skip]
        x = train.select(*features)
        labelled = string_columns(x)
        return cls(
            target,
            features,
            StandardScaler.fit(x, numeric_columns(x)),
            LabelEncoder.fit(x, labelled) if labelled else None,
            LabelEncoder.fit(train, [target]),
        )

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """(keep, label, features); codes enter as plain numbers, without nominal metadata."""
        out = self.scaler.transform(df.select(*keep, *self.features, self.target))
        if self.encoder:
            out = self.encoder.transform(out)
        out = self.target_encoder.transform(out)
        out = out.withColumns({c: F.col(c).cast("double") for c in self.features})
        out = VectorAssembler(inputCols=self.features, outputCol="_x", handleInvalid="keep").transform(out)
        return out.select(*keep, F.col(self.target).cast("double").alias("label"), F.col("_x").alias("features"))


def classifiers(
    n: int, seed: int, trees: int = 100, rounds: int = 100, max_depth: int = 30, early_stopping: bool = False
) -> dict[str, object]:
    """The three estimators. ``n`` is the number of training rows, which sets the ridge.

    ``early_stopping`` lets boosting hold out a tenth of the rows and stop when
    they improve no more; without it all rounds run, at any size.
    """
    boosting = GBTClassifier(
        maxIter=rounds, stepSize=0.1, maxDepth=5, maxBins=255, minInstancesPerNode=20, seed=seed, validationTol=1e-7
    )
    if early_stopping:
        boosting = boosting.setValidationIndicatorCol("held_out")
    return {
        "logistic": LogisticRegression(
            weightCol="weight", regParam=1.0 / max(n, 1), elasticNetParam=0.0, standardization=False, maxIter=10_000
        ),
        "random_forest": RandomForestClassifier(
            numTrees=trees, featureSubsetStrategy="sqrt", maxDepth=max_depth, seed=seed
        ),
        "hist_gradient": boosting,
    }


def stored(model: Model, spark: SparkSession) -> Model:
    """The model as saved and read back: durable, and free of its training summary.

    A summary refers to the session, which cannot travel to the executors with
    the model. Models without one are returned as they are.
    """
    if not getattr(model, "hasSummary", False):
        return model
    path = f"{spark.sparkContext.getCheckpointDir()}/models/{uuid.uuid4().hex}"
    model.save(path)
    return type(model).load(path)


def scored(model: Model, rows: DataFrame, *tags: Column) -> DataFrame:
    probability = F.element_at(vector_to_array("probability"), 2)
    return model.transform(rows).select(*tags, "label", probability.alias("score"))


@dataclass
class TrainedModels:
    preprocessor: Preprocessor
    models: dict[str, Model]
    errors: dict[str, str]
    folds: DataFrame | None  # (model, fold, n_pos, n_neg, auc)

    def cv(self) -> dict[str, tuple[float, float]]:
        if self.folds is None:
            return {}
        return {r["model"]: (r["cv_mean"], r["cv_std"]) for r in cv_summary(self.folds, ["model"]).collect()}

    def test(self, test: DataFrame) -> DataFrame:
        """(model, n_pos, n_neg, auc) on the complete test rows, prepared with the training statistics."""
        ready = write_down(self.preprocessor.transform(complete_cases(test, missing=".")))
        parts = [scored(m, ready.df, F.lit(name).alias("model")) for name, m in self.models.items()]
        union = parts[0]
        for part in parts[1:]:
            union = union.unionByName(part)
        return roc_auc(union, "score", "label", ["model"])


def _balancing(per_class: dict[float, int]) -> Column:
    """Row weights that give each class the same mass."""
    n = sum(per_class.values())
    weight = F.lit(1.0)
    for value, size in per_class.items():
        weight = F.when(F.col("label") == value, F.lit(n / (2.0 * size))).otherwise(weight)
    return weight


def train_models(
    train: DataFrame,
    target: str,
    key: str | None = None,
    seed: int = 42,
    max_splits: int = 5,
    models: Sequence[str] = MODELS,
    parallelism: int = 4,
    fit_per_fold: bool = False,
    **sizes,
) -> TrainedModels:
    """Cross-validated scores of the models and their fit on all rows.

    Encoders and scaler are fitted on all training rows before the folds are
    cut; ``fit_per_fold`` fits them inside each fold. ``sizes`` goes to
    :func:`classifiers`. A model that fails is reported, not dropped silently.
    """
    require_column(train, target)
    spark = train.sparkSession
    ensure_checkpoint_dir(spark)
    rows = complete_cases(train, missing=".")
    if key is None:
        rows, key = with_row_key(rows, "_key"), "_key"
    rows = write_down(rows).df
    counts = {r[target]: r["n"] for r in rows.groupBy(target).agg(F.count(F.lit(1)).alias("n")).limit(3).collect()}
    if len(counts) > 2:
        raise ValueError("target must have 2 classes")
    folded = stratified_folds(rows, target, key, max_splits, seed) if len(counts) > 1 else None
    k = fold_count(min(counts.values()), max_splits) if folded is not None else 0
    prep = Preprocessor.fit(rows, target, skip=[key])

    def ready(p: Preprocessor, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        out = p.transform(df, keep)
        per_class = {r["label"]: r["n"] for r in out.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
        return out.withColumn("weight", _balancing(per_class)).withColumn("held_out", uniform(seed, "held out", F.col(keep[0])) < 0.1)

    prepared = write_down(ready(prep, folded if folded is not None else rows, [key, "fold"] if k else [key]))
    n = prepared.rows

    cells = prepared.df.groupBy("fold", "label").agg(F.count(F.lit(1)).alias("n")).collect() if k and not fit_per_fold else []

    def weight_without(f: int) -> Column:
        """Classes balanced inside a fit: the fold left out does not count."""
        per_class: dict[float, int] = {}
        for r in cells:
            if r["fold"] != f:
                per_class[r["label"]] = per_class.get(r["label"], 0) + r["n"]
        return _balancing(per_class)

    def fit_all(name: str):
        return stored(classifiers(n, seed, **sizes)[name].fit(prepared.df), spark)

    def fit_fold(task: tuple[str, int]) -> DataFrame:
        name, f = task
        tags = (F.lit(name).alias("model"), F.lit(f).alias("fold"))
        if fit_per_fold:
            inside, outside = folded.filter(F.col("fold") != f), folded.filter(F.col("fold") == f)
            p = Preprocessor.fit(inside.drop("fold"), target, skip=[key])
            inside, outside = ready(p, inside, [key]), p.transform(outside)
        else:
            inside, outside = prepared.df.filter(F.col("fold") != f), prepared.df.filter(F.col("fold") == f)
            inside = inside.withColumn("weight", weight_without(f))
        model = classifiers(max(1, n - n // k), seed, **sizes)[name].fit(inside)
        return scored(stored(model, spark), outside, *tags)

    def attempt(task):
        try:
            return (fit_all(task) if isinstance(task, str) else fit_fold(task)), None
        except (ValueError, IllegalArgumentException, AnalysisException) as e:
            return None, f"{type(e).__name__}: {e}"

    jobs = [(name, f) for name in models for f in range(k)]
    results = side_by_side(spark, attempt, [*jobs, *models], parallelism)
    fold_results, full_results = results[: len(jobs)], results[len(jobs) :]
    fitted, errors = {}, {}
    for name, (model, error) in zip(models, full_results):
        if error:
            errors[name] = error
        else:
            fitted[name] = model
    for (name, f), (_, error) in zip(jobs, fold_results):
        if error:
            errors.setdefault(name, f"fold {f}: {error}")
    parts = [part for part, _ in fold_results if part is not None]
    folds = None
    if parts:
        union = parts[0]
        for part in parts[1:]:
            union = union.unionByName(part)
        folds = write_down(roc_auc(union, "score", "label", ["model", "fold"])).df
    return TrainedModels(prep, fitted, errors, folds)


SCORES = (
    "dataset string, method string, pct int, run int, model string, cv_mean double, cv_std double, "
    "test_roc double, error string"
)


def score_tables(
    tables: DataFrame,
    test: DataFrame,
    target: str,
    models: Sequence[str] = MODELS,
    key: str | None = None,
    seed: int = 42,
    max_splits: int = 5,
    **sizes,
) -> dict[int, dict[str, tuple[float, float, float, str | None]]]:
    """Per table and model (cv_mean, cv_std, test_roc, error), all tables in the same jobs.

    ``tables`` carries the number of the table in the column ``TABLE``; ``sizes``
    (trees, rounds, local_rows) goes to :func:`model_scores`. Of a table that
    cannot be used the error says why, and its scores are NaN.
    """
    sets = training_sets(tables, test, target, key, seed, max_splits)
    parts = [model_scores(sets, m, seed, **sizes).withColumn("model", F.lit(m)) for m in models]
    found: dict[tuple[int, str], dict[int, float]] = {}
    # a row for each model, table and fold
    for r in roc_auc(reduce(DataFrame.unionByName, parts), "score", "label", ["model", "v", "f"], "n").collect():
        found.setdefault((r["v"], r["model"]), {})[r["f"]] = r["auc"]
    out: dict[int, dict[str, tuple[float, float, float, str | None]]] = {}
    for v in {*sets.folds, *sets.errors}:
        for m in models:
            by_fold = found.get((v, m), {})
            cv = [auc for f, auc in by_fold.items() if f >= 0 and not math.isnan(auc)]
            mean, deviation = (fmean(cv), pstdev(cv)) if cv else (math.nan, math.nan)
            out.setdefault(v, {})[m] = (mean, deviation, by_fold.get(-1, math.nan), sets.errors.get(v))
    return out


def train_and_score(
    train: DataFrame,
    test: DataFrame,
    target: str,
    dataset: str,
    method: str = "original",
    pct: int | None = None,
    run: int = 0,
    models: Sequence[str] = MODELS,
    **options,
) -> list[tuple]:
    """One :data:`SCORES` row per model; a table that cannot be used is said in ``error`` and scores NaN.

    Only faults of the input are reported that way; a failing cluster is not.
    """
    failed = (math.nan, math.nan, math.nan)
    try:
        found = score_tables(train.withColumn(TABLE, F.lit(0)), test, target, models, **options)
        scores = found.get(0, {m: (*failed, "no complete rows") for m in models})
    except (ValueError, AnalysisException) as e:
        scores = {m: (*failed, f"{type(e).__name__}: {e}") for m in models}
    return [(dataset, method, pct, run, m, *scores[m]) for m in models]
