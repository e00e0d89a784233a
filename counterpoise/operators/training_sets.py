"""Training and scoring of all models over many tables of equal columns at once.

A table is named by a number (``TABLE``, later v). Its rows are cleaned, encoded and scaled by its own
training rows, and dealt to folds; each fold, and the whole table, is a training
set. All sets of all tables go through the same jobs, so the number of jobs does
not grow with the number of tables. Equal rows of a table, label and fold become one
line that counts them, so what the learners hold follows the distinct rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from counterpoise.functions.hashing import hash_bits
from counterpoise.operators import boosting, forest, logistic
from counterpoise.operators.encode import numeric_columns, string_columns
from counterpoise.operators.lineage import materialise, write_down
from counterpoise.operators.lookup import lookup_join
from counterpoise.operators.ranking import hashed_rank, running_sum, with_row_key
from counterpoise.operators.sampling import complete_cases, require_column

Set = tuple[int, int]
TABLE = "_table"
ROWS = "v bigint, row bigint, draw bigint, part int, label double, x array<double>, n bigint"


@dataclass
class TrainingSets:
    """``rows`` (v, row, draw, part, label, x, n): n equal rows; part is the fold, or -1 for test rows.

    ``sizes`` holds (rows, positive rows) that each set (v, f) is fitted to;
    f = -1 is the whole table. ``total`` and ``lines`` count the rows and lines of
    each table, ``errors`` names tables that cannot be used.
    """

    rows: DataFrame
    folds: dict[int, int]
    sizes: dict[Set, tuple[int, int]]
    total: dict[int, int]
    lines: dict[int, int]
    width: int
    errors: dict[int, str]


def fold_count(smallest_class: int, max_splits: int = 5) -> int | None:
    """Folds that give each class a row in each; ``None`` if a class has fewer than 2."""
    return None if smallest_class < 2 else min(max_splits, smallest_class)


def _classes(train: DataFrame, target: str) -> dict[int, dict]:
    """Per table: the number of classes, rows of the smallest, and the two labels in order."""
    per_class = train.groupBy(TABLE, F.col(f"`{target}`").cast("string").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    found = per_class.groupBy(TABLE).agg(
        F.count(F.lit(1)).alias("classes"), F.min("n").alias("smallest"), F.min("label").alias("low"), F.max("label").alias("high")
    )
    return {r[TABLE]: r.asDict() for r in found.collect()}  # a row for each table


def _codes(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(table, attr, value, code): values of each table's text columns in ascending order, from 0."""
    cells = F.array(*[F.struct(F.lit(c).alias("attr"), F.col(f"`{c}`").alias("value")) for c in columns])
    values = train.select(TABLE, F.explode(cells).alias("cell")).select(TABLE, "cell.attr", "cell.value").distinct()
    ranked = running_sum(values.withColumn("_one", F.lit(1)), [TABLE, "attr"], ["value"], {"_rank": "_one"})
    return ranked.select(TABLE, "attr", "value", (F.col("_rank") - 1).cast("double").alias("code"))


def training_sets(
    tables: DataFrame, test: DataFrame, target: str, key: str | None = None, seed: int = 42, max_splits: int = 5
) -> TrainingSets:
    """Prepares ``tables`` (with a column ``TABLE`` of non-negative numbers) and the test rows, which serve every table.

    Complete rows only, ``.`` being missing. Numbers are scaled by mean and
    population deviation, text columns become codes in ascending order, unseen
    values code 0, and the greater label is the positive class.
    """
    require_column(tables, target)
    spark = tables.sparkSession
    features = [c for c in tables.columns if c not in (TABLE, target, key)]
    train = complete_cases(tables.select(TABLE, *[f"`{c}`" for c in [*([key] if key else []), *features, target]]), missing=".")
    test = complete_cases(test.select(*[f"`{c}`" for c in [*([key] if key else []), *features, target]]), missing=".")
    if key is None:
        train, test, key = with_row_key(train, "_key"), with_row_key(test, "_key"), "_key"
    train, test = write_down(train).df, write_down(test).df
    classes = _classes(train, target)
    errors = {v: f"target must have 2 classes, found {c['classes']}" for v, c in classes.items() if c["classes"] != 2}
    folds = {v: fold_count(c["smallest"], max_splits) or 0 for v, c in classes.items() if v not in errors}
    if not folds:
        return TrainingSets(spark.createDataFrame([], ROWS), {}, {}, {}, {}, len(features), errors)
    listed = [(v, k, classes[v]["high"]) for v, k in folds.items()]
    listed = F.broadcast(spark.createDataFrame(listed, f"{TABLE} bigint, _folds int, _high string"))  # a row for each table
    ranked = hashed_rank(train, [TABLE, target], hash_bits(seed, "fold", F.col(f"`{key}`")), F.col(f"`{key}`"), "_rank")
    fold = F.when(F.col("_folds") > 0, F.pmod(F.col("_rank") - 1, F.col("_folds"))).otherwise(0)
    mine = ranked.withColumn(TABLE, F.col(TABLE).cast("bigint")).join(listed, TABLE).withColumn("_part", fold.cast("int"))
    every = F.array(*[F.lit(v).cast("bigint") for v in folds])
    line, many = [F.col(f"`{c}`") for c in [*features, target]], F.count(F.lit(1)).alias("_n")
    mine = mine.groupBy(TABLE, "_part", "_high", *line).agg(many)
    theirs = test.groupBy(*line).agg(many).withColumn(TABLE, F.explode(every)).join(listed, TABLE).withColumn("_part", F.lit(-1)).drop("_folds")
    both = mine.unionByName(theirs).withColumn("_label", (F.col(f"`{target}`").cast("string") == F.col("_high")).cast("double"))
    both = both.withColumn("_draw", F.xxhash64("_part", *line)).drop("_high")

    numbers, texts = numeric_columns(train.select(*[f"`{c}`" for c in features])), string_columns(train.select(*[f"`{c}`" for c in features]))
    if numbers:
        stats = [f(F.col(f"`{c}`").cast("double")).alias(f"{n}_{i}") for i, c in enumerate(numbers) for n, f in (("_m", F.avg), ("_s", F.stddev_pop))]
        both = lookup_join(both, write_down(train.groupBy(TABLE).agg(*stats)), [TABLE])
    scaled = {
        c: (F.col(f"`{c}`").cast("double") - F.col(f"_m_{i}")) / F.coalesce(F.nullif(F.col(f"_s_{i}"), F.lit(0.0)), F.lit(1.0))
        for i, c in enumerate(numbers)
    }
    if texts:
        codes = write_down(_codes(train, texts))
        for i, c in enumerate(texts):
            one = codes.df.filter(F.col("attr") == c).select(TABLE, F.col("value").alias("_value"), F.col("code").alias(f"_c_{i}"))
            both = lookup_join(both.withColumn("_value", F.col(f"`{c}`")), replace(codes, df=one), [TABLE, "_value"], "left")
            both = both.drop("_value")
            scaled[c] = F.coalesce(f"_c_{i}", F.lit(0.0))
    x = F.array(*[scaled.get(c, F.col(f"`{c}`").cast("double")) for c in features]).cast("array<double>")
    named = [F.col(f"_{c}").alias(c) for c in ("draw", "part", "label", "n")]
    rows = materialise(both.select(F.col(TABLE).alias("v"), F.monotonically_increasing_id().alias("row"), *named, x.alias("x")))

    sizes: dict[Set, tuple[int, int]] = {}
    total, lines = dict.fromkeys(folds, 0), dict.fromkeys(folds, 0)
    # a row for each table and fold
    sums = F.sum("n").alias("n"), F.sum(F.col("label") * F.col("n")).alias("positive"), F.count(F.lit(1)).alias("lines")
    for r in rows.groupBy("v", "part").agg(*sums).collect():
        v = r["v"]
        total[v] += r["n"]
        lines[v] += r["lines"]
        for f in range(-1, folds[v]):
            if r["part"] >= 0 and r["part"] != f:
                n, positive = sizes.get((v, f), (0, 0))
                sizes[v, f] = (n + r["n"], positive + int(r["positive"]))
    return TrainingSets(rows, folds, sizes, total, lines, len(features), errors)


def model_scores(
    sets: TrainingSets,
    model: str,
    seed: int = 42,
    trees: int = forest.TREES,
    rounds: int = boosting.ROUNDS,
    local_rows: int = boosting.LOCAL_ROWS,
    local_lines: int = boosting.LOCAL_LINES,
) -> DataFrame:
    """(v, f, row, label, score, n) of one model: folds scored by the other folds, test rows by all.

    Tables of at most ``local_rows`` rows, or ``local_lines`` lines (for boosting: of
    binned rows), have their trees fitted in tasks; larger ones by jobs over all their sets.
    """
    if not sets.folds:
        return sets.rows.sparkSession.createDataFrame([], boosting.SCORED)
    if model == "logistic":
        return logistic.scores(sets.rows, logistic.fit(sets.rows, sets.sizes, sets.width))
    few = local_lines if model == "random_forest" else 0
    near = {v: k for v, k in sets.folds.items() if sets.total[v] <= local_rows or sets.lines[v] <= few}
    far = {s: size for s, size in sets.sizes.items() if s[0] not in near}
    parts = []
    if near:
        folds = sets.rows.sparkSession.createDataFrame(list(near.items()), "v bigint, folds int")
        if model == "hist_gradient":
            parts.append(boosting.local_scores(sets.rows, folds, rounds))
        else:
            parts.append(forest.local_scores(sets.rows, folds, seed, trees))
    if far:
        rows = sets.rows.filter(F.col("v").isin(sorted({v for v, _ in far})))
        if model == "hist_gradient":
            parts.append(boosting.wide_scores(rows, far, sets.width, rounds, task_lines=local_lines, each=False))
        else:
            parts.append(forest.wide_scores(rows, list(far), sets.width, seed, trees, local_rows))
    return reduce(DataFrame.unionByName, parts)
