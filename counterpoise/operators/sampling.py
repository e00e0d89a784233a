"""Class profile, rebalance plan, exact-size samples and splits."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from counterpoise.functions.hashing import hash_bits
from counterpoise.operators.ranking import Cutoff, rank_cutoffs, running_sum


def require_column(df: DataFrame, name: str) -> None:
    if name not in df.columns:
        raise ValueError(f"column {name!r} not in the table")


def complete_cases(df: DataFrame, missing: str | None = None) -> DataFrame:
    """Rows without nulls; a string cell equal to ``missing`` counts as null."""
    if missing is not None:
        strings = [c for c, t in df.dtypes if t == "string"]
        df = df.replace(missing, None, subset=strings) if strings else df
    return df.na.drop("any")


def class_counts(df: DataFrame, target: str) -> DataFrame:
    """(label, n) per non-null class."""
    require_column(df, target)
    return (
        df.filter(F.col(target).isNotNull())
        .groupBy(F.col(target).alias("label"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


@dataclass(frozen=True)
class ClassProfile:
    minority: object
    majority: object
    n_minority: int
    n_majority: int
    n_null: int

    def majority_rows(self, drop_null_target: bool = False) -> int:
        return self.n_majority + (0 if drop_null_target else self.n_null)


def class_profile(df: DataFrame, target: str) -> ClassProfile:
    """The two classes, the rarer one first; a tie goes to the smaller label."""
    require_column(df, target)
    # null is a group of its own here, hence four rows show "more than two classes"
    rows = df.groupBy(F.col(target).alias("label")).agg(F.count(F.lit(1)).alias("n")).limit(4).collect()
    classes = sorted((r["n"], r["label"]) for r in rows if r["label"] is not None)
    nulls = sum(r["n"] for r in rows if r["label"] is None)
    if len(classes) != 2:
        found = "more than 2" if len(classes) > 2 else len(classes)
        raise ValueError(f"target must have exactly 2 classes, found {found}")
    (few, low), (many, high) = classes
    return ClassProfile(low, high, few, many, nulls)


def check_proportion(p: float) -> float:
    if not 0 < p < 1:
        raise ValueError("proportion must lie strictly between 0 and 1")
    return float(p)


def percent(p: float) -> int:
    """Label of a proportion; rounded, so .29 is 29 and .57 is 57."""
    return round(p * 100)


def kept_rows(majority: int, p: float) -> int:
    return int(check_proportion(p) * majority / (1 - p))


def rebalance_plan(df: DataFrame, target: str, proportions: Sequence[float]) -> DataFrame:
    """(pct, p, n_minority, n_majority, keep, synth, feasible) for every proportion, one pass."""
    counts = class_counts(df, target)
    sizes = counts.agg(
        F.min(F.struct("n", "label")).alias("low"), F.max("n").alias("n_majority"), F.count(F.lit(1)).alias("k")
    ).filter(F.col("k") == 2)
    wanted = F.array(
        *[F.struct(F.lit(percent(p)).alias("pct"), F.lit(check_proportion(p)).alias("p")) for p in proportions]
    )
    plan = sizes.select(F.explode(wanted).alias("w"), F.col("low.n").alias("n_minority"), "n_majority").select(
        "w.pct", "w.p", "n_minority", "n_majority"
    )
    keep = F.floor(F.col("p") * F.col("n_majority") / (F.lit(1) - F.col("p")))
    return (
        plan.withColumn("keep", keep)
        .withColumn("synth", F.col("n_majority") - F.col("keep"))
        .withColumn("feasible", (F.col("keep") <= F.col("n_minority")) & (F.col("synth") >= 0))
    )


def is_class(target: str, label: object) -> Column:
    """Null-safe: a null target is not of the class, and its negation is true."""
    return F.col(target).eqNullSafe(F.lit(label))


def split_by_class(df: DataFrame, target: str, minority: object, drop_null_target: bool = False):
    """(minority rows, all other rows); null targets stay with the others unless dropped."""
    if drop_null_target:
        df = df.filter(F.col(target).isNotNull())
    return df.filter(is_class(target, minority)), df.filter(~is_class(target, minority))


def _marked(df: DataFrame, cut: Cutoff, bits: Column, key: Column, name: str) -> DataFrame:
    """Adds the boolean ``name``: true for exactly the rows up to the cut-off.

    Where rows repeat the key at the cut-off, those rows (and only they) are
    ordered by their content; equal rows are interchangeable, so they are
    counted, and their counts divided, without gathering them.
    """
    if cut.exact:
        return df.withColumn(name, cut.admits(bits, key))
    tied = cut.tied(bits, key)
    plain = df.filter(~tied).withColumn(name, cut.admits(bits, key))
    digest = F.md5(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}))
    counted = df.filter(tied).groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n")).withColumn("_d", digest)
    summed = running_sum(counted, [], ["_d"], {"_upto": "_n"})
    within = F.greatest(F.lit(0), F.least(F.col("_n"), cut.inside - (F.col("_upto") - F.col("_n"))))
    parts = F.array(F.struct(F.lit(True).alias("in"), within.alias("n")), F.struct(F.lit(False).alias("in"), (F.col("_n") - within).alias("n")))
    split = summed.select(*df.columns, F.explode(parts).alias("_p")).filter("_p.n > 0")
    copies = split.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_p.n"))))
    return plain.unionByName(copies.select(*df.columns, F.col("_p.in").alias(name)))


def exact_sample(df: DataFrame, n: int, key: str, seed: int = 42, salt: str = "sample") -> DataFrame:
    """Exactly n rows without replacement, also where keys repeat or are null.

    Smaller n gives a subset of larger n.
    """
    bits = hash_bits(seed, salt, F.col(key))
    available = df.count()
    if n > available:
        raise ValueError(f"cannot take {n} rows out of {available} without replacement")
    if n == available:
        return df
    cut = rank_cutoffs(df, bits, F.col(key), [n])[n]
    if cut.exact:
        return df.filter(cut.admits(bits, F.col(key)))
    return _marked(df, cut, bits, F.col(key), "_in").filter("_in").drop("_in")


def train_test_split(
    df: DataFrame, key: str, test_size: float = 0.2, seed: int = 42, exact: bool = True
) -> DataFrame:
    """Adds ``split`` in ('train', 'test'); the test part holds ceil(n * test_size) rows.

    ``exact=False`` decides each row on its own hash: no pass over the data, and
    sizes that are only nearly right.
    """
    check_proportion(test_size)
    bits = hash_bits(seed, "split", F.col(key))
    if exact:
        n = math.ceil(df.count() * test_size)
        cut = rank_cutoffs(df, bits, F.col(key), [n])[n]
        marked = _marked(df, cut, bits, F.col(key), "_in")
        return marked.select(*df.columns, F.when(F.col("_in"), "test").otherwise("train").alias("split"))
    chosen = bits < F.lit(int(test_size * (1 << 52)))
    return df.withColumn("split", F.when(chosen, "test").otherwise("train"))


def sweep_samples(
    df: DataFrame,
    target: str,
    proportions: Sequence[float],
    key: str,
    seed: int = 42,
    drop_null_target: bool = False,
    profile: ClassProfile | None = None,
) -> DataFrame:
    """The rows of every variant before synthesis, keyed by ``pct``.

    Majority rows belong to each variant; a minority row to those whose sample
    reaches its rank. All cut-offs come from one counting pass, and the variants
    from one scan: each row is repeated once per variant it belongs to.
    """
    profile = profile or class_profile(df, target)
    majority = profile.majority_rows(drop_null_target)
    keep = {p: kept_rows(majority, p) for p in proportions}
    for p, n in keep.items():
        if n > profile.n_minority:
            raise ValueError(f"p={p} needs {n} minority rows, only {profile.n_minority} exist")
        if n > majority:
            raise ValueError(f"p={p} would make the minority larger than the majority")
    if drop_null_target:
        df = df.filter(F.col(target).isNotNull())
    bits, k = hash_bits(seed, "sample", F.col(key)), F.col(key)
    rare = is_class(target, profile.minority)
    cuts = rank_cutoffs(df.filter(rare), bits, k, list(keep.values()))
    if not all(c.exact for c in cuts.values()):
        raise ValueError("the key has to tell the minority rows apart")
    row = df.withColumn("_h", bits)
    variants = F.array(
        *[
            F.when(
                ~rare | cuts[keep[p]].admits(F.col("_h"), k),
                F.struct(F.lit(percent(p)).alias("pct"), F.lit(float(p)).alias("p")),
            )
            for p in proportions
        ]
    )
    exploded = row.withColumn("_v", F.explode(F.array_compact(variants)))
    return exploded.select(*df.columns, "_v.pct", "_v.p")
