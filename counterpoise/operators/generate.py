"""Drawing synthetic rows from a description."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from counterpoise.functions.hashing import uniform
from counterpoise.operators.describe import (
    Attribute,
    BinnedTable,
    Network,
    attribute_distribution,
    bin_table,
    column_kinds,
    conditional_tables,
    learn_network,
)
from counterpoise.operators.lineage import materialise
from counterpoise.operators.lookup import BROADCAST_ROWS, lookup_join

MODES = ("independent", "correlated")
MIN_SLOTS = 16
LETTERS = "abcdefghijklmnopqrstuvwxyz"


@dataclass
class Description:
    """All that is kept of a table: scalars per column and small typed tables."""

    spark: SparkSession
    mode: str
    columns: list[str]
    attributes: list[Attribute]
    dist: DataFrame | None = None
    binned: BinnedTable | None = None
    network: Network | None = None
    cpt: DataFrame | None = None
    keys: dict[str, str] = field(default_factory=dict)


def describe(
    df: DataFrame,
    mode: str = "independent",
    category_threshold: int = 30,
    histogram_bins: int = 10,
    max_parents: int = 2,
    categorical_cols: Sequence[str] = (),
    key_cols: Sequence[str] = (),
    epsilon: float | None = None,
    seed: int = 42,
    network: Network | None = None,
) -> Description:
    """Model a table. ``key_cols`` are not modelled: they are numbered when generated."""
    if mode not in MODES:
        raise ValueError(f"mode {mode!r}: use one of {MODES}")
    attributes = column_kinds(df, category_threshold, histogram_bins, categorical_cols or (), key_cols)
    keys = {c: t for c, t in df.dtypes if c in key_cols}
    out = Description(df.sparkSession, mode, df.columns, attributes, keys=keys)
    if mode == "independent":
        out.dist = materialise(attribute_distribution(df, attributes, epsilon, seed))
    else:
        out.binned = bin_table(df, attributes)
        out.network = network or learn_network(out.binned, max_parents)
        out.cpt = materialise(conditional_tables(out.binned, out.network))
    return out


def slotted(dist: DataFrame, slots: int) -> DataFrame:
    """Repeat each interval once per slot of [0, 1) it touches.

    Looking a uniform up then is an equi-join on its slot. Uniforms fill the
    slots evenly however uneven the distribution is, so a value that is a third
    of the data does not become a hot join key.
    """
    first = F.floor(F.col("cum_lo") * slots)
    last = F.least(F.ceil(F.col("cum_hi") * slots) - 1, F.lit(slots - 1))
    return dist.filter(F.col("cum_hi") > F.col("cum_lo")).withColumn("_slot", F.explode(F.sequence(first, last)))


def slot_count(bins: int) -> int:
    slots = MIN_SLOTS
    while slots < bins:
        slots *= 2
    return slots


def slot_of(u: Column, slots: int) -> Column:
    return F.floor(u * slots)


def holds(u: Column) -> Column:
    return (u >= F.col("cum_lo")) & (u < F.col("cum_hi"))


def draw(df: DataFrame, dist: DataFrame, u: str, bins: int) -> DataFrame:
    """Attach to each row the interval of ``dist`` that holds its uniform ``u``."""
    slots = slot_count(bins)
    keyed = df.withColumn("_slot", slot_of(F.col(u), slots))
    joined = lookup_join(keyed, slotted(dist, slots), ["_slot"], small=slots + bins <= BROADCAST_ROWS)
    return joined.filter(holds(F.col(u))).drop("_slot", "cum_lo", "cum_hi")


def shaped(a: Attribute, x: Column, seed: int) -> Column:
    """A drawn number as a value of the column's own type."""
    if a.kind == "length":
        letter = lambda i: F.substr(
            F.lit(LETTERS),
            (F.pmod(F.xxhash64(F.lit(seed), F.lit(a.name), F.col("_id"), i), F.lit(26)) + 1).cast("int"),
            F.lit(1),
        )
        size = F.greatest(F.round(x), F.lit(0)).cast("int")
        return F.when(size > 0, F.concat_ws("", F.transform(F.sequence(F.lit(1), size), letter))).otherwise(F.lit(""))
    if a.dtype in ("int", "bigint"):
        return F.round(x).cast(a.dtype)
    return x.cast(a.dtype)


def generate(desc: Description, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows; every draw depends only on (seed, column, row number)."""
    rows = desc.spark.range(n).withColumnRenamed("id", "_id")
    rows = _independent(desc, rows, seed) if desc.mode == "independent" else _correlated(desc, rows, seed)
    for name, dtype in desc.keys.items():
        rows = rows.withColumn(name, F.col("_id").cast(dtype))
    return rows.select(*desc.columns)


def _independent(desc: Description, rows: DataFrame, seed: int) -> DataFrame:
    sizes = {r["attr"]: r["bins"] for r in desc.dist.groupBy("attr").agg(F.count(F.lit(1)).alias("bins")).collect()}
    for a in desc.attributes:
        if a.name not in sizes:  # nothing but nulls
            rows = rows.withColumn(a.name, F.lit(None).cast(a.dtype))
            continue
        mine = desc.dist.filter(F.col("attr") == a.name)
        drawn = rows.withColumn("_u", uniform(seed, a.name, F.col("_id")))
        kept = rows.columns
        if a.kind == "categorical":
            drawn = draw(drawn, mine.select("value", "cum_lo", "cum_hi"), "_u", sizes[a.name])
            value = F.col("value").cast(a.dtype)
        else:
            drawn = draw(drawn, mine.select("lo", "hi", "cum_lo", "cum_hi"), "_u", sizes[a.name])
            inside = uniform(seed, a.name, F.col("_id"), part=1)
            value = shaped(a, F.col("lo") + inside * (F.col("hi") - F.col("lo")), seed)
        if a.missing:
            gone = uniform(seed, f"{a.name}:missing", F.col("_id")) < F.lit(a.missing / a.rows)
            value = F.when(~gone, value)
        rows = drawn.select(*kept, value.alias(a.name))
    return rows


def _correlated(desc: Description, rows: DataFrame, seed: int) -> DataFrame:
    """Ancestral sampling: each column's bin is drawn given the bins of its parents."""
    table, cpt = desc.binned, desc.cpt
    shape = {
        r["attr"]: (r["rows"], r["combos"])
        for r in cpt.groupBy("attr")
        .agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("parent_key").alias("combos"))
        .collect()
    }
    holes = {a.name for a in table.attributes if a.missing}
    for child, parents in desc.network.edges:
        bins = table.cards[child]
        slots = slot_count(bins)
        mine = slotted(cpt.filter(F.col("attr") == child), slots).select(
            F.col("parent_key").alias("_pk"), "_slot", F.col("bin").alias("_bin"), "cum_lo", "cum_hi"
        )
        n_rows, combos = shape.get(child, (0, 0))
        bound = combos * slots + n_rows  # the intervals of one parent key cut its slots that often at most
        drawn = rows.withColumns(
            {"_u": uniform(seed, child, F.col("_id")), "_pk": table.key(parents)}
        ).withColumn("_slot", slot_of(F.col("_u"), slots))
        joined = lookup_join(drawn, mine, ["_pk", "_slot"], "left", small=bound <= BROADCAST_ROWS)
        joined = joined.filter(F.col("cum_lo").isNull() | holds(F.col("_u")))
        # parents never seen together: every value is as likely as any other, null only if the column has any
        anything = F.floor(F.col("_u") * F.lit(bins if child in holes else max(1, bins - 1)))
        rows = joined.withColumn(child, F.coalesce("_bin", anything)).select(*rows.columns, child)
    values = {}
    for a in table.attributes:
        if a.kind != "categorical":
            b = F.col(a.name)
            x = F.lit(a.lo) + (b + uniform(seed, f"{a.name}:inside", F.col("_id"))) * F.lit(a.width)
            values[a.name] = F.when(b < F.lit(a.bins), shaped(a, x, seed))
    for a in table.attributes:
        if a.kind == "categorical" and a.name in table.encoder.sizes:
            code = F.when(F.col(a.name) < table.cards[a.name] - 1, F.col(a.name))
            rows = table.encoder.decode(rows.withColumn(a.name, code), [a.name])
            rows = rows.withColumn(a.name, F.col(a.name).cast(a.dtype))
        elif a.kind == "categorical":
            rows = rows.withColumn(a.name, F.lit(None).cast(a.dtype))
    return rows.withColumns(values) if values else rows


def synthesize(df: DataFrame, n: int, mode: str = "independent", seed: int = 42, **options) -> DataFrame:
    """Describe ``df`` and draw ``n`` rows with its columns. Options as in :func:`describe`."""
    return generate(describe(df, mode, seed=seed, **options), n, seed)
