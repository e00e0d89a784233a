"""Mixing sources to target weights by Poisson replication.

A source's target weight and size give a mean repetition rate. Each document is
repeated a Poisson-distributed number of times with that mean: the distribution
is inverted at a uniform number that is a hash of (seed, key), so a document's
count does not depend on partitioning, on other rows or on a retry. Copies are
exploded and put into one global order by a hash of (seed, key, copy).

The expected bytes of a source are budget x weight, whatever its skew: no row is
moved to count or draw. Sources are totalled with map-side combining, and the
rates are joined by ``lookup_join`` (broadcast if measured small, else hot
sources are salted).

Defined results: a null source is a source of its own; a source without bytes
gets rate 0; a null key draws like the text "null"; repeated rows draw the same
count, and rows of one key that differ stand in the order of a hash of what they
carry; an empty table gives no rows. Other columns are carried in a struct.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from counterpoise.functions.hashing import hash_bits, uniform
from counterpoise.llm.common import ranked
from counterpoise.operators.lineage import write_down
from counterpoise.operators.lookup import lookup_join

SEED = 29
TEMPERATURE = 0.5


def poisson_count(u: Column, rate: Column) -> Column:
    """The smallest k with P(count <= k) > u, where counts are Poisson with mean ``rate``.

    Probabilities are summed from k = 0 by their recurrence, as far as the tail is
    below double precision; no table is kept. Terms are carried as logarithms, so
    a large rate does not underflow. The steps are about as many as the copies.
    """
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    start = F.struct(F.lit(0.0).alias("term"), F.lit(0.0).alias("total"), F.lit(0).alias("count"))

    def step(state: Column, k: Column) -> Column:
        term = F.when(k == 0, -rate).otherwise(state["term"] + F.log(rate) - F.log(k))
        total = state["total"] + F.exp(term)
        return F.struct(term.alias("term"), total.alias("total"), (state["count"] + (total <= u).cast("int")).alias("count"))

    counted = F.aggregate(F.sequence(F.lit(0), last), start, step, lambda s: s["count"])
    return F.when(rate > 0, counted).otherwise(F.lit(0))


def source_rates(
    docs: DataFrame,
    source: str = "source",
    text: str = "text",
    weights: Mapping[str, float] | None = None,
    temperature: float = TEMPERATURE,
    budget: float | None = None,
) -> DataFrame:
    """(source, bytes, weight, rate) of every source.

    Weights not given are size^temperature, over all sources scaled to sum to 1.
    ``budget`` is the wanted number of bytes, the corpus's own by default.
    """
    size = F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)).cast("bigint")
    name = F.col(f"`{source}`").cast("string")
    sizes = docs.select(name.alias("source"), size.alias("size"))
    totals = write_down(sizes.groupBy("source").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("_rows"))).df
    mass = F.pow(F.col("bytes").cast("double"), F.lit(float(temperature)))
    if weights is not None:
        given = F.create_map(*[F.lit(x) for item in sorted(weights.items()) for x in item])
        mass = F.coalesce(given[F.col("source")].cast("double"), F.lit(0.0))
    mass = F.when(F.col("bytes") > 0, mass).otherwise(F.lit(0.0))
    shares = totals.withColumn("_mass", mass)
    whole = shares.agg(F.sum("_mass").alias("mass"), F.sum("bytes").alias("bytes")).first()
    wanted = float(budget if budget is not None else whole["bytes"] or 0)
    weight = F.col("_mass") / F.lit(float(whole["mass"] or 1.0) or 1.0)
    rate = F.when(F.col("bytes") > 0, F.lit(wanted) * F.col("weight") / F.col("bytes")).otherwise(F.lit(0.0))
    out = shares.withColumn("weight", weight).withColumn("rate", rate)
    return out.select("source", "bytes", "weight", "rate", "_rows")


def mix(
    docs: DataFrame,
    rates: DataFrame,
    key: str = "doc_id",
    source: str = "source",
    carry: Sequence[str] = (),
    seed: int = SEED,
) -> DataFrame:
    """(key, source, copies, copy, position, row): one row for each copy, in a global random order.

    ``copy`` counts from 1 to ``copies``; ``position`` from 0 over the whole
    result; ``row`` is a struct of the columns ``carry``.
    """
    table = write_down(rates)
    # null becomes a name of its own, so that it joins like any other source
    label = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    rows = docs.select(
        F.col(f"`{key}`").alias("key"),
        F.col(f"`{source}`").cast("string").alias("source"),
        F.struct(*[F.col(f"`{c}`") for c in carry] or [F.lit(None).alias("none")]).alias("row"),
    ).withColumn("_label", label)
    labelled = table.df.withColumn("_label", label)
    joined = lookup_join(rows, write_down(labelled.select("_label", "rate")), ["_label"], rows_per_key=labelled.select("_label", "_rows"))
    name = F.coalesce(F.col("key").cast("string"), F.lit("null"))
    copies = poisson_count(uniform(seed, "copies", name), F.col("rate"))
    drawn = joined.withColumn("copies", copies).filter("copies > 0")
    out = drawn.select("key", "source", "copies", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"), "row")
    hashed = [F.col(f"row.`{f.name}`") for f in out.schema["row"].dataType.fields if f.dataType.typeName() not in ("map", "variant")]
    shuffled = out.withColumn("_at", hash_bits(seed, "order", name, F.col("copy"))).withColumn("_tie", F.xxhash64(*hashed) if hashed else F.lit(0))
    placed, _ = ranked(shuffled, ["_at", "key", "copy", "_tie"], "position")
    return placed.select(F.col("key").alias(key), "source", "copies", "copy", "position", "row")
