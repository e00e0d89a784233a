"""Connected components of an edge table by alternating star contraction.

Large-star / small-star (Kiveris et al., "Connected Components in MapReduce and
Beyond", 2014). Neighbourhoods are never gathered: a star step is a minimum per
node (combined on the map side) and a join back to the edges, in which nodes of
very high degree are salted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from counterpoise.operators.lineage import discard, write_down
from counterpoise.operators.lookup import BROADCAST_ROWS, lookup_join


def _with_least(adjacent: DataFrame, scope: list[str], edges: int) -> DataFrame:
    """Adds ``least``, the smallest neighbour of ``u`` or ``u`` itself."""
    seen = adjacent.groupBy(*scope, "u").agg(
        F.least(F.min("v"), F.col("u")).alias("least"), F.count(F.lit(1)).alias("_rows")
    )
    small = 2 * edges <= BROADCAST_ROWS  # one row per node, two nodes per edge at most
    return lookup_join(
        adjacent, seen.drop("_rows"), [*scope, "u"], small=small, rows_per_key=seen.drop("least")
    )


def components(edges: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """(scope, node, root): root is the smallest node of the component.

    ``edges`` is (scope, src, dst). Only nodes with an edge appear; the root
    itself is listed too.
    """
    scope = list(scope)
    pairs = (
        edges.filter(F.col("src") != F.col("dst"))
        .select(*scope, F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
        .distinct()
    )
    before = []
    while True:
        written = write_down(pairs)
        discard(*before)
        before = [written]
        pairs, edges_now = written.df, written.rows
        if _are_stars(pairs, scope):
            break
        both = pairs.unionByName(pairs.select(*scope, F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, scope, edges_now).filter(F.col("v") > F.col("u"))
        large = large.select(*scope, F.col("v").alias("u"), F.col("least").alias("v")).distinct()
        small = _with_least(large, scope, edges_now)
        link = F.array(F.struct(F.col("u").alias("a")), F.struct(F.col("v").alias("a")))
        pairs = (
            small.select(*scope, "least", F.explode(link).alias("l"))
            .filter(F.col("l.a") != F.col("least"))
            .select(*scope, F.col("l.a").alias("u"), F.col("least").alias("v"))
            .distinct()
        )
    roots = pairs.select(*scope, F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return pairs.select(*scope, F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _are_stars(pairs: DataFrame, scope: list[str]) -> bool:
    """Every node either points to one centre or is one."""
    ends = F.array(
        F.struct(F.col("u").alias("node"), F.lit(1).alias("out")), F.struct(F.col("v").alias("node"), F.lit(0).alias("out"))
    )
    degree = (
        pairs.select(*scope, F.explode(ends).alias("e"))
        .groupBy(*scope, "e.node")
        .agg(F.sum("e.out").alias("out"), F.count(F.lit(1)).alias("n"))
    )
    # a centre has no way out; any other node has one way out and none in
    return degree.filter((F.col("out") > 0) & (F.col("n") > 1)).isEmpty()
