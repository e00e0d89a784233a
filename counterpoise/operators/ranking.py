"""Exact ranks, prefix sums and cut-offs without a one-partition window."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from counterpoise.functions.hashing import BITS
from counterpoise.operators.lineage import materialise, shuffle_partitions, write_down
from counterpoise.operators.lookup import lookup_join

WINDOW_ROWS = 200_000
_STEP = 13
_FETCH = 1_000


@dataclass(frozen=True)
class Cutoff:
    """The last (bits, key) still inside; ``None`` bits means every row is in.

    Rows that repeat a key are equal in this order: ``ties`` rows stand at the
    cut-off, of which ``inside`` are in. Null keys come last among equal bits.
    """

    bits: int | None
    key: object = None
    ties: int = 1
    inside: int = 1

    @property
    def exact(self) -> bool:
        """Whether :meth:`admits` takes the wanted number of rows."""
        return self.ties == self.inside

    def admits(self, bits: Column, key: Column) -> Column:
        """Rows up to and with the cut-off, all its ties included."""
        if self.bits is None:
            return F.lit(True)
        within = F.lit(True) if self.key is None else F.coalesce(key <= F.lit(self.key), F.lit(False))
        return (bits < F.lit(self.bits)) | ((bits == F.lit(self.bits)) & within)

    def tied(self, bits: Column, key: Column) -> Column:
        """The rows at the cut-off itself."""
        if self.bits is None:
            return F.lit(False)
        return (bits == F.lit(self.bits)) & key.eqNullSafe(F.lit(self.key))


def rank_cutoffs(df: DataFrame, bits: Column, key: Column, ranks: Sequence[int]) -> dict[int, Cutoff]:
    """For each wanted rank, the row that has it in (bits, key) order.

    A sample of exactly n rows then is a plain filter: no sort, no shuffle of
    the data. Rows are counted per prefix of their hash bits (2^13 counts per
    open prefix); only the prefix holding the wanted rank is opened further,
    until it holds few enough rows to look at.
    """
    rows = df.select(bits.alias("_h"), key.alias("_k"))
    wanted = sorted(set(ranks))
    found: dict[int, Cutoff] = {}
    open_ = {r: (0, 0) for r in wanted if r > 0}  # rank -> (prefix, rows before it)
    for r in wanted:
        if r <= 0:
            found[r] = Cutoff(-1, None)
    shift = BITS
    while open_:
        prefixes = sorted({p for p, _ in open_.values()})
        inside = rows if shift == BITS else rows.filter(F.shiftright("_h", shift).isin(prefixes))
        shift -= _STEP
        counted = inside.groupBy(F.shiftright("_h", shift).alias("p")).count().collect()
        counts = sorted((row["p"], row["count"]) for row in counted)
        widest = 0
        for r in list(open_):
            prefix, before = open_[r]
            hit = None
            for p, c in counts:
                if (p >> _STEP) != prefix:
                    continue
                if before + c >= r:
                    hit = (p, before)
                    widest = max(widest, c)
                    break
                before += c
            if hit is None:
                found[r] = Cutoff(None)  # fewer rows than asked for
                del open_[r]
            else:
                open_[r] = hit
        if widest <= _FETCH or shift == 0:
            break
    if open_:
        prefixes = sorted({p for p, _ in open_.values()})
        # rows of one key are counted here, so that a key of very many rows is one line
        tail = rows.filter(F.shiftright("_h", shift).isin(prefixes)).groupBy("_h", "_k").count().collect()
        by_prefix: dict[int, list] = {}
        for row in tail:
            by_prefix.setdefault(row["_h"] >> shift, []).append((row["_h"], row["_k"], row["count"]))
        for lines in by_prefix.values():
            lines.sort(key=lambda x: (x[0], x[1] is None, x[1]))
        for r, (p, before) in open_.items():
            for h, k, n in by_prefix[p]:
                if before + n >= r:
                    found[r] = Cutoff(h, k, n, r - before)
                    break
                before += n
    return found


def hashed_rank(df: DataFrame, group: Sequence[str], bits: Column, key: Column, name: str) -> DataFrame:
    """Exact 1-based rank by (bits, key) inside each group.

    Hash bits are spread evenly, so buckets of their leading bits are as well:
    each bucket is numbered on its own and shifted by the rows before it. The
    number of buckets follows the row count, so no window outgrows a task.
    """
    group = list(group)
    total = df.count()
    depth = 0
    while depth < 20 and (total >> depth) > WINDOW_ROWS:
        depth += 1
    tagged = df.withColumn("_h", bits).withColumn("_k", key)
    if depth == 0:
        order = Window.partitionBy(*group).orderBy("_h", "_k")
        return tagged.withColumn(name, F.row_number().over(order).cast("bigint")).drop("_h", "_k")
    tagged = tagged.withColumn("_b", F.shiftright("_h", BITS - depth))
    sizes = tagged.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*group, "_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))
    local = tagged.withColumn(
        "_n", F.row_number().over(Window.partitionBy(*group, "_b").orderBy("_h", "_k"))
    )
    joined = lookup_join(local, sizes, [*group, "_b"])
    return joined.withColumn(name, F.col("_before") + F.col("_n")).drop("_h", "_k", "_b", "_n", "_before")


def running_sum(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    sums: Mapping[str, str],
    window_rows: int = WINDOW_ROWS,
) -> DataFrame:
    """For each ``new: value`` in ``sums``, the sum up to and including each row.

    Small inputs (counted first) take one window. Larger ones are range
    partitioned by (group, order), summed inside each partition and shifted by
    the totals of the partitions before, so a group that is most of the data
    still spreads over all tasks.
    """
    group, order = list(group), list(order)
    written = write_down(df)
    df, total = written.df, written.rows
    upto = (Window.unboundedPreceding, Window.currentRow)
    if total <= window_rows:
        w = Window.partitionBy(*group).orderBy(*order).rowsBetween(*upto)
        return df.withColumns({name: F.sum(value).over(w) for name, value in sums.items()})
    parts = -(-total // window_rows)
    ranged = materialise(
        df.repartitionByRange(parts, *group, *order).withColumn("_pid", F.spark_partition_id())
    )
    local = Window.partitionBy("_pid", *group).orderBy(*order).rowsBetween(*upto)
    totals = ranged.groupBy("_pid", *group).agg(*[F.sum(v).alias(f"_s_{n}") for n, v in sums.items()])
    prior = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    before = {f"_b_{n}": F.coalesce(F.sum(f"_s_{n}").over(prior), F.lit(0)) for n in sums}
    totals = totals.withColumns(before).select("_pid", *group, *before)
    joined = lookup_join(ranged.withColumns({n: F.sum(v).over(local) for n, v in sums.items()}), totals, ["_pid", *group])
    return joined.withColumns({n: F.col(n) + F.col(f"_b_{n}") for n in sums}).drop("_pid", *before)


def with_row_key(df: DataFrame, name: str = "row_key", block: int = 10_000) -> DataFrame:
    """A stable string key for tables that have none.

    Equal rows are interchangeable, so they are counted and numbered rather than
    gathered: first in blocks, then inside each block, so that a row repeated
    for a third of the table never sits in one task. The number of tasks follows
    the rows that come out: the blocks that go in are few and small, and left to
    their size they would all be merged into one task.
    """
    cols = df.columns
    digest = F.md5(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}))
    counted = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_copies"))
    blocks = counted.withColumn("_d", digest).withColumn(
        "_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_copies") - 1) / F.lit(block))))
    )
    parts = max(shuffle_partitions(df.sparkSession), -(-df.count() // WINDOW_ROWS))
    spread = blocks.repartition(parts, "_d", "_block")
    copy = F.explode(
        F.sequence(
            F.col("_block") * block + 1,
            F.least((F.col("_block") + 1) * F.lit(block), F.col("_copies")),
        )
    )
    return spread.withColumn("_copy", copy).select(
        *cols, F.concat_ws(":", "_d", F.col("_copy").cast("string")).alias(name)
    )
