"""Attribute models: column kinds, histograms, and a Bayesian network over bins."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field, replace
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from counterpoise.functions.hashing import laplace, uniform
from counterpoise.operators.encode import LabelEncoder, is_numeric, nan_as_null
from counterpoise.operators.lineage import materialise, side_by_side
from counterpoise.operators.ranking import running_sum


NOISE_UNIT = float(1 << 36)
SUBSETS_PER_JOB = 200
SETS_AT_ONCE = 50


@dataclass(frozen=True)
class Attribute:
    """What is known of one column; a handful of scalars."""

    name: str
    dtype: str
    kind: str  # 'categorical' | 'histogram' | 'length'
    distinct: int
    missing: int
    rows: int
    lo: float | None = None
    hi: float | None = None
    bins: int = 1

    @property
    def width(self) -> float:
        return (self.hi - self.lo) / self.bins

    def number(self) -> Column:
        """The quantity that is binned: the number itself, or a string's length."""
        col = F.col(self.name)
        return (F.length(col) if self.kind == "length" else col).cast("double")

    def bin(self) -> Column:
        """Equal-width bin over [lo, hi]; the top edge belongs to the last bin."""
        if self.bins == 1:
            return F.when(F.col(self.name).isNotNull(), F.lit(0).cast("bigint"))
        raw = F.floor((self.number() - F.lit(self.lo)) / F.lit(self.width))
        # least() alone would put missing values into the last bin
        return F.when(raw.isNotNull(), F.least(raw, F.lit(self.bins - 1).cast("bigint")))


def column_kinds(
    df: DataFrame,
    category_threshold: int = 30,
    histogram_bins: int = 10,
    categorical_cols: Sequence[str] = (),
    skip: Sequence[str] = (),
) -> list[Attribute]:
    """Kind, range and missing count of each column.

    The first pass uses sketches for all columns; the exact distinct count is
    taken only where the sketch is near the threshold, so its sets stay small.
    """
    df = nan_as_null(df)
    cols = [c for c in df.columns if c not in skip]
    types = dict(df.dtypes)
    aggs = [F.count(F.lit(1)).alias("rows")]
    for c in cols:
        aggs += [F.approx_count_distinct(c).alias(f"d_{c}"), F.count(c).alias(f"n_{c}")]
        if is_numeric(types[c]) or types[c] == "string":
            x = F.length(c) if types[c] == "string" else F.col(c)
            aggs += [F.min(x).cast("double").alias(f"lo_{c}"), F.max(x).cast("double").alias(f"hi_{c}")]
    seen = df.agg(*aggs).first()
    near = [c for c in cols if seen[f"d_{c}"] <= 2 * category_threshold + 10]
    exact = df.agg(*[F.count_distinct(c).alias(c) for c in near]).first().asDict() if near else {}
    out = []
    for c in cols:
        distinct = exact.get(c, seen[f"d_{c}"])
        usable = is_numeric(types[c]) or types[c] == "string"
        common = dict(name=c, dtype=types[c], distinct=distinct, missing=seen["rows"] - seen[f"n_{c}"], rows=seen["rows"])
        if c in categorical_cols or distinct <= category_threshold or not usable:
            out.append(Attribute(kind="categorical", **common))
        else:
            lo, hi = seen[f"lo_{c}"], seen[f"hi_{c}"]
            kind = "length" if types[c] == "string" else "histogram"
            out.append(Attribute(kind=kind, lo=lo, hi=hi, bins=1 if lo == hi else histogram_bins, **common))
    return out


def attribute_counts(df: DataFrame, attributes: Sequence[Attribute]) -> DataFrame:
    """(attr, bin, value, n): one scan, one shuffle of pre-aggregated counts.

    Empty bins of a histogram are listed with n = 0.
    """
    df = nan_as_null(df)
    cells = []
    for a in attributes:
        categorical = a.kind == "categorical"
        cells.append(
            F.struct(
                F.lit(a.name).alias("attr"),
                (F.lit(None).cast("bigint") if categorical else a.bin()).alias("bin"),
                (F.col(a.name).cast("string") if categorical else F.lit(None).cast("string")).alias("value"),
            )
        )
    melted = df.select(F.explode(F.array(*cells)).alias("c")).select("c.*")
    known = melted.filter(F.col("bin").isNotNull() | F.col("value").isNotNull())
    counts = known.groupBy("attr", "bin", "value").agg(F.count(F.lit(1)).alias("n"))
    empty = [(a.name, b) for a in attributes if a.kind != "categorical" for b in range(a.bins)]
    if empty:
        cells = [F.struct(F.lit(c).alias("attr"), F.lit(b).cast("bigint").alias("bin")) for c, b in empty]
        zero = df.sparkSession.range(1).select(F.explode(F.array(*cells)).alias("c")).select(
            "c.*", F.lit(None).cast("string").alias("value"), F.lit(0).cast("bigint").alias("n")
        )
        counts = counts.unionByName(zero).groupBy("attr", "bin", "value").agg(F.sum("n").alias("n"))
    return counts


def attribute_distribution(
    df: DataFrame, attributes: Sequence[Attribute], epsilon: float | None = None, seed: int = 42
) -> DataFrame:
    """(attr, bin, value, lo, hi, n, prob, cum_lo, cum_hi) of each column.

    With ``epsilon``, Laplace noise of scale 2 * columns / (rows * epsilon) is
    added to the frequencies, which are clipped at 0 and normalised again.
    """
    counts = attribute_counts(df, attributes).withColumn("weight", F.col("n"))
    if epsilon:
        # one row per column of the table, so these sides are small by construction
        totals = counts.groupBy("attr").agg(F.sum("n").alias("_t"))
        rows = max(attributes[0].rows, 1)
        u = uniform(seed, "noise", F.col("attr"), F.coalesce("value", F.col("bin").cast("string")))
        noisy = F.col("n") / F.col("_t") + laplace(u, 2.0 * len(attributes) / (rows * epsilon))
        # whole numbers: their running sums are exact in any order of addition
        counts = counts.join(F.broadcast(totals), "attr").withColumn(
            "weight", F.round(F.greatest(F.lit(0.0), noisy) * F.lit(NOISE_UNIT)).cast("bigint")
        )
        mass = counts.groupBy("attr").agg(F.sum("weight").alias("_m"))
        counts = counts.join(F.broadcast(mass), "attr")
        counts = counts.withColumn("weight", F.when(F.col("_m") > 0, F.col("weight")).otherwise(1)).drop("_t", "_m")
    summed = running_sum(
        counts.withColumn("_one", F.lit(1)), ["attr"], ["bin", "value"], {"_rank": "_one", "_cum": "weight"}
    )
    mass = summed.groupBy("attr").agg(F.sum("weight").alias("_m"))
    out = summed.join(F.broadcast(mass), "attr").select(
        "attr",
        (F.col("_rank") - 1).alias("bin"),
        "value",
        "n",
        (F.col("weight") / F.col("_m")).alias("prob"),
        ((F.col("_cum") - F.col("weight")) / F.col("_m")).alias("cum_lo"),
        (F.col("_cum") / F.col("_m")).alias("cum_hi"),
    )
    return with_edges(out, attributes)


def with_edges(dist: DataFrame, attributes: Sequence[Attribute]) -> DataFrame:
    lo = hi = F.lit(None).cast("double")
    for a in attributes:
        if a.kind != "categorical":
            mine = F.col("attr") == a.name
            left = F.lit(a.lo) + F.col("bin") * F.lit(a.width)
            right = F.when(F.col("bin") == a.bins - 1, F.lit(a.hi)).otherwise(left + F.lit(a.width))
            lo, hi = F.when(mine, left).otherwise(lo), F.when(mine, right).otherwise(hi)
    return dist.withColumn("lo", lo).withColumn("hi", hi)


# --- Bayesian network ---------------------------------------------------------


@dataclass
class BinnedTable:
    """A table of small integers: code or bin per column, with a last bin for nulls."""

    rows: DataFrame
    attributes: list[Attribute]
    cards: dict[str, int]
    encoder: LabelEncoder | None
    weight: str | None = None  # a column that says how many rows a row stands for

    def key(self, cols: Sequence[str]) -> Column:
        """Mixed-radix number of the bins of several columns."""
        if math.prod(self.cards[c] for c in cols) >= 1 << 62:
            raise ValueError(f"too many value combinations over {list(cols)}")
        out = F.lit(0).cast("bigint")
        for c in cols:
            out = out * F.lit(self.cards[c]).cast("bigint") + F.col(c)
        return out


def bin_table(df: DataFrame, attributes: Sequence[Attribute]) -> BinnedTable:
    df = nan_as_null(df)
    attributes = list(attributes)
    names = [a.name for a in attributes]
    labelled = [a.name for a in attributes if a.kind == "categorical"]
    encoder = LabelEncoder.fit(df, labelled) if labelled else None
    bins = {a.name: (encoder.sizes.get(a.name, 0) if a.name in labelled else a.bins) for a in attributes}
    rows = df.select(*names, *[F.col(c).isNull().alias(f"_null_{c}") for c in labelled])
    rows = rows.withColumns({a.name: a.bin() for a in attributes if a.kind != "categorical"})
    if encoder:
        rows = encoder.transform(rows)
        rows = rows.withColumns({c: F.when(~F.col(f"_null_{c}"), F.col(c)) for c in labelled})
    rows = rows.select(*[F.coalesce(F.col(c), F.lit(bins[c])).cast("bigint").alias(c) for c in names])
    return BinnedTable(rows, attributes, {c: bins[c] + 1 for c in names}, encoder)


def weighted(table: BinnedTable) -> BinnedTable:
    """The distinct rows, each with its number: what every entropy is counted from."""
    counted = table.rows.groupBy(*table.cards).agg(F.count(F.lit(1)).alias("_weight"))
    return replace(table, rows=materialise(counted), weight="_weight")


def subset_entropies(table: BinnedTable, subsets: Sequence[tuple[str, ...]]) -> DataFrame:
    """(subset, entropy) in nats.

    Every row names its bins in each subset; counts are combined on the map
    side, so what is shuffled is the distinct combinations, not the rows.
    """
    cells = F.array(
        *[F.struct(F.lit(",".join(s)).alias("subset"), table.key(s).alias("key")) for s in subsets]
    )
    weight = F.col(table.weight) if table.weight else F.lit(1).cast("bigint")
    counts = table.rows.select(F.explode(cells).alias("c"), weight.alias("w")).groupBy("c.subset", "c.key").agg(F.sum("w").alias("n"))
    total = F.sum("n")
    return counts.groupBy("subset").agg(
        (F.log(total) - F.sum(F.col("n") * F.log("n")) / total).alias("entropy")
    )


def entropies(table: BinnedTable, subsets: Sequence[tuple[str, ...]]) -> dict[str, float]:
    """:func:`subset_entropies` as numbers, so many subsets per job that its plan stays small."""
    if len(subsets) > SUBSETS_PER_JOB:
        table = replace(table, rows=materialise(table.rows))
    chunks = [subsets[i : i + SUBSETS_PER_JOB] for i in range(0, len(subsets), SUBSETS_PER_JOB)]
    rows = side_by_side(table.rows.sparkSession, lambda c: subset_entropies(table, c).collect(), chunks, 4)
    return {r["subset"]: r["entropy"] for chunk in rows for r in chunk}


def mutual_information(table: BinnedTable) -> DataFrame:
    """(child, parent, mi) for each pair of columns, child < parent by name."""
    names = sorted(table.cards)
    pairs = list(combinations(names, 2))
    ent = entropies(table, [(c,) for c in names] + pairs)
    rows = [(a, b, ent[a] + ent[b] - ent[f"{a},{b}"]) for a, b in pairs]
    return table.rows.sparkSession.createDataFrame(rows, "child string, parent string, mi double")


@dataclass
class Network:
    """Columns in sampling order, each with its parents."""

    edges: list[tuple[str, tuple[str, ...]]] = field(default_factory=list)

    def frame(self, spark) -> DataFrame:
        rows = [(i, c, list(p)) for i, (c, p) in enumerate(self.edges)]
        return spark.createDataFrame(rows, "step int, child string, parents array<string>")


def learn_network(table: BinnedTable, max_parents: int = 2, seen: list[int] | None = None) -> Network:
    """Greedy network: repeatedly add the (child, parents) of highest mutual information.

    I(c; P) = H(c) + H(P) - H(c, P). The entropies of single columns and pairs
    are counted first, over distinct weighted rows. They bound what larger sets
    can reach: I(c; P) is at most H(c), and at most I(c; p) plus what the other
    parents add to p. A larger set is counted only while its bound could still
    win its step, best bounds first; only one number per set reaches the driver.
    The root and ties go by name. ``seen`` receives the numbers of sets counted.
    """
    names = sorted(table.cards)
    if not names:
        return Network()
    table = weighted(table)
    ent: dict[tuple[str, ...], float] = {(): 0.0}

    def count(subsets: Iterable[tuple[str, ...]]) -> None:
        fresh = sorted({tuple(sorted(s)) for s in subsets} - ent.keys())
        if fresh:
            found = entropies(table, fresh)
            # the entropy of an empty table is no number
            ent.update({s: found.get(",".join(s)) or 0.0 for s in fresh})
            if seen is not None:
                seen.append(len(fresh))

    def h(*cols: str) -> float:
        return ent[tuple(sorted(cols))]

    pairs = list(combinations(names, 2)) if max_parents >= 1 else []
    count([(c,) for c in names] + pairs)
    about = {(c, p): h(c) + h(p) - h(c, p) for pair in pairs for c, p in (pair, pair[::-1])}
    more = {(q, p): h(p, q) - h(p) for pair in pairs for q, p in (pair, pair[::-1])}

    def bound(c: str, parents: tuple[str, ...]) -> float:
        return min(h(c), *(about[c, p] + sum(more[q, p] for q in parents if q != p) for p in parents))

    net = Network([(names[0], ())])
    placed = [names[0]]
    while len(placed) < len(names):
        size = min(max_parents, len(placed))
        rest = [c for c in names if c not in placed]
        options = [(c, p) for c in rest for p in combinations(sorted(placed), size)]
        if size <= 1:
            best = min((-round(about[c, p[0]] if p else 0.0, 9), c, p) for c, p in options)
        else:
            known: dict[tuple[str, tuple[str, ...]], float] = {}
            waiting = sorted(options, key=lambda o: (-bound(*o), o))
            best = (math.inf, "", ())
            while waiting:
                some, waiting = waiting[:SETS_AT_ONCE], waiting[SETS_AT_ONCE:]
                count([(c, *p) for c, p in some] + [p for _, p in some])
                known |= {(c, p): round(h(c) + h(*p) - h(c, *p), 9) for c, p in some}
                best = min((-value, c, p) for (c, p), value in known.items())
                # the others may win by their bound, or tie by their name
                waiting = [o for o in waiting if bound(*o) > 1e-9 - best[0] or (bound(*o) >= -best[0] - 1e-9 and o < best[1:])]
        _, child, parents = best
        net.edges.append((child, parents))
        placed.append(child)
    return net


def conditional_tables(table: BinnedTable, network: Network) -> DataFrame:
    """(attr, parent_key, bin, n, prob, cum_lo, cum_hi), all children in one shuffle."""
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("attr"), table.key(p).alias("parent_key"), F.col(c).alias("bin"))
            for c, p in network.edges
        ]
    )
    counts = (
        table.rows.select(F.explode(cells).alias("c"))
        .select("c.*")
        .groupBy("attr", "parent_key", "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    summed = running_sum(counts, ["attr", "parent_key"], ["bin"], {"_hi": "n"})
    mass = summed.groupBy("attr", "parent_key").agg(F.sum("n").alias("_m"))
    joined = summed.join(mass, ["attr", "parent_key"])
    return joined.select(
        "attr",
        "parent_key",
        "bin",
        "n",
        (F.col("n") / F.col("_m")).alias("prob"),
        ((F.col("_hi") - F.col("n")) / F.col("_m")).alias("cum_lo"),
        (F.col("_hi") / F.col("_m")).alias("cum_hi"),
    )
