"""Histogram gradient boosting of many training sets at a time, trees grown best leaf first.

One table holds the rows of all sets: (v, row, draw, part, label, x, n), a line
standing for n equal rows (without that column, for one). Set (v, f) is
fitted to the rows of v whose part is neither f nor -1, and scores those whose
part is f; f = -1 is the fit on all folds, which scores the test rows (part -1).

Features are cut into at most 255 bins. A tree starts as one leaf; the leaf whose
best split gains most is split next, up to 31 leaves. Gradients and hessians
enter sums as whole numbers of 2^-30, so that a sum, and with it every split, is
the same whatever the order and place of adding.

Sets of a bounded number of rows are fitted inside one task each. Of larger ones
the bins are shared by the sets of a table, and rows of equal bins, label and part
become one line that counts them. If the lines of a set are of that bounded number,
they are fitted in a task as well. For the others
every step is a job for all of them together: rows are routed through the
trees as far as they are known, gradient sums are combined by (set, node,
feature, bin), and the best split of each node is chosen where its sums meet.
Since best-first order is known only afterwards, both children of every leaf that
may still be split are looked at ahead, so a tree takes about as many jobs as it
is deep. Both ways give the same trees for the same bins.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from counterpoise.operators.lineage import materialise
from counterpoise.operators.lookup import lookup_join
from counterpoise.operators.ranking import running_sum

BINS = 255
LEAVES = 31
ROUNDS = 100
RATE = 0.1
MIN_ROWS = 20
MIN_HESSIAN = 1e-3
MIN_GAIN = 1e-9
UNIT = float(1 << 30)
LOCAL_ROWS = 100_000
LOCAL_LINES = 1_000_000  # lines of a table that are held in a task, some 100 bytes each
SCORED = "v bigint, f int, row bigint, label double, score double, n bigint"


class Split(NamedTuple):
    """The best split of a node (none if ``feature`` is -1), and the sums of the node."""

    gain: float
    feature: int
    bin: int
    gradient: float
    hessian: float


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of arrays of equal length as a matrix."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(flat, pa.ChunkedArray):
        flat = pa.concat_arrays(flat.chunks)
    values = flat.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(flat), -1) if len(flat) else np.zeros((0, 0))


def bin_edges(values: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Upper ends of all bins but the last: between neighbouring values, or at quantiles if they are many."""
    distinct = np.unique(values)
    if len(distinct) <= bins:
        return (distinct[:-1] + distinct[1:]) / 2
    cuts = np.quantile(values, np.arange(1, bins) / bins, method="midpoint")
    return np.unique(cuts)


def binned(x: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    """Bin numbers; a value equal to an edge is in the bin below it."""
    out = np.zeros(x.shape, np.uint8)
    for j, cut in enumerate(edges):
        out[:, j] = np.searchsorted(cut, x[:, j], "left")
    return out


def counted(rows: DataFrame) -> DataFrame:
    """The rows with ``n``, how many equal rows each stands for."""
    return rows if "n" in rows.columns else rows.withColumn("n", F.lit(1).cast("bigint"))


def slopes(raw: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and hessian of the logistic loss, in whole units."""
    p = 1 / (1 + np.exp(-raw))
    return np.rint((p - label) * UNIT), np.rint(p * (1 - p) * UNIT)


def histograms(bins: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, count: np.ndarray | None = None) -> np.ndarray:
    """(3, features, bins): sums of gradient and hessian, and rows; ``count`` is how many rows each line stands for."""
    sums = np.zeros((3, bins.shape[1], BINS + 1))
    weights = (gradient, hessian, None) if count is None else (gradient * count, hessian * count, count)
    for j in range(bins.shape[1]):
        cells = bins[:, j].astype(np.intp)
        for k, w in enumerate(weights):
            sums[k, j] = np.bincount(cells, w, BINS + 1)
    return sums


def best_split(sums: np.ndarray, min_rows: int = MIN_ROWS) -> Split:
    """The split of greatest gain; ties go to the first feature, then the lowest bin."""
    total = sums[:, 0, :].sum(axis=1)
    left = np.cumsum(sums, axis=2)[:, :, :-1]
    right = total[:, None, None] - left
    gradient, hessian = total[0] / UNIT, total[1] / UNIT
    low = MIN_HESSIAN * UNIT
    fit = (left[2] >= min_rows) & (right[2] >= min_rows) & (left[1] >= low) & (right[1] >= low)
    if not fit.any():
        return Split(0.0, -1, -1, gradient, hessian)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = (left[0] ** 2 / left[1] + right[0] ** 2 / right[1]) / UNIT - gradient**2 / max(hessian, MIN_HESSIAN)
    gain[~fit] = -np.inf
    place = int(np.argmax(gain))
    feature, cut = divmod(place, gain.shape[1])
    if not gain[feature, cut] > MIN_GAIN:
        return Split(0.0, -1, -1, gradient, hessian)
    return Split(float(gain[feature, cut]), feature, cut, gradient, hessian)


@dataclass
class Tree:
    """A tree under growth: nodes whose best split is known, and their children as far as looked at."""

    leaves: int = LEAVES
    splits: dict[int, Split] = field(default_factory=dict)
    children: dict[int, tuple[int, int]] = field(default_factory=dict)
    paths: dict[int, int] = field(default_factory=lambda: {0: 1})  # 2p and 2p + 1 below p; orders equal gains
    nodes: int = 1

    def _first(self) -> tuple[list[int], list[int], set[int]]:
        """(leaves, splittable leaves by gain, split nodes) as far as best-first order is known."""
        heap = [(-self.splits[0].gain, 1, 0)] if self.splits[0].feature >= 0 else []
        leaves, inner = {0}, set()
        while heap and len(leaves) < self.leaves:
            node = heap[0][2]
            pair = self.children.get(node)
            if pair is None or any(c not in self.splits for c in pair):
                break
            heapq.heappop(heap)
            leaves.remove(node)
            inner.add(node)
            for c in pair:
                leaves.add(c)
                if self.splits[c].feature >= 0:
                    heapq.heappush(heap, (-self.splits[c].gain, self.paths[c], c))
        open_ = [node for _, _, node in sorted(heap)][: self.leaves - len(leaves)]
        return sorted(leaves), open_, inner

    def wanted(self, ahead: bool) -> list[int]:
        """Nodes whose best split has to be known next: children of the next leaf, or of all that may follow."""
        if 0 not in self.splits:
            return [0]
        _, open_, _ = self._first()
        out = []
        for node in open_ if ahead else open_[:1]:
            if node not in self.children:
                self.children[node] = (self.nodes, self.nodes + 1)
                self.paths |= {self.nodes + side: 2 * self.paths[node] + side for side in (0, 1)}
                self.nodes += 2
            out += [c for c in self.children[node] if c not in self.splits]
        return out

    def table(self, values: bool = True) -> np.ndarray:
        """(nodes, 5): feature (-1 in a leaf), bin, left, right, value of the leaves kept."""
        out = np.zeros((self.nodes, 5))
        out[:, 0] = -1
        if values:
            leaves, _, inner = self._first()
            for node in leaves:
                s = self.splits[node]
                out[node, 4] = -RATE * s.gradient / s.hessian if s.hessian > 0 else 0.0
        else:
            inner = set(self.children)
        for node in inner:
            s = self.splits[node]
            out[node, :4] = s.feature, s.bin, *self.children[node]
        return out


def route(table: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """The leaf of the table that each row falls into."""
    at = np.zeros(len(bins), np.int64)
    live = np.arange(len(bins))
    while True:
        feature = table[at[live], 0].astype(np.int64)
        live, feature = live[feature >= 0], feature[feature >= 0]
        if len(live) == 0:
            return at
        down = bins[live, feature] > table[at[live], 1]
        at[live] = table[at[live], 2 + down].astype(np.int64)


def baseline(n: int, positive: float) -> float:
    """The log-odds that all rows start from."""
    p = min(max(positive / max(n, 1), 1e-15), 1 - 1e-15)
    return float(np.log(p / (1 - p)))


def fit_rows(
    bins: np.ndarray, label: np.ndarray, others: np.ndarray, rounds: int = ROUNDS, leaves: int = LEAVES, count: np.ndarray | None = None
) -> np.ndarray:
    """Raw scores of ``others`` after fitting to the rows, all in memory; ``count`` is how many rows each line stands for."""
    count = np.ones(len(label)) if count is None else count.astype(float)
    start = baseline(int(count.sum()), float((label * count).sum()))
    raw, out = np.full(len(label), start), np.full(len(others), start)
    for _ in range(rounds):
        gradient, hessian = slopes(raw, label)
        gradient, hessian = gradient * count, hessian * count

        def summed(at: np.ndarray) -> np.ndarray:
            sums = histograms(bins[at], gradient[at], hessian[at])
            for j in range(bins.shape[1]):
                sums[2, j] = np.bincount(bins[at, j].astype(np.intp), count[at], BINS + 1)
            return sums

        tree, rows, held = Tree(leaves), {0: np.arange(len(label))}, {}
        while nodes := tree.wanted(ahead=False):
            if nodes == [0]:
                held[0] = summed(rows[0])
            else:
                parent = next(p for p, pair in tree.children.items() if nodes[0] in pair)
                down = bins[rows[parent], tree.splits[parent].feature] > tree.splits[parent].bin
                whole, pair = rows.pop(parent), tree.children[parent]
                rows |= {c: whole[down == bool(side)] for side, c in enumerate(pair)}
                # sums are whole numbers, so those of the larger side are what the smaller leaves
                few, many = sorted(pair, key=lambda c: len(rows[c]))
                held[few] = summed(rows[few])
                held[many] = held.pop(parent) - held[few]
            for node in nodes:
                tree.splits[node] = best_split(held[node])
        table = tree.table()
        for node, at in rows.items():
            raw[at] += table[node, 4]
        out += table[route(table, others), 4]
    return out


def expand(rows: DataFrame, folds: DataFrame) -> DataFrame:
    """A row for each set that fits to it or scores it; ``folds`` is (v, folds), one row for each v."""
    joined = rows.join(F.broadcast(folds), "v")  # as many rows as tables are evaluated
    every = F.sequence(F.lit(-1), F.col("folds") - 1)
    return joined.withColumn("f", F.explode(F.when(F.col("part") == -1, F.array(F.lit(-1))).otherwise(every))).drop("folds")


def local_scores(rows: DataFrame, folds: DataFrame, rounds: int = ROUNDS, leaves: int = LEAVES) -> DataFrame:
    """Scores of sets small enough for a task each."""

    def run(table: pa.Table) -> pa.Table:
        v, f = table.column("v")[0].as_py(), table.column("f")[0].as_py()
        part, label, x = table.column("part").to_numpy(), table.column("label").to_numpy(), matrix(table.column("x"))
        inside = (part >= 0) & (part != f)
        out = part == f
        many = table.column("n").to_numpy()
        edges = [bin_edges(np.repeat(x[inside, j], many[inside])) for j in range(x.shape[1])]
        bins = binned(x, edges)
        return _scored(table, bins, inside, out, rounds, leaves)

    return expand(counted(rows), folds).groupBy("v", "f").applyInArrow(run, SCORED)


def _scored(table: pa.Table, bins: np.ndarray, inside: np.ndarray, out: np.ndarray, rounds: int, leaves: int) -> pa.Table:
    """The rows ``out`` of a set's table, scored by the fit to its rows ``inside``."""
    label, many = table.column("label").to_numpy(), table.column("n").to_numpy()
    score = np.zeros(out.sum())
    if inside.any():
        # rows of equal bins and label are one line of the fit, those of equal bins one score
        keys, of = np.unique(np.column_stack([bins[inside], label[inside] > 0]), axis=0, return_inverse=True)
        asked, at = np.unique(bins[out], axis=0, return_inverse=True)
        sums = np.bincount(of.ravel(), many[inside], len(keys))
        score = fit_rows(np.ascontiguousarray(keys[:, :-1]), keys[:, -1].astype(float), asked, rounds, leaves, sums)[at.ravel()]
    columns = [table.column(c).combine_chunks().filter(pa.array(out)) for c in ("v", "f", "row", "label", "n")]
    return pa.Table.from_arrays([*columns[:4], pa.array(score), columns[4]], ["v", "f", "row", "label", "score", "n"])


# --- sets larger than a task ------------------------------------------------------


def shared_edges(rows: DataFrame, width: int, bins: int = BINS) -> dict[int, list[np.ndarray]]:
    """Bin edges of every v, from its training rows: between neighbouring values, or the quantiles if they are many."""
    cells = counted(rows).filter("part >= 0").select("v", F.posexplode("x").alias("j", "value"), "n")
    values = materialise(cells.groupBy("v", "j", "value").agg(F.sum("n").alias("n")))
    sizes = materialise(values.groupBy("v", "j").agg(F.count(F.lit(1)).alias("distinct"), F.sum("n").alias("total")))
    upto = lookup_join(running_sum(values, ["v", "j"], ["value"], {"upto": "n"}), sizes, ["v", "j"])
    # the value at a quantile is the first whose rows, with those before it, reach it
    step = lambda x: F.expr(f"({x}) * {bins} div total")
    wanted = (F.col("distinct") <= bins) | ((step("upto") > step("upto - n")) & (F.col("upto") < F.col("total")))
    found = upto.filter(wanted).select("v", "j", "value", "distinct").orderBy("v", "j", "value").collect()
    seen: dict[tuple[int, int], list[float]] = {}
    few = {}
    for r in found:
        seen.setdefault((r["v"], r["j"]), []).append(r["value"])
        few[r["v"], r["j"]] = r["distinct"] <= bins
    out: dict[int, list[np.ndarray]] = {r["v"]: [np.zeros(0)] * width for r in sizes.select("v").distinct().collect()}
    for (v, j), cuts in seen.items():
        at = np.array(cuts)
        out[v][j] = (at[:-1] + at[1:]) / 2 if few[v, j] else at
    return out


def binned_rows(rows: DataFrame, edges: dict[int, list[np.ndarray]]) -> DataFrame:
    """(v, row, part, label, n, bins)."""
    sent = rows.sparkSession.sparkContext.broadcast(edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, x = batch.column("v").to_numpy(), matrix(batch.column("x"))
            bins = np.zeros(x.shape, np.uint8)
            for one in np.unique(v):
                bins[v == one] = binned(x[v == one], sent.value[one])
            arrays = [*(batch.column(c) for c in ("v", "row", "part", "label", "n")), pa.array([b.tobytes() for b in bins], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["v", "row", "part", "label", "n", "bins"])

    coded = counted(rows).select("v", "row", "part", "label", "n", "x")
    return coded.mapInArrow(run, "v bigint, row bigint, part int, label double, n bigint, bins binary")


def binned_lines(coded: DataFrame) -> DataFrame:
    """(v, row, part, label, bins, n): rows of equal bins, label and part are one line; ``row`` is one of theirs."""
    lines = coded.groupBy("v", "part", "label", "bins").agg(F.min("row").alias("row"), F.sum("n").alias("n"))
    return materialise(lines.select("v", "row", "part", "label", "bins", "n"))


def line_scores(lines: DataFrame, folds: DataFrame, rounds: int = ROUNDS, leaves: int = LEAVES) -> DataFrame:
    """Scores of sets whose binned lines are few enough for a task each."""

    def run(table: pa.Table) -> pa.Table:
        f, part = table.column("f")[0].as_py(), table.column("part").to_numpy()
        packed = b"".join(table.column("bins").to_pylist())
        bins = np.frombuffer(packed, np.uint8).reshape(len(part), -1)
        return _scored(table, bins, (part >= 0) & (part != f), part == f, rounds, leaves)

    # a fixed number of partitions: the work per byte is far above what size-based merging expects
    parts = 2 * (folds.agg(F.sum(F.col("folds") + 1)).first()[0] or 1)
    return expand(lines, folds).repartition(parts, "v", "f").groupBy("v", "f").applyInArrow(run, SCORED)


def _state(lines: DataFrame, starts: dict[int, list[float]]) -> DataFrame:
    """(v, row, part, label, bins, n, raw): raw scores of a line in all sets of its v, f = -1 first."""
    listed = [(v, values) for v, values in starts.items()]
    listed = lines.sparkSession.createDataFrame(listed, "v bigint, raw array<double>")  # a row for each table
    return materialise(lines.join(F.broadcast(listed), "v").select("v", "row", "part", "label", "bins", "n", "raw"))


_STATE = "v bigint, row bigint, part int, label double, bins binary, n bigint, raw array<double>"


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, dict]]:
    """Rows of a batch by v: (v, their places, columns)."""
    v = batch.column("v").to_numpy()
    part, label, n = (batch.column(c).to_numpy() for c in ("part", "label", "n"))
    packed = batch.column("bins").to_pylist()
    raw = batch.column("raw").to_pylist()
    for one in np.unique(v):
        at = np.flatnonzero(v == one)
        bins = np.frombuffer(b"".join(packed[i] for i in at), np.uint8).reshape(len(at), -1)
        yield int(one), at, {"part": part[at], "label": label[at], "n": n[at], "bins": bins, "raw": np.array([raw[i] for i in at])}


def _node_splits(state: DataFrame, trees: dict[tuple[int, int], Tree], wanted: dict[tuple[int, int], list[int]]) -> None:
    """One job: the best splits of all wanted nodes of all sets."""
    sent = state.sparkSession.sparkContext.broadcast({s: (trees[s].table(values=False), nodes) for s, nodes in wanted.items()})
    names = ["v", "f", "node", "feature", "bin", "g", "h", "n"]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int, int], np.ndarray] = {}
        for batch in batches:
            for v, _, rows in _unpacked(batch):
                for (of, f), (table, nodes) in sent.value.items():
                    inside = (rows["part"] >= 0) & (rows["part"] != f)
                    if of != v or not inside.any():
                        continue
                    bins, many = rows["bins"][inside], rows["n"][inside]
                    gradient, hessian = slopes(rows["raw"][inside, f + 1], rows["label"][inside])
                    leaf = route(table, bins)
                    for node in nodes:
                        at = leaf == node
                        if at.any():
                            found = histograms(bins[at], gradient[at], hessian[at], many[at])
                            held[v, f, node] = held[v, f, node] + found if (v, f, node) in held else found
        for (v, f, node), found in held.items():
            feature, cut = np.nonzero(found[2])
            values = [np.full(len(feature), k) for k in (v, f, node)] + [feature, cut, *found[:, feature, cut]]
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in values], names)

    def choose(table: pa.Table) -> pa.Table:
        cells = {c: table.column(c).to_numpy() for c in names}
        width = int(cells["feature"].max()) + 1
        found = np.zeros((3, width, BINS + 1))
        for k, c in enumerate("ghn"):
            found[k, cells["feature"], cells["bin"]] = cells[c]
        split = best_split(found)
        out = {c: [int(cells[c][0])] for c in ("v", "f", "node")}
        return pa.table(out | {c: [getattr(split, c)] for c in Split._fields})

    summed = state.mapInArrow(sums, ", ".join(f"{c} bigint" for c in names)).groupBy("v", "f", "node", "feature", "bin")
    summed = summed.agg(*[F.sum(c).alias(c) for c in "ghn"])
    chosen = summed.groupBy("v", "f", "node").applyInArrow(
        choose, "v bigint, f bigint, node bigint, gain double, feature bigint, bin bigint, gradient double, hessian double"
    )
    for r in chosen.collect():  # a row for each node asked for
        trees[r["v"], r["f"]].splits[r["node"]] = Split(r["gain"], r["feature"], r["bin"], r["gradient"], r["hessian"])
    sent.unpersist()


def _grown(state: DataFrame, trees: dict[tuple[int, int], Tree]) -> DataFrame:
    """The state with the values of finished trees added, held-out and test rows included."""
    sent = state.sparkSession.sparkContext.broadcast({s: tree.table() for s, tree in trees.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw: list = [None] * batch.num_rows
            for v, at, rows in _unpacked(batch):
                for f in range(-1, rows["raw"].shape[1] - 1):
                    table = sent.value[v, f]
                    rows["raw"][:, f + 1] += table[route(table, rows["bins"]), 4]
                for i, line in zip(at, rows["raw"]):
                    raw[i] = line
            columns = [*(batch.column(c) for c in ("v", "row", "part", "label", "bins", "n")), pa.array(raw, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["v", "row", "part", "label", "bins", "n", "raw"])

    return materialise(state.mapInArrow(run, _STATE))


def root_splits(rows: DataFrame, sizes: dict[tuple[int, int], tuple[int, int]], width: int) -> list[tuple]:
    """(v, f, feature, edge, gain) of the first split of each set, by one job for all of them."""
    edges = shared_edges(rows, width)
    starts = _starts(sizes)
    trees = {s: Tree() for s in sizes}
    _node_splits(_state(binned_lines(binned_rows(rows, edges)), starts), trees, {s: [0] for s in sizes})
    best = {s: tree.splits[0] for s, tree in trees.items()}
    return [(v, f, s.feature, float(edges[v][s.feature][s.bin]), s.gain) for (v, f), s in sorted(best.items()) if s.feature >= 0]


def _starts(sizes: dict[tuple[int, int], tuple[int, int]]) -> dict[int, list[float]]:
    """Baselines of the sets of each v, f = -1 first."""
    folds: dict[int, int] = {}
    for v, f in sizes:
        folds[v] = max(folds.get(v, 0), f + 1)
    return {v: [baseline(*sizes[v, f]) for f in range(-1, k)] for v, k in folds.items()}


def wide_scores(
    rows: DataFrame,
    sizes: dict[tuple[int, int], tuple[int, int]],
    width: int,
    rounds: int = ROUNDS,
    leaves: int = LEAVES,
    task_lines: int = 0,
    each: bool = True,
) -> DataFrame:
    """Scores of sets of any size; ``sizes`` is (rows, positive rows) fitted to of each set (v, f).

    Tables of at most ``task_lines`` lines of binned rows are fitted a set to a
    task, larger ones by jobs over all their sets. Without ``each`` a line is one
    row of the result, with ``n`` telling how many rows it stands for.
    """
    coded = binned_rows(rows, shared_edges(rows, width))
    lines = binned_lines(coded)
    starts = _starts(sizes)
    # a row for each table
    counts = {r["v"]: r["lines"] for r in lines.groupBy("v").agg(F.count(F.lit(1)).alias("lines")).collect()} if task_lines else {}
    near = {v: len(starts[v]) - 1 for v, found in counts.items() if found <= task_lines}
    parts = []
    if near:
        folds = rows.sparkSession.createDataFrame(list(near.items()), "v bigint, folds int")
        parts.append(line_scores(lines.filter(F.col("v").isin(sorted(near))), folds, rounds, leaves))
    far = {s: size for s, size in sizes.items() if s[0] not in near}
    if far:
        state = _state(lines.filter(F.col("v").isin(sorted({v for v, _ in far}))), _starts(far))
        for _ in range(rounds):
            trees = {s: Tree(leaves) for s in far}
            while wanted := {s: nodes for s, tree in trees.items() if (nodes := tree.wanted(ahead=True))}:
                _node_splits(state, trees, wanted)
            state = _grown(state, trees)
        # a row is scored by the set that leaves its part out; without folds only test rows are
        own = F.get("raw", F.col("part") + 1)
        parts.append(state.select("v", F.col("part").alias("f"), "row", "label", own.alias("score"), "n").filter("score IS NOT NULL"))
    scores = reduce(DataFrame.unionByName, parts)
    if not each:
        return scores
    line = ["v", "part", "label", "bins"]
    of = lines.select(*line, F.col("row").alias("_line"))
    found = scores.select("v", F.col("row").alias("_line"), "score")
    members = coded.join(of, line).join(found, ["v", "_line"])
    return members.select("v", F.col("part").alias("f"), "row", "label", "score", "n")
