"""Random forests of many training sets at a time, every tree grown until its leaves are pure.

Sets are laid out as in :mod:`counterpoise.operators.boosting`. A tree is fitted
to a bootstrap of its set: each row counts a Poisson(1) number of times, and a
line that stands for n equal rows a Poisson(n) number, their sum's distribution, as a
function of the seed, the tree and the line's ``draw`` (a hash of its name), so a
retried task draws the same rows and sampling needs no order. At a node the root of the number of
features are drawn, by a hash of the node's place in the tree; if all of them are
constant there, more are drawn. The split of least Gini impurity is taken, halfway
between two neighbouring values, as long as a node holds both classes and any
feature that varies. Depth is not limited. A row's score is the mean share of
positives in its leaves.

Tables of a bounded number of lines are fitted in tasks of some trees of all
their sets, all trees of a set level by level at once, over distinct values with the
class counts drawn for them. Trees of larger sets begin with
histograms: class counts by (set, tree, node, feature, bin) are summed over the
table, and nodes are split at bin edges until the rows of a node, fitted and
scored, fit a task; there the rows of each such node meet and finish its subtree
with exact splits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from counterpoise.operators.boosting import BINS, LOCAL_ROWS, binned, counted, matrix, shared_edges
from counterpoise.operators.lineage import materialise

TREES = 100
TASK_TREES = 25
TASKS = 48  # tasks asked for at least, if trees are enough
TASK_ENTRIES = 1_500_000
_RATIO = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of the splitmix64 generator."""
    x = np.asarray(x).astype(np.uint64)
    with np.errstate(over="ignore"):
        x = x + np.uint64(_RATIO)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def tree_seed(seed: int, v: int, f: int, tree: np.ndarray) -> np.ndarray:
    """One number for each tree of a set, also the place name of its root."""
    head = _mix(np.array([(seed * 1_000_003 + v) & (2**63 - 1)]))
    return _mix(_mix(head ^ np.uint64(f + 2)) ^ np.asarray(tree).astype(np.uint64))


# The distribution of a Poisson variable of mean 1.
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)])


@lru_cache(maxsize=4_096)
def _poisson(n: int) -> tuple[int, np.ndarray]:
    """(low, distribution from low on) of a Poisson variable of mean n; what lies beyond ten deviations is left out."""
    if n == 1:
        return 0, _POISSON
    spread = 10 * math.sqrt(n) + 20
    k = np.arange(max(0, int(n - spread)), int(n + spread))
    logs = np.concatenate([[0.0], np.cumsum(np.log(k[1:]))]) + math.lgamma(k[0] + 1)
    return int(k[0]), np.cumsum(np.exp(k * math.log(n) - n - logs))


def bootstrap(seeds: np.ndarray, row: np.ndarray, n: np.ndarray | None = None) -> np.ndarray:
    """(trees, rows): how often each row counts in each tree; row i stands for n[i] equal ones."""
    with np.errstate(over="ignore"):
        bits = _mix(seeds[:, None] ^ _mix(row.astype(np.uint64))[None, :])
    uniform = (bits >> np.uint64(11)).astype(float) / float(1 << 53)
    if n is None or (n == 1).all():
        return np.searchsorted(_POISSON, uniform, "right")
    out = np.zeros(uniform.shape, np.int64)
    order = np.argsort(n, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(n[order])) + 1):
        low, upto = _poisson(int(n[at[0]]))
        out[:, at] = low + np.searchsorted(upto, uniform[:, at], "right")
    return out


def drawn_features(place: np.ndarray, width: int) -> np.ndarray:
    """(nodes, features): the order in which a node draws its features."""
    with np.errstate(over="ignore"):
        keys = _mix(place[:, None] ^ _mix(np.arange(1, width + 1, dtype=np.uint64))[None, :])
    return np.argsort(keys, axis=1, kind="stable")


def child_place(place: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The place name of a node's left or right child."""
    with np.errstate(over="ignore"):
        return _mix(place * np.uint64(2) + right.astype(np.uint64))


class Cuts(NamedTuple):
    """For each node the best cut of the drawn feature: gain (minus infinity: none), and the values next to it."""

    gain: np.ndarray
    below: np.ndarray
    above: np.ndarray


def best_cuts(node: np.ndarray, rank: np.ndarray, weight: np.ndarray, positive: np.ndarray, nodes: int) -> Cuts:
    """Cuts between ranks of each node, by the weighted squares of the class counts on both sides."""
    width = int(rank.max(initial=0)) + 1
    key = node * width + rank
    order = np.argsort(key)  # lines of equal rank are never cut apart, so their order is free
    n, key = node.take(order), key.take(order)
    w, p = np.cumsum(weight.take(order)), np.cumsum(positive.take(order))
    last = np.cumsum(np.bincount(node, minlength=nodes))
    first = np.concatenate([[0], last[:-1]])
    before_w, before_p = np.concatenate([[0], w]), np.concatenate([[0], p])
    base_w, base_p = before_w[first], before_p[first]
    total_w, total_p = before_w[last] - base_w, before_p[last] - base_p
    cut = np.flatnonzero((n[1:] == n[:-1]) & (key[1:] != key[:-1])) if len(n) else np.zeros(0, np.int64)
    gain, below, above = np.full(nodes, -np.inf), np.zeros(nodes, np.int64), np.zeros(nodes, np.int64)
    if len(cut) == 0:
        return Cuts(gain, below, above)
    of = n[cut]
    lw, lp = (w.take(cut) - base_w.take(of)).astype(float), (p.take(cut) - base_p.take(of)).astype(float)
    rw, rp = total_w.take(of) - lw, total_p.take(of) - lp
    ln, rn = lw - lp, rw - rp
    score = (lp * lp + ln * ln) / lw + (rp * rp + rn * rn) / rw
    opens = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    top = np.maximum.reduceat(score, opens)
    hit = np.flatnonzero(score == np.repeat(top, np.diff(np.append(opens, len(of)))))
    hit = hit[np.append(True, of[hit][1:] != of[hit][:-1])]  # the first of equals
    best = of[hit]
    gain[best], below[best], above[best] = score[hit], key[cut[hit]] - best * width, key[cut[hit] + 1] - best * width
    return Cuts(gain, below, above)


def grow(
    x: np.ndarray,
    label: np.ndarray | None,
    weight: np.ndarray,
    others: np.ndarray,
    place: np.ndarray,
    deepest: list[int] | None = None,
    ones: np.ndarray | None = None,
) -> np.ndarray:
    """(trees, others): the share of positives in the leaf of each of ``others``.

    ``weight`` is (trees, rows), ``place`` the name of each tree's root. All trees
    advance together, a level at a time; ``deepest`` receives the number of levels.
    Where rows of both labels share a line, ``ones`` (trees, rows) is the positive part of ``weight``.
    """
    trees, width = len(place), x.shape[1]
    draws = max(1, int(math.sqrt(width)))
    values = [np.unique(x[:, j]) for j in range(width)]
    ranks = np.stack([np.searchsorted(values[j], x[:, j]) for j in range(width)], axis=1) if width else np.zeros(x.shape, np.int64)
    # gathered from flat arrays: a level is a few passes over what still stands in nodes of both classes
    flat, ahead_flat = ranks.astype(np.int32).ravel(), np.ascontiguousarray(others).ravel()
    tree, row = np.nonzero(weight)
    node, count = tree.copy(), weight[tree, row]
    positive = count * label[row].astype(np.int64) if ones is None else ones[tree, row]
    ahead_tree, ahead = np.divmod(np.arange(trees * len(others)), max(1, len(others)))
    ahead_node = ahead_tree.copy()
    out = np.zeros((trees, len(others)))
    nodes, levels = trees, 0
    while nodes:
        levels += 1
        total, held = np.bincount(node, count, nodes), np.bincount(node, positive, nodes)
        share = np.divide(held, total, out=np.zeros(nodes), where=total > 0)
        # a node of one line cannot be split
        mixed = np.flatnonzero((held > 0) & (held < total) & (np.bincount(node, minlength=nodes) > 1)) if width else np.zeros(0, np.int64)
        number = np.full(nodes, -1)
        number[mixed] = np.arange(len(mixed))
        node = number.take(node)
        stay = np.flatnonzero(node >= 0)
        row, node, count, positive = row.take(stay), node.take(stay), count.take(stay), positive.take(stay)
        feature, edge, below = np.full(nodes, -1), np.zeros(nodes), np.zeros(len(mixed), np.int64)
        if len(mixed):
            order = drawn_features(place[mixed], width)
            gain = np.full(len(mixed), -np.inf)
            node_of, row_of, count_of, positive_of = node, row, count, positive
            for draw in range(width):
                if draw >= draws:  # only where all features so far are constant
                    want = np.isneginf(gain)
                    if not want.any():
                        break
                    some = np.flatnonzero(want.take(node_of))
                    node_of, row_of, count_of, positive_of = node_of.take(some), row_of.take(some), count_of.take(some), positive_of.take(some)
                drawn = order[:, draw]
                cuts = best_cuts(node_of, flat.take(row_of * width + drawn.take(node_of)), count_of, positive_of, len(mixed))
                better = np.flatnonzero(cuts.gain > gain)
                gain[better] = cuts.gain[better]
                feature[mixed[better]], below[better] = drawn[better], cuts.below[better]
                for j in range(width):
                    k = better[drawn[better] == j]
                    edge[mixed[k]] = (values[j][cuts.below[k]] + values[j][cuts.above[k]]) / 2
        done = feature.take(ahead_node) < 0
        out[ahead_tree[done], ahead[done]] = share[ahead_node[done]]
        left = np.flatnonzero(~done)
        ahead_tree, ahead, ahead_node = ahead_tree.take(left), ahead.take(left), ahead_node.take(left)
        split = np.flatnonzero(feature >= 0)
        index = np.zeros(nodes, np.int64)
        index[split] = np.arange(len(split))
        chosen = feature[mixed].take(node)
        if len(split) < len(mixed):
            stay = np.flatnonzero(chosen >= 0)
            row, node, count, positive, chosen = row.take(stay), node.take(stay), count.take(stay), positive.take(stay), chosen.take(stay)
        right = flat.take(row * width + chosen) > below.take(node)
        ahead_right = ahead_flat.take(ahead * width + feature.take(ahead_node)) > edge.take(ahead_node)
        node = 2 * index[mixed].take(node) + right
        ahead_node = 2 * index.take(ahead_node) + ahead_right
        place = child_place(np.repeat(place[split], 2), np.tile([0, 1], len(split)))
        nodes = 2 * len(split)
    if deepest is not None:
        deepest.append(levels)
    return out


_SHARES = "v bigint, f int, row bigint, label double, n bigint, share double"


def _mean(shares: DataFrame, trees: int) -> DataFrame:
    found = shares.groupBy("v", "f", "row").agg(F.first("label").alias("label"), F.first("n").alias("n"), F.round(F.sum("share") / trees, 14).alias("score"))
    return found.select("v", "f", "row", "label", "score", "n")


def local_scores(rows: DataFrame, folds: DataFrame, seed: int, trees: int = TREES, task_trees: int = TASK_TREES) -> DataFrame:
    """Scores of tables small enough for a task; a task fits some trees of all sets of one table."""
    tables = max(1, folds.count())
    tasks = min(trees, max(-(-trees // task_trees), -(-TASKS // tables)))

    def run(table: pa.Table) -> pa.Table:
        v, task, parts = (table.column(c)[0].as_py() for c in ("v", "task", "folds"))
        part, draw, label, many = (table.column(c).to_numpy() for c in ("part", "draw", "label", "n"))
        x, line = np.unique(matrix(table.column("x")), axis=0, return_inverse=True)
        line = line.ravel()
        mine = np.array([t for t in range(trees) if t % tasks == task])
        total = np.zeros(len(part))
        for f in range(-1, parts):
            inside, out = np.flatnonzero((part >= 0) & (part != f)), part == f
            if len(inside) == 0 or not out.any():
                continue
            inside = inside[np.argsort(line[inside], kind="stable")]
            opens = np.flatnonzero(np.append(True, np.diff(line[inside]) != 0))  # the lines of one value stand together
            asked, at = np.unique(line[out], return_inverse=True)
            step = max(1, TASK_ENTRIES // max(1, len(inside) + len(asked)))
            for some in (mine[k : k + step] for k in range(0, len(mine), step)):
                place = tree_seed(seed, v, f, some)
                weight = bootstrap(place, draw[inside], many[inside])
                ones = np.add.reduceat(weight * (label[inside] > 0), opens, axis=1)
                weight = np.add.reduceat(weight, opens, axis=1)
                total[out] += grow(x[line[inside][opens]], None, weight, x[asked], place, ones=ones).sum(axis=0)[at]
        columns = [table.column(c) for c in ("v", "part", "row", "label", "n")]
        return pa.Table.from_arrays([*columns, pa.array(total)], ["v", "f", "row", "label", "n", "share"])

    listed = counted(rows).join(F.broadcast(folds), "v")  # as many rows as tables are evaluated
    dealt = listed.withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))
    # a fixed number of partitions: the work per byte is far above what size-based merging expects
    dealt = dealt.repartition(2 * tables * tasks, "v", "task")
    scored = dealt.groupBy("v", "task").applyInArrow(run, _SHARES)
    return _mean(scored.join(F.broadcast(folds), "v").filter(F.col("f") < F.col("folds")).drop("folds"), trees)


# --- sets larger than a task ------------------------------------------------------


class Top(NamedTuple):
    """The first levels of a tree: (feature, bin, left, right) by node; place names; what is to be finished or is a leaf."""

    nodes: list[list[int]]
    place: list[int]
    open: list[int]
    share: dict[int, float]


def _at(top: list[list[int]], bins: np.ndarray) -> np.ndarray:
    """The node of the first levels that each row stands in."""
    table = np.array(top, np.int64).reshape(-1, 4)
    at = np.zeros(len(bins), np.int64)
    live = np.arange(len(bins))
    while len(live):
        feature = table[at[live], 0]
        live, feature = live[feature >= 0], feature[feature >= 0]
        down = bins[live, feature] > table[at[live], 1]
        at[live] = table[at[live], 2 + down]
    return at


_CELLS = ["v", "f", "tree", "node", "feature", "bin", "w", "p", "n", "s"]


def _level(coded: DataFrame, tops: dict[tuple[int, int, int], Top], seed: int) -> list:
    """Class counts of every open node: by feature and bin, and how many rows are fitted and scored there."""
    sent = coded.sparkSession.sparkContext.broadcast({t: (top.nodes, top.open) for t, top in tops.items() if top.open})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            v, part, draw, label, many = (batch.column(c).to_numpy() for c in ("v", "part", "draw", "label", "n"))
            packed = batch.column("bins").to_pylist()
            for one in np.unique(v):
                at = np.flatnonzero(v == one)
                bins = np.frombuffer(b"".join(packed[i] for i in at), np.uint8).reshape(len(at), -1)
                width = bins.shape[1]
                for (of, f, tree), (nodes, open_) in sent.value.items():
                    if of != one:
                        continue
                    weight = bootstrap(tree_seed(seed, of, f, np.array([tree])), draw[at], many[at])[0]
                    weight *= (part[at] >= 0) & (part[at] != f)
                    scored = part[at] == f
                    here = _at(nodes, bins)
                    for node in open_:
                        inside = np.flatnonzero((here == node) & ((weight > 0) | scored))
                        if len(inside) == 0:
                            continue
                        cells = (bins[inside] + np.arange(width) * (BINS + 1)).ravel()
                        w = weight[inside]
                        marks = (w, w * (label[at][inside] > 0), w > 0, scored[inside])
                        found = np.stack([np.bincount(cells, np.repeat(m, width), width * (BINS + 1)) for m in marks])
                        name = (one, f, tree, node)
                        held[name] = held[name] + found if name in held else found
        for (one, f, tree, node), found in held.items():
            cell = np.flatnonzero(found[2] + found[3])
            feature, cut = np.divmod(cell, BINS + 1)
            columns = [np.full(len(cell), k) for k in (one, f, tree, node)] + [feature, cut, *found[:, cell]]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], _CELLS)

    def choose(table: pa.Table) -> pa.Table:
        cells = {c: table.column(c).to_numpy() for c in _CELLS}
        width = int(cells["feature"].max()) + 1
        sums = np.zeros((4, width, BINS + 1))
        for k, c in enumerate("wpns"):
            sums[k, cells["feature"], cells["bin"]] = cells[c]
        total, ones, fitted, scored = sums[:, 0].sum(axis=1)
        gains = []
        for j in range(width):
            filled = np.flatnonzero(sums[0, j])
            cuts = best_cuts(np.zeros(len(filled), np.int64), filled, sums[0, j, filled], sums[1, j, filled], 1)
            gains.append((float(cuts.gain[0]), int(cuts.below[0])))
        out = {c: [int(cells[c][0])] for c in ("v", "f", "tree", "node")}
        out |= {"total": [total], "ones": [ones], "rows": [fitted + scored]}
        return pa.table(out | {"gain": [[g for g, _ in gains]], "cut": [[b for _, b in gains]]})

    schema = "v bigint, f bigint, tree bigint, node bigint, total double, ones double, rows double, gain array<double>, cut array<bigint>"
    summed = coded.mapInArrow(run, ", ".join(f"{c} bigint" for c in _CELLS)).groupBy(*_CELLS[:6]).agg(*[F.sum(c).alias(c) for c in "wpns"])
    found = summed.groupBy("v", "f", "tree", "node").applyInArrow(choose, schema).collect()  # a row for each open node
    sent.unpersist()
    return found


def wide_scores(
    rows: DataFrame, sets: list[tuple[int, int]], width: int, seed: int, trees: int = TREES, task_rows: int = LOCAL_ROWS
) -> DataFrame:
    """Scores of sets of any size: first levels by histograms, subtrees of at most ``task_rows`` rows in tasks.

    Nodes whose rows no bin tells apart are finished as they are.
    """
    edges = shared_edges(rows, width)
    sent = rows.sparkSession.sparkContext.broadcast(edges)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, x = batch.column("v").to_numpy(), matrix(batch.column("x"))
            bins = np.zeros(x.shape, np.uint8)
            for one in np.unique(v):
                bins[v == one] = binned(x[v == one], sent.value[one])
            names = ("v", "row", "draw", "part", "label", "n", "x")
            arrays = [*(batch.column(c) for c in names), pa.array([b.tobytes() for b in bins], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, [*names, "bins"])

    schema = "v bigint, row bigint, draw bigint, part int, label double, n bigint, x array<double>, bins binary"
    coded = materialise(counted(rows).select("v", "row", "draw", "part", "label", "n", "x").mapInArrow(code, schema))
    tops = {(v, f, t): Top([[-1, 0, 0, 0]], [int(tree_seed(seed, v, f, np.array([t]))[0])], [0], {}) for v, f in sets for t in range(trees)}
    draws = max(1, int(math.sqrt(width)))
    while any(top.open for top in tops.values()):
        found = _level(coded, tops, seed)
        fresh: dict[tuple[int, int, int], list[int]] = {t: [] for t in tops}
        for r in found:
            top = tops[r["v"], r["f"], r["tree"]]
            node = r["node"]
            if r["ones"] in (0.0, r["total"]):
                top.share[node] = r["ones"] / r["total"] if r["total"] else 0.0
                continue
            if r["rows"] <= task_rows:
                continue
            order = drawn_features(np.array([top.place[node]], np.uint64), width)[0]
            ways = [(r["gain"][j], j) for j in order if j < len(r["gain"]) and r["gain"][j] > -math.inf]
            tried = [(g, -k, j) for k, j in enumerate(order[:draws]) for g, i in ways if i == j] or [(g, 0, j) for g, j in ways[:1]]
            if not tried:
                continue
            _, _, j = max(tried)
            children = [len(top.nodes), len(top.nodes) + 1]
            top.nodes[node] = [int(j), int(r["cut"][j]), *children]
            names = child_place(np.array([top.place[node]] * 2, np.uint64), np.array([0, 1]))
            for name in names.tolist():
                top.nodes.append([-1, 0, 0, 0])
                top.place.append(name)
            fresh[r["v"], r["f"], r["tree"]] += children
        tops = {t: top._replace(open=fresh[t]) for t, top in tops.items()}
    return _finished(coded, tops, seed, trees)


def _finished(coded: DataFrame, tops: dict[tuple[int, int, int], Top], seed: int, trees: int) -> DataFrame:
    """Rows brought to the node of each tree that they stand in, and its subtree grown there."""
    sent = coded.sparkSession.sparkContext.broadcast({t: (top.nodes, top.place, top.share) for t, top in tops.items()})
    names = ["v", "f", "tree", "node", "row", "label", "n", "weight", "share"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, part, row, draw, label, many = (batch.column(c).to_numpy() for c in ("v", "part", "row", "draw", "label", "n"))
            packed = batch.column("bins").to_pylist()
            for (of, f, tree), (nodes, _, share) in sent.value.items():
                at = np.flatnonzero(v == of)
                if len(at) == 0:
                    continue
                bins = np.frombuffer(b"".join(packed[i] for i in at), np.uint8).reshape(len(at), -1)
                weight = bootstrap(tree_seed(seed, of, f, np.array([tree])), draw[at], many[at])[0]
                weight *= (part[at] >= 0) & (part[at] != f)
                scored = part[at] == f
                here = _at(nodes, bins)
                leaf = np.array([share.get(k, np.nan) for k in range(len(nodes))])[here]
                keep = np.flatnonzero(scored | ((weight > 0) & np.isnan(leaf)))
                weight = np.where(scored, 0, weight)[keep]
                columns = [np.full(len(keep), k) for k in (of, f, tree)] + [here[keep], row[at][keep]]
                arrays = [pa.array(c.astype(np.int64)) for c in columns]
                arrays += [pa.array(label[at][keep]), pa.array(many[at][keep]), pa.array(weight.astype(np.int64)), pa.array(leaf[keep], from_pandas=True)]
                x = batch.column("x").take(pa.array(at[keep]))
                yield pa.RecordBatch.from_arrays([*arrays, x], [*names, "x"])

    schema = "v bigint, f bigint, tree bigint, node bigint, row bigint, label double, n bigint, weight bigint, share double, x array<double>"
    dealt = coded.mapInArrow(deal, schema)

    def finish(table: pa.Table) -> pa.Table:
        v, f, tree, node = (table.column(c)[0].as_py() for c in names[:4])
        row, label, many, weight = (table.column(c).to_numpy() for c in ("row", "label", "n", "weight"))
        x, inside = matrix(table.column("x")), weight > 0
        place = np.array([sent.value[v, f, tree][1][node]], np.uint64)
        share = grow(x[inside], label[inside], weight[None, inside], x[~inside], place)[0] if inside.any() else np.zeros((~inside).sum())
        n = len(share)
        columns = [pa.array(np.full(n, v, np.int64)), pa.array(np.full(n, f, np.int32)), pa.array(row[~inside]), pa.array(label[~inside]), pa.array(many[~inside]), pa.array(share)]
        return pa.Table.from_arrays(columns, ["v", "f", "row", "label", "n", "share"])

    leaves = dealt.filter("share IS NOT NULL").selectExpr("v", "cast(f AS int) AS f", "row", "label", "n", "share")
    grown = dealt.filter("share IS NULL").groupBy("v", "f", "tree", "node").applyInArrow(finish, _SHARES)
    return _mean(leaves.unionByName(grown), trees)
