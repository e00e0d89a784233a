"""Hard negatives by exact scores from Four-Russians tables.

Rows are vectors of integer weights with a label. For an anchor, the sums of its
weights over every subset of eight dimensions stand in a table of 256 entries,
one table for each group of eight. A candidate's weights are written as
two's-complement bit planes, and the bits of one plane and one group packed into
a byte. The byte looks up what this plane of this group adds to the inner
product; planes are shifted and added from the highest, which counts negative,
to the lowest. The result is the whole inner product, exactly, with one lookup
for eight multiplications of one bit.

Every anchor has to meet every candidate. Candidates stay where they are: each
task packs its candidates and runs them against a block of anchors that is sent
to all tasks, ``ANCHOR_BLOCK`` rows at a time, so that what is sent and what a
task holds (the k best of each anchor) is bounded at every size; nothing but
those lists is shuffled. The same pass runs twice: once for each anchor's
positives (best rows of its own label), and, with their scores known, once for
the negatives of each positive.

Defined results: rows whose key, label or vector is null, or whose vector holds a
null or non-finite component, take no part; components beyond the range of a long
are cut to it, and sums wrap as longs do; vectors of different lengths are
compared as if padded with zeros; a positive is a row of another key; ties go to
the smaller key; anchor rows that are repeated are answered once each, candidate
rows that are repeated count each; fewer rows than k give all of them; a label
held by most rows is not gathered anywhere; an empty table gives no rows; other
columns are not looked at.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from counterpoise.operators.lineage import fan_out, materialise, write_down

K = 5
SCALE = 256
LOW_PERCENT, HIGH_PERCENT = 80, 100
ANCHOR_BLOCK = 32_768
CANDIDATE_TILE = 4_096
ANCHOR_TILE = 128
GROUP = 8


def labelled_weights(vectors: DataFrame, key: str, vector: str, label: str, scale: int = SCALE) -> DataFrame:
    """(id, label, w): floor(scale * x) of every component; unusable rows are left out."""
    cells = F.col(f"`{vector}`")
    # NaN and the infinities are the values whose difference with themselves is not 0
    usable = F.forall(cells, lambda x: F.coalesce((x.cast("double") - x.cast("double")) == 0, F.lit(False)))
    weights = F.transform(cells, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("bigint"))
    rows = vectors.filter(usable & F.col(f"`{key}`").isNotNull() & F.col(f"`{label}`").isNotNull())
    return rows.select(F.col(f"`{key}`").alias("id"), F.col(f"`{label}`").alias("label"), weights.alias("w"))


def dense(column: pa.ListArray) -> np.ndarray:
    """Rows of weights as a matrix; shorter rows are filled up with zeros to whole groups of eight."""
    first = column.offsets.to_numpy().astype(np.int64)
    length = np.diff(first)
    width = -(-int(length.max(initial=0)) // GROUP) * GROUP
    out = np.zeros((len(length), width), np.int64)
    row = np.repeat(np.arange(len(length)), length)
    place = np.arange(first[-1] - first[0]) - np.repeat(first[:-1] - first[0], length)
    out[row, place] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def bit_planes(weights: np.ndarray) -> np.ndarray:
    """(planes, groups, rows) of bytes: bit d of a byte is the plane's bit of the group's dimension d."""
    n, width = weights.shape
    low, high = int(weights.min(initial=0)), int(weights.max(initial=0))
    planes = 1 + max(high.bit_length(), (~low).bit_length() if low < 0 else 0)
    grouped = weights.reshape(n, width // GROUP, GROUP).astype(np.uint64)  # two's complement
    out = np.empty((planes, width // GROUP, n), np.uint8)
    for b in range(planes):
        bits = (grouped >> np.uint64(b) & np.uint64(1)).astype(np.uint8)
        out[b] = np.packbits(bits, axis=2, bitorder="little")[:, :, 0].T
    return out


def subset_sums(weights: np.ndarray) -> np.ndarray:
    """(groups, 256, anchors): sums of each anchor's weights over every subset of a group's dimensions."""
    anchors, width = weights.shape
    grouped = weights.reshape(anchors, width // GROUP, GROUP)
    out = np.zeros((width // GROUP, 1 << GROUP, anchors), weights.dtype)
    for d in range(GROUP):
        out[:, 1 << d : 2 << d] = out[:, : 1 << d] + grouped[:, :, d].T[:, None, :]
    return out


def scores(planes: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Inner products, candidates x anchors, by table lookups, shifts and additions."""
    bits, groups, n = planes.shape
    groups = min(groups, anchors.shape[1] // GROUP)
    # the greatest value on the way; half the width does if it fits
    bound = float(np.abs(anchors.astype(np.float64)).sum(axis=1).max(initial=0.0)) * 2.0**bits
    table = subset_sums(anchors[:, : groups * GROUP].astype(np.int32 if bound < 2**31 else np.int64))
    total = np.zeros((n, len(anchors)), table.dtype)
    held = np.empty_like(total)
    for b in reversed(range(bits)):
        total <<= 1
        for g in range(groups):
            np.take(table[g], planes[b, g], axis=0, out=held, mode="clip")
            if b == bits - 1:
                total -= held
            else:
                total += held
    return total.astype(np.int64, copy=False)


def best_rows(columns: dict[str, np.ndarray], by: list[str], k: int) -> dict[str, np.ndarray]:
    """The k rows of greatest score, then least id, of each group."""
    order = np.lexsort((columns["id"], -columns["score"], *(columns[c] for c in reversed(by))))
    fresh = np.zeros(len(order), bool)
    fresh[:1] = True
    for c in by:
        x = columns[c][order]
        fresh[1:] |= x[1:] != x[:-1]
    start = np.flatnonzero(fresh)
    rank = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
    kept = order[rank < k]
    return {c: x[kept] for c, x in columns.items()}


def _top(line: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest scores; ``ids`` is ascending."""
    if len(line) > k:
        bar = np.partition(line, len(line) - k)[len(line) - k]
        open_ = np.flatnonzero(line >= bar)  # ties at the bar included
    else:
        open_ = np.arange(len(line))
    return open_[np.lexsort((ids[open_], -line[open_]))][:k]


def positives_in(tile: dict, anchors: dict, a: int, line: np.ndarray, k: int) -> list[tuple[int, np.ndarray]]:
    """(0, places of candidates): the best of the anchor's label among other keys."""
    place = np.flatnonzero((tile["label"] == anchors["label"][a]) & (tile["id"] != anchors["id"][a]))
    return [(0, place[_top(line[place], tile["id"][place], k)])]


def negatives_in(tile: dict, anchors: dict, a: int, line: np.ndarray, k: int, low: int, high: int) -> list[tuple[int, np.ndarray]]:
    """(number of the positive, places of candidates): the best of other labels inside each positive's band."""
    wanted = anchors["positives"][a]
    least = min(low * s for s in wanted)
    most = max(high * s for s in wanted)
    place = np.flatnonzero((tile["label"] != anchors["label"][a]) & (100 * line >= least) & (100 * line <= most))
    out = []
    for number, s in enumerate(wanted):
        hit = place[(100 * line[place] >= low * s) & (100 * line[place] <= high * s)]
        out.append((number, hit[_top(line[hit], tile["id"][hit], k)]))
    return out


def _anchor_block(table: pa.Table) -> dict:
    table = table.combine_chunks()
    out = {c: table.column(c).to_numpy() for c in ("row", "id", "label")}
    out["w"] = dense(pa.concat_arrays(table.column("w").chunks) if table.num_rows else pa.array([], pa.list_(pa.int64())))
    if "positives" in table.column_names:
        out["positives"] = [[p["score"] for p in of] for of in table.column("positives").to_pylist()]
    return out


def _against(block, pick: Callable, k: int) -> Callable:
    """Function over a task's candidates: the best of each anchor of the block, one list for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = block.value
        held = {c: np.zeros(0, np.int64) for c in ("row", "number", "id", "score")}
        for batch in batches:
            for start in range(0, batch.num_rows, CANDIDATE_TILE):
                part = pa.Table.from_batches([batch.slice(start, CANDIDATE_TILE)]).sort_by("id").combine_chunks()
                tile = {c: part.column(c).to_numpy() for c in ("id", "label")}
                planes = bit_planes(dense(pa.concat_arrays(part.column("w").chunks)))
                found = {c: [x] for c, x in held.items()}
                for first in range(0, len(anchors["id"]), ANCHOR_TILE):
                    product = np.ascontiguousarray(scores(planes, anchors["w"][first : first + ANCHOR_TILE]).T)
                    for a, line in enumerate(product, first):
                        for number, place in pick(tile, anchors, a, line, k):
                            found["row"].append(np.full(len(place), anchors["row"][a]))
                            found["number"].append(np.full(len(place), number))
                            found["id"].append(tile["id"][place])
                            found["score"].append(line[place])
                held = best_rows({c: np.concatenate(x) for c, x in found.items()}, ["row", "number"], k)
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in held.values()], list(held))

    return run


def _met(candidates: DataFrame, anchors: DataFrame, rows: int, pick: Callable, k: int, block: int) -> DataFrame:
    """(row, number, id, score, rank): the k best candidates of each anchor and number, a block of anchors at a time."""
    sc = candidates.sparkSession.sparkContext
    blocks = max(1, -(-rows // block))
    dealt = anchors.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    lists = []
    for b in range(blocks):
        sent = sc.broadcast(_anchor_block(dealt.filter(F.col("block") == b).drop("block").toArrow()))
        found = candidates.mapInArrow(_against(sent, pick, k), "row bigint, number bigint, id bigint, score bigint")
        lists.append(materialise(found))  # the block is in use up to here
        sent.unpersist()
    order = Window.partitionBy("row", "number").orderBy(F.col("score").desc(), "id")
    every = functools.reduce(DataFrame.unionByName, lists)
    return every.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(
    vectors: DataFrame,
    is_anchor: Column,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    k_positives: int = K,
    k_negatives: int = K,
    low_percent: int = LOW_PERCENT,
    high_percent: int = HIGH_PERCENT,
    scale: int = SCALE,
    anchor_block: int = ANCHOR_BLOCK,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor`` is a condition on the column ``id`` (the key). For each of an
    anchor's best rows of its own label: the best rows of other labels whose
    score is between ``low_percent`` and ``high_percent`` of the positive's.
    """
    rows = labelled_weights(vectors, key, vector, label, scale).withColumn("row", F.monotonically_increasing_id())
    candidates = write_down(fan_out(rows))
    anchors = write_down(candidates.df.filter(is_anchor))
    if anchors.rows == 0:
        nothing = vectors.sparkSession.range(0)
        names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
        return nothing.select(*[F.lit(0).alias(n) if n == "rank" else F.col("id").alias(n) for n in names])
    others = candidates.df.select("id", "label", "w")
    best = _met(others, anchors.df, anchors.rows, positives_in, k_positives, anchor_block)
    pairs = F.sort_array(F.collect_list(F.struct("rank", "id", "score")))  # k at most
    wanted = anchors.df.join(best.groupBy("row").agg(pairs.alias("positives")), "row")
    wanted = write_down(wanted)
    pick = functools.partial(negatives_in, low=low_percent, high=high_percent)
    found = _met(others, wanted.df, wanted.rows, pick, k_negatives, anchor_block)
    named = found.join(wanted.df.select("row", F.col("id").alias("anchor_id"), "positives"), "row")
    positive = F.element_at("positives", F.col("number").cast("int") + 1)
    return named.select(
        "anchor_id",
        positive["id"].alias("positive_id"),
        "rank",
        F.col("id").alias("negative_id"),
        positive["score"].alias("positive_score"),
        F.col("score").alias("negative_score"),
    )
