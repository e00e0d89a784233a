"""Exact top-k search by exhaustive term-at-a-time accumulation.

Vectors are sparse rows of integer weights. For every term, the queries that
hold it scatter weight x posting into a dense array of scores (queries x
candidates of one block); a partition selection then keeps the k best of each
query in that block, and the blocks' lists are merged.

Every query has to meet every candidate. Candidates stay where they are and are
never shuffled: queries are sent to all tasks in blocks of a bounded number of
rows, and each task runs its candidates, tile by tile, against the block. Only
the k best of each query and task are shuffled, for the merge.

Defined results: vectors that are null or hold null or non-finite components
take no part; vectors of different lengths are compared as sparse rows (absent
components are 0); components beyond the range of a long are cut to it, and sums
wrap as longs do; rows with the query's id are its own and are no candidates;
a query row that is repeated is answered once for each of its rows; ties go to
the smaller id; fewer than k candidates give all of them.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from counterpoise.operators.lineage import fan_out, materialise, write_down

K = 5
SCALE = 256
QUERY_BLOCK = 32_768
CANDIDATE_BLOCK = 4_096
QUERY_TILE = 256


def integer_weights(vectors: DataFrame, key: str, vector: str, scale: int = SCALE) -> DataFrame:
    """(id, w): floor(scale * x) of every component; unusable vectors are left out."""
    cells = F.col(f"`{vector}`")
    # NaN and the infinities are the values whose difference with themselves is not 0
    usable = F.forall(cells, lambda x: F.coalesce((x.cast("double") - x.cast("double")) == 0, F.lit(False)))
    weights = F.transform(cells, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("bigint"))
    return vectors.filter(usable & F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").alias("id"), weights.alias("w"))


class Postings:
    """Weights of a block of rows by term: (rows, weights) of the non-zero components."""

    def __init__(self, column: pa.ListArray):
        lengths = np.diff(column.offsets.to_numpy())
        values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        self.terms: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        begin = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        for term in range(int(lengths.max(initial=0))):
            rows = np.flatnonzero(lengths > term)
            weights = values[begin[rows] + term]
            held = weights != 0
            self.terms[term] = rows[held], weights[held]


def accumulate(queries: Postings, n_queries: int, candidates: Postings, n_candidates: int) -> np.ndarray:
    """Dense scores, queries x candidates, term by term."""
    scores = np.zeros((n_queries, n_candidates), np.int64)
    for term, (rows, weights) in queries.terms.items():
        if term not in candidates.terms or len(rows) == 0:
            continue
        found, postings = candidates.terms[term]
        if len(found) == n_candidates:  # the posting list is dense, so it is added in place
            for row, weight in zip(rows, weights):
                scores[row] += weight * postings
        else:
            for row, weight in zip(rows, weights):
                scores[row, found] += weight * postings
    return scores


def best(scores: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query rows, candidate columns) of the k best of each row; ``ids`` is ascending."""
    low = np.iinfo(np.int64).min
    rows, columns = [], []
    for q in range(len(scores)):
        line = np.where(ids == own[q], low, scores[q])
        open_ = np.count_nonzero(ids != own[q])
        take = min(k, open_)
        if take == 0:
            continue
        bar = np.partition(line, len(line) - take)[len(line) - take]
        above = np.flatnonzero((line >= bar) & (ids != own[q]))  # ties at the bar included
        order = above[np.lexsort((ids[above], -line[above]))][:take]
        rows.append(np.full(take, q))
        columns.append(order)
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(columns)


def _against(block, k: int, tile: int):
    """Function over a task's candidates: the k best of each query of the block, one list for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = block.value
        held = {n: np.zeros(0, np.int64) for n in ("query_row", "query_id", "vec_id", "score")}
        for batch in batches:
            for start in range(0, batch.num_rows, tile):
                part = pa.Table.from_batches([batch.slice(start, tile)]).sort_by("id").combine_chunks()
                ids = part.column("id").to_numpy()
                postings = Postings(pa.concat_arrays(part.column("w").chunks))
                found = {n: [x] for n, x in held.items()}
                for first in range(0, table.num_rows, QUERY_TILE):
                    some = table.slice(first, QUERY_TILE).combine_chunks()
                    own = some.column("id").to_numpy()
                    scores = accumulate(Postings(pa.concat_arrays(some.column("w").chunks)), len(own), postings, len(ids))
                    rows, columns = best(scores, own, ids, k)
                    for n, x in (("query_row", some.column("row").to_numpy()[rows]), ("query_id", own[rows]), ("vec_id", ids[columns]), ("score", scores[rows, columns])):
                        found[n].append(x)
                held = _merged({n: np.concatenate(x) for n, x in found.items()}, k)
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in held.values()], list(held))

    return run


def _merged(lists: dict[str, np.ndarray], k: int) -> dict[str, np.ndarray]:
    """The k best of each query row of several lists."""
    order = np.lexsort((lists["vec_id"], -lists["score"], lists["query_row"]))
    row = lists["query_row"][order]
    start = np.flatnonzero(np.append(True, row[1:] != row[:-1])[: len(row)])
    rank = np.arange(len(row)) - np.repeat(start, np.diff(np.append(start, len(row))))
    return {n: x[order[rank < k]] for n, x in lists.items()}


def search(
    vectors: DataFrame,
    is_query: Column,
    key: str = "vec_id",
    vector: str = "embedding",
    k: int = K,
    scale: int = SCALE,
    query_block: int = QUERY_BLOCK,
    candidate_block: int = CANDIDATE_BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of every query row.

    ``is_query`` is a condition on the column ``id`` (the key).
    """
    rows = integer_weights(vectors, key, vector, scale).withColumn("row", F.monotonically_increasing_id())
    rows = write_down(fan_out(rows))
    queries = write_down(rows.df.filter(is_query))
    if queries.rows == 0:
        nothing = vectors.sparkSession.range(0)
        return nothing.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.col("id").alias("score"))
    blocks = -(-queries.rows // query_block)
    dealt = queries.df.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    lists = []
    for b in range(blocks):
        sent = vectors.sparkSession.sparkContext.broadcast(dealt.filter(F.col("block") == b).select("row", "id", "w").toArrow())
        found = rows.df.select("id", "w").mapInArrow(_against(sent, k, candidate_block), "query_row bigint, query_id bigint, vec_id bigint, score bigint")
        lists.append(materialise(found))  # the block is in use up to here
        sent.unpersist()
    order = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id")
    every = functools.reduce(DataFrame.unionByName, lists)
    merged = every.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return merged.select("query_id", "rank", "vec_id", "score")
