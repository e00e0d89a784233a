"""Quality rules judged by an isolation forest.

Every document gets rule statistics over its whole text. Two fixed rules decide
first (too few words, too much repetition). For the rest an isolation forest
(Liu, Ting and Zhou, "Isolation Forest", 2008) is grown on a bounded sample of
labelled documents: random splits isolate unusual documents after short paths.
The score above which a document is rejected is taken from the labels, all of
them: the one that catches most bad rows while wrongly rejecting at most
``max_false`` of the good ones. Only the trees, which by their method look at a
few rows each, are drawn from at most ``sample_rows`` rows; the good rows'
scores are ranked by counts, so the threshold is exact at any number of labels.
Statistics and verdicts cover every row in one pass over the text.

Defined results: a null or empty text has no words and fails the base rule; rows
repeated are judged alike; without usable labels of both kinds no forest verdict
is made and only the base rule decides; other columns are never looked at, so
their names do not matter; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from counterpoise.functions.hashing import BITS, SCALE
from counterpoise.llm.common import lean
from counterpoise.llm.words import slices, windows_of, words_of
from counterpoise.operators.lineage import materialise, write_down
from counterpoise.operators.lookup import lookup_join
from counterpoise.operators.ranking import rank_cutoffs

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
SAMPLE_ROWS = 20_000
TREES = 150
TREE_ROWS = 64
MAX_FALSE = 0.005
SEED = 17

# Characters that the symbol rule counts.
SYMBOLS = "#*$%&|<>"

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATIOS = ("word_length", "symbols", "dup_lines", "repeats", "capitals", "marks", "digits", "lone_marks", "line_words")


def _flags(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[[ord(c) for c in chars]] = True
    return table


_SYMBOL = _flags(SYMBOLS)
_CAPITAL = _flags("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_DIGIT = _flags("0123456789")
_MARK = _flags("!?=+_~^@/\\{}[]") | _SYMBOL
_CHARACTER = ~_flags(" \t\n\x0b\x0c\r")
_CHARACTER[0x80:0xC0] = False  # continuation bytes: a character is counted at its first byte


def _per_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Number of set flags between consecutive positions."""
    set_at = np.flatnonzero(flags)
    return np.diff(np.searchsorted(set_at, at))


def _repeated_words(windows: np.ndarray, n_words: int) -> int:
    """Words inside a window that occurs at least twice."""
    if len(windows) < 2:
        return 0
    ordered = np.sort(windows)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if len(twice) == 0:
        return 0
    hit = np.flatnonzero(np.isin(windows, twice))
    edge = np.zeros(n_words + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(edge[:-1])))


def text_statistics(texts: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The five counts of each text, and its row of ratios for the forest."""
    words = words_of(texts)
    data, at = words.data, words.at
    n_words = np.diff(words.first)
    windows, first = windows_of(words, WINDOW)
    rows = len(texts)
    dup_lines = np.zeros(rows, np.int64)
    lines = np.zeros(rows, np.int64)
    repeats = np.zeros(rows, np.int64)
    for i in range(rows):
        if n_words[i] == 0:
            continue
        with_word = [line for line in data[at[i] : at[i + 1]].tobytes().split(b"\n") if line.strip()]
        lines[i] = len(with_word)
        dup_lines[i] = len(with_word) - len(set(with_word))
        repeats[i] = _repeated_words(windows[first[i] : first[i + 1]], int(n_words[i]))
    counts = {
        "n_words": n_words,
        "word_chars": _per_text(_CHARACTER[data], at),
        "n_symbols": _per_text(_SYMBOL[data], at),
        "n_dup_lines": dup_lines,
        "n_repeat_words": repeats,
    }
    lone = (words.end - words.begin == 1) & _MARK[data[words.begin]] if len(data) else np.zeros(0, bool)
    per_word = np.maximum(n_words, 1)
    per_char = np.maximum(counts["word_chars"], 1)
    per_line = np.maximum(lines, 1)
    ratios = np.stack(
        [
            counts["word_chars"] / per_word,
            counts["n_symbols"] / per_word,
            dup_lines / per_line,
            repeats / per_word,
            _per_text(_CAPITAL[data], at) / per_char,
            _per_text(_MARK[data], at) / per_word,
            _per_text(_DIGIT[data], at) / per_char,
            _per_text(lone, words.first) / per_word,
            np.log1p(n_words / per_line),
        ],
        axis=1,
    )
    return counts, ratios


def base_failed(n_words: np.ndarray, n_repeat_words: np.ndarray) -> np.ndarray:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)


def _expected_path(n: float) -> float:
    """Mean path length of an unsuccessful search in a binary search tree of n keys."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (np.log(n - 1) + np.euler_gamma) - 2.0 * (n - 1) / n


@dataclass(frozen=True)
class Forest:
    """Trees in one table of nodes: leaves point to themselves and carry the path length."""

    feature: np.ndarray
    cut: np.ndarray
    child: np.ndarray
    path: np.ndarray
    depth: int
    tree_rows: int

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """2^(-mean path / expected path): near 1 for documents isolated early."""
        n, total = len(rows), np.zeros(len(rows))
        line = np.arange(n)
        for t in range(len(self.feature)):
            node = np.zeros(n, np.int64)
            feature, cut, child = self.feature[t], self.cut[t], self.child[t]
            for _ in range(self.depth):
                right = rows[line, feature[node]] >= cut[node]
                node = child[node, right.astype(np.int64)]
            total += self.path[t][node]
        return np.power(2.0, -total / (len(self.feature) * _expected_path(self.tree_rows)))


def grow(rows: np.ndarray, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = SEED) -> Forest:
    """Isolation trees over random subsets of ``rows``."""
    rng = np.random.default_rng(seed)
    tree_rows = min(tree_rows, len(rows))
    depth = max(1, int(np.ceil(np.log2(max(tree_rows, 2)))))
    size = 2 ** (depth + 1)
    feature = np.zeros((trees, size), np.int64)
    cut = np.full((trees, size), np.inf)
    child = np.tile(np.arange(size)[:, None], (trees, 1, 2))
    path = np.zeros((trees, size))
    for t in range(trees):
        free = 1
        todo = [(0, rows[rng.choice(len(rows), tree_rows, replace=False)], 0)]
        while todo:
            node, part, level = todo.pop()
            low, high = part.min(axis=0), part.max(axis=0)
            wide = np.flatnonzero(high > low)
            if level == depth or len(part) <= 1 or len(wide) == 0:
                path[t, node] = level + _expected_path(len(part))
                continue
            f = int(rng.choice(wide))
            at = rng.uniform(low[f], high[f])
            right = part[:, f] >= at
            if right.all():  # the draw met the lowest value
                at, right = high[f], part[:, f] >= high[f]
            feature[t, node], cut[t, node], child[t, node] = f, at, (free, free + 1)
            todo += [(free, part[~right], level + 1), (free + 1, part[right], level + 1)]
            free += 2
    return Forest(feature, cut, child, path, depth, tree_rows)


def calibrate(scores: DataFrame, max_false: float = MAX_FALSE) -> float:
    """The lowest score that rejects at most ``max_false`` of the good rows, whose scores these are."""
    allowed = int(np.floor(max_false * scores.count()))
    # from the highest down; scores lie in (0, 1], equal bits are told apart by the score itself
    bits = F.least(F.floor((F.lit(1.0) - F.col("score")) * F.lit(SCALE)).cast("bigint"), F.lit((1 << BITS) - 1))
    return -float(rank_cutoffs(scores, bits, -F.col("score"), [allowed + 1])[allowed + 1].key)


@dataclass(frozen=True)
class QualityModel:
    forest: Forest | None
    threshold: float

    def kept(self, counts: dict[str, np.ndarray], ratios: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        failed = base_failed(counts["n_words"], counts["n_repeat_words"])
        scores = self.forest.scores(ratios) if self.forest is not None else np.zeros(len(ratios))
        return failed, scores, ~failed & (scores <= self.threshold)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    sample_rows: int = SAMPLE_ROWS,
    max_false: float = MAX_FALSE,
) -> QualityModel:
    """Forest from at most ``sample_rows`` labelled documents, threshold from all of them.

    The sample is taken by a hash of the key, so it does not depend on how the
    rows are partitioned. Documents that fail the base rule take no part.
    """
    named, marked = F.col(f"`{key}`"), F.col(f"`{label}`")
    wanted = labels.filter(marked.isin(0, 1) & named.isNotNull()).select(named.alias("_key"), marked.cast("int").alias("_good"))
    narrow = docs.select(named.alias("_key"), F.col(f"`{text}`").alias("_text"))
    place = F.xxhash64("_key", "_text", F.lit(SEED))
    rows = lookup_join(narrow, write_down(wanted), ["_key"])
    schema = "good int, failed boolean, ratios array<double>, place bigint, picked bigint"

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "_text"):
                counts, ratios = text_statistics(batch.column("_text"))
                failed = base_failed(counts["n_words"], counts["n_repeat_words"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_good"), pa.array(failed), pa.array(list(ratios), pa.list_(pa.float64())), batch.column("_place"), batch.column("_picked")],
                    ["good", "failed", "ratios", "place", "picked"],
                )

    hashed = rows.select("_text", "_good", place.alias("_place"), F.xxhash64("_key", F.lit(SEED)).alias("_picked"))
    # two numbers and nine ratios for each labelled document
    measured = materialise(hashed.mapInArrow(lean(measure), schema).filter("NOT failed"))
    sample = measured.orderBy("picked", "place", "good").limit(sample_rows).toPandas()
    kinds = measured.agg(F.min("good").alias("low"), F.max("good").alias("high")).first()
    if kinds["low"] is None or kinds["low"] == kinds["high"]:
        return QualityModel(None, np.inf)
    order = np.lexsort(np.array(sample["ratios"].tolist()).T)  # rows arrive in any order
    ratios = np.array(sample["ratios"].tolist())[order]
    forest = grow(ratios)
    sent = docs.sparkSession.sparkContext.broadcast(forest)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column("ratios").flatten().to_numpy().reshape(len(batch), len(RATIOS))
            yield pa.RecordBatch.from_arrays([pa.array(sent.value.scores(held), pa.float64())], ["score"])

    scores = materialise(measured.filter("good = 1").select("ratios").mapInArrow(lean(score), "score double"))
    return QualityModel(forest, calibrate(scores, max_false))


def judge(docs: DataFrame, model: QualityModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, five counts, base_failed, score, kept) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    narrow = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text"))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "_text"):
                counts, ratios = text_statistics(batch.column("_text"))
                failed, scores, kept = sent.value.kept(counts, ratios)
                arrays = [pa.array(counts[c], pa.int64()) for c in COUNTS]
                arrays = [batch.column("_key"), *arrays, pa.array(failed), pa.array(scores), pa.array(kept)]
                yield pa.RecordBatch.from_arrays(arrays, ["_key", *COUNTS, "base_failed", "score", "kept"])

    columns = ", ".join(f"{c} bigint" for c in COUNTS)
    out = narrow.mapInArrow(lean(run), f"_key {kind}, {columns}, base_failed boolean, score double, kept boolean")
    return out.withColumnRenamed("_key", key)


def keep_good(docs: DataFrame, model: QualityModel, text: str = "text") -> DataFrame:
    """The rows that pass, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text):
                _, _, kept = sent.value.kept(*text_statistics(batch.column(place)))
                yield batch.filter(pa.array(kept))

    return docs.mapInArrow(lean(run), docs.schema)
