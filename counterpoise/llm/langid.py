"""Language identification by fusing several pieces of evidence.

Evidence is combined as in Bayes' rule, each piece as a log-likelihood by language:

* text: a naive Bayes model over hashed runs of three bytes of letters, fitted
  on all labelled documents, over the whole text. Runs are not
  independent, so a text counts as at most ``evidence_runs`` of them;
* declared language of the markup or metadata: P(declared | language), counted
  over all rows;
* prior: languages of a host, smoothed towards those of the address suffix,
  which are smoothed towards those of all rows (hierarchical Dirichlet
  smoothing). Hosts, suffixes and declarations are counted with the text's own
  posteriors by grouped aggregation over every row.

A host that holds a third of all rows is one row after map-side combining; its
prior comes back by ``lookup_join`` (broadcast if measured small, else hot hosts
are salted). The driver sees only tables of (languages x declarations).

A row is kept if its text holds two letters in a row, its best language reaches
``min_posterior`` and is among ``accepted``, and the text's runs are about as
likely in it as those of held-out labelled texts (``floors_of``). The posterior
compares the known languages with each other; the floor is what tells gibberish,
code and unknown languages. Such a row shows the nearest language but is not kept.

Defined results: a null, empty or (so) letterless text gets language ``und`` and is
not kept; missing columns or nulls are no evidence (a null host or suffix is
treated as unknown); ties go to the first language by name; repeated rows get
equal results; without any labelled row every text is ``und``. Rows travel as
one struct, so other column names do not matter.
"""

from __future__ import annotations

import json
import logging
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from counterpoise.llm.common import lean
from counterpoise.llm.words import slices, text_bytes
from counterpoise.operators.lineage import materialise, write_down
from counterpoise.operators.lookup import lookup_join

BUCKET_BITS = 16
MIN_LABEL_ROWS = 2
#: Of held-out labelled rows this share may lie below the floor before it is moved on; a floor needs so many rows.
BELOW_FLOOR, BEYOND, FLOOR_ROWS = 0.001, 1.5, 20
#: Texts of at least so many runs have a floor of their own: the longer, the narrower.
LENGTHS = (1, 50, 200, 1_000)
#: Steps a unit by which mean log-likelihoods are counted on the way to their quantiles.
MEAN_STEPS = 4_096
EVIDENCE_RUNS = 200
MIN_POSTERIOR = 0.5
HOST_STRENGTH = 20.0
SUFFIX_STRENGTH = 50.0
UNKNOWN = "und"
SEED = 23

_FOLD = np.zeros(256, np.uint32)  # 0: not a letter
_FOLD[0x41:0x5B] = np.arange(1, 27)
_FOLD[0x61:0x7B] = np.arange(1, 27)
_FOLD[0x80:] = np.arange(27, 27 + 0x80)


def letter_runs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every run of three letter bytes, where each text's begin).

    ASCII capitals are folded; whatever is not a letter counts as one blank, and
    runs do not cross texts or two blanks.
    """
    data, at = text_bytes(texts)
    rows = len(at) - 1
    # one blank before every text and one behind the last
    code = np.zeros(len(data) + rows + 2, np.uint32)
    at = at + np.arange(rows + 1)
    code[np.arange(len(data)) + np.repeat(np.arange(rows), np.diff(at) - 1) + 1] = _FOLD[data]
    a, b, c = code[:-2], code[1:-1], code[2:]
    use = (b > 0) & ((a > 0) | (c > 0))
    place = np.flatnonzero(use)
    mixed = (a[place] * np.uint32(0x9E3779B1)) ^ (b[place] * np.uint32(0x85EBCA77)) ^ (c[place] * np.uint32(0xC2B2AE3D))
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x2C1B3C6D)
    return (mixed >> np.uint32(32 - BUCKET_BITS)).astype(np.int64), np.searchsorted(place, at)


@dataclass(frozen=True)
class TextModel:
    languages: tuple[str, ...]
    logs: np.ndarray  # buckets x languages
    left_out: dict[str, int] = field(default_factory=dict)  # rows of labels, or asked-for languages, that are no class
    floors: np.ndarray | None = None  # LENGTHS x languages: least mean log-likelihood of a run

    def likelihoods(self, texts: pa.Array, evidence_runs: int) -> tuple[np.ndarray, np.ndarray]:
        """(texts x languages log-likelihoods, number of runs of each text)."""
        runs, first = letter_runs(texts)
        count = np.diff(first)
        out = np.zeros((len(count), len(self.languages)))
        held = np.flatnonzero(count)
        if len(held) and self.languages:
            for i in range(len(self.languages)):
                out[held, i] = np.add.reduceat(self.logs[runs, i], first[:-1][held])
            out[held] *= (np.minimum(count[held], evidence_runs) / count[held])[:, None]
        return out, count


def fit_text(
    docs: DataFrame,
    text: str = "text",
    label: str = "lang",
    key: str = "doc_id",
    languages: Sequence[str] | None = None,
    min_rows: int = MIN_LABEL_ROWS,
) -> TextModel:
    """Counts of letter runs by language in all labelled documents.

    Labels are folded to their primary subtag. The languages are all those given
    that have rows, or all labels of at least ``min_rows`` rows. The others are
    in ``left_out`` with their rows, and logged. What reaches the driver are
    counts by language and bucket, whatever the number of documents.
    """
    tagged = docs.select(F.xxhash64(F.col(f"`{key}`"), F.lit(SEED)).alias("h"), primary_tag(F.col(f"`{label}`")).alias("lang"), F.col(f"`{text}`").alias("text"))
    tagged = tagged.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    if languages is not None:
        tagged = tagged.filter(F.col("lang").isin(list(languages)))
    rows = {lang: 0 for lang in languages or ()} | {r["lang"]: r["count"] for r in tagged.groupBy("lang").count().collect()}
    found = {lang: n for lang, n in rows.items() if n >= (min_rows if languages is None else 1)}
    left_out = {lang: n for lang, n in sorted(rows.items()) if lang not in found}
    if left_out:
        logging.getLogger(__name__).warning("labels with too few rows for a language of their own: %s", left_out)
    if not found:
        return TextModel((), np.zeros((1 << BUCKET_BITS, 0), np.float32), left_out)
    names = tuple(sorted(found))
    known = F.from_json(F.lit(json.dumps({x: i for i, x in enumerate(names)})), "map<string,int>")[F.col("lang")]
    half = F.pmod(F.xxhash64("h"), F.lit(2)).cast("int")
    labelled = tagged.select(known.alias("lang"), half.alias("half"), "text").filter("lang IS NOT NULL")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[tuple[int, int], np.ndarray] = {}
        for whole in batches:
            for batch in slices(whole, "text"):
                runs, first = letter_runs(batch.column("text"))
                parts: dict[tuple[int, int], list[np.ndarray]] = {}
                for i, part in enumerate(zip(batch.column("lang").to_pylist(), batch.column("half").to_pylist())):
                    parts.setdefault(part, []).append(runs[first[i] : first[i + 1]])
                for part, held in parts.items():
                    table = tables.setdefault(part, np.zeros(1 << BUCKET_BITS, np.int64))
                    table += np.bincount(np.concatenate(held), minlength=1 << BUCKET_BITS)
        for (lang, half), table in tables.items():
            used = np.flatnonzero(table)
            arrays = [pa.array(np.full(len(used), x, np.int32)) for x in (lang, half)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(used.astype(np.int32)), pa.array(table[used])], ["lang", "half", "bucket", "n"])

    counted = labelled.mapInArrow(lean(count), "lang int, half int, bucket int, n bigint")
    # at most 2 x languages x buckets rows, whatever the corpus
    table = counted.groupBy("lang", "half", "bucket").agg(F.sum("n").alias("n")).toArrow()
    halves = np.zeros((2, 1 << BUCKET_BITS, len(names)))
    lang, part, bucket, n = (table.column(c).to_numpy() for c in ("lang", "half", "bucket", "n"))
    halves[part, bucket, lang] = n

    def logs_of(counts: np.ndarray) -> np.ndarray:
        return np.log((counts + 0.5) / (counts + 0.5).sum(axis=0)).astype(np.float32)

    # the counts of one half judge the other
    sent = docs.sparkSession.sparkContext.broadcast([TextModel(names, logs_of(halves[1 - k])) for k in (0, 1)])

    def held_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Mean log-likelihood of a run, of the texts that are likeliest in the language of their label."""
        for whole in batches:
            for batch in slices(whole, "text"):
                for k, model in enumerate(sent.value):
                    part = batch.filter(pc.equal(batch.column("half"), k))
                    lang = part.column("lang").to_numpy()
                    logs, size = model.likelihoods(part.column("text"), 1 << 62)
                    told = np.flatnonzero((size > 0) & (logs.argmax(axis=1) == lang))
                    mean = logs[told, lang[told]] / size[told]
                    yield pa.RecordBatch.from_arrays([pa.array(lang[told]), pa.array(size[told].astype(np.int64)), pa.array(mean)], ["lang", "runs", "mean"])

    tried = materialise(labelled.mapInArrow(lean(held_out), "lang int, runs bigint, mean double"))
    return TextModel(names, logs_of(halves[0] + halves[1]), left_out, floors_of(tried, len(names)))


def floors_of(tried: DataFrame, n: int) -> np.ndarray:
    """LENGTHS x languages: how unlikely the runs of a text may be on the mean.

    From held-out rows (lang, runs, mean) at least as long: the floor lies BEYOND
    times as far below their median as the lowest of them, BELOW_FLOOR of the rows
    left aside. With few such rows the floor of shorter texts holds, at first that
    of a model that knows nothing. The quantiles are exact: rows are counted by
    steps of their mean, then those of the steps that hold a quantile by value.
    """
    out = np.full((len(LENGTHS), n), -np.log(1 << BUCKET_BITS))
    levels = F.array(*[F.when(F.col("runs") >= least, F.lit(k)) for k, least in enumerate(LENGTHS)])
    leveled = tried.select("lang", F.explode(F.filter(levels, lambda k: k.isNotNull())).alias("level"), "mean")
    leveled = leveled.withColumn("step", F.floor(F.col("mean") * MEAN_STEPS))
    # a mean lies between 0 and the logarithm of the rows of a table: steps, levels and languages bound these rows
    steps: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for r in leveled.groupBy("lang", "level", "step").agg(F.count(F.lit(1)).alias("n")).collect():
        steps.setdefault((r["lang"], r["level"]), []).append((r["step"], r["n"]))
    wanted = []
    for (lang, level), counts in steps.items():
        counts.sort()
        upto = np.cumsum([c for _, c in counts])
        if upto[-1] >= FLOOR_ROWS:
            for which, q in enumerate((BELOW_FLOOR, 0.5)):
                rank = int(np.floor(q * (upto[-1] - 1)))
                at = int(np.searchsorted(upto, rank, "right"))
                wanted.append((lang, level, counts[at][0], which, rank - int(upto[at] - counts[at][1])))
    if not wanted:
        return out
    asked = F.broadcast(tried.sparkSession.createDataFrame(wanted, "lang int, level int, step bigint, which int, rank bigint"))
    inside = leveled.join(asked, ["lang", "level", "step"]).groupBy("lang", "level", "which", "rank", "mean").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("lang", "level", "which").orderBy("mean")
    reached = inside.withColumn("_upto", F.sum("n").over(before)).filter("_upto > rank")
    found = {(r["lang"], r["level"], r["which"]): r["mean"] for r in reached.groupBy("lang", "level", "which").agg(F.min("mean").alias("mean")).collect()}
    for i in range(n):
        for k in range(len(LENGTHS)):
            if (i, k, 1) in found:
                low, middle = found[i, k, 0], found[i, k, 1]
                out[k, i] = middle + BEYOND * (low - middle)
            elif k:
                out[k, i] = out[k - 1, i]
    return out


def primary_tag(declared: Column) -> Column:
    """``pt-BR`` and ``pt_br`` are ``pt``; an empty tag is null."""
    tag = F.lower(F.regexp_extract(F.trim(declared.cast("string")), r"^([A-Za-z]+)", 1))
    return F.when(tag != "", tag)


def host_of(url: Column) -> Column:
    """Host of an address in lower case, without user, port and ``www.``."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    host = F.regexp_replace(host, r"^www\.", "")
    return F.when(host != "", host)


def suffix_of(host: Column) -> Column:
    """The last label of a host."""
    last = F.regexp_extract(host, r"([a-z][a-z0-9-]*)$", 1)
    return F.when(last != "", last)


def markup_language(html: Column) -> Column:
    """The ``lang`` attribute of the html element."""
    tag = F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)", 1)
    return F.when(tag != "", tag)


def identify(
    rows: DataFrame,
    model: TextModel,
    text: str = "text",
    declared: str | None = None,
    host: str | None = None,
    suffix: str | None = None,
    carry: Sequence[str] = (),
    accepted: Sequence[str] | None = None,
    evidence_runs: int = EVIDENCE_RUNS,
    min_posterior: float = MIN_POSTERIOR,
) -> DataFrame:
    """(row, language, posterior, text_language, declared_language, kept) of every row.

    ``row`` is a struct of the columns ``carry``.
    """
    spark = rows.sparkSession
    n = len(model.languages)
    names = list(model.languages)

    def given(name: str | None) -> Column:
        return F.lit(None).cast("string") if name is None else F.col(f"`{name}`").cast("string")

    packed = rows.select(
        F.struct(*[F.col(f"`{c}`") for c in carry] or [F.lit(None).alias("none")]).alias("row"),
        F.col(f"`{text}`").alias("text"),
        primary_tag(given(declared)).alias("declared"),
        given(host).alias("host"),
        given(suffix).alias("suffix"),
    )
    # what a row looks its prior up by; without host and suffix a key that finds nothing, spread by the text
    nowhere = F.concat(F.lit("?"), F.pmod(F.xxhash64("text"), F.lit(4_096)).cast("string"))
    at_host, at_suffix = F.concat(F.lit("="), F.col("host")), F.concat(F.lit("~"), F.col("suffix"))
    packed = packed.withColumn("place", F.coalesce(at_host, at_suffix, nowhere))
    sent = spark.sparkContext.broadcast(model)

    def score(keep: Sequence[str]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                if "text" not in whole.schema.names:  # the text came inside the row, once
                    inside = whole.column("row").field(text)
                    whole = pa.RecordBatch.from_arrays([*whole.columns, inside], [*whole.schema.names, "text"])
                for batch in slices(whole, "text"):
                    logs, count = sent.value.likelihoods(batch.column("text"), evidence_runs)
                    flat = pa.array(logs.reshape(-1))
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(count) + 1) * n, pa.int32()), flat)
                    arrays = [batch.column(c) for c in keep]
                    yield pa.RecordBatch.from_arrays([*arrays, lists, pa.array(count, pa.int64())], [*keep, "logs", "runs"])

        return run

    def scored(df: DataFrame, keep: Sequence[str]) -> DataFrame:
        schema = T.StructType([df.schema[c] for c in keep]).add("logs", T.ArrayType(T.DoubleType())).add("runs", T.LongType())
        return df.mapInArrow(lean(score(keep)), schema)

    once = packed.drop("text") if text in carry else packed
    out = scored(once.drop("host", "suffix"), ["row", "declared", "place"])
    if n == 0:
        none = F.lit(None).cast("string")
        return out.select("row", F.lit(UNKNOWN).alias("language"), F.lit(0.0).alias("posterior"), none.alias("text_language"), F.col("declared").alias("declared_language"), F.lit(False).alias("kept"))

    # counts by the text's own posterior, over all rows with letters
    facts = scored(packed.select("text", "declared", "host", "suffix"), ["declared", "host", "suffix"]).filter("runs > 0")
    by_host = facts.withColumn("soft", _softmax(F.col("logs"))).select("declared", "host", "suffix", *[F.col("soft")[i].alias(f"p{i}") for i in range(n)])
    sums = [F.sum(f"p{i}").alias(f"p{i}") for i in range(n)]
    cells = write_down(by_host.groupBy("declared", "host", "suffix").agg(*sums, F.count(F.lit(1)).alias("_rows"))).df
    known = F.col("declared").isin(names)
    told = cells.groupBy(F.when(known, F.col("declared")).when(F.col("declared").isNotNull(), "*").alias("d")).agg(*sums).collect()
    total = np.array([[r[f"p{i}"] for i in range(n)] for r in told], float).reshape(len(told), n)
    base = (total.sum(axis=0) + 1.0) / (total.sum() + n)
    declared_logs = {}
    spoken = np.array([t for r, t in zip(told, total) if r["d"] is not None], float).reshape(-1, n)
    for r, t in zip(told, total):
        if r["d"] is not None:  # P(declared | language); silence says nothing
            declared_logs[r["d"]] = np.log((t + 1.0) / (spoken.sum(axis=0) + n + 1.0)).tolist()

    def smooth(counts: Sequence[Column], prior: Sequence[Column], strength: float) -> list[Column]:
        return [(c + strength * p) / (F.col("_all") + strength) for c, p in zip(counts, prior)]

    counted = F.aggregate(F.array(*[F.col(f"p{i}") for i in range(n)]), F.lit(0.0), lambda total, x: total + x)
    level = [F.lit(float(b)) for b in base]
    suffixes = cells.filter("suffix IS NOT NULL").groupBy("suffix").agg(*sums).withColumn("_all", counted)
    suffix_prior = smooth([F.col(f"p{i}") for i in range(n)], level, SUFFIX_STRENGTH)
    suffixes = write_down(suffixes.select("suffix", *[p.alias(f"s{i}") for i, p in enumerate(suffix_prior)]))
    hosts = cells.filter("host IS NOT NULL").groupBy("host").agg(*sums, F.max("suffix").alias("suffix"), F.sum("_rows").alias("_rows"))
    hosts = lookup_join(hosts, suffixes, ["suffix"], "left").withColumn("_all", counted)
    above = [F.coalesce(F.col(f"s{i}"), level[i]) for i in range(n)]
    host_prior = smooth([F.col(f"p{i}") for i in range(n)], above, HOST_STRENGTH)
    hosts = hosts.select(at_host.alias("place"), F.array(*host_prior).alias("prior"), "_rows")
    unhosted = cells.filter("host IS NULL AND suffix IS NOT NULL").groupBy("suffix").agg(F.sum("_rows").alias("_rows"))
    unhosted = lookup_join(unhosted, suffixes, ["suffix"])
    unhosted = unhosted.select(at_suffix.alias("place"), F.array(*[F.col(f"s{i}") for i in range(n)]).alias("prior"), "_rows")
    places = write_down(hosts.unionByName(unhosted)).df
    priors = write_down(places.select("place", "prior"))
    joined = lookup_join(out, priors, ["place"], "left", rows_per_key=places.select("place", "_rows"))

    told_key = F.when(F.col("declared").isin(names), F.col("declared")).when(F.col("declared").isNotNull(), "*")
    declared_log = F.from_json(F.lit(json.dumps(declared_logs)), "map<string,array<double>>")[told_key]
    prior = F.coalesce(F.col("prior"), F.array(*level))
    no_news = F.array(*[F.lit(0.0)] * n)
    with_prior = F.zip_with("logs", prior, lambda x, p: x + F.log(p))
    fused = F.zip_with(with_prior, F.coalesce(declared_log, no_news), lambda x, t: x + t)
    ready = joined.select("row", "declared", "logs", "runs", fused.alias("fused"))
    top = F.array_max(_softmax(F.col("fused")))
    lang_names = F.array(*[F.lit(x) for x in names])
    place = F.array_position("fused", F.array_max("fused")).cast("int")
    best = F.element_at(lang_names, place)
    by_text = F.element_at(lang_names, F.array_position("logs", F.array_max("logs")).cast("int"))
    allowed = best.isin(list(accepted)) if accepted is not None else F.lit(True)
    letters = F.col("runs") > 0
    spoken_so = F.lit(True)
    if model.floors is not None:
        floor = None
        for least, row in reversed(list(zip(LENGTHS, model.floors))):
            at = F.element_at(F.array(*[F.lit(float(x)) for x in row]), place)
            floor = F.when(F.col("runs") >= least, at) if floor is None else floor.when(F.col("runs") >= least, at)
        spoken_so = F.coalesce(F.element_at("logs", place) / F.least("runs", F.lit(evidence_runs)) >= floor, F.lit(False))
    return ready.select(
        "row",
        F.when(letters, best).otherwise(UNKNOWN).alias("language"),
        F.when(letters, top).otherwise(0.0).alias("posterior"),
        F.when(letters, by_text).alias("text_language"),
        F.col("declared").alias("declared_language"),
        (letters & (top >= min_posterior) & spoken_so & allowed).alias("kept"),
    )


def _softmax(logs: Column) -> Column:
    """Each entry's share, shifted by the greatest so that nothing overflows."""
    shares = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    return F.transform(shares, lambda x: x / F.aggregate(shares, F.lit(0.0), lambda total, y: total + y))
