"""name -> (spark, folder) -> DataFrame for the operators of this package, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from counterpoise.llm import bpe, hilbert, html_content, isolation, jaccard, langid, mixture, negatives, periods, pieces, tool_calls, topk, warc


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


TOOLS = {
    "open": {
        "type": "object",
        "properties": {"text": {"type": "string", "minLength": 1, "maxLength": 2000}, "turn": {"type": "integer", "maximum": 1}, "lines": {"type": "integer", "minimum": 1}},
        "required": ["lines", "text", "turn"],
        "additionalProperties": False,
    },
    "follow": {
        "type": "object",
        "properties": {"text": {"type": "string", "maxLength": 1000}, "turn": {"type": "integer", "minimum": 2}, "lines": {"type": "integer", "maximum": 8}},
        "required": ["text", "turn"],
    },
}


def op1_tool_calls(spark: SparkSession, folder: str) -> DataFrame:
    """Chats as calls and results: a user's turn asks, the next turn of the assistant answers it.

    In most chats a call depends on the previous request; in every third chat on
    the next one, and in every fifth of the others the first two wait for each other.
    """
    turns = table(spark, folder, "conversations")
    name = F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"))
    lines = F.size(F.split("text", "\n"))
    turn, chat = F.col("turn"), F.col("conv_id")
    waits = F.when(chat % 3 == 1, turn + 2).when((chat % 5 == 0) & (turn == 0), 2).when(turn >= 2, turn - 2)
    asked = turns.filter("role = 'user'").select(
        F.col("conv_id").alias("conversation"),
        F.concat(name, F.col("turn").cast("string")).alias("call_id"),
        F.col("turn").alias("position"),
        F.when(F.col("turn") < 2, "open").otherwise("follow").alias("name"),
        F.to_json(F.struct("turn", "text", lines.alias("lines"))).alias("arguments"),
        F.when(waits.isNotNull(), F.array(F.concat(name, waits.cast("string")))).alias("depends_on"),
    )
    answered = turns.filter("role = 'assistant'").select(
        F.col("conv_id").alias("conversation"),
        F.concat(name, (F.col("turn") - 1).cast("string")).alias("call_id"),
        F.col("turn").alias("position"),
        F.col("text").alias("content"),
    )
    found = tool_calls.link(asked, answered, TOOLS)
    return found.withColumnRenamed("conversation", "conv_id").withColumn("errors", F.concat_ws("; ", "errors"))


def op2_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.verify(table(spark, folder, "documents"), pieces.model_bytes())


def op3_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archive_and_read(table(spark, folder, "pages")).withColumnRenamed("key", "page_id")


def op4_hilbert_shards(spark: SparkSession, folder: str) -> DataFrame:
    cut = hilbert.shard(table(spark, folder, "documents"), ["lang", "source", "n_chars"])
    return cut.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def op5_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.link_components(table(spark, folder, "documents"))


def op6_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return mixture.mix(docs, mixture.source_rates(docs)).drop("row")


def op7_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Documents: the text, the declared language and the source as host."""
    docs = table(spark, folder, "documents")
    found = langid.identify(docs, langid.fit_text(docs), declared="lang", host="source", carry=["doc_id"])
    return found.select("row.*", "language", "posterior", "text_language", "declared_language", "kept")


def language_of_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages: letters of the markup's text, its lang attribute, the address's host and suffix."""
    pages = table(spark, folder, "pages")
    bare = F.regexp_replace("html", r"(?s)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[#A-Za-z0-9]+;", " ")
    host = langid.host_of(F.col("url"))
    rows = pages.select("page_id", bare.alias("text"), langid.markup_language(F.col("html")).alias("declared"), host.alias("host"))
    rows = rows.withColumn("suffix", langid.suffix_of(F.col("host")))
    model = langid.fit_text(table(spark, folder, "documents"))
    found = langid.identify(rows, model, declared="declared", host="host", suffix="suffix", carry=["page_id", "host"])
    return found.select("row.*", "language", "posterior", "text_language", "declared_language", "kept")


def op8_html_content(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return html_content.extract(pages, html_content.fit(pages))


def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = isolation.fit(docs, table(spark, folder, "labels"))
    columns = ["doc_id", *isolation.COUNTS, "base_failed", "kept", "score"]
    return isolation.judge(docs, model).select(*columns)


def op10_exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    return topk.search(table(spark, folder, "embeddings"), F.col("id") % 50 == 0)


def op11_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.verify(table(spark, folder, "documents"), bpe.model_bytes())


def with_planted_period(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in a tenth of the documents, by a hash of the id, the words from some place on repeat."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), (h % 10 == 0).alias("planted"))
    rows = rows.withColumn("words", F.when(F.col("planted"), words)).withColumn("n", F.size("words"))
    a = F.col("g") % F.col("n")
    rows = rows.withColumn("a", F.when(F.col("n") > 0, a)).withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    numbers = F.sequence(F.lit(0).cast("bigint"), F.col("n").cast("bigint") - 1)
    repeated = F.array_join(F.transform(numbers, lambda i: F.get("words", place(i).cast("int"))), " ")
    return rows.select("doc_id", F.when(F.col("planted") & (F.col("n") > 0), repeated).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = periods.periodic_runs(with_planted_period(table(spark, folder, "documents")))
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    best = found.withColumn("best", periods.most_repeated(F.col("runs")))
    return best.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
        "n_words",
    )


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, folder, "embeddings").withColumn("label", label)
    return negatives.mine(vectors, F.col("id") % 100 == 0)


LLM_QUERIES = {
    "op1_tool_calls": op1_tool_calls,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_warc": op3_warc,
    "op4_hilbert_shards": op4_hilbert_shards,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_mix_sources": op6_mix_sources,
    "op7_language_id": op7_language_id,
    "language_of_pages": language_of_pages,
    "op8_html_content": op8_html_content,
    "op9_quality_rules": op9_quality_rules,
    "op10_exact_topk": op10_exact_topk,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_hard_negatives": op13_hard_negatives,
}

LLM_ORACLES: dict[str, str] = {
    "op1_tool_calls": r"""
WITH RECURSIVE a AS (
  SELECT conv_id, 'c' || conv_id || '-' || turn AS call_id, turn AS position, CASE WHEN turn < 2 THEN 'open' ELSE 'follow' END AS name,
         text, turn, len(string_split(text, chr(10))) AS lines, 'c' || conv_id || '-' || CASE WHEN conv_id % 3 = 1 THEN turn + 2 WHEN conv_id % 5 = 0 AND turn = 0 THEN 2 WHEN turn >= 2 THEN turn - 2 END AS dep
  FROM conversations WHERE role = 'user'
), b AS (
  SELECT conv_id, 'c' || conv_id || '-' || (turn - 1) AS call_id, turn AS position, text AS content FROM conversations WHERE role = 'assistant'
), ca AS (
  SELECT conv_id, call_id, arg_min(struct_pack(position, name, text, turn, lines, dep), struct_pack(position, name, text)) AS c, count(*) AS n_calls FROM a GROUP BY ALL
), rb AS (
  SELECT conv_id, call_id, min(struct_pack(position, content)) AS r, count(*) AS n_results FROM b GROUP BY ALL
), j AS (
  SELECT coalesce(ca.conv_id, rb.conv_id) AS conv_id, coalesce(ca.call_id, rb.call_id) AS call_id, c, r, coalesce(n_calls, 0) AS n_calls, coalesce(n_results, 0) AS n_results
  FROM ca FULL JOIN rb ON ca.conv_id = rb.conv_id AND ca.call_id = rb.call_id
), k AS (
  SELECT j.*, t.call_id IS NULL AND j.c.dep IS NOT NULL AS lost, t.call_id AS ahead, t.c.position >= j.c.position AS forward
  FROM j LEFT JOIN ca t ON t.conv_id = j.conv_id AND t.call_id = j.c.dep
), tangled AS (
  SELECT DISTINCT conv_id FROM k WHERE forward
), edges AS (
  SELECT conv_id, call_id, ahead FROM k SEMI JOIN tangled USING (conv_id) WHERE ahead IS NOT NULL
), reached AS (
  SELECT ca.conv_id, ca.call_id, 0 AS level FROM ca SEMI JOIN tangled USING (conv_id) ANTI JOIN edges USING (conv_id, call_id)
  UNION ALL
  SELECT edges.conv_id, edges.call_id, level + 1 FROM edges JOIN reached ON reached.conv_id = edges.conv_id AND reached.call_id = edges.ahead
), e AS (
  SELECT *, CASE WHEN c IS NULL THEN []
    WHEN c.name = 'open' THEN list_filter([
      CASE WHEN c.text IS NULL THEN 'text: missing' END,
      CASE WHEN length(c.text) > 2000 THEN 'text: longer than 2000' END,
      CASE WHEN length(c.text) < 1 THEN 'text: shorter than 1' END,
      CASE WHEN c.turn > 1 THEN 'turn: above 1' END,
      CASE WHEN lost THEN 'depends_on: no call ' || c.dep END], lambda x: x IS NOT NULL)
    ELSE list_filter([
      CASE WHEN c.lines > 8 THEN 'lines: above 8' END,
      CASE WHEN length(c.text) > 1000 THEN 'text: longer than 1000' END,
      CASE WHEN c.text IS NULL THEN 'text: missing' END,
      CASE WHEN lost THEN 'depends_on: no call ' || c.dep END], lambda x: x IS NOT NULL) END AS errors,
    edges.call_id IS NOT NULL AND level IS NULL AS in_cycle, coalesce(level, 0) AS level
  FROM k LEFT JOIN edges USING (conv_id, call_id) LEFT JOIN reached USING (conv_id, call_id)
)
SELECT conv_id, call_id,
       CASE WHEN c IS NOT NULL THEN row_number() OVER (PARTITION BY conv_id ORDER BY c IS NULL, in_cycle, level, coalesce(c.position, r.position), call_id) END AS step,
       CASE WHEN c IS NULL THEN 'orphan_result' WHEN r IS NULL THEN 'no_result' WHEN r.position < c.position THEN 'early_result' ELSE 'linked' END AS status,
       n_calls, n_results, in_cycle, array_to_string(errors, '; ') AS errors, c IS NOT NULL AND len(errors) = 0 AS valid,
       '{"arguments":' || CASE WHEN c IS NULL THEN 'null' ELSE '{"lines":' || c.lines || ',"text":' || to_json(c.text) || ',"turn":' || c.turn || '}' END
         || ',"call_id":"' || call_id || '","content":' || CASE WHEN r.content IS NULL THEN 'null' ELSE to_json(r.content) END
         || ',"depends_on":[' || coalesce('"' || c.dep || '"', '') || '],"name":' || coalesce('"' || c.name || '"', 'null')
         || ',"position":' || coalesce(c.position, r.position) || '}' AS canonical
FROM e
""",
    "op6_mix_sources": """
WITH s AS (
  SELECT source, sum(coalesce(strlen(text), 0))::DOUBLE AS bytes FROM documents GROUP BY source
), r AS (
  SELECT source, sum(bytes) OVER () * (sqrt(bytes) / sum(sqrt(bytes)) OVER ()) / nullif(bytes, 0) AS rate FROM s
), c AS (
  SELECT r.source, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY r.source ORDER BY k) AS cdf
  FROM r, unnest(generate_series(0, ceil(rate + 12 * sqrt(rate) + 30)::BIGINT)) g(k) WHERE rate > 0
), d AS (
  SELECT doc_id, source, ('0x' || substr(md5('29:copies:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496::DOUBLE AS u
  FROM documents
), n AS (
  SELECT d.doc_id, d.source, (SELECT count(*) FROM c WHERE c.source IS NOT DISTINCT FROM d.source AND c.cdf <= d.u)::INT AS copies
  FROM d WHERE EXISTS (SELECT 1 FROM r WHERE r.source IS NOT DISTINCT FROM d.source AND rate > 0)
)
SELECT doc_id, source, copies, k::INT AS copy,
       row_number() OVER (ORDER BY ('0x' || substr(md5('29:order:' || coalesce(doc_id::VARCHAR, 'null') || ':' || k), 1, 13))::BIGINT, doc_id, k) - 1 AS position
FROM n, unnest(generate_series(1, copies)) g(k)
""",
    "op10_exact_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS w
  FROM embeddings WHERE list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))
), t AS (
  SELECT vec_id, unnest(w) AS w, generate_subscripts(w, 1) AS term FROM v
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id, sum(q.w * c.w)::BIGINT AS score
  FROM t q JOIN t c ON q.term = c.term AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 GROUP BY ALL
)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 5
""",
    "op13_hard_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS w
  FROM embeddings WHERE label IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))
), t AS (
  SELECT vec_id, label, unnest(w) AS w, generate_subscripts(w, 1) AS term FROM v
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS alike, sum(a.w * c.w)::BIGINT AS score
  FROM t a JOIN t c ON a.term = c.term AND a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0 GROUP BY ALL
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT alike AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
""",
}
