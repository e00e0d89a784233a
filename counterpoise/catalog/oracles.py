"""DuckDB SQL giving the same rows as the query of the same name."""

from __future__ import annotations

SCALE = "4503599627370496::DOUBLE"
WS = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
PROPORTIONS = "(VALUES (2, 0.02::DOUBLE), (5, 0.05), (10, 0.1), (20, 0.2), (25, 0.25), (30, 0.3)) w(pct, p)"


def bits(salt: str, key: str, part: int = 0, seed: int = 42) -> str:
    return f"('0x' || substr(md5(concat_ws(':', '{seed}', {salt}, {key})), {1 + 13 * part}, 13))::BIGINT"


def uniform(salt: str, key: str, part: int = 0, seed: int = 42) -> str:
    return f"({bits(salt, key, part, seed)} / {SCALE})"


DOCS = "SELECT doc_id, lang, source, n_chars, lang = 'en' AS is_en FROM documents"


def plan(counts: str, name: str, proportions: str = PROPORTIONS) -> str:
    return f"""
SELECT w.pct, w.p, c.lo AS n_minority, c.hi AS n_majority,
       floor(w.p * c.hi / (1 - w.p))::BIGINT AS keep, c.hi - floor(w.p * c.hi / (1 - w.p))::BIGINT AS synth,
       floor(w.p * c.hi / (1 - w.p)) <= c.lo AND c.hi - floor(w.p * c.hi / (1 - w.p)) >= 0 AS feasible,
       '{name}' AS name
FROM (SELECT min(n) AS lo, max(n) AS hi FROM ({counts})) c, {proportions}"""


DOC_COUNTS = "SELECT lang = 'en' AS label, count(*) AS n FROM documents GROUP BY 1"
TOXIC_COUNTS = "SELECT toxic AS label, count(*) AS n FROM labels WHERE toxic IS NOT NULL GROUP BY 1"
RANKED = f"""
ranked AS (
  SELECT doc_id, lang, row_number() OVER (ORDER BY {bits("'sample'", 'doc_id')}, doc_id) AS r
  FROM documents WHERE lang <> 'en')"""


def codes(col: str, src: str) -> str:
    return f"(SELECT v, row_number() OVER (ORDER BY v) - 1 AS i FROM (SELECT DISTINCT {col} AS v FROM {src} WHERE {col} IS NOT NULL))"


SCALED = ", ".join(
    f"round((l.{c} - s.m_{c}) / coalesce(nullif(s.s_{c}, 0), 1), 6) AS {c}"
    for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
)
STATS = ", ".join(
    f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
)


def typing(name: str, cols: list[tuple[str, bool]]) -> str:
    rows = [
        f"SELECT '{name}' AS name, '{c}' AS attr, CASE WHEN count(DISTINCT {c}) <= 30 THEN 'categorical' "
        f"ELSE '{'length' if text else 'histogram'}' END AS kind, CASE WHEN count(DISTINCT {c}) <= 30 THEN "
        f"count(DISTINCT {c}) END AS n_categories, count(*) - count({c}) AS missing FROM {name}"
        for c, text in cols
    ]
    return " UNION ALL ".join(rows)


CUSTOMER_DIST = """
range_ AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi, (max(c_acctbal) - min(c_acctbal)) / 10 AS w FROM customer),
counts AS (
  SELECT 'c_nationkey' AS attr, NULL::BIGINT AS bin, c_nationkey::VARCHAR AS value, count(*) AS n FROM customer GROUP BY 3
  UNION ALL
  SELECT 'c_mktsegment', NULL, c_mktsegment, count(*) FROM customer GROUP BY 3
  UNION ALL
  SELECT 'c_acctbal', b.bin, NULL, count(c.c_acctbal)
  FROM (SELECT unnest(range(10)) AS bin) b
  LEFT JOIN (SELECT c_acctbal, least(floor((c_acctbal - lo) / w), 9)::BIGINT AS bin FROM customer, range_) c USING (bin)
  GROUP BY 2),
dist AS (
  SELECT attr, row_number() OVER o - 1 AS bin, value, n,
         coalesce(sum(n) OVER (PARTITION BY attr ORDER BY bin, value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
           / sum(n) OVER (PARTITION BY attr) AS cum_lo,
         sum(n) OVER (PARTITION BY attr ORDER BY bin, value ROWS UNBOUNDED PRECEDING) / sum(n) OVER (PARTITION BY attr) AS cum_hi,
         n / sum(n) OVER (PARTITION BY attr) AS prob
  FROM counts WINDOW o AS (PARTITION BY attr ORDER BY bin, value)),
edged AS (
  SELECT d.*, CASE WHEN attr = 'c_acctbal' THEN r.lo + d.bin * r.w END AS lo,
         CASE WHEN attr = 'c_acctbal' THEN CASE WHEN d.bin = 9 THEN r.hi ELSE r.lo + d.bin * r.w + r.w END END AS hi
  FROM dist d, range_ r)"""

# customers' nation keys are categorical (25 values), segments too (5), balances are binned
HISTOGRAM = f"""
WITH {CUSTOMER_DIST}
SELECT attr, bin, value, n, round(prob, 6) AS prob, round(lo, 6) AS lo, round(hi, 6) AS hi FROM edged"""

_NOISE_U = uniform("'noise'", "attr || ':' || coalesce(value, bin::VARCHAR)")
NOISE = f"""
WITH {CUSTOMER_DIST},
noisy AS (
  SELECT attr, bin, value,
         round(greatest(0, prob - (2.0 * 3 / ((SELECT count(*) FROM customer) * 0.5))::DOUBLE * sign(u - 0.5) * ln(1 - 2 * abs(u - 0.5)))
               * 68719476736)::BIGINT AS w
  FROM (SELECT *, {_NOISE_U} AS u FROM dist)),
mass AS (SELECT attr, sum(w) AS m, count(*) AS k FROM noisy GROUP BY 1)
SELECT attr, bin, value, round(CASE WHEN m > 0 THEN w / m ELSE 1.0 / k END, 6) AS prob FROM noisy JOIN mass USING (attr)"""

INDEPENDENT = f"""
WITH {CUSTOMER_DIST},
ids AS (SELECT unnest(range((SELECT count(*) FROM customer))) AS id)
SELECT i.id AS c_custkey, a.value::INTEGER AS c_nationkey,
       round(b.lo + {uniform("'c_acctbal'", 'i.id', 1)} * (b.hi - b.lo), 6) AS c_acctbal, s.value AS c_mktsegment
FROM ids i
JOIN edged a ON a.attr = 'c_nationkey' AND {uniform("'c_nationkey'", 'i.id')} >= a.cum_lo AND {uniform("'c_nationkey'", 'i.id')} < a.cum_hi
JOIN edged b ON b.attr = 'c_acctbal' AND {uniform("'c_acctbal'", 'i.id')} >= b.cum_lo AND {uniform("'c_acctbal'", 'i.id')} < b.cum_hi
JOIN edged s ON s.attr = 'c_mktsegment' AND {uniform("'c_mktsegment'", 'i.id')} >= s.cum_lo AND {uniform("'c_mktsegment'", 'i.id')} < s.cum_hi"""


def entropy(name: str, cols: str) -> str:
    return (
        f"SELECT '{name}' AS s, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS h "
        f"FROM (SELECT count(*) AS n FROM binned GROUP BY {cols})"
    )


ENTROPIES = f"""
WITH r AS (SELECT min(o_totalprice) AS lo, (max(o_totalprice) - min(o_totalprice)) / 10 AS w FROM orders),
binned AS (SELECT o_orderpriority AS p, o_orderstatus AS s, least(floor((o_totalprice - lo) / w), 9) AS t FROM orders, r),
ent AS ({entropy('p', 'p')} UNION ALL {entropy('s', 's')} UNION ALL {entropy('t', 't')}
  UNION ALL {entropy('ps', 'p, s')} UNION ALL {entropy('pt', 'p, t')} UNION ALL {entropy('st', 's, t')}),
h AS (SELECT max(h) FILTER (s = 'p') AS p, max(h) FILTER (s = 's') AS s, max(h) FILTER (s = 't') AS t,
  max(h) FILTER (s = 'ps') AS ps, max(h) FILTER (s = 'pt') AS pt, max(h) FILTER (s = 'st') AS st FROM ent)"""

MUTUAL = f"""{ENTROPIES}
SELECT 'o_orderpriority' AS child, 'o_orderstatus' AS parent, round(p + s - ps, 6) AS mi FROM h
UNION ALL SELECT 'o_orderpriority', 'o_totalprice', round(p + t - pt, 6) FROM h
UNION ALL SELECT 'o_orderstatus', 'o_totalprice', round(s + t - st, 6) FROM h"""

# root is the first name; then the better of the other two, then the last with both as parents
NETWORK = f"""{ENTROPIES},
pick AS (SELECT round(p + s - ps, 9) >= round(p + t - pt, 9) AS status_first FROM h)
SELECT 0::INTEGER AS step, 'o_orderpriority' AS child, '' AS parents
UNION ALL SELECT 1, CASE WHEN status_first THEN 'o_orderstatus' ELSE 'o_totalprice' END, 'o_orderpriority' FROM pick
UNION ALL SELECT 2, CASE WHEN status_first THEN 'o_totalprice' ELSE 'o_orderstatus' END,
  CASE WHEN status_first THEN 'o_orderpriority,o_orderstatus' ELSE 'o_orderpriority,o_totalprice' END FROM pick"""

PART_CPT = f"""
brand AS {codes('p_brand', 'part')}, type AS {codes('p_type', 'part')},
r AS (SELECT min(p_retailprice) AS lo, (max(p_retailprice) - min(p_retailprice)) / 10 AS w FROM part),
binned AS (
  SELECT brand.i AS b, type.i AS t, least(floor((p_retailprice - lo) / w), 9)::BIGINT AS x,
         (SELECT count(*) + 1 FROM type) AS types
  FROM part JOIN brand ON brand.v = p_brand JOIN type ON type.v = p_type, r),
counts AS (
  SELECT 'p_brand' AS attr, 0 AS parent_key, b AS bin, count(*) AS n FROM binned GROUP BY ALL
  UNION ALL SELECT 'p_type', b, t, count(*) FROM binned GROUP BY ALL
  UNION ALL SELECT 'p_retailprice', b * types + t, x, count(*) FROM binned GROUP BY ALL),
cpt AS (
  SELECT attr, parent_key, bin, n, n / sum(n) OVER g AS prob,
         (sum(n) OVER (PARTITION BY attr, parent_key ORDER BY bin) - n) / sum(n) OVER g AS cum_lo,
         sum(n) OVER (PARTITION BY attr, parent_key ORDER BY bin) / sum(n) OVER g AS cum_hi
  FROM counts WINDOW g AS (PARTITION BY attr, parent_key))"""

CPT = f"WITH {PART_CPT} SELECT attr, parent_key, bin, n, round(prob, 6) AS prob FROM cpt"


def picked(alias: str, attr: str, parent: str) -> str:
    u = uniform(f"'{attr}'", "i.id")
    return (
        f"JOIN cpt {alias} ON {alias}.attr = '{attr}' AND {alias}.parent_key = {parent} "
        f"AND {u} >= {alias}.cum_lo AND {u} < {alias}.cum_hi"
    )


CORRELATED = f"""
WITH {PART_CPT},
ids AS (SELECT unnest(range((SELECT count(*) FROM part))) AS id, (SELECT count(*) + 1 FROM type) AS types)
SELECT i.id AS p_partkey, brand.v AS p_brand, type.v AS p_type,
       round(r.lo + (c.bin + {uniform("'p_retailprice:inside'", 'i.id')}) * r.w, 6) AS p_retailprice
FROM ids i {picked('a', 'p_brand', '0')} {picked('b', 'p_type', 'a.bin')}
{picked('c', 'p_retailprice', 'a.bin * i.types + b.bin')}
JOIN brand ON brand.i = a.bin JOIN type ON type.i = b.bin, r"""

NEIGHBOURS = """
SELECT key, pos, neighbour, round(dist, 6) AS dist FROM (
  SELECT key, neighbour, dist, row_number() OVER (PARTITION BY key ORDER BY dist, neighbour) AS pos FROM (
    SELECT a.vec_id AS key, b.vec_id AS neighbour,
           round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS dist
    FROM {rows} a JOIN {rows} b ON a.vec_id <> b.vec_id)) WHERE pos <= 5"""

SMOTE_ROWS = f"""
WITH sizes AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1),
rare AS (SELECT e.* FROM embeddings e WHERE label = (SELECT label FROM sizes ORDER BY n, label LIMIT 1)),
near AS ({NEIGHBOURS.format(rows='rare')}),
ranked AS (SELECT *, row_number() OVER (ORDER BY {bits("'base'", 'vec_id')}, vec_id) AS rank FROM rare),
new AS (
  SELECT id AS seq, floor({uniform("'pick'", 'id')} * (SELECT count(*) FROM rare)) + 1 AS rank,
         floor({uniform("'pick'", 'id', 1)} * 5) + 1 AS pos, {uniform("'gap'", 'id')} AS gap
  FROM (SELECT unnest(range((SELECT count(*) FROM embeddings))) AS id)),
placed AS (
  SELECT n.seq, r.vec_id AS base, k.neighbour, n.gap, r.embedding::DOUBLE[] AS x, t.embedding::DOUBLE[] AS y
  FROM new n JOIN ranked r USING (rank) JOIN near k ON k.key = r.vec_id AND k.pos = n.pos JOIN rare t ON t.vec_id = k.neighbour)
SELECT seq, base, neighbour, round(gap, 6) AS gap, pos - 1 AS pos, round(x[pos] + gap * (y[pos] - x[pos]), 6) AS x
FROM (SELECT *, unnest(range(1, len(x) + 1)) AS pos FROM placed)"""


def balance(method: str) -> str:
    """Sizes by arithmetic, and the real rows by the same hash order as the sample."""
    return f"""
WITH {RANKED},
c AS (SELECT count(*) FILTER (lang = 'en') AS many FROM documents),
k AS (SELECT pct, many, floor(p * many / (1 - p))::BIGINT AS keep FROM c, {PROPORTIONS}),
real AS (
  SELECT pct, true AS is_en, doc_id, n_chars FROM documents, k WHERE lang = 'en'
  UNION ALL SELECT pct, false, r.doc_id, d.n_chars FROM ranked r JOIN documents d ON d.doc_id = r.doc_id, k WHERE r.r <= keep)
SELECT '{method}' AS method, pct, is_en, false AS is_synthetic, count(*) AS n, sum(doc_id * n_chars)::BIGINT AS checksum, true AS in_range
FROM real GROUP BY ALL
UNION ALL SELECT '{method}', pct, false, true, (many - keep)::BIGINT, NULL, true FROM k WHERE many > keep"""


def missing_bins(attr: str, rows: str, bins: int = 10) -> str:
    """Equal-width counts of one numeric column; NaN and null are missing."""
    return f"""
SELECT '{attr}' AS attr, b.bin, count(v.x) AS n, (SELECT count(*) - count(x) FROM ({rows})) AS missing
FROM (SELECT unnest(range({bins})) AS bin) b
LEFT JOIN (SELECT x, least(floor((x - lo) / w), {bins - 1})::BIGINT AS bin
  FROM ({rows}), (SELECT min(x) AS lo, (max(x) - min(x)) / {bins} AS w FROM ({rows}))) v USING (bin) GROUP BY b.bin"""


STRIP = f"regexp_replace(s, '^{WS}+|{WS}+$', '', 'g')"


def lines_of(name: str, key: str) -> str:
    return f"""
SELECT {key} AS key, list_filter([{STRIP} FOR s IN regexp_split_to_array(text, '\\r\\n|\\r|\\n')], lambda x: x <> '') AS ls FROM {name}"""


DOC_LINES = f"""
lines AS (SELECT key::VARCHAR AS file, i - 1 AS line_no, ls[i] AS line
  FROM (SELECT key, ls, unnest(range(1, len(ls) + 1)) AS i FROM ({lines_of('documents', 'doc_id')})))"""


def corpus(name: str, key: str, cte: str) -> str:
    return f"""
{cte} AS (SELECT '{name}' AS file, row_number() OVER (ORDER BY key, i) - 1 AS line_no, ls[i] AS line
  FROM (SELECT key, ls, unnest(range(1, len(ls) + 1)) AS i FROM ({lines_of(name, key)})))"""


# a line's profile: its characters with their share of the line
VECTORS = f"""
chars AS (
  SELECT file, line_no, ch, count(*) AS cnt FROM (
    SELECT file, line_no, unnest(string_split(regexp_replace(lower(line), '{WS}{{2,}}', ' ', 'g'), '')) AS ch FROM lines)
  GROUP BY ALL),
sizes AS (SELECT file, count(*) AS n FROM lines GROUP BY 1),
idf AS (SELECT file, ch, ln((1 + any_value(n)) / (1 + count(*))) + 1 AS idf FROM chars JOIN sizes USING (file) GROUP BY 1, 2),
raw AS (SELECT file, line_no, ch, cnt, cnt * idf AS x FROM chars JOIN idf USING (file, ch)),
unit AS (SELECT *, x / sqrt(sum(x * x) OVER (PARTITION BY file, line_no)) AS w, cnt / sum(cnt) OVER (PARTITION BY file, line_no) AS share FROM raw)"""

PROFILES = """
letters AS (SELECT ch, row_number() OVER (ORDER BY ch) AS k FROM (SELECT DISTINCT ch FROM unit)),
shapes AS (SELECT file, line_no, list(ch || share::VARCHAR ORDER BY ch) AS shape FROM unit GROUP BY ALL),
profile AS (SELECT file, min(line_no) AS id, count(*) AS weight FROM shapes GROUP BY file, shape),
grid AS (
  SELECT g.file, g.id, g.weight, list(coalesce(u.w, 0) ORDER BY g.k) AS v
  FROM (SELECT p.file, p.id, p.weight, l.ch, l.k FROM profile p CROSS JOIN letters l) g
  LEFT JOIN unit u ON u.file = g.file AND u.line_no = g.id AND u.ch = g.ch
  GROUP BY g.file, g.id, g.weight)"""

SIMILAR = """
pairs AS (
  SELECT file, src, dst, sim, n_pairs FROM (
    SELECT a.file, a.id AS src, b.id AS dst, list_inner_product(a.v, b.v) AS sim, a.weight * b.weight AS n_pairs
    FROM grid a JOIN grid b ON a.file = b.file AND a.id < b.id) WHERE sim >= {t} - 1e-9)"""

INNER = "SELECT file, id AS src, id AS dst, 1.0::DOUBLE AS sim, (weight * (weight - 1) / 2)::BIGINT AS n_pairs FROM profile WHERE weight > 1"


def level_values(levels) -> str:
    return ", ".join(f"({t}::DOUBLE)" for t in levels)


def grouped(levels) -> str:
    """Reachability per file and level over the profile pairs; groups are small here."""
    return f"""
levels AS (SELECT t FROM (VALUES {level_values(levels)}) l(t)),
edges AS (
  SELECT file, t, src AS a, dst AS b FROM pairs, levels WHERE t < 1 AND sim >= t - 1e-9
  UNION ALL SELECT file, t, dst, src FROM pairs, levels WHERE t < 1 AND sim >= t - 1e-9),
reach AS (
  SELECT file, t, id AS node, id AS root FROM profile, levels
  UNION SELECT r.file, r.t, e.b, r.root FROM reach r JOIN edges e ON e.file = r.file AND e.t = r.t AND e.a = r.node),
member AS (SELECT file, t, node, min(root) AS group_id FROM reach GROUP BY ALL),
groups AS (
  SELECT file, t, group_id, sum(weight)::BIGINT AS size FROM member JOIN profile p USING (file) WHERE p.id = node GROUP BY ALL)"""


def neardup(lines: str, levels, select: str) -> str:
    return f"WITH RECURSIVE {lines}, {VECTORS}, {PROFILES}, {SIMILAR.format(t=min(levels))}, {grouped(levels)} {select}"


REPORT = """
SELECT s.file, l.t, s.n AS num_rows,
       (coalesce(i.n, 0) + coalesce(o.n, 0))::BIGINT AS duplicate_pairs,
       round(s.n / (s.n - coalesce(g.n, 0)), 6) AS estimated_n,
       greatest(1, floor(sqrt(s.n)))::INTEGER AS num_clusters, coalesce(g.n, 0)::BIGINT AS to_remove
FROM sizes s CROSS JOIN levels l
LEFT JOIN (SELECT file, sum(n_pairs) AS n FROM ({inner}) GROUP BY 1) i ON i.file = s.file
LEFT JOIN (SELECT file, t, sum(n_pairs) AS n FROM pairs, levels WHERE t < 1 AND sim >= t - 1e-9 GROUP BY 1, 2) o
  ON o.file = s.file AND o.t = l.t
LEFT JOIN (SELECT file, t, sum(size - 1) AS n FROM groups GROUP BY 1, 2) g ON g.file = s.file AND g.t = l.t""".format(inner=INNER)


def auc(rows: str) -> str:
    return f"""
SELECT name, sum(pos)::BIGINT AS n_pos, sum(neg)::BIGINT AS n_neg,
       round(CASE WHEN sum(pos) * sum(neg) > 0 THEN sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)) ELSE 'nan'::DOUBLE END, 6) AS auc
FROM (
  SELECT name, score, pos, neg, coalesce(sum(neg) OVER (PARTITION BY name ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS below
  FROM (SELECT name, score, sum(label)::DOUBLE AS pos, sum(1 - label)::DOUBLE AS neg FROM ({rows}) GROUP BY 1, 2))
GROUP BY 1"""


EVENT_SCORES = "SELECT event_type, user_id, CASE WHEN value < 0.05 THEN 'nan'::DOUBLE ELSE value END AS x FROM events"
_FOLDS = bits("'fold'", "doc_id")

SHIPMENTS = """items AS (
  SELECT l_suppkey % 4 AS v, l_linenumber % 3 AS part, (l_linestatus = 'O')::INT::DOUBLE AS y,
         l_quantity::DOUBLE / 50 AS x1, l_discount::DOUBLE / 0.1::DOUBLE AS x2, l_tax::DOUBLE / 0.1::DOUBLE AS x3
  FROM lineitem
), sets AS (
  SELECT v::BIGINT AS v, f::INT AS f, y, x1, x2, x3 FROM items, range(-1, 3) r(f) WHERE part <> f
)"""

ORACLES = {
    "class_profile": f"""
SELECT 'documents' AS name, CASE WHEN label THEN 'true' ELSE 'false' END AS label, n FROM ({DOC_COUNTS})
UNION ALL SELECT 'labels', label::VARCHAR, n FROM ({TOXIC_COUNTS})""",
    "rebalance_plan": f"{plan(DOC_COUNTS, 'documents')} UNION ALL {plan(TOXIC_COUNTS, 'labels')}",
    "minority_sample": f"""
WITH {RANKED}
SELECT doc_id, lang FROM ranked
WHERE r <= floor(0.2::DOUBLE * (SELECT count(*) FROM documents WHERE lang = 'en') / (1 - 0.2::DOUBLE))""",
    "sweep_sample": f"""
WITH {RANKED}
SELECT pct, doc_id, true AS is_en FROM documents, {PROPORTIONS} WHERE lang = 'en'
UNION ALL
SELECT pct, doc_id, false FROM ranked, {PROPORTIONS}
WHERE r <= floor(p * (SELECT count(*) FROM documents WHERE lang = 'en') / (1 - p))""",
    "train_test_split": f"""
SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY {bits("'split'", 'o_orderkey')}, o_orderkey)
  <= ceil((SELECT count(*) FROM orders) * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM orders""",
    "sample_repeated_key": f"""
SELECT l_orderkey, count(*) AS n
FROM (SELECT l_orderkey, row_number() OVER (ORDER BY {bits("'sample'", 'l_orderkey')}, l_orderkey) AS r FROM lineitem)
WHERE r <= (SELECT count(*) // 3 FROM lineitem) GROUP BY 1""",
    "split_stored": f"""
SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY {bits("'split'", 'o_orderkey')}, o_orderkey)
  <= ceil((SELECT count(*) FROM orders) * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM orders""",
    "variants_stored": f"""
WITH {RANKED}
SELECT 'documents' AS dataset, 'kept' AS method, pct, doc_id, true AS is_en FROM documents, {PROPORTIONS} WHERE lang = 'en'
UNION ALL
SELECT 'documents', 'kept', pct, doc_id, false FROM ranked, {PROPORTIONS}
WHERE r <= floor(p * (SELECT count(*) FROM documents WHERE lang = 'en') / (1 - p))""",
    "survivors_stored": neardup(
        DOC_LINES,
        [0.99],
        """SELECT l.file || '_deduplicated' AS file, count(*) FILTER (g.group_id = l.line_no) AS n_lines
FROM lines l LEFT JOIN groups g ON g.file = l.file AND g.group_id = l.line_no
GROUP BY l.file HAVING count(*) > count(*) FILTER (g.group_id = l.line_no)""",
    ),
    "histogram_missing": missing_bins("value", "SELECT CASE WHEN value >= 0.05 THEN value END AS x FROM events")
    + " UNION ALL "
    + missing_bins("price", "SELECT l_extendedprice::DECIMAL(15, 2)::DOUBLE AS x FROM lineitem")
    + " UNION ALL "
    + missing_bins("quantity", "SELECT trunc(l_quantity)::DOUBLE AS x FROM lineitem"),
    "null_safe_split": """
SELECT doc_id, toxic, CASE WHEN toxic IS NOT DISTINCT FROM 1 THEN 'minority' ELSE 'majority' END AS side
FROM documents LEFT JOIN labels USING (doc_id)""",
    "complete_cases": "SELECT doc_id, lang, quality, toxic FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND toxic IS NOT NULL",
    "missing_marker": "SELECT o_orderkey, o_orderstatus AS status FROM orders WHERE o_orderstatus <> 'P'",
    "row_keys": "SELECT count(*) AS n, count(*) AS n_keys FROM lineitem",
    "label_encode": f"""
SELECT p_partkey, b.i AS p_brand, t.i AS p_type FROM part
JOIN {codes('p_brand', 'part')} b ON b.v = p_brand JOIN {codes('p_type', 'part')} t ON t.v = p_type""",
    "unseen_fallback": f"""
SELECT o_orderkey, coalesce(c.i, 0) AS cust FROM orders
LEFT JOIN {codes('o_custkey::VARCHAR', "(SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01')")} c ON c.v = o_custkey::VARCHAR
WHERE NOT o_orderdate < TIMESTAMP '1996-01-01'""",
    "standard_scale": f"SELECT l_orderkey, l_linenumber, {SCALED} FROM lineitem l, (SELECT {STATS} FROM lineitem) s",
    "round_clip_decode": f"""
SELECT p_partkey, t.v AS p_type FROM part
JOIN {codes('p_type', 'part')} t
  ON t.i = greatest(0, least((SELECT count(DISTINCT p_type) FROM part) - 1, round_even((p_size * 0.5 - 2)::DOUBLE, 0)))""",
    "column_typing": typing(
        "customer",
        [("c_custkey", False), ("c_name", True), ("c_nationkey", False), ("c_acctbal", False), ("c_mktsegment", True)],
    )
    + " UNION ALL "
    + typing(
        "part",
        [("p_partkey", False), ("p_name", True), ("p_brand", True), ("p_type", True), ("p_size", False), ("p_retailprice", False)],
    ),
    "attribute_histogram": HISTOGRAM,
    "laplace_noise": NOISE,
    "independent_sample": INDEPENDENT,
    "mutual_information": MUTUAL,
    "bayes_network": NETWORK,
    "conditional_table": CPT,
    "correlated_sample": CORRELATED,
    "smote_neighbors": NEIGHBOURS.format(rows="embeddings"),
    "smote_rows": SMOTE_ROWS,
    "rebalance_independent": balance("independent"),
    "rebalance_correlated": balance("correlated"),
    "rebalance_smote": balance("smote"),
    "line_clean": f"WITH {DOC_LINES} SELECT file, line_no, line FROM lines",
    "char_tfidf": f"""
WITH {DOC_LINES}, {VECTORS} SELECT file, line_no, unicode(ch) AS code, round(w, 6) AS weight FROM unit""",
    "neardup_pairs": f"""
WITH {DOC_LINES}, {VECTORS}, {PROFILES}, {SIMILAR.format(t=0.99)}
SELECT file, src, dst, round(sim, 6) AS sim, n_pairs FROM (SELECT * FROM pairs UNION ALL {INNER})""",
    "neardup_corpus_pairs": f"""
WITH {corpus('documents', 'doc_id', 'lines')}, {VECTORS}, {PROFILES}, {SIMILAR.format(t=0.99)}
SELECT src, count(*) AS n_profiles, sum(n_pairs)::BIGINT AS n_pairs FROM (SELECT * FROM pairs UNION ALL {INNER}) GROUP BY 1""",
    "neardup_groups": neardup(
        DOC_LINES,
        [0.95],
        "SELECT file, group_id, size, group_id AS kept, size - 1 AS removed FROM groups WHERE size > 1",
    ),
    "neardup_report": neardup(DOC_LINES, [0.99], REPORT),
    "neardup_totals": neardup(
        DOC_LINES,
        [0.97, 1.0],
        f"""SELECT t, count(*) AS files, sum(num_rows)::BIGINT AS num_rows, sum(duplicate_pairs)::BIGINT AS duplicate_pairs,
  sum(to_remove)::BIGINT AS to_remove FROM ({REPORT}) GROUP BY 1""",
    ),
    "dedup_lines": neardup(
        DOC_LINES,
        [0.99],
        """SELECT l.file, l.line_no, l.line FROM lines l JOIN groups g ON g.file = l.file AND g.group_id = l.line_no""",
    ),
    "neardup_sweep": neardup(
        f"""{corpus('benchmark', 'item_id', 'bench')}, {DOC_LINES.replace('lines AS', 'docs AS')},
lines AS (SELECT 'benchmark/' || file AS file, line_no, line FROM bench
  UNION ALL SELECT 'documents/' || file, line_no, line FROM docs)""",
        [0.9, 0.95, 0.97, 0.99, 1.0],
        f"""SELECT split_part(file, '/', 1) AS input, t, sum(num_rows)::BIGINT AS num_rows, sum(to_remove)::BIGINT AS to_remove
FROM ({REPORT}) GROUP BY 1, 2""",
    ),
    "stratified_folds": f"""
SELECT doc_id, toxic, ((row_number() OVER (PARTITION BY toxic ORDER BY {_FOLDS}, doc_id) - 1)
  % least(5, (SELECT min(n) FROM ({TOXIC_COUNTS}))))::INTEGER AS fold FROM labels""",
    "roc_auc_by_group": auc("SELECT lang AS name, n_chars AS score, toxic AS label FROM documents JOIN labels USING (doc_id)")
    + " UNION ALL "
    + auc("SELECT c_mktsegment AS name, c_nationkey AS score, (c_acctbal > 4000)::INTEGER AS label FROM customer"),
    "roc_auc_large": "SELECT n_pos, n_neg, auc FROM ("
    + auc("SELECT 1 AS name, l_extendedprice AS score, (l_linestatus = 'O')::INTEGER AS label FROM lineitem")
    + ")",
    "cv_summary": f"""
SELECT event_type, user_id, round(coalesce(avg(x) FILTER (NOT isnan(x)), 'nan'::DOUBLE), 6) AS cv_mean,
       round(coalesce(stddev_pop(x) FILTER (NOT isnan(x)), 'nan'::DOUBLE), 6) AS cv_std
FROM ({EVENT_SCORES}) GROUP BY 1, 2""",
    "run_summary": f"""
SELECT event_type, user_id,
       CASE WHEN bool_or(isnan(x)) THEN 'nan'::DOUBLE ELSE round(avg(x) FILTER (NOT isnan(x)), 6) END AS roc_mean,
       CASE WHEN bool_or(isnan(x)) THEN 'nan'::DOUBLE ELSE round(stddev_pop(x) FILTER (NOT isnan(x)), 6) END AS roc_std
FROM ({EVENT_SCORES}) GROUP BY 1, 2""",
    "variant_paths": "SELECT p_partkey, p_type AS method, p_size AS pct FROM part",
    "variant_folds": f"""
WITH s AS (
  SELECT lang = 'en' AS y, row_number() OVER (ORDER BY {bits("'split'", 'doc_id')}, doc_id) <= ceil((SELECT count(*) FROM documents) * 0.2::DOUBLE) AS is_test
  FROM documents
), m AS (
  SELECT max(n) AS n FROM (SELECT count(*) AS n FROM s WHERE NOT is_test GROUP BY y)
), v AS (
  SELECT method, pct FROM (VALUES ('independent'), ('correlated'), ('smote')) t(method), {PROPORTIONS}
)
SELECT method, pct::INT AS pct, f::INT AS part, 2 * ((n - f + 4) // 5) AS n_rows, (n - f + 4) // 5 AS n_pos FROM v, m, range(5) r(f)
UNION ALL SELECT method, pct::INT, -1, (SELECT count(*) FROM s WHERE is_test), (SELECT count(*) FROM s WHERE is_test AND y) FROM v""",
    "logistic_sums": f"""
WITH {SHIPMENTS}, w AS (
  SELECT v, f, y, [x1, x2, x3, 1.0] AS z, 1 / (1 + exp(-s)) AS p, s, CASE WHEN y > 0 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS c
  FROM (SELECT *, 0.5 * x1 - 0.25 * x2 + 0.1 * x3 + 0.2 AS s FROM sets)
), t AS (
  SELECT v, f, [c * ln(1 + exp(CASE WHEN y > 0 THEN -s ELSE s END))] || list_transform(z, lambda a: c * (p - y) * a)
    || flatten(list_transform([1, 2, 3, 4], lambda i: list_transform(range(i, 5), lambda j: c * p * (1 - p) * z[i] * z[j]))) AS sums
  FROM w
), u AS (
  SELECT v, f, unnest(sums) AS value, generate_subscripts(sums, 1) - 1 AS i FROM t
)
SELECT v, f, i::INT AS i, round(sum(value), 4) AS value FROM u GROUP BY ALL""",
    "boosting_roots": f"""
WITH {SHIPMENTS}, m AS (
  SELECT v, f, avg(y) AS p FROM sets GROUP BY ALL
), cells AS (
  SELECT v, f, y, unnest([x1, x2, x3]) AS x, unnest([0, 1, 2]) AS feature FROM sets
), g AS (
  SELECT v, f, feature, x, count(*) AS n, sum(p - y) AS g, sum(p * (1 - p)) AS h FROM cells JOIN m USING (v, f) GROUP BY ALL
), c AS (
  SELECT *, lead(x) OVER w AS above, sum(n) OVER w AS ln, sum(g) OVER w AS lg, sum(h) OVER w AS lh,
         sum(n) OVER a - sum(n) OVER w AS rn, sum(g) OVER a - sum(g) OVER w AS rg, sum(h) OVER a - sum(h) OVER w AS rh
  FROM g WINDOW w AS (PARTITION BY v, f, feature ORDER BY x ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY v, f, feature)
), e AS (
  SELECT v, f, feature, (x + above) / 2 AS edge, lg * lg / lh + rg * rg / rh - (lg + rg) * (lg + rg) / (lh + rh) AS gain
  FROM c WHERE above IS NOT NULL AND ln >= 20 AND rn >= 20
)
SELECT v, f, feature::INT AS feature, round(edge, 4) AS edge, round(gain, 4) AS gain FROM e
QUALIFY row_number() OVER (PARTITION BY v, f ORDER BY gain DESC, feature, edge) = 1""",
    "kmeans_invariants": f"""
WITH {DOC_LINES}
SELECT file, count(*) AS num_rows, greatest(1, floor(sqrt(count(*))))::INT AS num_clusters, true AS within, 0::BIGINT AS strays FROM lines GROUP BY file""",
    "survivor_files": neardup(
        DOC_LINES,
        [0.99],
        """SELECT 'd' || l.file[1] || '/' || l.file || '_deduplicated.txt' AS file, count(*) FILTER (g.group_id = l.line_no) AS n_lines,
  md5(string_agg(l.line, chr(10) ORDER BY l.line_no) FILTER (g.group_id = l.line_no)) AS digest
FROM lines l LEFT JOIN groups g ON g.file = l.file AND g.group_id = l.line_no
GROUP BY l.file HAVING count(*) > count(*) FILTER (g.group_id = l.line_no)""",
    ),
    "descent_recall": "SELECT count(*) AS n_rows, true AS nine_in_ten FROM embeddings WHERE embedding IS NOT NULL",
}
