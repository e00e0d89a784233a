import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from counterpoise.llm import langid

SYLLABLES = {"aa": ["ka", "ra", "tu", "mi"], "bb": ["sch", "ei", "ung", "er"], "cc": ["éle", "ça", "ou", "tre"]}


def sentence(lang, rng, n=30):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(3)) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    rows = []
    for i in range(600):
        lang = list(SYLLABLES)[i % 3]
        rows.append((i, sentence(lang, rng), lang.upper() + "-X", f"h{i % 7}", lang))
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, truth string")


def test_runs_do_not_cross_texts():
    texts = ["abc", "de", "", None, "ABC", "1 2", "x y", "é"]
    runs, first = langid.letter_runs(pa.array(texts))
    assert list(np.diff(first)) == [3, 2, 0, 0, 3, 0, 0, 2]
    for i, text in enumerate(texts):
        assert langid.letter_runs(pa.array([text], pa.string()))[0].tolist() == runs[first[i] : first[i + 1]].tolist()
    alone = [langid.letter_runs(pa.array([t]))[0].tolist() for t in ["abc def", "ABC def"]]
    assert alone[0] == alone[1]


def test_held_out_accuracy(spark, corpus):
    model = langid.fit_text(corpus.filter("doc_id < 300"), label="truth")
    assert model.languages == ("aa", "bb", "cc")
    rows = langid.identify(corpus.filter("doc_id >= 300"), model, carry=["truth"]).collect()
    assert len(rows) == 300 and all(r.language == r.row.truth and r.kept for r in rows)


def test_evidence_is_fused_as_by_hand(spark, corpus):
    model = langid.fit_text(corpus, label="truth")
    rows = corpus.withColumn("suffix", F.concat(F.lit("s"), F.col("truth")))
    out = {r.row.doc_id: r for r in langid.identify(rows, model, declared="lang", host="source", suffix="suffix", carry=["doc_id"]).collect()}
    data = rows.collect()
    logs, count = model.likelihoods(pa.array([r.text for r in data]), langid.EVIDENCE_RUNS)
    soft = np.exp(logs - logs.max(axis=1, keepdims=True))
    soft /= soft.sum(axis=1, keepdims=True)
    said = np.array([langid_index(r.lang) for r in data])
    table = np.array([soft[said == d].sum(axis=0) for d in range(3)])
    base = (soft.sum(axis=0) + 1) / (soft.sum() + 3)
    by_suffix, by_host = {}, {}
    for r, p in zip(data, soft):
        by_suffix[r.suffix] = by_suffix.get(r.suffix, 0) + p
        by_host.setdefault(r.source, [0, ""])
        by_host[r.source] = [by_host[r.source][0] + p, max(by_host[r.source][1], r.suffix)]
    for i, r in enumerate(data):
        counts, suffix = by_host[r.source]
        above = by_suffix[suffix]
        above = (above + langid.SUFFIX_STRENGTH * base) / (above.sum() + langid.SUFFIX_STRENGTH)
        prior = (counts + langid.HOST_STRENGTH * above) / (counts.sum() + langid.HOST_STRENGTH)
        told = np.log((table[said[i]] + 1) / (table.sum(axis=0) + 4))
        total = logs[i] + np.log(prior) + told
        chance = np.exp(total - total.max())
        assert out[r.doc_id].posterior == pytest.approx((chance / chance.sum()).max(), abs=1e-9)
    assert count.min() > 0


def langid_index(tag):
    return ["aa", "bb", "cc"].index(tag[:2].lower())


def test_priors_decide_short_texts(spark, corpus):
    model = langid.fit_text(corpus, label="truth")
    short = spark.createDataFrame([(9000, "xq", "bb", "h0", "bb"), (9001, "xq", "zz", None, "")], corpus.schema)
    big = corpus.withColumn("source", F.concat(F.lit("host-"), F.col("truth")))
    rows = langid.identify(big.unionByName(short.withColumn("source", F.when(F.col("doc_id") == 9000, "host-cc"))), model, declared="lang", host="source", carry=["doc_id"]).collect()
    found = {r.row.doc_id: r for r in rows}
    assert found[9000].language == "bb" and found[9001].language in model.languages


def test_defined_results(spark, corpus):
    model = langid.fit_text(corpus, label="truth")
    odd = spark.createDataFrame(
        [(None, None, None, None, "x"), (1, "", "", "", "x"), (1, "12 !!", "aa", "h", "x"), (2, "karatumi " * 50_000, None, None, "x")] * 2,
        "doc_id bigint, text string, lang string, source string, language string",
    )
    rows = langid.identify(odd, model, declared="lang", host="source", carry=odd.columns).collect()
    assert len(rows) == 8
    assert sorted(r.language for r in rows) == ["aa"] * 2 + ["und"] * 6
    assert [r.kept for r in rows] == [r.language == "aa" for r in rows]
    assert langid.identify(odd.limit(0), model, declared="lang", host="source").count() == 0
    nothing = langid.fit_text(odd.limit(0))
    assert nothing.languages == () and {r.language for r in langid.identify(odd, nothing).collect()} == {"und"}
    refused = langid.identify(corpus, model, accepted=["aa"], carry=["truth"]).filter("kept").collect()
    assert {r.row.truth for r in refused} == {"aa"}


def test_addresses(spark):
    df = spark.createDataFrame([("https://u@www.Site.example.DE:80/x?y",), ("nonsense",), (None,)], "url string")
    rows = df.select(langid.host_of(F.col("url")).alias("h")).select("h", langid.suffix_of(F.col("h")).alias("s")).collect()
    assert [tuple(r) for r in rows] == [("site.example.de", "de"), (None, None), (None, None)]
    tag = spark.createDataFrame([("<!doctype html><HTML class=a LANG='pt-BR'>",), ("<p lang=x>",)], "html string")
    assert [r[0] for r in tag.select(langid.primary_tag(langid.markup_language(F.col("html")))).collect()] == ["pt", None]


def many_languages(spark, count, each):
    rng = random.Random(9)
    rows = []
    for k in range(count):
        tag = "q" + chr(97 + k // 26) + chr(97 + k % 26)
        own = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3)) for _ in range(12)]
        rows += [(len(rows) + i, " ".join(rng.choice(own) + rng.choice(own) for _ in range(60)), tag, "h") for i in range(each)]
    rows += [(-1, "a single row of its own", "junk", "h")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")


def test_all_labels_are_languages(spark):
    docs = many_languages(spark, 80, 4)
    model = langid.fit_text(docs)
    assert len(model.languages) == 80 and model.left_out == {"junk": 1}
    rows = langid.identify(docs.filter("doc_id >= 0"), model, declared="lang", host="source", carry=["lang"]).collect()
    assert len(rows) == 320 and all(r.language == r.text_language == r.row.lang for r in rows)
    assert "junk" in langid.fit_text(docs, min_rows=1).languages


def test_asked_for_languages_do_not_vanish(spark):
    docs = many_languages(spark, 80, 4)
    model = langid.fit_text(docs, languages=["qdb", "junk", "zz"])
    assert model.languages == ("junk", "qdb") and model.left_out == {"zz": 0}


def test_gibberish_and_unknown_languages_are_not_kept(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz"
    planted = [" ".join("".join(rng.choice(letters) for _ in range(rng.randint(3, 9))) for _ in range(n)) for n in (8, 60, 900)]
    planted += [
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.",
        "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью.",
        "for (int i = 0; i < n; ++i) { if (buf[i] != NULL && strncmp(buf[i], key, len) == 0) return idx; } void *ptr = malloc(sizeof(struct node));",
    ]
    odd = spark.createDataFrame([(-1 - i, t, lang, "web") for i, t in enumerate(planted) for lang in ("en", None)], "doc_id bigint, text string, lang string, source string")
    model = langid.fit_text(docs)
    rows = langid.identify(docs.select(odd.columns).unionByName(odd), model, declared="lang", host="source", carry=["doc_id", "text"]).collect()
    assert not [r.row.text for r in rows if r.row.doc_id < 0 and r.kept]
    clean = [r for r in rows if r.row.doc_id >= 0 and langid.letter_runs(pa.array([r.row.text], pa.string()))[0].size]
    assert len(clean) > 100 and all(r.kept for r in clean)


def test_every_labelled_document_counts(spark):
    # 4,100 short texts of one language; one run of letters stands in a single one of them
    def text(i):
        return "qxz" if i == odd else "kara tumi raka"

    odd = spark.range(4_100).select(F.max_by("id", F.xxhash64(F.col("id"), F.lit(langid.SEED)))).first()[0]
    docs = spark.createDataFrame([(i, text(i), "aa") for i in range(4_100)], "doc_id bigint, text string, lang string")
    model = langid.fit_text(docs)
    bucket = langid.letter_runs(pa.array(["qxz"]))[0]
    unseen = model.logs.min()
    assert (model.logs[bucket, 0] > unseen).all()


def test_floors_are_exact_quantiles(spark):
    rng = np.random.default_rng(3)
    lang, runs = rng.integers(0, 3, 3_000), rng.integers(1, 1_500, 3_000)
    mean = -10 + np.round(rng.random(3_000), 5)  # with ties
    runs[lang == 2] = np.minimum(runs[lang == 2], 60)
    rows = [(int(a), int(b), float(c)) for a, b, c in zip(lang, runs, mean)]
    floors = langid.floors_of(spark.createDataFrame(rows, "lang int, runs bigint, mean double"), 4)
    for i in range(4):
        above = -np.log(1 << langid.BUCKET_BITS)
        for k, least in enumerate(langid.LENGTHS):
            of = mean[(lang == i) & (runs >= least)]
            if len(of) >= langid.FLOOR_ROWS:
                low, middle = np.quantile(of, [langid.BELOW_FLOOR, 0.5], method="lower")
                above = middle + langid.BEYOND * (low - middle)
            assert floors[k, i] == above
