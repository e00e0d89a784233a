import itertools
import zlib

import numpy as np
import pytest

from counterpoise.llm import hilbert

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, shard int, curve string"


@pytest.mark.parametrize("bits, dims", [(1, 1), (3, 1), (1, 2), (3, 2), (2, 3), (3, 3), (1, 4), (2, 5)])
def test_curve_visits_every_cell_by_single_steps(bits, dims):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    place = hilbert.curve_index(cells, bits)
    assert sorted(place) == list(range(len(cells)))
    path = cells[np.argsort(place)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def _docs(spark, n=1_003):
    rows = [(i, f"text {i % 90} " * (1 + i % 17), ["de", "en", "fr", None][i % 4], f"src{i % 9}" if i % 3 else "src0", (i * 37) % 500, 1, "x") for i in range(n)]
    rows += [(None, None, None, None, None, None, None), (5, "", "en", "src1", 0, 1, "x"), (5, "", "en", "src1", 0, 1, "x"), (6, "é" * 300_000, "en", "src1", 1, 1, "x")]
    return spark.createDataFrame(rows, SCHEMA), rows


@pytest.mark.parametrize("shards", [16, 5, 2_000])
def test_law_of_rows(spark, shards):
    docs, rows = _docs(spark)
    out = hilbert.shard(docs.repartition(7), ["lang", "source", "n_chars"], shards).collect()
    assert len(out) == len(rows)
    sizes = {}
    for r in out:
        sizes.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(slots) == list(range(len(slots))) for slots in sizes.values())
    counts = [len(sizes.get(s, [])) for s in range(shards)]
    assert max(counts) - min(counts) <= 1 and set(sizes) <= set(range(shards))
    wanted = sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows), key=repr)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in out), key=repr) == wanted
    curve = [r.curve for r in sorted(out, key=lambda r: (r.shard, r.slot))]
    assert curve == sorted(curve)


def test_written_shards_prune(spark, tmp_path):
    docs, rows = _docs(spark)
    manifest = hilbert.write_shards(docs, ["lang", "source", "n_chars"], str(tmp_path / "s")).cache()
    assert manifest.agg({"rows": "sum"}).first()[0] == len(rows)
    back = spark.read.parquet(str(tmp_path / "s")).select("row.*")
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(rows, key=repr)
    near = {r.shard for r in hilbert.shards_meeting(manifest, "n_chars", 0, 30).collect()}
    held = {r.shard for r in spark.read.parquet(str(tmp_path / "s")).filter("row.n_chars BETWEEN 0 AND 30").select("shard").distinct().collect()}
    assert held <= near and len(near) < 16
    few = {r.shard for r in hilbert.shards_meeting(manifest, "lang", "de", "de").collect()}
    assert len(few) < 16


def test_empty_table(spark):
    docs, _ = _docs(spark)
    assert hilbert.shard(docs.limit(0), ["lang", "n_chars"]).count() == 0


def test_cells_are_quantiles_of_the_values_themselves(spark):
    prefix = "https://www.example.org/a/b/c/"
    rows = [(prefix + f"{i:05d}", float(i % 100), bytes([7, i % 256])) for i in range(4_000)] + [(None, None, None)] * 3
    df = spark.createDataFrame(rows, "url string, x double, b binary")
    urls, numbers, raw = hilbert.quantile_edges(df, ["url", "x", "b"], 3)
    assert urls == [prefix + f"{500 * k:05d}" for k in range(1, 8)] and len(raw) == 7 and len(numbers) == 7
    out = df.select("url", hilbert.curve_column(df, ["url"], 3).alias("c")).collect()
    for r in out:
        assert r.c == (0 if r.url is None else sum(e <= r.url for e in urls))
    common = spark.createDataFrame([("same",)] * 900 + [("a",)] * 50 + [("z",)] * 50, "t string")
    assert hilbert.quantile_edges(common, ["t"], 4) == [["z"] * 15] and hilbert.quantile_edges(common.limit(0), ["t"], 4) == [[]]


def test_addresses_with_a_common_beginning_prune(spark, tmp_path):
    rows = [(i, "t", f"https://www.example.org/path/to/{(i * 7919) % 3000:06d}", i % 50) for i in range(3_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, url string, n int")
    manifest = hilbert.write_shards(df, ["url", "n"], str(tmp_path / "u"))
    low, high = "https://www.example.org/path/to/000100", "https://www.example.org/path/to/000200"
    assert hilbert.shards_meeting(manifest, "url", low, high).count() <= 6
