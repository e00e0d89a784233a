import base64
import gzip
import hashlib
import zlib

import pytest

from counterpoise.llm import warc

SCHEMA = "page_id bigint, url string, html string, key string, digest int"


def rows_of():
    rows = [(i, f"http://h.example/{i}?q=a b\r\nX: y", f"<p>{i % 5} été</p>" * (1 + i % 5), "k", 1) for i in range(40)]
    rows += [(100, None, None, None, None), (101, "", "", "k", 1), (None, "u", "", "k", 1), (102, "u", "only\r\n\r\nhere", "k", 1)]
    rows += [(103, "u", "z" * 3_000_000, "k", 1), (104, "u", "z" * 3_000_000, "k", 1), (105, "u", "same row", "k", 1), (105, "u", "same row", "k", 1)]
    return rows


def wanted(rows, least=0):
    groups = {}
    for key, _, html, *_ in rows:
        groups.setdefault((html or "").encode(), []).append(key)
    out = []
    for body, keys in groups.items():
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        first = max(keys, key=lambda k: (k is not None, k))
        left = list(keys)
        if len(body) >= least:
            left.remove(first)
            out += [(k, len(body), digest, "revisit", first) for k in left]
            left = [first]
        out += [(k, len(body), digest, "response", None) for k in left]
    return sorted(out, key=repr)


def found(df):
    return sorted(map(tuple, df.select("key", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)


@pytest.mark.parametrize("least", [0, 30, 10**9])
def test_round_trip(spark, least):
    rows = rows_of()
    pages = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert found(warc.archive_and_read(pages, revisit_bytes=least)) == wanted(rows, least)


def test_members_stand_alone(spark, tmp_path):
    rows = rows_of()
    raw, done = str(tmp_path / "raw"), str(tmp_path / "done")
    pages = spark.createDataFrame(rows, SCHEMA).repartition(2)
    records = warc.write_archives(pages, raw, archive_bytes=4_000, archive_records=7).cache()
    assert records.groupBy("archive").count().agg({"count": "max"}).first()[0] <= 7
    archives = warc.normalise(warc.revisits(records), raw, done).cache()
    assert archives.agg({"records": "sum"}).first()[0] == len(rows)
    for name in [r.archive for r in archives.collect()]:
        whole = gzip.decompress(open(f"{done}/{name}", "rb").read())
        first = zlib.decompressobj(31)
        assert len(first.decompress(open(f"{done}/{name}", "rb").read())) <= len(whole)
        assert whole.count(b"WARC/1.1\r\n") == len(open(f"{done}/{name}.idx").readlines())
    back = warc.read_archives(archives, done, with_payload=True).collect()
    texts = {r.key: bytes(r.payload) for r in back if r.record_type == "response"}
    for key, _, html, *_ in rows:
        same = [texts[r.refers_to] if r.record_type == "revisit" else bytes(r.payload) for r in back if r.key == key]
        assert (html or "").encode() in same
    # an archive of several members is read like one stream
    plain = open(f"{done}/{name}", "rb").read()
    open(tmp_path / "again.warc.gz", "wb").write(plain)
    assert warc.normalise_file(str(tmp_path / "again.warc.gz"), str(tmp_path / "b" / "x.warc.gz"), {})[0] > 0


def test_damage_is_noticed(spark, tmp_path):
    open(tmp_path / "cut.warc.gz", "wb").write(gzip.compress(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc"))
    with pytest.raises(ValueError):
        warc.normalise_file(str(tmp_path / "cut.warc.gz"), str(tmp_path / "out.warc.gz"), {})


def test_empty_table(spark):
    assert warc.archive_and_read(spark.createDataFrame([], SCHEMA)).count() == 0
