"""WARC archives: monolithic gzip files rewritten record by record, with an offset index.

``write_archives`` packs rows into archives that are one gzip stream each, as
many crawlers leave them: nothing in such a file can be read without inflating
all before it. ``normalise`` inflates each file once, as a stream, and rewrites
every record as a gzip member of its own; beside the new file it writes an index
(a JSON line with offset and length for each record), so that any record can be
read by itself. On the way, records whose payload another record holds become
revisits of it. ``read_archives`` reads by the index.

Work is distributed by archive; archives are closed at a bounded size and number
of records, so a task holds one record's header and a fixed buffer, never a file.
Which record of equal payloads stays is decided on a narrow table of digests
(map-side combined; joined by ``lookup_join``, which salts hot digests), so the
payloads are not shuffled. Files are named by task attempt and only those that a
successful task reported are used, so retries and lost executors do no harm.

Defined results: a null payload is empty; of equal payloads of at least
``revisit_bytes`` bytes the record with the largest key is the response (null
keys count below all others, and of equal keys the last place wins); a null key
or address has no header line and is read back as null; keys of any kind come
back as they were (their header is percent-encoded), control characters in
addresses stay percent-encoded; very long payloads are written and read whole, one
record in memory at a time; an empty table gives no archives and no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from counterpoise.llm.common import shared_folder
from counterpoise.operators.lineage import write_down
from counterpoise.operators.lookup import lookup_join

ARCHIVE_BYTES = 64 << 20
ARCHIVE_RECORDS = 20_000
LEVEL = 6
REVISIT_BYTES = 0
NORMALISERS = 20_000
BUFFER = 1 << 20
DATE = "1970-01-01T00:00:00Z"

# Names of the file format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
KEY_HEADER = "X-Row-Key"
REFERS_HEADER = "X-Refers-To-Row-Key"


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder or file, for any store pyarrow knows."""
    if re.match(r"^file:/|^/", uri):
        return pafs.LocalFileSystem(), re.sub(r"^file:/+", "/", uri)
    return pafs.FileSystem.from_uri(uri)


def record_id(archive: str, ordinal: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{ordinal}')}>"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _head(fields: list[tuple[str, str | None]]) -> bytes:
    lines = [VERSION, *[f"{n}: {v}".encode() for n, v in fields if v is not None]]
    return b"\r\n".join(lines) + b"\r\n\r\n"


def _http_head(size: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()


class _ArchiveWriter:
    """One archive as a single gzip stream."""

    def __init__(self, folder: str, name: str):
        fs, path = _open(folder)
        fs.create_dir(path, recursive=True)
        self.name = name
        self.sink = fs.open_output_stream(f"{path}/{name}", compression=None)
        self.stream = gzip.GzipFile(fileobj=self.sink, mode="wb", compresslevel=LEVEL, mtime=0)
        self.bytes = self.records = 0

    def add(self, key: str | None, url: str | None, payload: bytes, digest: str) -> None:
        http = _http_head(len(payload))
        head = _head(
            [
                ("WARC-Type", "response"),
                ("WARC-Record-ID", record_id(self.name, self.records)),
                ("WARC-Date", DATE),
                ("WARC-Target-URI", None if url is None else quote(url, safe="!#$%&'()*+,/:;=?@[]~")),
                ("WARC-Payload-Digest", f"sha1:{digest}"),
                (KEY_HEADER, None if key is None else quote(key, safe="")),
                ("Content-Type", "application/http;msgtype=response"),
                ("Content-Length", str(len(http) + len(payload))),
            ]
        )
        for part in (head, http, payload, b"\r\n\r\n"):
            self.stream.write(part)
        self.bytes += len(head) + len(http) + len(payload) + 4
        self.records += 1

    def close(self) -> None:
        self.stream.close()
        self.sink.close()


def write_archives(
    pages: DataFrame,
    folder: str,
    key: str = "page_id",
    url: str = "url",
    payload: str = "html",
    archive_bytes: int = ARCHIVE_BYTES,
    archive_records: int = ARCHIVE_RECORDS,
) -> DataFrame:
    """Writes a response record for each row; returns (archive, ordinal, key, bytes, digest) of each.

    The result has to be written down once: running it again writes new files.
    """
    kind = pages.schema[key].dataType.simpleString()
    rows = pages.select(
        F.col(f"`{key}`").alias("key"),
        F.col(f"`{key}`").cast("string").alias("name"),
        F.col(f"`{url}`").cast("string").alias("url"),
        F.col(f"`{payload}`").cast("binary").alias("payload"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        stem = f"{task.partitionId():06d}-{task.taskAttemptId()}"
        writer, n = None, 0
        for batch in batches:
            places = []
            columns = (batch.column(c) for c in ("name", "url", "payload"))
            for name, address, body in zip(*columns):
                if writer is None:
                    writer = _ArchiveWriter(folder, f"{stem}-{n:05d}.warc.gz")
                    n += 1
                content = body.as_py() or b""
                digest = payload_digest(content)
                places.append((writer.name, writer.records, len(content), digest))
                writer.add(name.as_py(), address.as_py(), content, digest)
                if writer.bytes >= archive_bytes or writer.records >= archive_records:
                    writer.close()
                    writer = None
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
            lists = [pa.array(list(x), t) for x, t in zip(zip(*places), kinds)] if places else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays([batch.column("key"), *lists], ["key", "archive", "ordinal", "bytes", "digest"])
        if writer is not None:
            writer.close()

    return rows.mapInArrow(run, f"key {kind}, archive string, ordinal bigint, bytes bigint, digest string")


def revisits(records: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """``records`` with ``first``: the response that a revisit refers to, else null."""
    order = F.struct(F.col("key").isNotNull().alias("named"), "key", "archive", "ordinal")
    shared = records.filter(F.col("bytes") >= revisit_bytes).groupBy("digest")
    shared = shared.agg(F.max(order).alias("first"), F.count(F.lit(1)).alias("_rows")).filter("_rows > 1")
    held = write_down(shared)
    firsts = write_down(held.df.select("digest", "first"))
    joined = lookup_join(records, firsts, ["digest"], "left", rows_per_key=held.df.select("digest", "_rows"))
    own = (F.col("first.archive") == F.col("archive")) & (F.col("first.ordinal") == F.col("ordinal"))
    small = F.col("bytes") < revisit_bytes
    return joined.withColumn("first", F.when(~(own | small), F.col("first")))


class _Inflated:
    """Forward reader of a gzip file of one or more members, with a bounded buffer."""

    def __init__(self, source):
        self.source, self.held, self.engine, self.over = source, bytearray(), zlib.decompressobj(31), False

    def _more(self) -> bool:
        while not self.over:
            if self.engine.eof:
                raw = self.engine.unused_data or self.source.read(BUFFER)
                if not raw:
                    self.over = True
                    break
                self.engine = zlib.decompressobj(31)
            else:
                raw = self.engine.unconsumed_tail or self.source.read(BUFFER)
            piece = self.engine.decompress(raw, BUFFER)  # without input: what it still holds
            if piece:
                self.held += piece
                return True
            if not raw and not self.engine.eof:
                raise ValueError("the archive ends inside a gzip stream")
        return False

    def head(self) -> bytes | None:
        """Bytes up to and with the next empty line; none at the end."""
        seen = 0
        while (at := self.held.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(self.held)
            if not self._more():
                if self.held.strip():
                    raise ValueError("the archive ends inside a header")
                return None
        out = bytes(self.held[: at + 4])
        del self.held[: at + 4]
        return out

    def pieces(self, size: int) -> Iterator[bytes]:
        while size:
            if not self.held and not self._more():
                raise ValueError("the archive ends inside a record")
            out = bytes(self.held[:size])
            del self.held[: len(out)]
            size -= len(out)
            yield out


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return dict(line.split(": ", 1) for line in lines[1:] if line)


def _key(fields: dict[str, str], name: str) -> str | None:
    """A row's key out of its header, where it is percent-encoded."""
    return unquote(fields[name]) if name in fields else None


def _length_of(http: bytes) -> int:
    found = re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)
    if found is None:
        raise ValueError("an HTTP head without a length")
    return int(found[1])


def normalise_file(source: str, target: str, revisit: dict[int, tuple[str, str]]) -> tuple[int, int]:
    """Rewrites one archive; ``revisit`` maps places of records to (record id, key) they refer to.

    Returns (records, bytes written). The index is ``target`` + ``.idx``.
    """
    fs, path = _open(source)
    out_fs, out_path = _open(target)
    out_fs.create_dir(out_path.rpartition("/")[0], recursive=True)
    offset = ordinal = 0
    with fs.open_input_stream(path, compression=None) as raw, out_fs.open_output_stream(out_path, compression=None) as sink, out_fs.open_output_stream(f"{out_path}.idx", compression=None) as index:
        stream = _Inflated(raw)
        while (head := stream.head()) is not None:
            fields = parse_head(head)
            size = int(fields["Content-Length"])
            member = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
            written = 0

            def put(data: bytes) -> None:
                nonlocal written
                packed = member.compress(data)
                sink.write(packed)
                written += len(packed)

            if ordinal in revisit:
                first, first_key = revisit[ordinal]
                http = stream.head() or b""
                for _ in stream.pieces(size - len(http)):
                    pass
                changed = {"WARC-Type": "revisit", "Content-Length": str(len(http)), "WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": first}
                fields |= changed | ({REFERS_HEADER: quote(first_key, safe="")} if first_key is not None else {})
                put(_head(list(fields.items())) + http)
            else:
                put(head)
                for piece in stream.pieces(size):
                    put(piece)
            for _ in stream.pieces(4):
                pass
            put(b"\r\n\r\n")
            packed = member.flush()
            sink.write(packed)
            written += len(packed)
            line = {"offset": offset, "length": written, "type": fields["WARC-Type"], "id": fields["WARC-Record-ID"]}
            line |= {"digest": fields.get("WARC-Payload-Digest"), "key": _key(fields, KEY_HEADER)}
            index.write(json.dumps(line).encode() + b"\n")
            offset += written
            ordinal += 1
    return ordinal, offset


def normalise(records: DataFrame, source: str, target: str) -> DataFrame:
    """(archive, records, bytes) of every rewritten archive.

    ``records`` is (archive, ordinal, first) as from :func:`revisits`; the rows
    of one archive are bounded by the writer. To be written down once.
    """
    rows = records.select("archive", "ordinal", "first.archive", "first.ordinal", F.col("first.key").cast("string").alias("first_key"))
    rows = rows.toDF("archive", "ordinal", "first_archive", "first_ordinal", "first_key")

    def run(table: pa.Table) -> pa.Table:
        name = table.column("archive")[0].as_py()
        decided = {}
        for row in table.filter(pc.is_valid(table.column("first_archive"))).to_pylist():
            decided[row["ordinal"]] = (record_id(row["first_archive"], row["first_ordinal"]), row["first_key"])
        attempt = TaskContext.get().taskAttemptId()
        new = f"{attempt}/{name}"
        count, size = normalise_file(f"{source}/{name}", f"{target}/{new}", decided)
        if count != table.num_rows:
            raise ValueError(f"{name} holds {count} records, not {table.num_rows}")
        return pa.table({"archive": [new], "records": [count], "bytes": [size]})

    # the rows are narrow, the archives behind them are not: partitions by their number, not by the bytes of the rows
    archives = max(1, records.select("archive").distinct().count())
    spread = rows.repartition(min(2 * archives, NORMALISERS), "archive")
    return spread.groupBy("archive").applyInArrow(run, "archive string, records bigint, bytes bigint")


def read_record(file, offset: int, length: int) -> tuple[dict[str, str], bytes, bytes]:
    """(header fields, HTTP head, payload) of the record at a place of the index."""
    file.seek(offset)
    data = zlib.decompress(file.read(length), 31)
    cut = data.index(b"\r\n\r\n") + 4
    fields = parse_head(data[:cut])
    block = data[cut : cut + int(fields["Content-Length"])]
    body = block.index(b"\r\n\r\n") + 4
    return fields, block[:body], block[body:]


def read_archives(archives: DataFrame, folder: str, key_type: str = "bigint", with_payload: bool = False) -> DataFrame:
    """One row for each record, read member by member through the index.

    (key, url, record_type, refers_to, payload_bytes, payload_digest[, payload]);
    a response whose payload does not have its digest raises an error. A
    revisit has no payload here: that of ``refers_to`` is its own.
    """
    body = ", payload binary" if with_payload else ""
    schema = f"key string, url string, record_type string, refers_to string, payload_bytes bigint, payload_digest string{body}"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                fs, path = _open(f"{folder}/{name}")
                with fs.open_input_stream(f"{path}.idx", compression=None) as index, fs.open_input_file(path) as file:
                    rows, held = [], 0
                    for line in index.read().splitlines():
                        place = json.loads(line)
                        fields, http, payload = read_record(file, place["offset"], place["length"])
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        kind = fields["WARC-Type"]
                        if kind == "response" and (payload_digest(payload) != digest or len(payload) != _length_of(http)):
                            raise ValueError(f"{fields['WARC-Record-ID']} is damaged")
                        row = [_key(fields, KEY_HEADER), fields.get("WARC-Target-URI"), kind, _key(fields, REFERS_HEADER), _length_of(http), digest]
                        rows.append([*row, payload if kind == "response" else None] if with_payload else row)
                        held += len(payload) if with_payload else 100
                        if held > BUFFER:
                            yield _batch(rows, names)
                            rows, held = [], 0
                    if rows:
                        yield _batch(rows, names)

    found = archives.select("archive").mapInArrow(run, schema)
    return found.withColumn("key", F.col("key").cast(key_type)).withColumn("refers_to", F.col("refers_to").cast(key_type))


def _batch(rows: list[list], names: list[str]) -> pa.RecordBatch:
    kinds = {"payload_bytes": pa.int64(), "payload": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.string())) for n, c in zip(names, zip(*rows))], names)


def archive_and_read(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Writes all rows to archives, normalises them, and reads the records back."""
    spark = pages.sparkSession
    raw, done = shared_folder(spark, "warc-raw"), shared_folder(spark, "warc")
    records = write_down(write_archives(pages, raw, key, url, payload)).df
    archives = write_down(normalise(revisits(records, revisit_bytes), raw, done))
    files = max(1, archives.rows)
    spread = archives.df.repartition(min(files, 8 * spark.sparkContext.defaultParallelism + files // 8), "archive")
    return read_archives(spread, done, pages.schema[key].dataType.simpleString())
