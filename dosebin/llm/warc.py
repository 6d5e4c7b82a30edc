"""Web archives with a two-level capture index.

Pages become WARC records, each a gzip member of its own.  Of pages with equal payloads the one
with the largest id holds the payload; the others are revisits that refer to it.

Captures are sorted by their URL with the host's labels reversed.  Lines of the sorted index are
cut into compressed blocks; a directory holds the first key and place of every block.  A
lookup searches the directory, then the block, and reads the record's bytes alone.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files

BLOCK_LINES = 1000
DATE = "2000-01-01T00:00:00Z"
# Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE_URN = "urn:page:"
CAPTURE = "key string, page_id long, file string, at long, bytes long"
SHARD = "part int, file string, first_key string, first_page long, n long"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, intact boolean"


class Archive(NamedTuple):
    """A written archive: its captures (a row each) and its index shards (a row each)."""

    folder: str
    captures: DataFrame
    shards: DataFrame


def reversed_key(url: str | None) -> str:
    """Sort key: host labels from the last to the first, then path and query.

    Scheme, user, default port, fragment and letter case of the host are left out.  Null and
    texts without a host sort by the text itself.
    """
    text = (url or "").strip()
    try:
        u = urlsplit(text)
        host, port = u.hostname or "", u.port
    except ValueError:
        return text
    if not host:
        return text
    tail = "" if port in (None, 80, 443) else f":{port}"
    return ",".join(reversed(host.split("."))) + f"{tail}){u.path or '/'}" + (f"?{u.query}" if u.query else "")


def _safe(text: str) -> str:
    return "".join(c if " " < c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in text)


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def make_record(page_id: int | None, url: str | None, payload: bytes, revisit: bool, refers_to: int | None) -> bytes:
    """A WARC/1.1 record as a gzip member."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = head if revisit else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{PAGE_URN}{'' if page_id is None else page_id}>"]
    lines += [f"WARC-Date: {DATE}"] + ([] if url is None else [f"WARC-Target-URI: {_safe(url)}"])
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{PAGE_URN}{refers_to}>"]
    lines += [f"WARC-Payload-Digest: sha1:{_digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n", 6, mtime=0)


def parse_record(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Record headers, HTTP headers and payload of a gzip member."""

    def fields(data: bytes) -> dict[str, str]:
        pairs = (line.partition(":") for line in data.decode().split("\r\n")[1:])
        return {k.strip(): v.strip() for k, _, v in pairs}

    head, _, rest = gzip.decompress(member).partition(b"\r\n\r\n")
    warc = fields(head)
    http, _, payload = rest[: int(warc["Content-Length"])].partition(b"\r\n\r\n")
    return warc, fields(http), payload


def write_archive(
    pages: DataFrame,
    folder: str | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    block_lines: int = BLOCK_LINES,
) -> Archive:
    """Write a record per row of ``pages`` and the capture index.

    A null page is an empty payload; empty payloads are equal to each other.  Rows that repeat the largest
    id of their payload are responses too; a null id counts as smaller than any.  A null URL has no target header.
    An empty table gives an archive without files.
    """
    spark = pages.sparkSession
    folder = folder or files.new_folder(spark, "warc")
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"),
    ).withColumn("sha1", F.sha1("html"))
    # Only digests go through the shuffles that find copies; html moves at most once, by page id.
    light = rows.select("page_id", "sha1")
    last = light.groupBy("sha1").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = light.join(last, "sha1").where(~F.col("page_id").eqNullSafe(F.col("last")))
    again = files.written(again.distinct(), folder, "revisits")
    some = again.select(F.col("page_id").alias("__p"), F.col("sha1").alias("__s"), "last")
    whole = rows.join(some, F.col("page_id").eqNullSafe(F.col("__p")) & (F.col("sha1") == F.col("__s")), "left")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at, path = None, 0, ""
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                done = []
                for page, url, html, revisit, refers in zip(*(c.to_pylist() for c in batch.slice(i, 256).columns)):
                    if out is None:
                        path = f"{folder}/archive/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
                        out = files.create(path)
                    member = make_record(page, url, html.encode(), revisit, refers)
                    out.write(member)
                    done.append((reversed_key(url), page, path, at, len(member)))
                    at += len(member)
                yield _batch(done, CAPTURE)
        if out is not None:
            out.close()

    made = whole.select("page_id", "url", "html", F.col("__s").isNotNull().alias("revisit"), "last").mapInArrow(write, CAPTURE)
    captures = files.written(made, folder, "captures")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, lines, directory, at, n, path, first = None, [], [], 0, 0, "", None

        def flush():
            nonlocal at, lines
            block = zlib.compress("\n".join(json.dumps(x) for x in lines).encode(), 6)
            out.write(block)
            directory.append([lines[0][0], lines[0][1], at, len(block)])
            at, lines = at + len(block), []

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    path = f"{folder}/index/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
                    out, first = files.create(f"{path}.blocks"), row
                lines.append(row)
                n += 1
                if len(lines) == block_lines:
                    flush()
        if out is None:
            return
        if lines:
            flush()
        out.close()
        with files.create(f"{path}.directory") as f:
            f.write(json.dumps(directory).encode())
        yield _batch([(TaskContext.get().partitionId(), path, first[0], first[1], n)], SHARD)

    ordered = captures.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id")
    return Archive(folder, captures, files.written(ordered.mapInArrow(index, SHARD), folder, "shards"))


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    fields = [x.split(" ") for x in schema.split(", ")]
    columns = zip(*rows) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], [n for n, _ in fields])


def open_archive(spark: SparkSession, folder: str) -> Archive:
    """An archive written earlier."""
    return Archive(folder, *(spark.read.schema(s).parquet(f"{folder}/{n}") for n, s in (("captures", CAPTURE), ("shards", SHARD))))


def _order(key: str, page: int | None) -> tuple[bytes, int]:
    return key.encode(), -(1 << 63) - 1 if page is None else page


def lookup(archive: Archive, wanted: DataFrame, url_col: str = "url", id_col: str = "page_id") -> DataFrame:
    """Captures of the wanted (URL, page id) pairs, each once: CAPTURE columns.

    Pairs go to the index shard whose range may hold them (a binary search over the shards' first
    keys, one row per shard), there to a block by binary search in the shard's directory.
    Pairs that were not archived give no row.
    """
    spark = wanted.sparkSession
    # One row per index shard, of which there are as many as partitions wrote it.
    shards = sorted((_order(r["first_key"], r["first_page"]), r["file"]) for r in archive.shards.collect())
    sent = spark.sparkContext.broadcast(shards)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = [s for s, _ in sent.value]
        for batch in batches:
            rows = []
            for url, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                key = reversed_key(url)
                mine = _order(key, page)
                rows.append((key, page, max(0, bisect_right(starts, mine) - 1)))
            yield _batch(rows, "key string, page_id long, shard int")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, directory, starts, blocks, at, lines, orders = -1, [], [], None, -1, [], []
        for batch in batches:
            found = []
            for key, page, s in zip(*(c.to_pylist() for c in batch.columns)):
                if s != shard:
                    shard, at, file = s, -1, sent.value[s][1]
                    directory = json.loads(files.open_file(f"{file}.directory").read())
                    starts = [_order(d[0], d[1]) for d in directory]
                    blocks = files.open_file(f"{file}.blocks")
                mine = _order(key, page)
                b = max(0, bisect_left(starts, mine) - 1)  # equal keys may begin in the block before
                while b < len(directory) and starts[b] <= mine:
                    if b != at:
                        blocks.seek(directory[b][2])
                        lines = [json.loads(x) for x in zlib.decompress(blocks.read(directory[b][3])).decode().split("\n")]
                        orders, at = [_order(x[0], x[1]) for x in lines], b
                    found += lines[bisect_left(orders, mine) : bisect_right(orders, mine)]
                    b += 1
            yield _batch(found, CAPTURE)

    if not shards:
        return spark.createDataFrame([], CAPTURE)
    placed = wanted.select(F.col(url_col).cast("string"), F.col(id_col).cast("long")).distinct().mapInArrow(place, "key string, page_id long, shard int")
    return placed.distinct().repartition("shard").sortWithinPartitions("shard", "key", "page_id").mapInArrow(search, CAPTURE)


def read_records(captures: DataFrame, with_payload: bool = False) -> DataFrame:
    """Records of captures by range reads: RECORD columns and, if asked for, ``payload`` (null for revisits).

    ``intact`` says that the payload, where the record has one, has the digest and length it states.
    """
    schema = RECORD + ", payload binary" * with_payload

    def page_of(urn: str) -> int | None:
        text = urn.strip("<>").removeprefix(PAGE_URN)
        return int(text) if text else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                rows, payloads = [], []
                for path, at, size in zip(*(c.to_pylist() for c in batch.slice(i, 256).columns)):
                    if path != name:
                        name, file = path, files.open_file(path)
                    file.seek(at)
                    warc, http, payload = parse_record(file.read(size))
                    revisit = warc["WARC-Type"] == "revisit"
                    digest, length = warc["WARC-Payload-Digest"].removeprefix("sha1:"), int(http["Content-Length"])
                    refers = page_of(warc["WARC-Refers-To"]) if revisit else None
                    intact = revisit or (len(payload) == length and _digest(payload) == digest)
                    rows.append((page_of(warc["WARC-Record-ID"]), warc.get("WARC-Target-URI"), warc["WARC-Type"], refers, length, digest, intact))
                    payloads.append(None if revisit else payload)
                out = _batch(rows, RECORD)
                if with_payload:
                    out = pa.RecordBatch.from_arrays([*out.columns, pa.array(payloads, pa.binary())], [*out.schema.names, "payload"])
                yield out

    placed = captures.select("file", "at", "bytes").repartition("file").sortWithinPartitions("file", "at")
    return placed.mapInArrow(read, schema)
