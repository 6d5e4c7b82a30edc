"""Archives: round trip of payloads, revisits, and the capture index."""

import base64
import gzip
import hashlib

import pytest

from dosebin.llm import files, queries, warc

PAGES = "page_id long, url string, html string, key string, bytes long"


def expected(pages):
    last = {}
    for i, _, html in pages:
        k = html or ""
        last[k] = max(last.get(k, -1), -1 if i is None else i)
    out = []
    for i, _, html in pages:
        data, top = (html or "").encode(), last[html or ""]
        first = i == top or (i is None and top == -1)
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if first else "revisit", None if first else top))
    return sorted(out, key=str)


def test_op10(spark, folder, table):
    pages = [(p["page_id"], p["url"], p["html"]) for p in table("pages")]
    got = queries.op10_warc(spark, folder)
    assert got.where("not intact").count() == 0
    assert sorted((tuple(r)[:5] for r in got.collect()), key=str) == expected(pages)


@pytest.fixture(scope="module")
def pages():
    same = "<p>same</p>" * 50
    return (
        [(i, f"http://www.b.example.com/p{i % 7}?x={i}", same) for i in range(40)]
        + [(i, "https://hot.example.org/", f"<b>{i} é漢</b>") for i in range(100, 160)]
        + [(200, None, None), (201, "no host", ""), (202, "http://[bad", ""), (None, "http://x.y/", "alone"), (203, "http://X.Y:8080/a b\r\n#f", "z" * 300_000)]
        + [(300, "http://twice.example/", "twice")] * 3
    )


def test_archive_of_odd_pages(spark, pages):
    rows = spark.createDataFrame([(*p, "clash", 3) for p in pages], PAGES).repartition(4)
    archive = warc.write_archive(rows, block_lines=10)
    again = warc.open_archive(spark, archive.folder)
    assert again.captures.count() == len(pages)
    records = warc.read_records(warc.lookup(again, rows), with_payload=True).collect()
    assert all(r.intact for r in records)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in records), key=str) == expected(pages)
    html = {p[0]: (p[2] or "").encode() for p in pages}
    assert all(bytes(r.payload) == html[r.page_id] for r in records if r.record_type == "response")
    # Each record is a gzip member of its own, so a whole file is one valid gzip stream.
    name = archive.captures.first()["file"]
    assert gzip.decompress(files.open_file(name).read()).startswith(b"WARC/1.1\r\n")


def test_lookup_finds_what_is_there(spark, pages):
    rows = spark.createDataFrame([(*p, "clash", 3) for p in pages], PAGES)
    archive = warc.write_archive(rows, block_lines=3)
    asked = [("https://HOT.example.org", 130), ("https://hot.example.org/", 99), ("http://twice.example/", 300), ("http://zz.zz/", 1), (None, 200)]
    found = warc.lookup(archive, spark.createDataFrame(asked * 2, "url string, page_id long"))
    assert sorted(r.page_id for r in found.collect()) == [130, 200, 300, 300, 300]


def test_empty_table(spark):
    none = spark.createDataFrame([], PAGES)
    archive = warc.write_archive(none)
    assert archive.captures.count() == 0 and warc.read_records(warc.lookup(archive, none)).count() == 0


def test_keys_sort_by_reversed_host():
    assert warc.reversed_key("https://user@A.B.example.com:443/x/Y?q=1#z") == "com,example,b,a)/x/Y?q=1"
    assert warc.reversed_key("http://a.com:8080") == "com,a:8080)/"
    assert warc.reversed_key(None) == "" and warc.reversed_key("mailto:x") == "mailto:x"
