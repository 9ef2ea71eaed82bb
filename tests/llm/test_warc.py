"""WARC archives: exact round trips, against a plain version and by lookups through the index."""

from __future__ import annotations

import gzip
import hashlib

import pyarrow.fs as pafs

from corvane.llm import queries, warc
from corvane.llm._common import table

SCHEMA = "page_id long, url string, html string, payload string, key int, _cv_id string"


def pages(spark, *rows):
    return spark.createDataFrame([(i, u, h, "x", -1, "y") for i, u, h in rows], SCHEMA)


def plain(rows):
    first = {}
    for i, h in sorted((i, h) for i, _, h in rows if i is not None):
        first.setdefault(h or "", i)
    out = {}
    for i, _, h in rows:
        raw = (h or "").encode()
        again = i is not None and len(raw) >= 100 and first[h or ""] < i
        out[i] = (len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first[h] if again else None)
    return out


def test_pages_match_a_plain_version(spark):
    rows = [tuple(r) for r in table(spark, "/root/testdata/sf0.01", "pages").select("page_id", "url", "html").collect()]
    got = {r["page_id"]: tuple(r)[1:] for r in queries.op8_warc(spark, "/root/testdata/sf0.01").collect()}
    assert got == plain(rows)


def test_round_trip_of_hard_pages(spark):
    long = "<p>é\r\n\r\nWARC/1.1</p>" * 50_000
    rows = [(0, "http://a.example/", None), (1, None, ""), (2, "http://www.B.example:80/p?q=1#f", "x" * 100), (3, "http://b.example/p?q=1", "x" * 100), (4, "not a url\r\nX: y", "é" * 50), (5, "https://c.example/é", "é" * 50), (6, "ftp://[::bad", "x" * 99), (7, "http://b.example/p?q=1", "x" * 99), (8, "http://d.example/", long), (9, "http://e.example/", long), (None, "http://a.example/", "x" * 100)]
    out = warc.archive_pages(spark, pages(spark, *rows))
    found = out.collect()
    got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found}
    assert got == plain(rows)
    assert all(bytes(r["payload"]).decode() == (dict((i, h or "") for i, _, h in rows)[r["page_id"]] if r["record_type"] == "response" else "") for r in found)
    assert warc.archive_pages(spark, pages(spark, *rows).limit(0)).count() == 0


def test_lookups_go_through_the_index(spark, tmp_path):
    rows = [(i, f"http://h{i % 7}.example/page/{i:04d}", f"page {i} " * 20) for i in range(1500)]
    rows += [(5000 + i, "http://hot.example/same", f"capture {i}") for i in range(700)]
    directory = warc.write_archives(pages(spark, *rows), f"file://{tmp_path}/warc")
    assert directory.count() >= 8 and directory.agg({"lines": "sum"}).first()[0] == len(rows)
    index = warc.CaptureIndex.load(directory)
    assert index.keys == sorted(index.keys)
    for i in (0, 733, 1499):
        captures = index.lookup(rows[i][1])
        assert [(h["X-Page-ID"], p.decode()) for h, p in captures] == [(str(i), rows[i][2])]
    assert len(index.lookup("https://www.hot.example/same")) == 700
    assert index.lookup("http://nowhere.example/") == []


def test_archives_are_plain_gzip_records(spark, tmp_path):
    warc.write_archives(pages(spark, (1, "http://a.example/", "hello"), (2, "http://a.example/b", "y" * 200), (3, "http://a.example/c", "y" * 200)), f"file://{tmp_path}/warc")
    fs, _ = pafs.FileSystem.from_uri(f"file://{tmp_path}")
    seen = []
    for f in sorted(tmp_path.glob("warc/*.warc.gz")):
        data = f.read_bytes()
        assert gzip.decompress(data).count(b"WARC/1.1\r\n") == len(list(warc.records_of(data)))
        seen += [(h["WARC-Type"], p) for h, p in warc.records_of(data)]
    assert sorted(seen) == [("response", b"hello"), ("response", b"y" * 200), ("revisit", b"")]


def test_copies_of_a_row(spark, tmp_path):
    """Rows that repeat in id and payload: one response, the others revisit it; every record has an id of its own."""
    rows = [(3, "http://a.example/", "x" * 100)] * 3 + [(3, "http://b.example/", "x" * 100), (5, "http://a.example/", "x" * 100), (None, "http://a.example/", "x" * 100), (7, "u", "y" * 99), (7, "u", "y" * 99)]
    got = warc.archive_pages(spark, pages(spark, *rows)).collect()
    want = [(3, "response", None), *[(3, "revisit", 3)] * 3, (5, "revisit", 3), (None, "response", None), *[(7, "response", None)] * 2]
    assert sorted(((r["page_id"], r["record_type"], r["refers_to"]) for r in got), key=str) == sorted(want, key=str)
    warc.write_archives(pages(spark, *rows), f"file://{tmp_path}/warc")
    ids = [h["WARC-Record-ID"] for f in tmp_path.glob("warc/*.warc.gz") for h, _ in warc.records_of(f.read_bytes())]
    assert len(ids) == len(set(ids)) == len(rows)
    raw = b"".join(gzip.decompress(f.read_bytes()) for f in tmp_path.glob("warc/*.warc.gz"))
    assert raw.count(b"\r\n\r\nHTTP/1.1 200 OK\r\n") == len(rows)


def test_many_keys_are_located(spark, tmp_path):
    """Searched keys alone come back, whole, whether they fill blocks or are not there."""
    rows = [(i, f"http://h{i % 7}.example/page/{i:04d}", f"page {i} " * 20) for i in range(1500)]
    rows += [(5000 + i, "http://hot.example/same", f"capture {i}") for i in range(1500)]
    directory = warc.write_archives(pages(spark, *rows), f"file://{tmp_path}/warc")
    keys = spark.createDataFrame([("example,h3)/page/0003",), ("example,h3)/page/0003",), ("example,hot)/same",), ("nothing)/",), (None,)], "key string")
    assert sorted(r["page_id"] for r in warc.read_archives(warc.locate(directory, keys)).collect()) == [3, *range(5000, 6500)]
    assert warc.read_archives(directory).count() == len(rows)
    assert warc.locate(directory, keys).selectExpr("sum(size(keys))").first()[0] <= 20


def test_both_keys_agree(spark):
    from pyspark.sql import functions as F

    urls = ["http://www.a.b.example/x?y=1#z", "https://A.example", "http://user@h.example:8080/p/q", "http://h.example?x=1", " http://h.example/ "]
    got = [r[0] for r in spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string").orderBy("i").select(warc._surt_column(F.col("u"))).collect()]
    assert got == [warc.surt(u) for u in urls]


def test_lookup_finds_unusual_urls(spark, tmp_path):
    urls = ["http://t.example/x ", "example.com/a", "//cdn.ex/a", "mailto:a@b.example", "http://a.ex/?", "http://[::1]:80/p", "http://c.ex/a\tb", "http://d.ex/a\r\nb", "http://e.ex/é#f", "ftp://[::bad", None]
    index = warc.CaptureIndex.load(warc.write_archives(pages(spark, *[(i, u, "x") for i, u in enumerate(urls)]), f"file://{tmp_path}/warc"))
    assert [[h["X-Page-ID"] for h, _ in index.lookup(u)] for u in urls] == [[str(i)] for i in range(len(urls))]


def test_both_keys_agree_on_blanks(spark):
    from pyspark.sql import functions as F

    assert spark.range(1).select(warc._surt_column(F.lit(" http://h.example/ "))).first()[0] == "example,h)/" == warc.surt(" http://h.example/ ")
