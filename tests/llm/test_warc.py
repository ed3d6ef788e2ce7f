import base64
import gzip
import hashlib

from llm import tables  # noqa: F401
from pyspark.sql import functions as F

from isogrid.llm.warc import WarcReader, op5_warc, read_warc, write_warc

SCHEMA = "page_id long, url string, html string, digest string, first long, row int"
PAGES = [(1, "http://a/", "<p>one</p>", "x", 1, 1), (2, "http://b/", "<p>one</p>", "x", 1, 1), (9, None, "<p>one</p>", "x", 1, 1), (3, "http://c/\r\nX: y", None, "x", 1, 1), (4, "http://d/", "", "x", 1, 1), (5, "http://é/", "ü" * 30000 + "\r\n\r\n", "x", 1, 1), (None, "http://n/", "alone", "x", 1, 1), (7, "u", "twice", "x", 1, 1), (7, "u", "twice", "x", 1, 1), (8, "v", "\r\n\r\n", "x", 1, 1), (None, "http://n/", "<p>one</p>", "x", 1, 1)]


def folder(spark, tmp_path, rows=PAGES):
    spark.createDataFrame(rows, SCHEMA).repartition(2).write.parquet(f"{tmp_path}/pages.parquet")
    return str(tmp_path)


def test_against_brute_force(spark, tmp_path):
    got = sorted((tuple(r) for r in op5_warc(spark, folder(spark, tmp_path)).collect()), key=str)
    want = []
    for i, _, h, *_ in PAGES:
        b = (h or "").encode()
        top = max((j for j, _, g, *_ in PAGES if (g or "") == (h or "") and j is not None), default=None)
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if i == top else "revisit", None if i == top else top))
    assert got == sorted(want, key=str)


def test_least_size(spark, tmp_path):
    pages = spark.read.parquet(folder(spark, tmp_path) + "/pages.parquet")
    rows = read_warc(spark, write_warc(pages, min_bytes=8)).collect()
    assert {r.page_id for r in rows if r.record_type == "revisit"} == {1, 2, None} and len(rows) == len(PAGES)


def test_payloads_and_any_gzip_reader(spark, tmp_path):
    at = write_warc(spark.read.parquet(folder(spark, tmp_path) + "/pages.parquet"))
    back = {r.page_id: bytes(r.payload) for r in read_warc(spark, at).filter("record_type = 'response'").collect()}
    assert back[5].decode() == PAGES[5][2] and back[9] == b"<p>one</p>"
    reader = WarcReader({"path": at})
    data = b"".join(gzip.open(p).read() for part in reader.partitions() for p in part.paths)
    assert data.count(b"WARC/1.1\r\n") == len(PAGES) and data.count(b"WARC-Type: revisit") == 4


def test_filters_are_pushed(spark, tmp_path):
    at = write_warc(spark.read.parquet(folder(spark, tmp_path) + "/pages.parquet"))
    df = read_warc(spark, at).filter((F.col("record_type") == "revisit") & F.col("page_id").isin(1, 2))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.page_id for r in df.collect()) == [1, 2]
    assert "= revisit" not in plan and "IN (1,2)" not in plan  # left to the reader
    assert {r.payload for r in read_warc(spark, at, payload=False).collect()} == {None}


def test_damage_is_found(spark, tmp_path):
    import pytest

    at = write_warc(spark.createDataFrame([(1, "u", "some payload")], "page_id long, url string, html string"))
    path = WarcReader({"path": at}).partitions()[0].paths[0]
    data = bytearray(open(path, "rb").read())
    data[-20] ^= 255
    open(path, "wb").write(bytes(data))
    with pytest.raises(Exception):
        read_warc(spark, at).collect()


def test_empty(spark, tmp_path):
    assert op5_warc(spark, folder(spark, tmp_path, [])).collect() == []


def foreign() -> list[bytes]:
    """Records as other tools write them."""
    def rec(kind, block, *more):
        return "\r\n".join(["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{kind}-{len(block)}>", "WARC-Date: 2020-02-02T02:02:02Z", *more, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

    http = b"HTTP/1.1 200 OK\r\nX-Long: " + b"y" * 20_000 + b"\r\n\r\n"
    body = b"<p>caf\xe9</p>\r\n\r\nWARC/1.0\r\n" * 5000
    return [
        rec("warcinfo", b"software: x\r\nformat: WARC\r\n", "Content-Type: application/warc-fields"),
        rec("request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", "WARC-Target-URI: http://a/", "content-type: application/http; msgtype=request"),
        rec("response", http + body, "WARC-Target-URI: http://a/", "WARC-Payload-Digest: sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode(), "Content-Type: application/http;msgtype=response"),
        rec("metadata", b"fetchTimeMs: 3", "WARC-Target-URI: http://a/", "Content-Type: application/warc-fields", "WARC-Note: one", "\ttwo"),
        rec("resource", b"\x00\x01" * 40_000, "WARC-Target-URI: file:///b", "Content-Type: application/octet-stream"),
        rec("revisit", b"HTTP/1.1 200 OK\r\nContent-Length: 77\r\n\r\n", "WARC-Target-URI: http://a/", "WARC-Refers-To: <urn:uuid:z>", "Content-Type: application/http; msgtype=response"),
        rec("response", b"", "WARC-Target-URI: http://empty/", "Content-Type: application/http; msgtype=response"),
    ]


def test_archives_of_other_makers(spark, tmp_path):
    records = foreign()
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.warc").write_bytes(b"".join(records))
    (tmp_path / "in/b.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    (tmp_path / "in/c.warc.gz").write_bytes(gzip.compress(b"".join(records)))
    (tmp_path / "in/readme.txt").write_text("no archive")
    rows = read_warc(spark, f"{tmp_path}/in").collect()
    assert len(rows) == 3 * len(records)
    one = rows[: len(records)]
    for i in range(3):
        assert rows[i * len(records) : (i + 1) * len(records)] == one
    by = {r.record_type: r for r in one[:-1]}
    assert bytes(by["response"].payload) == b"<p>caf\xe9</p>\r\n\r\nWARC/1.0\r\n" * 5000 and by["response"].payload_bytes == len(by["response"].payload)
    assert bytes(by["warcinfo"].payload).startswith(b"software") and bytes(by["resource"].payload) == b"\x00\x01" * 40_000
    assert by["revisit"].payload is None and by["revisit"].payload_bytes == 77 and by["revisit"].refers_to_id == "<urn:uuid:z>" and by["revisit"].refers_to is None
    assert by["request"].payload_bytes == 0 and by["metadata"].content_type == "application/warc-fields" and one[-1].payload_bytes == 0
    assert {r.warc_date for r in rows} == {"2020-02-02T02:02:02Z"} and {r.page_id for r in rows} == {None}
    some = read_warc(spark, f"{tmp_path}/in/*.gz", payload=False).filter(F.col("record_type").isin("resource", "response"))
    assert [(r.record_type, r.payload_bytes) for r in some.collect()] == [(r.record_type, r.payload_bytes) for r in one if r.record_type in ("resource", "response")] * 2
    assert read_warc(spark, f"{tmp_path}/in/a.warc").count() == len(records)


def test_cut_off_archives_are_errors(spark, tmp_path):
    import pytest

    whole = foreign()[2]
    for name, data in (("a.warc", whole[:-100]), ("b.warc.gz", gzip.compress(whole)[:-30]), ("c.warc", b"something else\r\n\r\n")):
        (tmp_path / name).write_bytes(data)
        with pytest.raises(Exception):
            read_warc(spark, f"{tmp_path}/{name}", payload=False).collect()


def test_frequent_payload_and_long_page(spark, tmp_path):
    """A third of all pages are empty; one has over two megabytes."""
    rows = [(i, "u", None if i % 3 else f"page {i}") for i in range(300)] + [(1000, "u", "long " * 500_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    got = {r.page_id: r for r in read_warc(spark, write_warc(pages, stable=False)).collect()}
    assert len(got) == 301 and bytes(got[1000].payload) == b"long " * 500_000
    assert all(got[i].refers_to == (299 if i % 3 and i != 299 else None) for i in range(300))
