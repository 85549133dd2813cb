import base64
import gzip
import hashlib

import pytest

from shopstat.llm import warc as W
from shopstat.llm.common import scratch_path
from tests.llm.helpers import SF

PAGES = [(1, "http://x y/é", "dup"), (2, None, "dup"), (3, "u", "dup"), (4, "u", None), (5, "u", ""), (None, "u", "dup"), (1, "http://x y/é", "dup"),
         (9, "u", "\r\n\r\nWARC/1.0\r\nContent-Length: 3\r\n\r\n"), (10, "u", "filedesc://x 0 0 0\n1 0 y\n"), (11, "u", "é日😀" * 20_000), (12, "u", "big" * 9)]
SCHEMA = "page_id bigint, url string, html string"


def _digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def _brute(pages):
    first = {}
    for i, _, html in pages:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    out, given = [], set()
    for i, _, html in sorted(pages, key=lambda p: (p[0] is None, p[0] or 0)):
        key = html or ""
        kind = "revisit" if key in given else "response"
        given.add(key)
        out.append((i, len(key.encode()), _digest(key), kind, first[key] if kind == "revisit" else None))
    return sorted(out, key=str)


def _got(spark, pages):
    return sorted((tuple(r[:5]) for r in W.report(spark, pages).collect()), key=str)


def test_round_trip_with_edges(spark):
    rows = W.report(spark, spark.createDataFrame(PAGES, SCHEMA)).collect()
    assert sorted((tuple(r[:5]) for r in rows), key=str) == _brute(PAGES)
    assert all(r.intact for r in rows)


def test_pages_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    assert _got(spark, pages) == _brute([tuple(r) for r in pages.select("page_id", "url", "html").collect()])


def test_empty_table(spark):
    assert W.report(spark, spark.createDataFrame([], SCHEMA)).collect() == []


def test_small_payloads_are_never_revisits(spark):
    arc, out = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    pages = spark.createDataFrame(PAGES, SCHEMA).selectExpr("*", "'20200102030405' AS date", "1 AS extra")
    W.write_arc(pages, arc)
    W.convert(spark, arc, out, min_revisit_bytes=4)
    assert {r.record_type for r in W.warc_records(spark, out).collect()} == {"response"}


def test_many_files_begin_with_their_own_headers(spark):
    arc, out = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    pages = spark.range(100).selectExpr("id AS page_id", "concat('http://h/', id) AS url", "concat('text ', id) AS html", "'20200102030405' AS date").coalesce(2)
    W.write_arc(pages, arc, records_per_file=8)
    assert W._files(spark, arc).count() >= 100 / 8
    records = W.arc_records(spark, arc).collect()
    assert sorted(r.page_id for r in records) == list(range(100)) and len({r.record_id for r in records}) == 100
    W.convert(spark, arc, out, records_per_file=8)
    for row in W._files(spark, out).collect():
        assert gzip.decompress(bytes(row.content)).startswith(b"WARC/1.0\r\nWARC-Type: warcinfo\r\n")
    assert sorted(r.page_id for r in W.warc_records(spark, out).collect()) == list(range(100))


def test_files_are_bounded_by_bytes(spark):
    arc, out = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    pages = spark.range(40).selectExpr("id AS page_id", "concat('http://h/', id) AS url", "concat(id, repeat('x', IF(id = 7, 90000, 9000))) AS html",
                                       "'20200102030405' AS date").coalesce(1)
    W.write_arc(pages, arc, bytes_per_file=50_000)
    W.convert(spark, arc, out, bytes_per_file=50_000)
    for path in (arc, out):
        sizes = sorted(len(gzip.decompress(bytes(f.content))) for f in W._files(spark, path).collect())
        assert len(sizes) >= 9 and 90_000 < sizes[-1] < 92_000 and sizes[-2] < 51_000      # the large page is alone
    rows = W.warc_records(spark, out).collect()
    assert sorted(r.page_id for r in rows) == list(range(40)) and all(r.intact for r in rows)


def test_archives_of_the_same_name_have_their_own_ids():
    body = b"http://a/ 1.2.3.4 19970102030405 text/html 5\nhello\n"
    assert len({r["record_id"] for p in ("x/old.arc", "y/old.arc") for r in W.parse_arc(body, p)}) == 2


V1 = (b"filedesc://old.arc 0.0.0.0 19970101000000 text/plain 70\n1 0 Archive\nURL IP-address Archive-date Content-type Archive-length\n")
V2_FIELDS = b"2 0 Archive\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n"


def test_both_versions_by_declared_lengths():
    body = b"HTTP/1.0 200 OK\r\nContent-Type: text/html\r\n\r\n<p>\nfiledesc\n"
    about = b"1 0 Archive\nURL IP-address Archive-date Content-type Archive-length\n"
    v1 = b"filedesc://old.arc 0.0.0.0 19970101000000 text/plain %d\n%s\nhttp://a/b c 1.2.3.4 19970102030405 text/html %d\n%s\n" % (len(about), about, len(body), body)
    v1 += b"dns:host 1.2.3.4 19970102030406 text/dns 5\nhello\n"
    v2 = b"filedesc://new.arc 0.0.0.0 19970101000000 text/plain 200 - - 0 new.arc %d\n%s\nhttp://a/ 1.2.3.4 19970102030405 text/html 200 abc - 99 new.arc %d\n%s\n" % (len(V2_FIELDS), V2_FIELDS, len(body), body)
    one, two = list(W.parse_arc(v1)), list(W.parse_arc(gzip.compress(v2)))
    assert [r["url"] for r in one] == ["http://a/b c", "dns:host"] and one[0]["payload"] == b"<p>\nfiledesc\n" and one[1]["payload"] == b"hello"
    assert [r["http"] for r in one] == [True, False] and two[0]["mime"] == "text/html" and two[0]["date"] == "19970102030405"
    record = W._warc_record({**one[1], "first_id": None}) + b"\r\n\r\n" + W._warc_record({**one[0], "first_id": "other"}) + b"\r\n\r\n"
    back = list(W.parse_warc(record))
    assert [r["record_type"] for r in back] == ["resource", "revisit"] and all(r["intact"] for r in back) and back[1]["first_id"] == "other"


def test_short_record_is_an_error():
    with pytest.raises(ValueError):
        list(W.parse_arc(b"http://a/ 1.2.3.4 19970102030405 text/html 50\nshort\n"))
    with pytest.raises(ValueError):
        list(W.parse_warc(b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: 50\r\n\r\nshort"))
