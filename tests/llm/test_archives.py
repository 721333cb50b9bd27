import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from ridelens.llm import archives
from ridelens.llm.queries import op12_archive_converter

V1_BODY = b"1 0 Archive Inc\nURL IP-address Archive-date Content-type Archive-length\n"
V1_PAGE = b"HTTP/1.0 200 Document follows\r\nA: b\r\n\r\nhello\n"
V1 = (
    b"filedesc://old.arc 0.0.0.0 19960923142103 text/plain %d\n" % len(V1_BODY) + V1_BODY
    + b"\nhttp://a.example/x y z 10.0.0.1 19961104142103 text/html %d\n" % len(V1_PAGE) + V1_PAGE + b"\n"
    b"dns:a.example 10.0.0.2 1996110414 text/dns 7\n1 2 3 4\n"
    b"http://short.example/ 10.0.0.3 nonsense text/html 5\n<p>\n"
    b"this is no header line\n"
    b"http://b.example/ 10.0.0.3 19961104 text/html 900\n<html>cut"
)
V2_BODY = b"2 0 Archive Inc\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n"
V2 = (
    b"filedesc://new.arc 0.0.0.0 19980101000000 text/plain 200 - - 0 new.arc %d\n" % len(V2_BODY) + V2_BODY
    + b"\nhttp://c.example/ 10.0.0.4 19980102030405 text/html 404 abc http://d.example/ 209 new.arc 29\nHTTP/1.1 404 No\r\n\r\n\nnot\nhere\n\n"
)


def read(data):
    return [(r.fields["URL"], r.block, r.truncated) for r in archives.arc_records(data)]


def test_version_1_headers_lengths_and_faults():
    got = list(archives.arc_records(V1))
    assert got[0].is_start and got[0].block == V1_BODY
    first = got[1]
    assert first.fields == {
        "URL": "http://a.example/x y z", "IP-address": "10.0.0.1", "Archive-date": "19961104142103",
        "Content-type": "text/html", "Archive-length": str(len(V1_PAGE)),
    }
    assert first.block == V1_PAGE and first.payload == b"hello\n"
    assert got[2].fields["URL"] == "dns:a.example" and got[2].block == b"1 2 3 4" and not got[2].http
    # neither the line with a date that is no number nor the stray line begins a record
    assert [r.fields["URL"] for r in got[3:]] == ["http://b.example/"] and got[3].truncated and got[3].block == b"<html>cut"


def test_version_2_names_ten_fields():
    start, page = archives.arc_records(V2)
    assert start.block == V2_BODY and page.fields["Result-code"] == "404" and page.fields["Offset"] == "209"
    assert page.payload == b"\nnot\nhere\n" and not page.truncated


def test_nothing_and_junk():
    assert read(b"") == [] and read(b"\n\n\r\n") == [] and read(b"junk\n" * 5) == []
    assert read(b"filedesc://x 0.0.0.0 2000 text/plain 5") == [("filedesc://x", b"", True)]


@pytest.mark.parametrize("digits,iso", [("19961104142103", "1996-11-04T14:21:03Z"), ("199611041421", "1996-11-04T14:21:00Z"), ("19961104", "1996-11-04T00:00:00Z"), ("19969904", "?"), ("1996", "?")])
def test_times(digits, iso):
    assert archives.iso_time(digits, "?") == iso


def test_synthesised_records():
    records = list(archives.arc_records(V1))
    whole = b"\r\n\r\n".join(archives.warc_of("old.arc", r, "1996-09-23T14:21:03Z", None) for r in records) + b"\r\n\r\n"
    got = [(h.decode(), b) for h, b in archives.warc_records(whole)]
    get = archives.header_of
    assert [get(h.encode(), "WARC-Type") for h, _ in got] == ["warcinfo", "response", "resource", "resource"]
    assert len({get(h.encode(), "WARC-Record-ID") for h, _ in got}) == 4
    head = got[1][0].encode()
    assert got[1][1] == records[1].block and get(head, "WARC-Date") == "1996-11-04T14:21:03Z" and get(head, "WARC-IP-Address") == "10.0.0.1"
    assert get(head, "WARC-Payload-Digest") == "sha256:" + hashlib.sha256(records[1].payload).hexdigest()
    assert get(head, "WARC-Block-Digest") == "sha256:" + hashlib.sha256(records[1].block).hexdigest()
    assert get(got[2][0].encode(), "Content-Type") == "text/dns" and get(got[3][0].encode(), "WARC-Truncated") == "length"
    assert whole == b"\r\n\r\n".join(archives.warc_of("old.arc", r, "1996-09-23T14:21:03Z", None) for r in archives.arc_records(V1)) + b"\r\n\r\n"


def test_gzip_members():
    assert archives.unpacked(gzip.compress(b"ab") + gzip.compress(b"cd")) == b"abcd" and archives.unpacked(b"ab") == b"ab"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in rows], "page_id long, url string, html string, path string, offset int")


HARD = [
    (5, "http://a/ b\nc", "x" * 500), (3, "http://a/", "x" * 500), (9, None, "x" * 500), (9, None, "x" * 500), (None, "http://n/", "x" * 500),
    (1, "", None), (2, "http://e/", ""), (4, "http://s/", "short"), (6, "http://s/", "short"), (7, "u", "é" * 50), (8, "u", "é" * 50),
    (10, "http://h/", "\n\nHTTP/1.1 200 OK\r\n\r\nWARC/1.0\r\n\r\nhttp://z/ 1.1.1.1 20000101000000 text/html 3\nabc" * 3), (11, "w", "y" * 300_000),
    (-4, "http://neg/", "z" * 100), (12, "http://neg/", "z" * 100), (13, "q", "z" * 99), (14, "q", "z" * 99), (15, "nul", "\x00" * 200),
]


def plain(rows, least=100):
    """(page_id, bytes, digest, type, refers_to) by the definition."""
    out, data = [], [(i, (h or "").encode()) for i, _, h in rows]
    first = {}
    for i, h in sorted(data, key=lambda r: (r[0] is None, r[0] or 0)):
        revisit = len(h) >= least and h in first
        out.append((i, len(h), hashlib.sha256(h).hexdigest(), "revisit" if revisit else "response", first[h] if revisit else None))
        first.setdefault(h, i)
    return sorted(out, key=str)


@pytest.mark.parametrize("version", ["1", "2", "page_id % 2 + 1"])
@pytest.mark.parametrize("archive_bytes", [400, 1 << 20])
def test_round_trip_equals_the_definition(spark, tmp_path, version, archive_bytes):
    rows = pages(spark, HARD).repartition(3).select(
        F.col("page_id").alias("source_id"), "url", F.col("html").alias("payload"), F.expr(f"coalesce({version}, 1)").alias("version"), "path", "offset"
    )
    arcs = archives.write_arc(rows, str(tmp_path / "arc"), archive_bytes)
    warcs = archives.convert(spark, arcs, str(tmp_path / "warc"))
    records = archives.read_warc(spark, warcs, with_payload=True)
    got = records.filter("record_type <> 'warcinfo'").collect()
    assert sorted(((r.source_id and int(r.source_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to_source and int(r.refers_to_source)) for r in got), key=str) == plain(HARD)
    assert all(r.digest_ok for r in got)
    html = {i: (h or "").encode() for i, _, h in HARD}
    ids = {r.record_id: r for r in got}
    assert len(ids) == len(HARD)
    for r in got:
        if r.record_type == "response" and r.source_id:
            assert bytes(r.payload) == html[int(r.source_id)]
        if r.record_type == "revisit":
            assert r.payload is None and ids[r.refers_to_id].payload_digest == r.payload_digest and ids[r.refers_to_id].record_type == "response"
    assert records.filter("record_type = 'warcinfo'").count() == len(list((tmp_path / "arc").glob("part-*")))


def test_every_archive_stands_alone(spark, tmp_path):
    """Archives read without Spark, one file at a time."""
    rows = pages(spark, HARD).select(F.col("page_id").alias("source_id"), "url", F.col("html").alias("payload"), F.lit(2).alias("version"))
    archives.write_arc(rows.coalesce(1), str(tmp_path / "arc"), 2000)
    files = sorted((tmp_path / "arc").glob("part-*"))
    assert len(files) > 1
    found = [r for f in files for r in archives.arc_records(gzip.decompress(f.read_bytes()))]
    assert sum(r.is_start for r in found) == len(files) and len(found) == len(files) + len(HARD)
    for f in files:
        data = gzip.decompress(f.read_bytes())
        for r in archives.arc_records(data):
            assert int(r.fields["Offset"]) == r.offset and data[r.offset :].startswith(r.line.encode())


def test_empty_table(spark, tmp_path):
    pages(spark, []).write.parquet(str(tmp_path / "pages.parquet"))
    assert op12_archive_converter(spark, str(tmp_path)).count() == 0


def test_query_on_hard_rows(spark, tmp_path):
    pages(spark, HARD * 2).write.parquet(str(tmp_path / "pages.parquet"))
    got = op12_archive_converter(spark, str(tmp_path))
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(HARD * 2)
