"""Legacy web archives: ARC files in, WARC files out.

An ARC archive begins with a version block (``filedesc://`` line, version line, and the line that names
the fields of its records).  Each record is a header line in those fields and as many bytes as the line
declares.  The converter reads the fields by their names, from the right, so version 1 (five
fields), version 2 (ten fields) and URLs that hold blanks are all read alike, and synthesises what
WARC asks for: a record id (a UUID from archive name, offset and header line, the same on every
run), an ISO timestamp, the record type, and SHA-256 digests of block and payload.

On Spark an archive is a file of about ``ARCHIVE_BYTES`` and the unit of a task, as records can only be found
from its start.  Writers fill archives from the rows of their own task, without a shuffle.  Equal payloads are found on
digests: the first record of each digest is an aggregate, and the later records' places, grouped by
archive, go back to their archive, which Spark broadcasts if the written table of places is small.  A lost executor repeats
whole archives, never parts of them.

Defined cases.  Null payload: empty.  Null or empty URL: written ``-``.  Blanks and control characters in URLs:
percent-encoded by the writer, kept by the reader.  Dates of 8 to 14 digits are filled with zeros; others become
the archive's own date, or 1970.  A declared length beyond the file's end: the rest, marked truncated.  A line that is no
header: skipped up to the next one.  No HTTP status line: a ``resource`` whose payload is the block.  Null
source id: sorted behind the others; a revisit of such a record names its record id only.  Rows that repeat a
source id: a record each; with equal payloads one of them is the response.  Empty table: no archives, no records.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path
from .common import delete_path

ARCHIVE_BYTES = 8 << 20
#: Payloads of fewer bytes are never revisits.
LEAST_BYTES = 100
SALTS = 16
CRAWLED = "20240101000000"
ORIGIN = "Archive"
SOURCE = "X-Source-Id"
REFERS = "X-Refers-To-Source-Id"

# Fixed values of the formats.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
SAME_PAYLOAD = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
GAP = b"\r\n\r\n"


# --- ARC -------------------------------------------------------------------------------


def arc_line(version: int, url: str, date: str, kind: str, length: int, status: str, offset: int, name: str) -> str:
    """Header line of a record."""
    if version == 1:
        return f"{url} 0.0.0.0 {date} {kind} {length}"
    return f"{url} 0.0.0.0 {date} {kind} {status} - - {offset} {name} {length}"


def arc_start(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 {ORIGIN}\n{ARC_FIELDS[version]}\n"
    return f"{arc_line(version, f'filedesc://{name}', date, 'text/plain', len(body), '200', 0, name)}\n{body}".encode()


def safe_url(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "-"


def http_block(source: object, payload: bytes) -> bytes:
    """The response as it came: status line, headers, payload."""
    named = "" if source is None else f"{SOURCE}: {source}\r\n"
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{named}Content-Length: {len(payload)}\r\n\r\n".encode() + payload


class ArcWriter:
    """One archive after another; ``add`` returns a full one."""

    def __init__(self, version: int, name: str, most: int):
        self.version, self.name, self.most, self.made = version, name, most, 0
        self._begin()

    def _begin(self) -> None:
        self.parts = [arc_start(self.version, f"{self.name}-{self.made}.arc", CRAWLED)]
        self.size, self.records = len(self.parts[0]), 0

    def add(self, url: str | None, block: bytes) -> bytes | None:
        line = arc_line(self.version, safe_url(url), CRAWLED, "text/html", len(block), "200", self.size + 1, f"{self.name}-{self.made}.arc")
        self.parts += [b"\n", line.encode("utf-8", "surrogatepass"), b"\n", block]
        self.size += sum(map(len, self.parts[-4:]))
        self.records += 1
        return self.close() if self.size >= self.most else None

    def close(self) -> bytes | None:
        """The archive as far as it is; None if it has no record."""
        whole = b"".join(self.parts) if self.records else None
        self.made += 1
        self._begin()
        return whole


class ArcRecord:
    """A record as it lies in its archive."""

    def __init__(self, offset: int, line: str, fields: dict, block: bytes, truncated: bool):
        self.offset, self.line, self.fields, self.block, self.truncated = offset, line, fields, block, truncated
        self.http = block.startswith(b"HTTP/")
        end = block.find(GAP) if self.http else -1
        self.head = block[: end + 4] if end >= 0 else (block if self.http else b"")
        self.payload = block[len(self.head) :]

    def source(self) -> str | None:
        """The id that the response's own headers carry."""
        return header_of(self.head, SOURCE)

    @property
    def is_start(self) -> bool:
        return self.fields["URL"].startswith("filedesc:")


def header_of(head: bytes, name: str) -> str | None:
    found = re.search(rb"(?im)^" + name.encode() + rb":[ \t]*([^\r\n]*)", head)
    return found[1].decode("utf-8", "replace") if found else None


def _fields(line: str, names: list[str]) -> dict | None:
    """The line's values by field name, read from the right; None if it is no header line."""
    values = line.rsplit(" ", len(names) - 1)
    fields = dict(zip(names, values))
    fine = len(values) == len(names) and fields["URL"] and fields["Archive-length"].isdigit() and fields["Archive-date"].isdigit()
    return fields if fine else None


def arc_records(data: bytes) -> Iterator[ArcRecord]:
    """The records of an archive, its version block first.  The block's own line has its version's fields."""
    names = ARC_FIELDS[1].split(" ")
    at = 0
    while at < len(data):
        if data[at] in b"\r\n":
            at += 1
            continue
        end = data.find(b"\n", at)
        end = len(data) if end < 0 else end
        line = data[at:end].decode("utf-8", "replace").rstrip("\r")
        start = line.startswith("filedesc:")
        # The first line alone is read before its fields are named: it has as many as its version has.
        named = ARC_FIELDS[2 if len(line.split(" ")) >= 10 else 1].split(" ") if start else names
        fields = _fields(line, named)
        if fields is None:
            at = end + 1
            continue
        length = int(fields["Archive-length"])
        block = data[end + 1 : end + 1 + length]
        yield ArcRecord(at, line, fields, block, len(block) < length)
        at = end + 1 + length
        if start:
            described = block.decode("utf-8", "replace").replace("\r", "").split("\n")
            if len(described) > 1 and {"URL", "Archive-date", "Archive-length"} <= set(described[1].split(" ")):
                names = described[1].split(" ")


# --- WARC ------------------------------------------------------------------------------


def iso_time(digits: str, otherwise: str = "1970-01-01T00:00:00Z") -> str:
    """``YYYYMMDDhhmmss``, or its first 8 to 13 digits, as WARC writes it."""
    if 8 <= len(digits) <= 14:
        try:
            return datetime.strptime(digits.ljust(14, "0"), "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
        except ValueError:
            pass
    return otherwise


def record_id(archive: str, record: ArcRecord) -> str:
    seed = f"{archive}|{record.offset}|{record.line}".encode("utf-8", "replace")
    return str(uuid.UUID(bytes=hashlib.sha256(seed).digest()[:16], version=5))


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def warc_record(kind: str, id_: str, date: str, block: bytes, content: str, **headers: str | None) -> bytes:
    """A record without the gap that follows it; header names are written with dashes for underscores."""
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{id_}>", f"WARC-Date: {date}"]
    lines += [f"{name.replace('_', '-')}: {value}" for name, value in headers.items() if value is not None]
    lines += [f"WARC-Block-Digest: sha256:{digest(block)}", f"Content-Type: {content}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "replace") + GAP + block


def warc_of(archive: str, record: ArcRecord, began: str, first: dict | None) -> bytes:
    """The WARC record equivalent to an ARC record; ``first`` describes the record that it revisits."""
    id_, fields = record_id(archive, record), record.fields
    date = iso_time(fields["Archive-date"], began)
    if record.is_start:
        body = f"software: arc to warc\r\nformat: WARC File Format 1.0\r\nisPartOf: {fields['URL']}\r\n".encode("utf-8", "replace")
        return warc_record("warcinfo", id_, date, body, "application/warc-fields", WARC_Filename=archive)
    address = fields.get("IP-address")
    common = {
        "WARC_Target_URI": fields["URL"],
        "WARC_IP_Address": None if address in ("0.0.0.0", "-", None) else address,
        "WARC_Truncated": "length" if record.truncated else None,
        "WARC_Payload_Digest": f"sha256:{digest(record.payload)}",
    }
    if not record.http:
        return warc_record("resource", id_, date, record.block, fields.get("Content-type", "application/octet-stream"), **common)
    if first is None:
        return warc_record("response", id_, date, record.block, "application/http; msgtype=response", **common)
    return warc_record(
        "revisit", id_, date, record.head, "application/http; msgtype=response",
        WARC_Profile=SAME_PAYLOAD, WARC_Refers_To=f"<urn:uuid:{first['record_id']}>", WARC_Refers_To_Target_URI=first["uri"],
        WARC_Refers_To_Date=first["date"], **{REFERS: first["source_id"]}, **common,
    )


def warc_records(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(headers, block) of the records of a WARC archive."""
    at = data.find(b"WARC/")
    while 0 <= at < len(data):
        end = data.find(GAP, at)
        if end < 0:
            return
        head = data[at : end + 2]
        length = int(header_of(head, "Content-Length") or 0)
        yield head, data[end + 4 : end + 4 + length]
        at = end + 4 + length
        while at < len(data) and data[at] in b"\r\n":
            at += 1


# --- on Spark ---------------------------------------------------------------------------


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def unpacked(content: bytes) -> bytes:
    """A file's bytes; gzip files of one or many members are unpacked."""
    if content[:2] != b"\x1f\x8b":
        return content
    out = []
    while content[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        out.append(member.decompress(content))
        content = member.unused_data
    return b"".join(out)


def _write_archives(archives: DataFrame, path: str, end: str) -> str:
    """A gzip file for each row of ``archive``; ``end`` follows the last record."""
    writer = archives.select(F.col("archive").cast("string")).write.option("lineSep", end)
    writer.option("maxRecordsPerFile", 1).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)
    return path


def write_arc(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> str:
    """ARC archives of ``pages(source_id, url, payload, version)`` in the new folder ``path``.

    ``version`` 1 or 2 (others: 1) is that of the archive which takes the page.
    """

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writers = {v: ArcWriter(v, f"pages-v{v}", archive_bytes) for v in ARC_FIELDS}
        one = lambda data: pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["archive"])
        for batch in batches:
            for source, url, payload, version in zip(*(batch[c] for c in ("source_id", "url", "payload", "version"))):
                full = writers.get(version.as_py(), writers[1]).add(url.as_py(), http_block(source.as_py(), payload.as_py() or b""))
                if full:
                    yield one(full)
        for writer in writers.values():
            if rest := writer.close():
                yield one(rest)

    rows = pages.select("source_id", "url", F.col("payload").cast("binary").alias("payload"), F.col("version").cast("int").alias("version"))
    return _write_archives(rows.mapInArrow(fill, "archive binary"), path, "\n")


_INDEX = "path string, offset long, record_id string, source_id string, uri string, date string, digest binary"


def _index(arcs: DataFrame, least_bytes: int) -> DataFrame:
    """The HTTP records whose payloads are long enough to be revisits."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch["path"].to_pylist(), batch["content"]):
                rows, began = [], "1970-01-01T00:00:00Z"
                for r in arc_records(unpacked(content.as_py())):
                    began = iso_time(r.fields["Archive-date"], began) if r.is_start else began
                    if r.http and not r.is_start and len(r.payload) >= least_bytes:
                        rows.append((path, r.offset, record_id(_name(path), r), r.source(), r.fields["URL"], iso_time(r.fields["Archive-date"], began), hashlib.sha256(r.payload).digest()))
                columns = list(zip(*rows)) or [[]] * 7
                kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary()]
                names = [c.split(" ")[0] for c in _INDEX.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return arcs.mapInArrow(read, _INDEX)


def _name(path: str) -> str:
    return path.rsplit("/", 1)[-1]


def _revisits(index: DataFrame) -> DataFrame:
    """``path, places``: each archive's records whose payload an earlier record has, and that record.

    The earliest is the one with the smallest source id (as a number where it is one).  Digests that half the
    web shares are dealt to ``SALTS`` tasks.
    """
    number = F.expr("try_cast(source_id as long)")
    order = [F.col("source_id").isNull().alias("none"), number.isNull().alias("text"), number.alias("number"), "source_id", "path", "offset"]
    whole = F.struct(*order, "record_id", "uri", "date")
    firsts = index.groupBy("digest").agg(F.min(whole).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    firsts = firsts.select("digest", F.struct(*[f"first.{c}" for c in ("record_id", "source_id", "uri", "date", "path", "offset")]).alias("first"))
    salted = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    mine = index.select("digest", "path", "offset", F.pmod(F.xxhash64("path", "offset"), F.lit(SALTS)).cast("int").alias("salt"))
    later = mine.join(salted, ["digest", "salt"]).filter((F.col("path") != F.col("first.path")) | (F.col("offset") != F.col("first.offset")))
    return later.groupBy("path").agg(F.collect_list(F.struct("offset", "first.record_id", "first.source_id", "first.uri", "first.date")).alias("places"))


def convert(spark: SparkSession, arc_path: str, warc_path: str, least_bytes: int = LEAST_BYTES) -> str:
    """WARC archives in the new folder ``warc_path``, one for each ARC archive in ``arc_path``.

    Of HTTP records with equal payloads of at least ``least_bytes`` bytes the one with the smallest
    source id (its ``X-Source-Id`` header) stays a response; the others become revisits of it.
    """
    places_at = shared_path(spark, "arc", "places")
    _revisits(_index(_files(spark, arc_path), least_bytes)).write.parquet(places_at)
    places = spark.read.parquet(places_at)
    arcs = _files(spark, arc_path).join(places, "path", "left").select("path", "content", "places")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content, places in zip(batch["path"].to_pylist(), batch["content"], batch["places"]):
                firsts = {p["offset"]: p for p in places.as_py() or []}
                out, began = [], "1970-01-01T00:00:00Z"
                for r in arc_records(unpacked(content.as_py())):
                    began = iso_time(r.fields["Archive-date"], began) if r.is_start else began
                    out += [warc_of(_name(path), r, began, firsts.get(r.offset)), GAP]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(out[:-1])], pa.binary())], ["archive"])

    _write_archives(arcs.mapInArrow(rewrite, "archive binary"), warc_path, "\r\n\r\n")
    delete_path(spark, places_at)
    return warc_path


_RECORD = (
    "record_type string, record_id string, target_uri string, date string, source_id string, payload_bytes long, "
    "payload_digest string, digest_ok boolean, refers_to_id string, refers_to_source string, payload binary"
)


def _described(head: bytes, block: bytes, with_payload: bool) -> tuple:
    get = lambda name: header_of(head, name)
    kind = get("WARC-Type")
    http = block[: block.find(GAP) + 4] if block.startswith(b"HTTP/") and GAP in block else b""
    payload = block[len(http) :]
    stated = (get("WARC-Payload-Digest") or "").removeprefix("sha256:") or None
    if kind == "revisit":
        # The record holds the headers only; they and the digest are those of the whole payload.
        size = int(header_of(http, "Content-Length") or 0)
        known, same, payload = stated, digest(block) == (get("WARC-Block-Digest") or "").removeprefix("sha256:"), None
    else:
        size, known = len(payload), digest(payload)
        same = stated in (None, known)
    bare = lambda x: x and x.strip("<>").removeprefix("urn:uuid:")
    return (
        kind, bare(get("WARC-Record-ID")), get("WARC-Target-URI"), get("WARC-Date"), header_of(http, SOURCE), size, known, same,
        bare(get("WARC-Refers-To")), get(REFERS), payload if with_payload else None,
    )


def read_warc(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """A row for each record of the archives in ``path``.  ``payload_bytes`` and ``payload_digest`` are those of the whole payload,
    also of a revisit; ``digest_ok`` tells whether the bytes read have the digest that the record states."""
    names = [c.split(" ")[0] for c in _RECORD.split(", ")]
    text, long, flag = pa.string(), pa.int64(), pa.bool_()
    kinds = [text, text, text, text, text, long, text, flag, text, text, pa.binary()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch["content"]:
                rows = [_described(head, block, with_payload) for head, block in warc_records(unpacked(content.as_py()))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return _files(spark, path).mapInArrow(read, _RECORD)
