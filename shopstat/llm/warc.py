"""Legacy archive converter: ARC to WARC (operator 9).

``write_arc`` makes ARC files (version 1 or 2), ``arc_records`` parses them
by their version's header line and declared lengths, ``convert`` turns them
into WARC files with synthesised record ids, dates, types and digests, and
``warc_records`` reads those back.

Archives are written by Spark's text writer, one archive a row and file: the
record separators of the formats (a line feed; two CRLF) stand between the
records and as the writer's line separator at the end, and its commit
protocol survives lost tasks and works on any file system Spark writes to.
An archive ends before it would exceed ``RECORDS_PER_FILE`` records or
``BYTES_PER_FILE`` bytes (a larger record has an archive of its own), so
however large pages are, the tasks that write and read archives hold one of
that size; archives are read as binary files and parsed as a stream.
Record ids come from the archive's path and name and the record's offset, so
foreign archives of the same name don't collide.

Of records with equal payloads (length and digest) of at least
``min_revisit_bytes``, the one with the smallest page id is written as
response, the others as revisits without their payload.

Defined results: a null payload is empty; a null url is written as
``unknown:``; blanks, control and non-ASCII characters in urls are percent
encoded; null page ids come last in the choice of the response; repeated
rows are records of their own; blocks that are no HTTP responses become
resource records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopstat.llm.common import materialise, scratch_path

RECORDS_PER_FILE = 20_000
BYTES_PER_FILE = 64 << 20
# Field lines of the two ARC versions and names of the WARC format.
ARC_FIELDS = {
    1: b"URL IP-address Archive-date Content-type Archive-length",
    2: b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
PAGE_HEADER = b"X-Page-Id"
ARC_RECORD = ("record_id string, page_id bigint, url string, ip string, date string, mime string, "
              "head binary, payload binary, payload_bytes bigint, payload_digest string, http boolean")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(url: str, date: str, mime: str, length: int, version: int, name: str, check: str = "-") -> bytes:
    rest = f"{mime} {length}" if version == 1 else f"{mime} 200 {check} - 0 {name} {length}"
    return f"{url} 0.0.0.0 {date} {rest}\n".encode()


def _rows(values: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(values, pa.binary())], names=["value"])


class _Archive:
    """The records of the archive being filled; the first is its header."""

    def __init__(self, separator: bytes, most_records: int, most_bytes: int):
        self.separator, self.most_records, self.most_bytes = separator, most_records, most_bytes
        self.records, self.bytes = [], 0

    def ends_before(self, size: int) -> bool:
        """Whether a record of ``size`` bytes needs a new archive."""
        return len(self.records) > 1 and (len(self.records) >= self.most_records or self.bytes + size > self.most_bytes)

    def add(self, record: bytes) -> None:
        self.records.append(record)
        self.bytes += len(record) + len(self.separator)

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.records:
            whole = self.separator.join(self.records)
            self.records, self.bytes = [], 0
            yield _rows([whole])


def _write(archives: DataFrame, path: str, separator: str) -> None:
    (archives.select(F.col("value").cast("string")).write.option("lineSep", separator).option("compression", "gzip")
     .option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", 1).text(path))


def write_arc(pages: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE, bytes_per_file: int = BYTES_PER_FILE) -> None:
    """ARC files of ``page_id, url, html, date`` (14 digits); partitions take
    turns between the two versions."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), "date")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        version, begun, name = 1 + part % 2, 0, ""
        archive = _Archive(b"\n", records_per_file, bytes_per_file)

        def header() -> bytes:
            about = b"%d 0 shopstat\n%s\n" % (version, ARC_FIELDS[version])
            return _record(f"filedesc://{name}", "20240101000000", "text/plain", len(about), version, name) + about

        for batch in batches:
            for row in (r for some in _slices(batch) for r in some.to_pylist()):
                payload = row["html"].encode()
                page = b"" if row["page_id"] is None else PAGE_HEADER + b": %d\r\n" % row["page_id"]
                head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + page + b"Content-Length: %d\r\n\r\n" % len(payload)
                url = quote(row["url"], safe="%/:=&?~#+!$,;'@()*[]") if row["url"] else "unknown:"
                block, check = head + payload, digest(payload)
                if archive.ends_before(len(block)):
                    yield from archive.end()
                if not archive.records:
                    name, begun = f"pages-{part:06d}-{begun:04d}.arc", begun + 1
                    archive.add(header())
                archive.add(_record(url, row["date"], "text/html", len(block), version, name, check) + block)
        yield from archive.end()
    _write(rows.mapInArrow(run, "value binary"), path, "\n")


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


def _slices(batch: pa.RecordBatch, rows: int = 64) -> Iterator[pa.RecordBatch]:
    """A batch in parts, so that few pages are Python objects at a time."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def _stream(content: bytes) -> io.BufferedIOBase:
    raw = io.BytesIO(content)
    return gzip.GzipFile(fileobj=raw) if content[:2] == b"\x1f\x8b" else raw


def _http_field(head: bytes, name: bytes) -> bytes | None:
    for line in head.split(b"\r\n"):
        key, colon, value = line.partition(b":")
        if colon and key.strip().lower() == name.lower():
            return value.strip()
    return None


def _number(value: bytes | None) -> int | None:
    return int(value) if value and value.lstrip(b"-").isdigit() else None


def parse_arc(content: bytes, path: str = "") -> Iterator[dict]:
    """Records of one ARC file, by the declared lengths; the version block
    says which fields a header line has (a url may hold blanks, so fields are
    taken from the right)."""
    stream, version, name, offset = _stream(content), 1, "", 0
    while True:
        line = stream.readline()
        if not line:
            return
        at, offset = offset, offset + len(line)
        if line == b"\n":                       # the separator between records
            continue
        text = line.rstrip(b"\n").decode("utf-8", "replace")
        if text.startswith("filedesc://"):
            length = int(text.rsplit(" ", 1)[1])
            block = stream.read(length)
            version, name = int(block.split(b" ", 1)[0]), text.split(" ", 1)[0][len("filedesc://"):]
            offset += length
            continue
        fields = text.rsplit(" ", 4 if version == 1 else 9)
        url, ip, date, mime, length = fields[0], fields[1], fields[2], fields[3], int(fields[-1])
        block = stream.read(length)
        if len(block) != length:
            raise ValueError(f"{name}: the record at {at} declares {length} bytes, {len(block)} are there")
        offset += length
        http = block.startswith(b"HTTP/") and b"\r\n\r\n" in block
        cut = block.index(b"\r\n\r\n") + 4 if http else 0
        head, payload = block[:cut], block[cut:]
        yield {"record_id": str(uuid.uuid5(uuid.NAMESPACE_URL, f"{path}#{name}#{at}")), "page_id": _number(_http_field(head, PAGE_HEADER)),
               "url": url, "ip": ip, "date": date, "mime": mime, "head": head, "payload": payload,
               "payload_bytes": len(payload), "payload_digest": digest(payload), "http": http}


def _in_parts(records: Iterator[dict], schema: pa.Schema, rows: int = 256) -> Iterator[pa.RecordBatch]:
    part = []
    for r in records:
        part.append({k: r[k] for k in schema.names})
        if len(part) == rows:
            yield pa.RecordBatch.from_pylist(part, schema)
            part = []
    if part:
        yield pa.RecordBatch.from_pylist(part, schema)


_ARROW = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}


def _schemas(ddl: str, columns: list[str] | None = None) -> tuple[str, pa.Schema]:
    fields = [f.split() for f in ddl.split(", ") if columns is None or f.split()[0] in columns]
    return ", ".join(" ".join(f) for f in fields), pa.schema([(n, _ARROW[t]) for n, t in fields])


def arc_records(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    ddl, schema = _schemas(ARC_RECORD, columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("path"), batch.column("content")):
                yield from _in_parts(parse_arc(content.as_py(), file.as_py()), schema)
    return _files(spark, path).mapInArrow(run, ddl)


def _warc_record(r: dict) -> bytes:
    """One record without the two CRLF that end it."""
    date = r["date"]
    when = f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"
    revisit = r["first_id"] is not None
    kind = "revisit" if revisit else "response" if r["http"] else "resource"
    block = r["head"] if revisit else r["head"] + r["payload"]
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{r['record_id']}>", f"WARC-Date: {when}",
             f"WARC-Target-URI: {r['url']}", f"WARC-IP-Address: {r['ip']}"]
    if revisit:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:uuid:{r['first_id']}>"]
    lines += [f"WARC-Payload-Digest: sha1:{r['payload_digest']}", f"WARC-Block-Digest: sha1:{digest(block)}",
              "Content-Type: " + ("application/http; msgtype=response" if r["http"] else r["mime"]), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def convert(spark: SparkSession, arc_path: str, warc_path: str, min_revisit_bytes: int = 0,
            records_per_file: int = RECORDS_PER_FILE, bytes_per_file: int = BYTES_PER_FILE) -> None:
    """WARC files of the records of ARC files."""
    found = materialise(arc_records(spark, arc_path, ["record_id", "page_id", "payload_bytes", "payload_digest", "http"]), "arc-digests")
    # one row per payload, partly aggregated before the shuffle however often a payload repeats
    first = materialise(found.filter((F.col("payload_bytes") >= min_revisit_bytes) & F.col("http"))
                        .groupBy("payload_bytes", "payload_digest")
                        .agg(F.min(F.struct(F.col("page_id").isNull().alias("n"), "page_id", "record_id")).alias("f"), F.count(F.lit(1)).alias("n"))
                        .filter("n > 1").select("payload_bytes", "payload_digest", F.col("f.record_id").alias("first_id")), "arc-first")
    revisits = materialise(found.filter("http").join(first, ["payload_bytes", "payload_digest"]).filter("record_id <> first_id")
                           .select("record_id", "first_id"), "arc-revisits")
    # the planner broadcasts the written revisits only if they are small
    records = arc_records(spark, arc_path).join(revisits, "record_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = _Archive(b"\r\n\r\n", records_per_file, bytes_per_file)
        for batch in batches:
            for row in (r for some in _slices(batch) for r in some.to_pylist()):
                record = _warc_record(row)
                if archive.ends_before(len(record)):
                    yield from archive.end()
                if not archive.records:
                    about = b"software: shopstat\r\nformat: WARC File Format 1.0\r\n"
                    info = uuid.uuid5(uuid.NAMESPACE_URL, f"warcinfo:{row['record_id']}")
                    archive.add((f"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{info}>\r\nWARC-Date: 2024-01-01T00:00:00Z\r\n"
                                 f"Content-Type: application/warc-fields\r\nContent-Length: {len(about)}\r\n\r\n").encode() + about)
                archive.add(record)
        yield from archive.end()
    _write(records.mapInArrow(run, "value binary"), warc_path, "\r\n\r\n")


WARC_RECORD = ("record_id string, record_type string, url string, page_id bigint, payload_bytes bigint, "
               "payload_digest string, first_id string, intact boolean")


def parse_warc(content: bytes) -> Iterator[dict]:
    """Records of one WARC file but for warcinfo; ``intact`` says whether the
    digests written agree with the bytes read."""
    stream = _stream(content)
    while True:
        line = stream.readline()
        if not line:
            return
        if line == b"\r\n":
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {line[:40]!r}")
        fields = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            key, _, value = line.partition(b":")
            fields[key.strip().lower()] = value.strip().decode("utf-8", "replace")
        length = int(fields[b"content-length"])
        block = stream.read(length)
        if len(block) != length:
            raise ValueError(f"a record declares {length} bytes, {len(block)} are there")
        kind = fields[b"warc-type"]
        if kind == "warcinfo":
            continue
        http = fields.get(b"content-type", "").startswith("application/http")
        cut = block.index(b"\r\n\r\n") + 4 if http else 0
        head, payload = block[:cut], block[cut:]
        stated = fields.get(b"warc-payload-digest", "").removeprefix("sha1:")
        intact = fields.get(b"warc-block-digest") == f"sha1:{digest(block)}"
        if kind != "revisit":
            intact = intact and digest(payload) == stated
        yield {"record_id": fields[b"warc-record-id"].removeprefix("<urn:uuid:").removesuffix(">"), "record_type": kind,
               "url": fields.get(b"warc-target-uri"), "page_id": _number(_http_field(head, PAGE_HEADER)),
               "payload_bytes": _number(_http_field(head, b"Content-Length")) if kind == "revisit" else len(payload),
               "payload_digest": stated if kind == "revisit" else digest(payload),
               "first_id": fields[b"warc-refers-to"].removeprefix("<urn:uuid:").removesuffix(">") if b"warc-refers-to" in fields else None,
               "intact": intact}


def warc_records(spark: SparkSession, path: str) -> DataFrame:
    ddl, schema = _schemas(WARC_RECORD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                yield from _in_parts(parse_warc(content.as_py()), schema)
    return _files(spark, path).mapInArrow(run, ddl)


def report(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write the pages as ARC, convert, read the WARC back: the contract's rows."""
    arc, warc = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    dated = pages.select("page_id", "url", "html", F.date_format(
        F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(31_536_000))), "yyyyMMddHHmmss").alias("date"))
    write_arc(dated, arc)
    convert(spark, arc, warc)
    back = materialise(warc_records(spark, warc), "warc-records")
    first = back.filter("record_type = 'response'").select(F.col("record_id").alias("first_id"), F.col("page_id").alias("refers_to"))
    return back.join(first, "first_id", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")
