"""Legacy archive converter: ARC files (versions 1 and 2) to WARC, and back to rows.

An ARC file names its version and the fields of its header lines in its first record; later records are one header line,
as many bytes as the line declares, and a line feed. Each becomes a WARC record with a synthesised identifier (a
name-based UUID of the archive's name, the record's offset, URL and date), date, type and digests. Of the records with equal
payloads of at least MIN_REVISIT bytes the first stays a response: that with the smallest page id, or without page ids the
first by archive and offset. The others become revisits without a payload. Archives are read by Spark as whole binary
files, one for each task that wrote, and parsed as streams by declared lengths, so payloads may hold anything.

Conversion reads the archives twice and shuffles no payload: the first time gives digests, of which only those that records
share are kept (and broadcast, if they are few), the second time writes.

A header line that cannot be read, a length that is no number or reaches beyond the file, and a file that is cut off or no
gzip become rejected rows with a reason (read_rejected), and reading goes on at the next line that is a header. The same
holds for WARC records whose head, length or digest is wrong (read_warc_rejected). Blanks and bytes beyond ASCII in a URL are
percent-encoded, dates of fewer digits are filled up with zeros, and an odd page id counts as none.

Defined results: a null html is an empty payload. A null url is written as "-". A null page id never is the smallest: such
a record revisits the smallest there is. Records that share both the smallest page id and the payload are all responses.
"""

from __future__ import annotations

import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from .common import materialize, shared_path, small, table

MIN_REVISIT = 100
#: The date of records whose source has none.
DATE = "20000101000000"
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:kerbline:page")
# fixed values: the formats' field names and profile
ARC_FIELDS = {
    1: b"URL IP-address Archive-date Content-type Archive-length",
    2: b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = "page_id long, url string, ip string, date string, http binary, payload binary, digest string, file string, offset long, reason string"
#: Names of a URL's characters that stay as they are.
URL_SAFE = "%/:=&?~#+!$,;@()*[]'"


def arc_filedesc(version: int, name: str) -> bytes:
    block = b"%d 0 kerbline\n%s\n" % (version, ARC_FIELDS[version])
    line = f"filedesc://{name} 0.0.0.0 {DATE} text/plain" + (" 200 - - 0 " + name if version == 2 else "")
    return line.encode() + b" %d\n" % len(block) + block


def arc_record(version: int, name: str, page_id: int | None, url: str | None, payload: bytes) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    http += (b"X-Page-Id: %d\r\n" % page_id if page_id is not None else b"") + b"\r\n"
    line = f"{quote(url, safe=URL_SAFE) if url else '-'} 0.0.0.0 {DATE} text/html"
    line += f" 200 {hashlib.md5(payload).hexdigest()} - 0 {name}" if version == 2 else ""
    return b"%s %d\n" % (line.encode(), len(http) + len(payload)) + http + payload


def write_lines(rows: DataFrame, path: str, end: str) -> None:
    """One gzip file for each task: the bytes of column value of each row, then end."""
    rows.select(F.col("value").cast("string")).write.option("lineSep", end).option("compression", "gzip").text(path)


def write_arc(pages: DataFrame, path: str, version: int | None = None) -> None:
    """ARC files of pages(page_id, url, html); without a version, odd tasks write version 1 and even ones 2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        v, name, first = version or 2 - task % 2, f"part-{task}.arc", True
        for b in batches:
            out = [arc_filedesc(v, name)] if first else []
            first = False
            for p, u, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), strict=True):
                out.append(arc_record(v, name, p, u, h or b""))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    write_lines(pages.select(F.col("page_id").cast("long"), F.col("url"), F.col("html")).mapInArrow(run, "value binary"), path, "\n")


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """The HTTP header with its empty line, and the payload; a block without a header is all payload."""
    at = block.find(b"\r\n\r\n") + 4 if block.startswith(b"HTTP/") else 0
    return (block[:at], block[at:]) if at >= 4 else (b"", block)


def page_of(http: bytes) -> int | None:
    for line in http.split(b"\r\n"):
        if line.lower().startswith(b"x-page-id:"):
            value = line.split(b":", 1)[1].strip()
            return int(value) if value.isdigit() and len(value) < 19 else None
    return None


def header_of(line: bytes, fields: list[bytes]) -> dict[bytes, bytes] | None:
    """The values of a header line; blanks within it belong to the URL, or else to the content type. None if it is no header."""
    values = line.split()
    extra = len(values) - len(fields)
    if extra < 0 or not values[-1].isdigit() or len(values[-1]) > 15:
        return None
    for at in (fields.index(b"URL"), fields.index(b"Content-type")) if extra else (0,):
        found = dict(zip(fields, [*values[:at], b"%20".join(values[at : at + extra + 1]), *values[at + extra + 1 :]], strict=True))
        if found[b"Archive-date"].isdigit() and 4 <= len(found[b"Archive-date"]) <= 14:
            return found
    return None


def rejected(offset: int | None, reason: str, line: bytes = b"") -> dict:
    return {"url": line[:200].decode(errors="replace"), "offset": offset, "reason": reason}


class Inflated(io.RawIOBase):
    """The bytes of a gzip file of any number of members; where it is cut off or damaged it ends, and broken tells why."""

    def __init__(self, content):
        self.content, self.at, self.engine, self.held, self.broken = memoryview(content), 0, None, b"", None

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        while not self.held:
            if self.broken or (self.engine is None and self.at == len(self.content)):
                return 0
            self.engine = self.engine or zlib.decompressobj(31)
            piece = self.engine.unconsumed_tail
            if not piece:
                piece = self.content[self.at : self.at + (1 << 16)]
                self.at += len(piece)
            if not piece:
                self.broken = "cut off"
                return 0
            try:
                self.held = self.engine.decompress(piece, 1 << 20)
            except zlib.error:
                self.broken = "no gzip"
                return 0
            if self.engine.eof:
                # the next member begins in what this one left
                self.at -= len(self.engine.unused_data)
                self.engine = None
        n = min(len(buffer), len(self.held))
        buffer[:n], self.held = self.held[:n], self.held[n:]
        return n


class Cursor:
    """A stream read forward, with the offset so far, that can take back what it has just read up to the end."""

    def __init__(self, stream):
        self.stream, self.offset = stream, 0

    def readline(self) -> bytes:
        line = self.stream.readline()
        self.offset += len(line)
        return line

    def read(self, n: int) -> bytes:
        block = self.stream.read(n)
        self.offset += len(block)
        return block

    def again(self, block: bytes) -> None:
        self.stream, self.offset = io.BytesIO(block), self.offset - len(block)


def parse_arc(stream) -> Iterator[dict]:
    """The records after the first, which tells the version's fields; what cannot be read has a reason, once for each run of lines."""
    fields: list[bytes] = ARC_FIELDS[1].split()
    lost, at_line = False, Cursor(stream)
    while True:
        offset = at_line.offset
        line = at_line.readline()
        if not line:
            return
        if not line.strip():
            continue
        if line.startswith(b"filedesc://") and line.split()[-1].isdigit():
            size = int(line.split()[-1])
            block = at_line.read(size)
            if len(block) < size:
                yield rejected(offset, "shorter than declared", line)
                at_line.again(block)
                lost = True
                continue
            lines, version = block.split(b"\n"), block.split(None, 1)[:1]
            named = lines[1].split() if len(lines) > 1 else []
            fields = named if {b"URL", b"IP-address", b"Archive-date", b"Content-type", b"Archive-length"} <= set(named) and named[-1] == b"Archive-length" else ARC_FIELDS.get(int(version[0]) if version and version[0].isdigit() else 1, ARC_FIELDS[1]).split()
            continue
        at = header_of(line, fields)
        if at is None:
            if not lost:
                yield rejected(offset, "no header line", line)
            lost = True
            continue
        length = int(at[b"Archive-length"])
        block = at_line.read(length)
        if len(block) < length:
            # the length is wrong, or the file is: what follows the line may hold more records
            yield rejected(offset, "shorter than declared", line)
            at_line.again(block)
            lost = True
            continue
        lost = False
        http, payload = split_http(block)
        yield {
            "page_id": page_of(http), "url": quote(at[b"URL"], safe=URL_SAFE), "ip": at[b"IP-address"].decode(errors="replace"), "date": at[b"Archive-date"].decode().ljust(14, "0"),
            "http": http, "payload": payload, "digest": hashlib.sha256(payload).hexdigest(), "offset": offset,
        }


def broken(raw: Inflated) -> Iterator[dict]:
    """A rejected row if the file could not be read to its end."""
    if raw.broken:
        yield rejected(None, raw.broken)


def read_archives(spark: SparkSession, path: str, parse, schema: str, batch_bytes: int = 8 << 20) -> DataFrame:
    """A row for each record that parse(stream) yields of every gzip file under path, with the file's name where schema has it."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                name = {"file": file.rpartition("/")[2]} if "file" in arrow.names else {}
                rows, size = [], 0
                raw = Inflated(content.as_buffer())
                for r in chain(parse(io.BufferedReader(raw, 1 << 20)), broken(raw)):
                    rows.append({**r, **name})
                    size += sum(len(v) for v in r.values() if isinstance(v, (bytes, str)))
                    if size > batch_bytes:
                        yield pa.RecordBatch.from_pylist(rows, arrow)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, arrow)

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    return files.mapInArrow(run, schema)


def read_arc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """RECORD of every ARC record that could be read; without payloads n_bytes instead."""
    if with_payload:
        return read_archives(spark, path, parse_arc, RECORD).where("reason is null").drop("reason")
    light = lambda stream: ({k: v for k, v in r.items() if k not in ("http", "payload")} | {"n_bytes": len(r.get("payload", b""))} for r in parse_arc(stream))
    return read_archives(spark, path, light, RECORD.replace("http binary, payload binary", "n_bytes long")).where("reason is null").drop("reason")


def read_rejected(spark: SparkSession, path: str) -> DataFrame:
    """file, offset, reason and the line of what read_arc() left out."""
    lines = lambda stream: (r for r in parse_arc(stream) if r.get("reason"))
    return read_archives(spark, path, lines, "file string, offset long, reason string, url string").withColumnRenamed("url", "line")


#: The key of the first record of those with equal payloads, and what its identifier is made of.
FIRST = ["page_id", "file", "offset", "url", "date"]


def with_references(records: DataFrame, light: DataFrame, least: int = MIN_REVISIT) -> DataFrame:
    """records with first, the record that a revisit refers to (null for responses); light: the same records without payloads."""
    key = F.struct(F.col("page_id").isNull().alias("no"), *FIRST)
    shared = light.where(F.col("n_bytes") >= least).groupBy("digest").agg(F.min(key).alias("first"), F.count("*").alias("n")).where("n > 1")
    shared = small(materialize(shared.select(F.col("digest").alias("of"), F.struct(*[F.col("first")[c].alias(c) for c in FIRST]).alias("first")), "shared"))
    same_page = F.col("first.page_id").eqNullSafe(F.col("page_id")) & F.col("page_id").isNotNull()
    same_record = (F.col("first.file") == F.col("file")) & (F.col("first.offset") == F.col("offset"))
    long_enough = F.octet_length("payload") >= least
    joined = records.join(shared, (F.col("digest") == F.col("of")) & long_enough, "left").drop("of")
    return joined.withColumn("first", F.when(~(same_page | same_record), F.col("first")))


def record_id(file: str, offset: int, url: str, date: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{file} {offset} {date} {url}')}>"


def warc_record(url, ip, date, http, payload, digest, file, offset, first) -> bytes:
    block = http if first is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: {record_id(file, offset, url, date)}",
        f"WARC-Date: {date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z", f"WARC-Target-URI: {url}", f"WARC-IP-Address: {ip}",
        f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if first is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(first['file'], first['offset'], first['url'], first['date'])}"]
        # our own: what a reader needs without the other record
        head += [f"X-Refers-To-Page: {first['page_id']}"] * (first["page_id"] is not None) + [f"X-Payload-Length: {len(payload)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block


def write_warc(records: DataFrame, path: str) -> None:
    """WARC files of what with_references() returns."""
    names = ["url", "ip", "date", "http", "payload", "digest", "file", "offset", "first"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [warc_record(*r) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    write_lines(records.select(*names).mapInArrow(run, "value binary"), path, "\r\n\r\n")


def warc_head(at: Cursor) -> dict[str, str]:
    """The named fields up to the empty line."""
    head: dict[str, str] = {}
    while line := at.readline().rstrip(b"\r\n"):
        name, _, value = line.decode(errors="replace").partition(":")
        head[name.lower()] = value.strip()
    return head


def parse_warc(stream) -> Iterator[dict]:
    """Response and revisit records; what cannot be read has a reason, and reading goes on at the next line that begins a record."""
    at, lost = Cursor(stream), False
    while True:
        offset = at.offset
        line = at.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            if not lost:
                yield rejected(offset, "no record", line)
            lost = True
            continue
        head = warc_head(at)
        lost = True
        if not {"warc-type", "warc-record-id", "warc-target-uri", "warc-date", "warc-payload-digest"} <= set(head) or not head.get("content-length", "").isdigit():
            yield rejected(offset, "fields missing", line)
            continue
        length = int(head["content-length"])
        block = at.read(length)
        if len(block) < length:
            yield rejected(offset, "shorter than declared", line)
            at.again(block)
            continue
        lost = False
        http, payload = split_http(block)
        kind, said = head["warc-type"], head["warc-payload-digest"].partition(":")[2]
        number = lambda name: int(head[name]) if head.get(name, "").isdigit() else None
        if kind == "response" and hashlib.sha256(payload).hexdigest() != said:
            yield rejected(offset, "other digest", line)
            continue
        yield {
            "page_id": page_of(http), "url": head["warc-target-uri"], "record_type": kind, "payload_digest": said, "payload": payload,
            "payload_bytes": len(payload) if kind == "response" else number("x-payload-length"), "refers_to": number("x-refers-to-page"), "record_id": head["warc-record-id"], "date": head["warc-date"],
        }


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    schema = "page_id long, url string, record_type string, payload_digest string, payload binary, payload_bytes long, refers_to long, record_id string, date string, reason string"
    parse = parse_warc if with_payload else lambda stream: ({**r, "payload": None} for r in parse_warc(stream))
    found = read_archives(spark, path, parse, schema).where("reason is null").drop("reason")
    return found if with_payload else found.drop("payload")


def read_warc_rejected(spark: SparkSession, path: str) -> DataFrame:
    """file, offset, reason and the line of what read_warc() left out."""
    lines = lambda stream: (r for r in parse_warc(stream) if r.get("reason"))
    return read_archives(spark, path, lines, "file string, offset long, reason string, url string").withColumnRenamed("url", "line")


def convert(spark: SparkSession, arc_path: str, warc_path: str) -> None:
    """Every ARC record that can be read as a WARC record."""
    write_warc(with_references(read_arc(spark, arc_path), read_arc(spark, arc_path, with_payload=False)), warc_path)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    arc, warc = shared_path(spark, "arc"), shared_path(spark, "warc")
    write_arc(table(spark, sf_dir, "pages").select("page_id", "url", "html"), arc)
    convert(spark, arc, warc)
    return read_warc(spark, warc, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n, sha256(coalesce(html, '')) AS d FROM pages),
m AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p LEFT JOIN m ON p.d = m.d
"""
