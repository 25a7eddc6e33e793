"""Conversion of legacy ARC archives to WARC.

``read_arc`` walks each file by the declared lengths: the version block names the version, the version
fixes the fields of every record's header line. ``to_warc`` synthesises what WARC wants and ARC lacks: a
record id (from file and offset, so that a rerun gives the same), a timestamp (from the 14-digit date), a
record type and a payload digest. Of records with equal payloads of at least REVISIT_BYTES, the one with
the largest row id (then file, then offset) is the response and the others revisit it; a revisit keeps its
HTTP head, not its payload. ``read_warc`` reads the result back.

Both kinds of archive are written by Spark's text writer, one file a partition, as one gzip stream: every
record ends in a line feed, which is the writer's separator. So any file system works, and a lost task
leaves nothing behind.

Defined results: a null html is an empty payload, a null url the address ``unknown:``; white space and
controls in an address are percent-encoded; a null page_id stays null; repeated rows are records of their
own; an empty table gives no records. A file that breaks off, has a bad header line or a wrong length yields one row with
``error`` set for each such place, and its records from the next line on that is a header; what no longer
unzips is lost from there. ``to_warc`` writes those rows to a table where it is named one. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REVISIT_BYTES = 1000
BATCH_BYTES = 4_000_000
ROW_HEADER = "X-Row-Id"
# fixed by the two versions of the format
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset",
        "Filename", "Archive-length"],
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = ("file string, offset long, version int, url string, ip string, date string, mime string, row_id long, "
           "head binary, payload binary, payload_bytes long, digest string, error string")


def _batches(rows: Iterable[tuple], schema: pa.Schema, weight) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about BATCH_BYTES by ``weight(row)``."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += weight(row)
        if size >= BATCH_BYTES or len(held) >= 10_000:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


# --- ARC -------------------------------------------------------------------------------------------------


def arc_head(version: int, name: str) -> bytes:
    """The version block of a file, without the separator behind it."""
    body = f"{version} 0 signalsieve\n{' '.join(ARC_FIELDS[version])}\n".encode()
    extra = " 200 - - 0 " + name if version == 2 else ""
    return f"filedesc://{name} 0.0.0.0 20240101000000 text/plain{extra} {len(body)}\n".encode() + body


def arc_record(version: int, name: str, row_id: int | None, url: str | None, payload: bytes, offset: int) -> bytes:
    """One record: its header line and the HTTP response."""
    address = quote(url, safe="%/:=&?~#+!$,;'@()*[]") if url else "unknown:"
    row = f"{ROW_HEADER}: {row_id}\r\n" if row_id is not None else ""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{row}Content-Length: {len(payload)}\r\n\r\n"
    block = head.encode() + payload
    extra = f" 200 - - {offset} {name}" if version == 2 else ""
    return f"{address} 0.0.0.0 20240101000000 text/html{extra} {len(block)}\n".encode() + block


def write_arc(pages: DataFrame, path: str) -> None:
    """Archives of (page_id, url, html). Partitions take version 1 and 2 in turn."""
    schema = pa.schema([("value", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        version, name = 1 + part % 2, f"pages-{part:05d}.arc"

        def records() -> Iterator[tuple[bytes]]:
            head = arc_head(version, name)
            at = len(head) + 1
            yield (head,)
            for batch in batches:
                for row_id, url, html in zip(*(batch.column(c) for c in ("page_id", "url", "html"))):
                    payload = (html.as_py() or "").encode()
                    record = arc_record(version, name, row_id.as_py(), url.as_py(), payload, at)
                    at += len(record) + 1
                    yield (record,)

        yield from _batches(records(), schema, lambda r: len(r[0]))

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "value binary")
    _write(rows, path)


def _write(records: DataFrame, path: str) -> None:
    """Bytes as they are, one record a line-feed."""
    records.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\n").option(
        "compression", "gzip").text(path)


class Reader:
    """Takes lines and lengths off a gzip or plain stream without holding the whole of it."""

    def __init__(self, data: bytes):
        self.data = memoryview(data)
        self.zipped = data[:2] == b"\x1f\x8b"
        self.inflate = zlib.decompressobj(31) if self.zipped else None
        self.at = 0  # in the compressed data
        self.buffer = bytearray()
        self.offset = 0  # of the buffer's start in the plain data

    def _more(self) -> bool:
        if self.at >= len(self.data):
            return False
        chunk = bytes(self.data[self.at : self.at + (1 << 16)])
        self.at += len(chunk)
        while self.zipped and chunk:
            self.buffer += self.inflate.decompress(chunk)
            chunk = self.inflate.unused_data
            if self.inflate.eof:  # a member of its own for each record is common
                self.inflate = zlib.decompressobj(31)
        if not self.zipped:
            self.buffer += chunk
        return True

    def line(self) -> bytes | None:
        """The next line without its end, or None at the end of the stream."""
        seen = 0
        while (end := self.buffer.find(b"\n", seen)) < 0:
            seen = len(self.buffer)
            if not self._more():
                if not self.buffer:
                    return None
                end = len(self.buffer)
                break
        out = bytes(self.buffer[:end])
        self._drop(min(end + 1, len(self.buffer)))
        return out.removesuffix(b"\r")

    def take(self, length: int) -> bytes:
        while len(self.buffer) < length and self._more():
            pass
        if len(self.buffer) < length:
            raise ValueError(f"{length} bytes declared, {len(self.buffer)} left")
        out = bytes(self.buffer[:length])
        self._drop(length)
        return out

    def _drop(self, length: int) -> None:
        del self.buffer[:length]
        self.offset += length


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """(head with its blank line, payload); a block that is not an HTTP response is all payload."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    found = re.search(rb"\r?\n\r?\n", block)
    return (block[: found.end()], block[found.end() :]) if found else (block, b"")


def http_number(head: bytes, name: str) -> int | None:
    found = re.search(rb"(?im)^" + re.escape(name.encode()) + rb":[ \t]*(-?\d+)[ \t]*\r?$", head)
    return int(found[1]) if found else None


def _length(field: bytes) -> int:
    if not re.fullmatch(rb"[0-9]+", field):
        raise ValueError(f"no length: {field[:40]!r}")
    return int(field)


def _is_arc_header(line: bytes, fields: list[str]) -> bool:
    """Whether a line behind damage is a header beyond doubt: all fields, an address, 14 digits, a length."""
    parts = line.rsplit(b" ", len(fields) - 1)
    return (len(parts) == len(fields) and bool(re.match(rb"[A-Za-z][A-Za-z0-9+.-]*:", parts[0]))
            and bool(re.fullmatch(rb"[0-9]{14}", parts[2])) and bool(re.fullmatch(rb"[0-9]+", parts[-1])))


def _next_header(reader: Reader, is_header: Callable[[bytes], bool]) -> tuple[int, bytes | None]:
    """(offset, line) of the next line that is a header; (end, None) where there is none."""
    while True:
        at = reader.offset
        line = reader.line()
        if line is None or is_header(line):
            return at, line


def parse_arc(name: str, data: bytes) -> Iterator[tuple]:
    """RECORDS of a file, its version block first (mime ``filedesc``)."""
    reader, version = Reader(data), 1
    fields = ARC_FIELDS[1]
    damaged = False
    while True:
        at = reader.offset
        try:
            if damaged:
                at, line = _next_header(reader, lambda x: _is_arc_header(x, fields))
                damaged = False
            else:
                line = reader.line()
            if line is None:
                return
            if not line:
                continue
            is_head = line.startswith(b"filedesc://")
            # the last field is the length in every version, and the address itself may hold blanks
            parts = line.split(b" ") if is_head else line.rsplit(b" ", len(fields) - 1)
            if not is_head and len(parts) != len(fields):
                raise ValueError(f"{len(parts)} fields, {len(fields)} expected")
            block = reader.take(_length(parts[-1]))
            if is_head:
                version = int(block.split(b" ", 1)[0])
                fields = ARC_FIELDS[version]
        except (ValueError, KeyError, zlib.error) as problem:
            yield (name, at, version, None, None, None, None, None, b"", b"", 0, None, str(problem))
            if isinstance(problem, zlib.error):
                return
            damaged = True
            continue
        url, ip, date, mime = (p.decode("utf-8", "replace") for p in parts[:4])
        if is_head:
            yield (name, at, version, url, ip, date, "filedesc", None, b"", block, len(block), None, None)
            continue
        head, payload = split_http(block)
        yield (name, at, version, url, ip, date, mime, http_number(head, ROW_HEADER), head, payload, len(payload),
               hashlib.sha1(payload).hexdigest(), None)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _parsed(spark: SparkSession, path: str, parse, ddl: str, schema: pa.Schema, weight) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for name, data in zip(batch.column("path"), batch.column("content")):
                    yield from parse(name.as_py().rsplit("/", 1)[-1], data.as_py())

        yield from _batches(rows(), schema, weight)

    return _files(spark, path).mapInArrow(run, ddl)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (f.split() for f in ddl.split(","))])


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """RECORDS of all archives below ``path``."""
    return _parsed(spark, path, parse_arc, RECORDS, _arrow(RECORDS), lambda r: len(r[8]) + len(r[9]) + 200)


# --- WARC ------------------------------------------------------------------------------------------------


def record_id(file: Column, offset: Column) -> Column:
    """A URN from file and offset."""
    h = F.md5(F.concat_ws(" ", file, offset.cast("string")))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (14, 3), (18, 3), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), cut[0], F.lit("-"), cut[1], F.lit("-8"), cut[2], F.lit("-a"), cut[3],
                    F.lit("-"), cut[4], F.lit(">"))


def warc_date(date: Column) -> Column:
    """14 digits, or fewer padded to whole units, as an instant; the epoch where there are none."""
    digits = F.when(date.rlike(r"^\d{4,14}$"), date)
    full = F.concat(digits, F.substring(F.lit("00000101000000"), F.length(digits) + 1, F.lit(14)))
    parsed = F.try_to_timestamp(full, F.lit("yyyyMMddHHmmss"))
    return F.date_format(F.coalesce(parsed, F.timestamp_seconds(F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(name + ": "), value, F.lit("\r\n")), F.lit(""))


def warc_records(records: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """(value) a WARC record per record that was read; version blocks become warcinfo records.

    Winners among equal payloads are found on narrow columns, combined before they are shuffled; only
    digests that occur more than once meet the wide records again, and a revisit drops its payload.
    """
    good = records.where("error IS NULL")
    place = F.struct(F.col("row_id"), F.col("file"), F.col("offset"))
    winners = (
        good.where((F.col("payload_bytes") >= revisit_bytes) & F.col("digest").isNotNull())
        .groupBy("digest").agg(F.max(place).alias("win"), F.count(F.lit(1)).alias("n")).where("n > 1")
        .select(F.col("digest").alias("w_digest"), "win")
    )
    own = F.struct(F.col("file"), F.col("offset"))
    first = F.struct(F.col("win.file").alias("file"), F.col("win.offset").alias("offset"))
    joined = good.join(
        winners, (F.col("digest") == F.col("w_digest")) & (F.col("payload_bytes") >= revisit_bytes), "left")
    again = F.col("win").isNotNull() & (own != first)
    kind = (
        F.when(F.col("mime") == "filedesc", "warcinfo").when(again, "revisit")
        .when(F.octet_length("head") > 0, "response").otherwise("resource")
    )
    typed = joined.select("*", kind.alias("kind"))
    revisit = F.col("kind") == "revisit"
    body = F.when(revisit, F.col("head")).otherwise(F.concat("head", "payload"))
    content = (
        F.when(F.col("kind") == "warcinfo", "text/plain")
        .when(F.col("kind") == "resource", F.col("mime")).otherwise("application/http; msgtype=response")
    )
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.col("kind")),
        _line("WARC-Record-ID", record_id(F.col("file"), F.col("offset"))),
        _line("WARC-Date", warc_date(F.col("date"))),
        _line("WARC-Filename", F.when(F.col("kind") == "warcinfo", F.col("file"))),
        _line("WARC-Target-URI", F.when(F.col("kind") != "warcinfo", F.col("url"))),
        _line("WARC-IP-Address", F.when(F.col("kind") != "warcinfo", F.col("ip"))),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _line("WARC-Profile", F.when(revisit, F.lit(REVISIT_PROFILE))),
        _line("WARC-Refers-To", F.when(revisit, record_id(F.col("win.file"), F.col("win.offset")))),
        _line("WARC-Refers-To-Row", F.when(revisit, F.col("win.row_id").cast("string"))),
        _line("Content-Type", content),
        _line("Content-Length", F.octet_length(body).cast("string")),
        F.lit("\r\n"),
    )
    # the writer's separator is the last line feed of a record
    return typed.select(F.concat(F.encode(head, "UTF-8"), body, F.encode(F.lit("\r\n\r"), "UTF-8")).alias("value"))


def to_warc(spark: SparkSession, arc_path: str, warc_path: str, revisit_bytes: int = REVISIT_BYTES,
            errors_path: str | None = None) -> None:
    """Converts all archives below ``arc_path``. Damaged places go to a Parquet table (file, offset, error) at
    ``errors_path``, for which the archives are read once more."""
    records = read_arc(spark, arc_path)
    _write(warc_records(records, revisit_bytes), warc_path)
    if errors_path:
        records.where("error IS NOT NULL").select("file", "offset", "error").write.parquet(errors_path)


WARC_RECORDS = ("file string, offset long, record_type string, record_id string, url string, date string, "
                "row_id long, payload_bytes long, payload_digest string, refers_to string, refers_to_row long, "
                "error string")


def parse_warc(name: str, data: bytes) -> Iterator[tuple]:
    """WARC_RECORDS of a file. Digest and size are those of the full payload: of a response they are
    taken from its bytes, of a revisit from what it declares."""
    reader, damaged = Reader(data), False
    while True:
        at = reader.offset
        try:
            if damaged:
                at, line = _next_header(reader, lambda x: bool(re.fullmatch(rb"WARC/[0-9]\.[0-9]+", x)))
                damaged = False
            else:
                line = reader.line()
            if line is None:
                return
            if not line:
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError("no WARC version line")
            fields = {}
            while line := reader.line():
                key, _, value = line.partition(b":")
                fields[key.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
            block = reader.take(_length(fields["content-length"].encode()))
        except (ValueError, KeyError, zlib.error) as problem:
            yield (name, at, None, None, None, None, None, None, None, None, None, str(problem))
            if isinstance(problem, zlib.error):
                return
            damaged = True
            continue
        kind = fields.get("warc-type")
        head, payload = split_http(block) if kind in ("response", "revisit") else (b"", block)
        if kind == "revisit":
            size, digest = http_number(head, "Content-Length"), fields["warc-payload-digest"].removeprefix("sha1:")
        else:
            size, digest = len(payload), hashlib.sha1(payload).hexdigest()
        row = fields.get("warc-refers-to-row")
        yield (name, at, kind, fields.get("warc-record-id"), fields.get("warc-target-uri"), fields.get("warc-date"),
               http_number(head, ROW_HEADER), size, digest, fields.get("warc-refers-to"), int(row) if row else None, None)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """WARC_RECORDS of all archives below ``path``, without their payloads."""
    return _parsed(spark, path, parse_warc, WARC_RECORDS, _arrow(WARC_RECORDS), lambda r: 500)
