"""WARC archives: segmented records written by Spark's text writer, read back and reassembled.

Writing is native. Every page becomes a ``response`` record whose block is an HTTP message with a chunked body;
a block longer than ``SEGMENT`` bytes is cut: the first piece stays a response (segment number 1), the others are
``continuation`` records that name the origin record, their number and, in the last one, the total length. Of
pages with equal payloads of at least ``REVISIT`` bytes, the one with the largest ``page_id`` is the response and
the others are ``revisit`` records without a block that refer to it. A record and the two line ends after it are
one line of a text file whose line separator is these line ends, so the files are plain WARC files on any store
that Spark writes to, and a lost executor costs a task that writes its file again. No record is longer than a
segment and its headers, and a file holds at most ``FILE_RECORDS`` records, so files stay small enough for the
reader to take one at a time.

Reading parses each file by its content lengths (gzip members are unpacked). Unsegmented records are finished on
the spot; segments are grouped by origin identifier, ordered by number and joined when the numbers are gapless and
the lengths add up to the stated total; then the chunked framing is decoded and the payload digest compared. Equal
segments are counted before they are grouped, so repeated copies of one record are never collected.

Defined results: a null ``html`` is an empty payload; a null ``url`` or ``page_id`` has no header and comes back
null. Null ids are the smallest. Rows with the same id, url and payload are the same record: all are responses, or
all revisit. An empty table gives no records. A record that is cut off, lacks segments, states another length or
digest, or has broken framing comes back with the reason in ``problem`` and without a payload; nothing is dropped.
Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_path, store

CHUNK = 4096            # bytes of payload in a chunk of the transfer framing
SEGMENT = 16_384        # bytes of a block kept in one record
FILE_RECORDS = 2_000    # records of a file
REVISIT = 1_000         # bytes from which equal payloads are written once
BATCH = 8 << 20         # bytes of blocks handed from Python to Spark at once

# Fixed values of the formats.
CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"

RECORDS = ("file string, offset long, type string, record_id string, origin string, number int, total long, "
           "uri string, refers_to string, digest string, page_id long, stated long, block binary, problem string")
_ARROW = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("type", pa.string()), ("record_id", pa.string()),
                    ("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("uri", pa.string()),
                    ("refers_to", pa.string()), ("digest", pa.string()), ("page_id", pa.int64()), ("stated", pa.int64()),
                    ("block", pa.binary()), ("problem", pa.string())])


# ------------------------------------------------------------------ writing
def _pieces(data: Column, size: int) -> Column:
    """``data`` (binary) cut into an array of at most ``size`` bytes each."""
    n = F.ceil(F.octet_length(data) / F.lit(size)).cast("int")
    cuts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(data, i * size + 1, F.lit(size)))
    return F.when(n > 0, cuts).otherwise(F.array().cast("array<binary>"))


def chunked(payload: Column, size: int = CHUNK) -> Column:
    """The chunked transfer framing of a binary column, as a string of the same bytes."""
    frames = F.transform(_pieces(payload, size), lambda p: F.concat(
        F.lower(F.hex(F.octet_length(p))), F.lit(CRLF), p.cast("string"), F.lit(CRLF)))
    return F.concat(F.array_join(frames, ""), F.lit("0\r\n\r\n"))


def _uuid(*parts: Column) -> Column:
    """A record identifier made from ``parts`` (nulls count as a value)."""
    seen = F.md5(F.to_json(F.struct(*[p.alias(f"p{i}") for i, p in enumerate(parts)])).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(seen, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _header(name: str, value: Column) -> Column:
    """One header line, or nothing for a null value; line ends inside the value are percent-encoded."""
    flat = F.replace(F.replace(value.cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), flat, F.lit(CRLF)), F.lit(""))


def write_archives(pages: DataFrame, segment: int = SEGMENT, revisit: int = REVISIT, date: str = "2024-01-01T00:00:00Z",
                   file_records: int = FILE_RECORDS, compression: str = "gzip") -> str:
    """Write ``pages(page_id, url, html)`` as WARC files and return their folder; ``compression`` may be ``none``."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    rows = rows.withColumn("rid", _uuid(F.col("page_id"), F.col("url"), F.col("digest")))
    # Which records revisit which: decided on identifiers and digests, without the payloads.
    slim = store(rows.where(F.octet_length("payload") >= revisit).select("digest", "rid", "page_id"))
    groups = store(slim.groupBy("digest").agg(F.max(F.struct("page_id", "rid")).alias("last"), F.min("rid").alias("low"), F.max("rid").alias("high"))
                   .where("low <> high").select("digest", F.col("last.rid").alias("first_seen")))
    again = store(slim.join(groups, "digest").where("rid <> first_seen").select("rid", "first_seen").distinct())
    rows = rows.join(again, "rid", "left")

    common = lambda kind, rid: F.concat(F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: "), rid, F.lit(f"\r\nWARC-Date: {date}\r\n"))
    about = F.concat(_header("WARC-Target-URI", F.col("url")), _header("Page-Id", F.col("page_id")),
                     F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"), F.lit(CRLF),
                     F.lit("Content-Type: application/http;msgtype=response\r\n"))
    again_record = F.concat(common("revisit", F.col("rid")), about, F.lit(f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: "),
                            F.col("first_seen"), F.lit("\r\nContent-Length: 0\r\n\r\n"))
    block = F.concat(F.lit(HTTP_HEAD), chunked(F.col("payload"))).cast("binary")
    rows = rows.withColumn("block", F.when(F.col("first_seen").isNull(), block))
    length, last = F.octet_length("block"), F.ceil(F.octet_length("block") / F.lit(segment)).cast("int")

    def record(piece: Column, i: Column) -> Column:
        number = i + 1
        mark = F.when(last > 1, F.concat(F.lit("WARC-Segment-Number: "), number.cast("string"), F.lit(CRLF))).otherwise(F.lit(""))
        total = F.when((last > 1) & (number == last), F.concat(F.lit("WARC-Segment-Total-Length: "), length.cast("string"), F.lit(CRLF))).otherwise(F.lit(""))
        first = F.concat(common("response", F.col("rid")), about)
        later = F.concat(common("continuation", _uuid(F.col("rid"), number)), F.lit("WARC-Segment-Origin-ID: "), F.col("rid"), F.lit(CRLF))
        return F.concat(F.when(i == 0, first).otherwise(later), mark, total, F.lit("Content-Length: "),
                        F.octet_length(piece).cast("string"), F.lit("\r\n\r\n"), piece.cast("string"))

    records = F.when(F.col("first_seen").isNotNull(), F.array(again_record)).otherwise(F.transform(_pieces(F.col("block"), segment), record))
    path = shared_path(pages.sparkSession, "warc")
    (rows.select(F.explode(records).alias("value")).write.option("lineSep", "\r\n\r\n")
     .option("maxRecordsPerFile", file_records).option("compression", compression).text(path))
    return path


# ------------------------------------------------------------------ reading
def _unpacked(data: bytes) -> bytes:
    """The bytes of a file; a gzip file may hold a member for each record."""
    if not data.startswith(b"\x1f\x8b"):
        return data
    out = []
    while data:
        member = zlib.decompressobj(31)
        out.append(member.decompress(data) + member.flush())
        data = member.unused_data
    return b"".join(out)


def _fields(head: bytes) -> dict[str, str]:
    found: dict[str, str] = {}
    name = None
    for line in head.decode("utf-8", "replace").split(CRLF):
        if line[:1] in (" ", "\t") and name:  # a folded line goes on
            found[name] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            name = name.strip().lower()
            found.setdefault(name, value.strip())
    return found


def _number(text: str | None) -> int | None:
    return int(text) if text is not None and re.fullmatch(r"-?\d{1,18}", text) else None


def parse_archive(file: str, data: bytes):
    """The records of one archive in order, as dicts of the columns of ``RECORDS``."""
    pos = 0
    while pos < len(data):
        row = dict.fromkeys(_ARROW.names) | {"file": file, "offset": pos}
        end = data.find(b"\r\n\r\n", pos)
        fields = _fields(data[pos:end]) if end >= 0 and data.startswith(b"WARC/", pos) else {}
        size = _number(fields.get("content-length"))
        if size is None or size < 0:
            after = data.find(b"\r\n\r\nWARC/", pos)
            row["problem"] = "no record header"
            pos = len(data) if after < 0 else after + 4
            yield row
            continue
        begin = end + 4
        row |= {"type": fields.get("warc-type"), "record_id": fields.get("warc-record-id"), "uri": fields.get("warc-target-uri"),
                "refers_to": fields.get("warc-refers-to"), "number": _number(fields.get("warc-segment-number")),
                "total": _number(fields.get("warc-segment-total-length")), "page_id": _number(fields.get("page-id")),
                "stated": size, "digest": re.sub("^sha1:", "", fields.get("warc-payload-digest", "")) or None}
        if row["number"] is not None:
            row["origin"] = fields.get("warc-segment-origin-id") or row["record_id"]
        row["block"] = data[begin:begin + size]
        if len(row["block"]) < size:
            row["problem"] = "cut off"
        pos = begin + size
        if data.startswith(b"\r\n\r\n", pos):
            pos += 4
        elif row["problem"] is None and pos < len(data):
            row["problem"] = "no line ends after the block"
            after = data.find(b"\r\n\r\nWARC/", pos)
            pos = len(data) if after < 0 else after + 4
        yield row


def unchunked(body: bytes) -> bytes | None:
    """The payload of a chunked body; None if the framing is broken."""
    out, pos = [], 0
    while True:
        end = body.find(b"\r\n", pos)
        size = re.fullmatch(rb"([0-9A-Fa-f]{1,15})[ \t]*(;.*)?", body[pos:end]) if end >= 0 else None
        if not size:
            return None
        n, begin = int(size[1], 16), end + 2
        if n == 0:  # trailer fields may follow, up to an empty line
            return b"".join(out) if body.startswith(b"\r\n", begin) or b"\r\n\r\n" in body[begin:] else None
        if body[begin + n:begin + n + 2] != b"\r\n":
            return None
        out.append(body[begin:begin + n])
        pos = begin + n + 2


def payload_of(block: bytes) -> bytes | None:
    """The payload of an HTTP message."""
    end = block.find(b"\r\n\r\n")
    if end < 0:
        return None
    coding = _fields(block[:end]).get("transfer-encoding", "").lower()
    return unchunked(block[end + 4:]) if coding.endswith("chunked") else block[end + 4:]


def _batches(rows, schema: pa.Schema, weight):
    """Arrow batches of dicts, each of a bounded number of bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 200 + len(row[weight] or b"")
        if size >= BATCH:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def _parse(batches):
    def rows():
        for batch in batches:
            for file, data in zip(batch.column(0), batch.column(1)):
                yield from parse_archive(file.as_py(), _unpacked(data.as_py()))
    yield from _batches(rows(), _ARROW, "block")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives in ``path`` as they stand in the files (see ``RECORDS``)."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_parse, RECORDS)


#: Records that are segments to be joined.
SEGMENTED = "number IS NOT NULL AND record_id IS NOT NULL AND problem IS NULL"


def reassemble(records: DataFrame) -> DataFrame:
    """Join the segments of ``records`` by origin; a row for each whole record, with its block."""
    parts = records.where(SEGMENTED)
    # Copies of one record have equal segments; count them, so that a group holds each segment once.
    same = parts.withColumn("hash", F.sha2("block", 256)).groupBy("origin", "number", "hash").agg(
        F.count("*").alias("copies"), F.max("total").alias("total"), F.any_value("block").alias("block"),
        F.max(F.when(F.col("type") != "continuation", F.struct("file", "offset", "type", "record_id", "uri", "refers_to", "digest", "page_id"))).alias("head"))
    whole = same.groupBy("origin").agg(
        F.array_sort(F.collect_list(F.struct("number", "block"))).alias("parts"), F.max("total").alias("total"),
        F.max("head").alias("head"), F.max("copies").alias("copies"), F.min("copies").alias("least"))
    n, got = F.size("parts"), F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + F.octet_length(p["block"]))
    gapless = F.transform("parts", lambda p: p["number"]) == F.sequence(F.lit(1), n)
    problem = (F.when(F.col("head").isNull(), "no first segment").when(~gapless | (F.col("least") != F.col("copies")), "segments missing or at odds")
               .when(F.col("total").isNull(), "no last segment").when(F.col("total") != got, "another total length"))
    joined = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["block"]))
    whole = whole.select("head.*", "origin", got.alias("stated"), "total", F.lit(1).alias("number"),
                         F.when(problem.isNull(), joined).alias("block"), problem.alias("problem"), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    rest = records.where(f"NOT ({SEGMENTED})")
    return rest.unionByName(whole.select(*records.columns))


def _open(batches):
    """Payloads of whole records: transfer framing decoded, digest compared."""
    for batch in batches:
        def rows(batch=batch):
            for row in batch.to_pylist():
                block, problem, payload = row.pop("block"), row["problem"], None
                if problem is None and row["type"] == "response":
                    payload = payload_of(block)
                    problem = "broken framing" if payload is None else None
                elif problem is None and row["type"] == "resource":
                    payload = block
                row |= {"payload_bytes": None, "payload_digest": None, "payload": None}
                if payload is not None:
                    sha1 = hashlib.sha1(payload)
                    found = sha1.hexdigest()
                    # Archives state digests in base 32 or in hexadecimal digits.
                    if (row["digest"] or found).upper() not in (found.upper(), base64.b32encode(sha1.digest()).decode()):
                        problem = "another digest"
                    else:
                        row |= {"payload_bytes": len(payload), "payload_digest": found, "payload": payload}
                yield row | {"problem": problem}
        yield from _batches(rows(), _OPENED, "payload")


_KEPT = [f for f in _ARROW if f.name not in ("block", "number", "total", "stated", "origin")]
_OPENED = pa.schema([*_KEPT, ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
OPENED = ("file string, offset long, type string, record_id string, uri string, refers_to string, digest string, page_id long, "
          "problem string, payload_bytes long, payload_digest string, payload binary")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Whole records of the archives in ``path`` with their payloads (see ``OPENED``); revisits have none."""
    records = read_records(spark, path)
    # Only segments are stored; whole records are parsed again and opened on the spot.
    pieces = reassemble(store(records.where(SEGMENTED)))
    rows = records.where(f"NOT ({SEGMENTED})").unionByName(pieces).select(*[f.name for f in _KEPT], "block")
    return rows.mapInArrow(_open, OPENED)


def resolve(records: DataFrame) -> DataFrame:
    """Length, digest and page of each record, a revisit's from the record that it refers to.

    ``records`` is a stored table with the columns of ``OPENED`` but the payload."""
    target = (records.where("type = 'response' and problem is null").groupBy(F.col("record_id").alias("refers_to"))
              .agg(F.max("page_id").alias("of_page"), F.max("payload_bytes").alias("of_bytes"), F.max("payload_digest").alias("of_digest")))
    rows = records.join(store(target), "refers_to", "left")
    lost = (F.col("type") == "revisit") & F.col("of_digest").isNull()
    other = (F.col("type") == "revisit") & (F.col("digest") != F.col("of_digest"))
    return rows.select("page_id", F.coalesce("payload_bytes", "of_bytes").alias("payload_bytes"), F.coalesce("payload_digest", "of_digest").alias("payload_digest"),
                       F.col("type").alias("record_type"), F.col("of_page").alias("refers_to"),
                       F.coalesce("problem", F.when(lost, "nothing to refer to").when(other, "another digest")).alias("problem"))
