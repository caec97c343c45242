"""WARC archives: round trips through files, reassembly in any order, and records with faults."""

import base64
import gzip
import hashlib
import random

import pytest

from sigloom.llm import warc
from sigloom.llm.common import store

SCHEMA = "page_id long, url string, html string, block string, type string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "x") for r in rows], SCHEMA)


def judged(rows):
    """What each row must come back as: payload, type and page referred to."""
    payload = [(r[2] or "").encode() for r in rows]
    out = []
    for (page, url, _), data in zip(rows, payload):
        same = [(r[0] is not None, r[0] or 0) for r, d in zip(rows, payload) if d == data]
        last = max(same)
        again = len(data) >= 1000 and (page is not None, page or 0) < last
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", (last[1] if last[0] else None) if again else None))
    return sorted(out, key=str)


LONG = "é<p>\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\n" * 900
ROWS = [(1, "http://a/", "short"), (2, "http://b/", "short"), (3, None, None), (4, "http://c/", ""), (5, "http://d/", "x" * 999),
        (6, "http://e/", "x" * 999), (7, "http://f/", "y" * 1000), (8, "http://g/\r\nWARC-Type: warcinfo", "y" * 1000), (None, "http://h/", "y" * 1000),
        (9, "http://i/", LONG), (10, "http://j/", LONG), (11, "http://k/", LONG[:-1]), (11, "http://k/", LONG[:-1]), (None, None, "null id"),
        (12, "http://l/", "0\r\n\r\n"), (13, "http://m/", "\U0001f600" * 5000), (14, "", "\r\n" * 3000)]


def resolved(spark, path):
    return warc.resolve(store(warc.read_archives(spark, path).drop("payload"))).collect()


def test_round_trip(spark):
    path = warc.write_archives(frame(spark, ROWS), file_records=7)
    opened = warc.read_archives(spark, path).collect()
    assert not [r.problem for r in opened if r.problem]
    got = resolved(spark, path)
    assert sorted((tuple(r)[:5] for r in got), key=str) == judged(ROWS)
    texts = {r.page_id: bytes(r.payload) for r in opened if r.type == "response" and r.page_id is not None}
    assert all(texts[p] == (h or "").encode() for p, _, h in ROWS if p in texts) and len(texts) == 12
    records = warc.read_records(spark, path).collect()
    assert max(len(r.block) for r in records) <= warc.SEGMENT
    assert max(r.number or 0 for r in records) > 3 and {r.uri for r in records if r.page_id == 8} == {"http://g/%0D%0AWARC-Type: warcinfo"}


def test_empty_table(spark):
    assert resolved(spark, warc.write_archives(frame(spark, []))) == []


def test_hot_payload_and_repeated_rows(spark):
    rows = [(i, "u", "z" * 2000) for i in range(300)] + [(5000, "v", "w" * 40000)] * 200 + [(6000 + i, "u", f"{i}" * 40) for i in range(100)]
    assert sorted((tuple(r)[:5] for r in resolved(spark, warc.write_archives(frame(spark, rows)))), key=str) == judged(rows)


def test_segments_in_any_order_and_with_faults(spark):
    records = store(warc.read_records(spark, warc.write_archives(frame(spark, [(i, "u", f"{i}-" * 30000) for i in range(5)]))))
    rows = [r.asDict() for r in records.collect()]
    random.Random(1).shuffle(rows)
    by = {p: next(r["origin"] for r in rows if r["page_id"] == p) for p in range(5)}
    last = max(r["number"] for r in rows)

    def damaged(r):
        if r["origin"] == by[1] and r["number"] == 2:
            return None
        if r["origin"] == by[2] and r["number"] == last:
            return r | {"total": r["total"] + 1}
        if r["origin"] == by[3] and r["number"] == 1:
            return None
        if r["origin"] == by[4] and r["number"] == last:
            return None
        return r
    whole = warc.reassemble(spark.createDataFrame([d for r in rows if (d := damaged(r))], records.schema)).collect()
    assert {r.origin: r.problem for r in whole} == {by[0]: None, by[1]: "segments missing or at odds", by[2]: "another total length",
                                                    by[3]: "no first segment", by[4]: "no last segment"}
    (good,) = [r for r in whole if r.problem is None]
    assert warc.payload_of(bytes(good.block)) == b"0-" * 30000


def record(block, **fields):
    head = "WARC/1.1\r\n" + "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in fields.items()) + f"Content-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def test_foreign_archives(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n"
    good = record(http + b"4;a=b\r\nWiki\r\n5\r\npedia\r\n0\r\nX: y\r\n\r\n", WARC_Type="response", WARC_Record_ID="<a>", WARC_Payload_Digest="sha1:" + base64.b32encode(hashlib.sha1(b"Wikipedia").digest()).decode())
    plain = record(b"HTTP/1.0 200 OK\r\nA: b\r\n c\r\n\r\nbody", WARC_Type="response", WARC_Record_ID="<b>")
    wrong = record(http + b"5\r\nWiki\r\n0\r\n\r\n", WARC_Type="response", WARC_Record_ID="<c>")
    info = record(b"software: x", WARC_Type="warcinfo", WARC_Record_ID="<d>")
    digest = record(b"HTTP/1.0 200 OK\r\n\r\nbody", WARC_Type="response", WARC_Record_ID="<e>", WARC_Payload_Digest="sha1:00")
    lone = record(b"", WARC_Type="revisit", WARC_Record_ID="<f>", WARC_Refers_To="<none>")
    (tmp_path / "a.warc").write_bytes(good + b"junk\r\n\r\n" + plain + wrong + info + good[:-20])
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(digest) + gzip.compress(lone) + gzip.compress(record(b"raw", WARC_Type="resource", WARC_Record_ID="<g>")))
    (tmp_path / "c.warc").write_bytes(b"")
    got = warc.read_archives(spark, str(tmp_path)).collect()
    assert sorted((r.record_id or "", r.problem or "", bytes(r.payload or b"")) for r in got) == [
        ("", "no record header", b""), ("<a>", "", b"Wikipedia"), ("<a>", "cut off", b""), ("<b>", "", b"body"), ("<c>", "broken framing", b""),
        ("<d>", "", b""), ("<e>", "another digest", b""), ("<f>", "", b""), ("<g>", "", b"raw")]
    problems = {r.record_type: r.problem for r in resolved(spark, str(tmp_path)) if r.record_type == "revisit"}
    assert problems == {"revisit": "nothing to refer to"}


@pytest.mark.parametrize("size", [0, 1, warc.CHUNK - 1, warc.CHUNK, warc.CHUNK + 1, 3 * warc.CHUNK])
def test_framing(spark, size):
    from pyspark.sql import functions as F
    data = bytes(random.Random(size).randbytes(size))
    (row,) = spark.createDataFrame([(data,)], "d binary").select(warc.chunked(F.col("d")).cast("binary").alias("c")).collect()
    assert warc.unchunked(bytes(row.c)) == data
    assert size == 0 or warc.unchunked(bytes(row.c)[:-3]) is None
