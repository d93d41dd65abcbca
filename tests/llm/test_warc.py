import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from sparkstrata.llm.scratch import Scratch
from sparkstrata.llm.warc import parse_records, read_back, reconstruct, write_archive

SCHEMA = "page_id long, url string, html string, digest string, payload int"
ROWS = [(1, "http://a/", "same", "x", 1), (2, "http://b/", "same", "x", 1), (3, None, "same", "x", 1), (4, "http://c/\r\nWARC-Type: evil", None, None, None), (5, "u", "", "x", 1), (6, "u", "é😀" * 50_000, "x", 1), (None, "n", "same", "x", 1), (None, "n", "alone", "x", 1), (3, "again", "same", "x", 1)]


def want(rows, least):
    owner = {}
    for i, _, html, *_ in rows:
        if i is not None:
            owner[html or ""] = max(owner.get(html or "", i), i)
    out = []
    for i, _, html, *_ in rows:
        data = (html or "").encode()
        best = owner.get(html or "") if len(data) >= least else None
        again = best is not None and i != best
        out.append((i or 0, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", best if again else 0))
    return sorted(out)


@pytest.mark.parametrize("least", [0, 1, 5])
def test_read_back(spark, least):
    archive = write_archive(spark.createDataFrame(ROWS, SCHEMA), Scratch(spark, "t"), min_revisit_bytes=least)
    got = sorted((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or 0) for r in read_back(archive, Scratch(spark, "t")).collect())
    assert got == want(ROWS, least)
    assert archive.payloads.count() == len({r[2] or "" for r in ROWS})


def test_records_are_whole(spark):
    archive = write_archive(spark.createDataFrame(ROWS, SCHEMA), Scratch(spark, "t"))
    records = [bytes(r.record) for r in reconstruct(archive).collect()]
    assert len(records) == len(ROWS)
    for r in records:
        head, body = r.split(b"\r\n\r\n", 1)
        fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
        assert r.startswith(b"WARC/1.1\r\n") and int(fields[b"Content-Length"]) == len(body) - 4 and fields[b"WARC-Type"] in (b"response", b"revisit")
        if fields[b"WARC-Type"] == b"response":
            http, payload = body[:-4].split(b"\r\n\r\n", 1)
            assert http.startswith(b"HTTP/1.1 200 OK\r\n") and f"Content-Length: {len(payload)}".encode() in http
            assert fields[b"Content-Type"] == b"application/http; msgtype=response"
            assert base64.b32encode(hashlib.sha1(payload).digest()) == fields[b"WARC-Payload-Digest"].removeprefix(b"sha1:")
    evil = [r for r in records if b"evil" in r][0]
    assert b"\nWARC-Type: evil" not in evil


def test_parsing_checks_lengths_and_digests(spark):
    archive = write_archive(spark.createDataFrame(ROWS, SCHEMA), Scratch(spark, "t"))
    records = spark.createDataFrame([(bytes(r.record),) for r in reconstruct(archive).collect()], "record binary")
    assert {r.record_type for r in parse_records(records).collect()} == {"response", "revisit"}
    short = records.select(F.substring("record", 1, F.length("record") - 1).alias("record"))
    with pytest.raises(Exception, match="not as long"):
        parse_records(short).collect()
    other = spark.createDataFrame([(bytes(r.record).replace(b"alone", b"along"),) for r in records.collect()], "record binary")
    with pytest.raises(Exception, match="digest is not its payload"):
        parse_records(other).collect()


def test_a_very_long_payload(spark):
    rows = [(1, "u", "x" * 20_000_000, "d", 1), (2, "u", "x" * 20_000_000, "d", 1)]
    scratch = Scratch(spark, "t")
    got = sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or 0) for r in read_back(write_archive(spark.createDataFrame(rows, SCHEMA), scratch), scratch).collect())
    assert got == want(rows, 0)


def test_damage_shows(spark):
    scratch = Scratch(spark, "t")
    archive = write_archive(spark.createDataFrame(ROWS, SCHEMA), scratch)
    archive.payloads = archive.payloads.withColumn("payload", F.when(F.length("payload") == 4, F.lit(bytearray(b"sane"))).otherwise(F.col("payload")))
    with pytest.raises(Exception, match="does not match digest"):
        read_back(archive, Scratch(spark, "t")).collect()


def test_empty_table(spark):
    assert read_back(write_archive(spark.createDataFrame([], SCHEMA), Scratch(spark, "t")), Scratch(spark, "t")).collect() == []
