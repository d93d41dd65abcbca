"""Deferred content: markup streams made by hand, read and related."""

import struct

from pyspark.sql import functions as F

from sparkstrata.sources import deferred, resources
from tests.builders import markup_bytes, record

HEAD, ELEMENT, END = 28, record(3, bytes(3)), record(4)


def string_key(ref, position):
    return record(38, struct.pack("<hibb", ref, position, 0, 0), True)


def type_key(ref, position):
    return record(39, struct.pack("<hBibb", ref, 0, position, 0, 0))


def section(*content, size=None):
    body = b"".join(content)
    return record(37, struct.pack("<i", len(body) if size is None else size)) + body


def local(flags, ref):
    return record(55, struct.pack("<Bh", flags, ref))


def parsed(spark, streams):
    rows = [(k, bytearray(markup_bytes(*v)), HEAD + sum(map(len, v))) for k, v in streams.items()]
    df = spark.createDataFrame(rows, "id string, content binary, size long")
    records = deferred.records_table(df.select("id", resources.markup_records(F.col("content")).alias("m"))).cache()
    return records, df.select("id", "size")


def value(inner=b""):
    return ELEMENT + inner + END


def test_sections(spark):
    good = section(string_key(1, 0), value())
    streams = {
        "good": [ELEMENT, good, END],
        "leaves": [ELEMENT, section(string_key(1, 0), value(), size=9_999), END],
        "negative": [ELEMENT, section(value(), size=-1), END],
        "middle": [ELEMENT, section(string_key(1, 0), value(), size=3), END],
        "inner": [ELEMENT, section(ELEMENT, END, size=len(ELEMENT)), END],
        "ownerless": [section(size=0), END],
        "twice": [ELEMENT, section(string_key(1, 0), value(), section(size=0)), END],
        "two": [ELEMENT, ELEMENT, good, END, ELEMENT, good, END, END],
    }
    records, sizes = parsed(spark, streams)
    got = {}
    for r in deferred.sections(records, sizes).orderBy("id", "ord").collect():
        got.setdefault(r.id, []).append(r.error)
    leaves, middle, owner = "the content leaves the data", "the content ends at no element's end", "the content does not end where its owner does"
    assert got == {"good": [None], "leaves": [leaves], "negative": [leaves], "middle": [middle], "inner": [owner], "ownerless": [owner], "twice": [None, "sections overlap"], "two": [None, None]}


def test_headers_and_ranges(spark):
    first, second = value(record(50, struct.pack("<h", 0))), value()
    complex_key = record(40, struct.pack("<hBibb", 9, 0, len(first), 0, 0)) + record(3, bytes(3)) + record(4) + record(41)
    verbose = record(48, bytes(3)) + record(49)
    streams = {
        "good": [ELEMENT, section(string_key(1, 0), local(0, 5), verbose, complex_key, local(1, 6), first, second), END],
        "keyless": [ELEMENT, section(value()), END],
        "early": [ELEMENT, section(local(0, 5), string_key(1, 0), value()), END],
        "open": [ELEMENT, section(type_key(1, 0), record(48, bytes(3))), END],
        "stray": [ELEMENT, section(type_key(1, 0), record(49), value()), END],
        "reference": [ELEMENT, section(type_key(1, 0), record(50, bytes(2)), value()), END],
        "nothing": [ELEMENT, section(), END],
    }
    records, sizes = parsed(spark, streams)
    found = deferred.sections(records, sizes)
    assert found.where("error is not null").count() == 0
    h = deferred.headers(records, found)
    keys = h.keys.orderBy("key_ord").collect()
    assert [(k.id, k.key_ord, k.kind, k.ref, k.position) for k in keys] == [("good", 0, "string", 1, 0), ("good", 1, "complex", 9, len(first))]
    assert [(r.key_ord, r.local_id, r.kind, r.ref) for r in h.local.orderBy("key_ord", "local_id").collect()] == [(0, 0, "string-reference", 5), (0, 1, "verbose", None), (1, 0, "type-reference", 6)]
    assert {r.id: r.error for r in h.errors.collect()} == {"keyless": "the content has no keys", "early": "a local resource has no key", "open": "a key or resource does not end", "stray": "a record does not belong in the header", "reference": "a record does not belong in the header"}
    kept, over = deferred.cap_keys(h.keys, 1)
    assert [(r.key_ord, r.whole) for r in kept.collect()] == [(0, False)] and over.first().error == "more than 1 keys"
    kept, over = deferred.cap_keys(h.keys)
    ranges = resources.deferred_ranges(kept.where("whole").drop("content_start", "content_end"), kept.select("section", "content_start", "content_end").distinct()).withColumn("id", F.col("section.id"))
    assert [r.high - r.low for r in ranges.orderBy("key_ord").collect()] == [len(first), len(second)] and ranges.where("not ok").count() == 0
    references = records.where("type = 50").select("id", "ord", F.col("start").cast("long").alias("offset"))
    lost = deferred.unscoped_references(references, ranges, references.where("false"))
    assert [r.id for r in lost.collect()] == ["good"] and deferred.unscoped_references(references, ranges, references).count() == 0
    flags = spark.createDataFrame([("good", True, False), ("keyless", False, True), ("early", True, False)], "id string, tree_complete boolean, values_truncated boolean")
    assert {(r.id, r.keys, r.complete, r.error) for r in deferred.status(flags, kept, h.errors, over, lost).collect()} == {("good", 2, False, "a reference has no property scope"), ("keyless", 0, False, "the content has no keys"), ("early", 0, False, "a local resource has no key")}
    cut = flags.withColumn("tree_complete", F.lit(False))
    assert {r.id: r.error for r in deferred.status(cut, kept, over).collect()} == {"good": "the element tree is incomplete", "keyless": None, "early": None}
