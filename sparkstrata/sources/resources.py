"""Embedded resources: the serialised resource table and the markup (BAML) record stream.

Both are parsed where the bytes lie; what relates entries to each other afterwards (where one entry's
data ends, element trees, counts) is relational.
"""

from __future__ import annotations

import struct
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.lazy import arrow_function
from ..operators.resolve import interval_lookup

TABLE = "struct<status:string,error:string,truncated:boolean,entries:array<struct<ord:int,name:string,type:string,position:int,data:binary>>>"
RECORDS = "struct<status:string,error:string,reader_version:string,updater_version:string,writer_version:string,truncated:boolean,records:array<struct<ord:int,type:int,name:string,start:int,payload_start:int,stop:int,number:int,ref:int,flags:int>>,strings:array<struct<id:int,value:string>>,types:array<struct<id:int,assembly:int,name:string>>,attributes:array<struct<id:int,owner:int,name:string>>,assemblies:array<struct<id:int,name:string>>>"
# The resource table's magic number, versions and reader type, and bounds on it.
MAGIC, HEADER_VERSION, TABLE_VERSION = -1091581234, 1, 2
READER = "System.Resources.Extensions.DeserializingResourceReader,"
MAX_ENTRIES, MAX_TYPES, MAX_STRING_BYTES = 20_000, 2_000, 16_384
#: The built-in type codes of the table.
BUILT_IN = {0: "null", 1: "System.String", 2: "System.Boolean", 3: "System.Char", 4: "System.Byte", 5: "System.SByte", 6: "System.Int16", 7: "System.UInt16", 8: "System.Int32", 9: "System.UInt32", 10: "System.Int64", 11: "System.UInt64", 12: "System.Single", 13: "System.Double", 14: "System.Decimal", 15: "System.DateTime", 16: "System.TimeSpan", 32: "System.Byte[]", 33: "System.IO.Stream"}
FIRST_NAMED_TYPE = 64


class _Broken(ValueError):
    pass


class _Cursor:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def int32(self) -> int:
        if self.at + 4 > len(self.data):
            raise _Broken("the data end early")
        self.at += 4
        return struct.unpack_from("<i", self.data, self.at - 4)[0]

    def packed(self, stop: int | None = None) -> int:
        value, shift, stop = 0, 0, len(self.data) if stop is None else stop
        while shift < 35:
            if self.at >= stop:
                raise _Broken("a length is cut off")
            byte = self.data[self.at]
            self.at += 1
            value |= (byte & 0x7F) << shift
            if byte < 0x80:
                if value > 0x7FFFFFFF:
                    break
                return value
            shift += 7
        raise _Broken("a length is malformed")

    def text(self, stop: int, encoding: str = "utf-8") -> str:
        size = self.packed(stop)
        if size > MAX_STRING_BYTES or self.at + size > stop:
            raise _Broken("a string is too long")
        self.at += size
        return self.data[self.at - size : self.at].decode(encoding)


def read_table(data: bytes | None, limit: int = MAX_ENTRIES) -> dict:
    """Name, type, position and data of every entry; data end where the next entry's begin."""
    none = {"status": "not matched", "error": None, "truncated": False, "entries": []}
    c = _Cursor(data or b"")
    try:
        if c.int32() != MAGIC or c.int32() != HEADER_VERSION:
            return none
        stop = c.int32()
        stop += c.at
        if stop > len(c.data) or not c.text(stop).startswith(READER):
            return none
    except (_Broken, UnicodeDecodeError):
        return none
    try:
        c.text(stop)
        c.at = stop
        if c.int32() != TABLE_VERSION:
            raise _Broken("the table's version is unknown")
        count, n_types = c.int32(), c.int32()
        if not 0 <= count <= MAX_ENTRIES or not 0 <= n_types <= MAX_TYPES:
            raise _Broken("the table is too large")
        types = [c.text(len(c.data)) for _ in range(n_types)]
        c.at += -c.at % 8 + 4 * count
        names = [c.int32() for _ in range(count)]
        base = c.int32()
        if min(names, default=0) < 0 or not c.at <= base <= len(c.data) or (count and base == len(c.data)):
            raise _Broken("the table's offsets do not fit")
        found, section = [], c.at
        for place in names:
            n = _Cursor(c.data, section + place)
            if place > base - section:
                raise _Broken("a name lies outside its section")
            name = n.text(base, "utf-16-le")
            position = n.int32()
            if not 0 <= position < len(c.data) - base:
                raise _Broken("an entry lies outside the data")
            found.append((name, position))
        edges = sorted(p for _, p in found)
        if len(set(edges)) != len(edges):
            raise _Broken("two entries share a position")
        following = dict(zip(edges, [*edges[1:], len(c.data) - base], strict=True))
        entries = []
        for i, (name, position) in enumerate(found[:limit]):
            d, end = _Cursor(c.data, base + position), base + following[position]
            code = d.packed(end)
            kind = types[code - FIRST_NAMED_TYPE] if FIRST_NAMED_TYPE <= code < FIRST_NAMED_TYPE + len(types) else BUILT_IN.get(code)
            if kind is None:
                raise _Broken("an entry's type is unknown")
            entries.append({"ord": i, "name": name, "type": kind, "position": position, "data": c.data[d.at : end]})
        return {"status": "parsed", "error": None, "truncated": count > limit, "entries": entries}
    except (_Broken, UnicodeDecodeError) as e:
        return none | {"status": "invalid", "error": str(e)}


@arrow_function(TABLE)
def resource_table(contents: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_table(None if c is None else bytes(c)) for c in contents], columns=["status", "error", "truncated", "entries"])


def entry_ends(entries: DataFrame, key: str) -> DataFrame:
    """S22 as a relation: entries (key, position, limit) with ``stop``, the next position or the limit.
    Entries that share a position go by their other columns, so no result depends on how rows arrive."""
    others = [F.col(f"`{c}`") for c, kind in entries.dtypes if c not in (key, "position") and "map<" not in kind]
    w = W.partitionBy(key).orderBy("position", *others)
    return entries.withColumn("stop", F.coalesce(F.lead("position").over(w), F.col("limit")))


# Names of the markup's record types, by number.
RECORD_NAMES = [
    "Unknown", "DocumentStart", "DocumentEnd", "ElementStart", "ElementEnd", "Property", "PropertyCustom", "PropertyComplexStart", "PropertyComplexEnd", "PropertyArrayStart",
    "PropertyArrayEnd", "PropertyIListStart", "PropertyIListEnd", "PropertyIDictionaryStart", "PropertyIDictionaryEnd", "LiteralContent", "Text", "TextWithConverter", "RoutedEvent", "ClrEvent",
    "XmlnsProperty", "XmlAttribute", "ProcessingInstruction", "Comment", "DefTag", "DefAttribute", "EndAttributes", "PIMapping", "AssemblyInfo", "TypeInfo",
    "TypeSerializerInfo", "AttributeInfo", "StringInfo", "PropertyStringReference", "PropertyTypeReference", "PropertyWithExtension", "PropertyWithConverter", "DeferableContentStart", "DefAttributeKeyString", "DefAttributeKeyType",
    "KeyElementStart", "KeyElementEnd", "ConstructorParametersStart", "ConstructorParametersEnd", "ConstructorParameterType", "ConnectionId", "ContentProperty", "NamedElementStart", "StaticResourceStart", "StaticResourceEnd",
    "StaticResourceId", "TextWithId", "PresentationOptionsAttribute", "LineNumberAndPosition", "LinePosition", "OptimizedStaticResource", "PropertyWithStaticResourceId",
]
# Payload sizes of records; those listed as variable begin with their size.
VARIABLE = {5, 6, 15, 16, 17, 18, 20, 25, 27, 28, 29, 30, 31, 32, 36, 38, 51, 52}
SIZES = {1: 6, 35: 6, 39: 9, 40: 9, 53: 8} | dict.fromkeys((2, 4, 8, 10, 12, 14, 41, 42, 43, 49), 0) | dict.fromkeys((3, 48, 55), 3) | dict.fromkeys((7, 9, 11, 13, 44, 46, 50), 2) | dict.fromkeys((33, 34, 37, 45, 54, 56), 4)
MAX_RECORDS, HEADER_BYTES = 100_000, 28


def record_name(kind: int) -> str:
    return RECORD_NAMES[kind] if 0 <= kind < len(RECORD_NAMES) else "Unknown"


def _symbol(out: dict, kind: int, payload: bytes) -> None:
    """Symbol tables that records build up: assemblies, types, attributes and strings."""
    c = _Cursor(payload)

    def short() -> int:
        if c.at + 2 > len(payload):
            raise _Broken("a symbol is cut off")
        c.at += 2
        return struct.unpack_from("<h", payload, c.at - 2)[0]

    if kind == 28:
        out["assemblies"].append({"id": short(), "name": c.text(len(payload))})
    elif kind in (29, 30):
        number, assembly = short(), short()
        out["types"].append({"id": number, "assembly": assembly & 0x0FFF, "name": c.text(len(payload))})
    elif kind == 31:
        number, owner = short(), short()
        c.at += 1
        out["attributes"].append({"id": number, "owner": owner, "name": c.text(len(payload))})
    elif kind == 32:
        out["strings"].append({"id": short(), "value": c.text(len(payload))})


def _fields(kind: int, payload: bytes) -> dict:
    """What deferred content needs of a record: ``number`` (a section's size, a key's value position), ``ref``
    (an id) and ``flags``; null where the record has none or another length."""
    out = {"number": None, "ref": None, "flags": None}
    if kind == 37 and len(payload) == 4:
        out["number"] = struct.unpack("<i", payload)[0]
    elif kind == 38 and len(payload) == 8:
        out["ref"], out["number"] = struct.unpack_from("<hi", payload)
    elif kind in (39, 40) and len(payload) == 9:
        out["ref"], out["flags"], out["number"] = struct.unpack_from("<hBi", payload)
    elif kind == 50 and len(payload) == 2:
        out["ref"] = struct.unpack("<h", payload)[0]
    elif kind == 55 and len(payload) == 3:
        out["flags"], out["ref"] = struct.unpack("<Bh", payload)
    return out


def read_records(data: bytes | None) -> dict:
    """The records of a markup stream.  Reading stops at the first bad record with what was read
    before it (``partial``); other reader versions than 0.96 are not read."""
    out = {"status": "invalid", "error": None, "reader_version": None, "updater_version": None, "writer_version": None, "truncated": False, "records": [], "strings": [], "types": [], "attributes": [], "assemblies": []}
    if data is None or len(data) < HEADER_BYTES or data[:16] != struct.pack("<i", 12) + "MSBAML".encode("utf-16-le"):
        return out | {"error": "no markup signature"}
    versions = [".".join(map(str, struct.unpack_from("<hh", data, at))) for at in (16, 20, 24)]
    out |= {"reader_version": versions[0], "updater_version": versions[1], "writer_version": versions[2], "status": "partial"}
    if versions[0] != "0.96":
        return out | {"error": f"reader version {versions[0]} is not supported"}
    c, records = _Cursor(data, HEADER_BYTES), out["records"]
    try:
        while c.at < len(data) and len(records) < MAX_RECORDS:
            start, kind = c.at, data[c.at]
            c.at += 1
            if kind in VARIABLE:
                field = c.at
                stop = field + c.packed()
                if stop < c.at or stop > len(data):
                    raise _Broken(f"record {record_name(kind)} at {start} has a bad length")
            elif kind in SIZES:
                stop = c.at + SIZES[kind]
                if stop > len(data):
                    raise _Broken(f"record {record_name(kind)} at {start} is cut off")
            else:
                raise _Broken(f"record type {kind} at {start} is not supported")
            _symbol(out, kind, data[c.at : stop])
            records.append({"ord": len(records), "type": kind, "name": record_name(kind), "start": start, "payload_start": c.at, "stop": stop} | _fields(kind, data[c.at : stop]))
            c.at = stop
    except (_Broken, UnicodeDecodeError) as e:
        return out | {"error": str(e), "truncated": True}
    cut = c.at < len(data)
    return out | {"status": "partial" if cut else "parsed", "truncated": cut}


@arrow_function(RECORDS)
def markup_records(contents: pd.Series) -> pd.DataFrame:
    rows = [read_records(None if c is None else bytes(c)) for c in contents]
    return pd.DataFrame(rows, columns=["status", "error", "reader_version", "updater_version", "writer_version", "truncated", "records", "strings", "types", "attributes", "assemblies"])


def record_usage(markup: DataFrame) -> DataFrame:
    """A10: id, type, name, n of markup (id, m): how often each record type occurs, most first."""
    r = markup.select("id", F.explode("m.records").alias("r")).groupBy("id", "r.type", "r.name").agg(F.count("*").alias("n"))
    return r.orderBy("id", F.desc("n"), "type")


def element_records(markup: DataFrame) -> DataFrame:
    """Start and end records of elements, for ``graph.element_tree``: id, ord, kind, start, stop."""
    r = markup.select("id", F.explode("m.records").alias("r")).select("id", "r.*")
    kind = F.when(F.col("type").isin(3, 47), "start").when(F.col("type") == 4, "end")
    return r.withColumn("kind", kind).where("kind is not null").select("id", F.col("ord").cast("long"), "kind", "start", "stop")


def symbol_name(symbol: str, fallback: Column) -> Column:
    """A user symbol's name, else that of the known table."""
    return F.coalesce(F.col(symbol), fallback)


def deferred_ranges(keys: DataFrame, sections: DataFrame) -> DataFrame:
    """Value ranges of deferred keys (section, key_ord, position) in sections (section, content_start,
    content_end): [position, next position), the last to the content's end; ``ok`` where positions rise
    and stay inside."""
    w = W.partitionBy("section").orderBy("key_ord")
    joined = keys.join(sections, "section").withColumn("low", F.col("content_start") + F.col("position"))
    nxt, before = F.lead("low").over(w), F.lag("low").over(w)
    ranged = joined.withColumn("high", F.coalesce(nxt, F.col("content_end"))).withColumn("ok", (before.isNull() | (F.col("low") > before)) & (F.col("low") >= F.col("content_start")) & (F.col("low") < F.col("content_end")))
    return ranged.select("section", "key_ord", "low", "high", "ok")


def direct_children_agree(ranges: DataFrame, children: DataFrame) -> DataFrame:
    """Per section, whether its ranges' starts, in the order of their keys, are the starts of the owner's
    children (section, start) in the order in which they stand."""
    a = ranges.groupBy("section").agg(F.sort_array(F.collect_list(F.struct("key_ord", F.col("low").cast("long").alias("low")))).alias("keys"))
    b = children.groupBy("section").agg(F.sort_array(F.collect_list(F.col("start").cast("long"))).alias("starts"))
    return a.join(b, "section", "left").select("section", F.coalesce(F.col("keys.low") == F.col("starts"), F.lit(False)).alias("ok"))


def link_local_values(references: DataFrame, ranges: DataFrame, local: DataFrame, width: int = 4096) -> DataFrame:
    """References (section, offset, local_id) to the value of their own range's key: half-open
    ranges, found by bins of ``width`` bytes, ids local to the key; a missing id leaves a null value and
    ``complete`` false."""
    inside = interval_lookup(references, ranges.where("ok"), ["section"], "offset", width=width)
    linked = inside.join(local, ["section", "key_ord", "local_id"], "left")
    return linked.select("section", "key_ord", "offset", "local_id", "value", F.col("value").isNotNull().alias("complete"))
