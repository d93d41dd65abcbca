"""Structure of configuration texts, without values: JSON property paths and XML element paths.

Both come from one pass of a parser in an Arrow function: nesting has no fixed depth, so there is no
plain expression for it.  Results are struct(status, root, paths, properties, truncated); status is
parsed, partial (a bound was met) or invalid.
"""

from __future__ import annotations

import json
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .lazy import arrow_function

SHAPE = "struct<status:string,root:string,paths:array<string>,properties:int,truncated:boolean>"
# Bounds on one text.
MAX_BYTES, MAX_DEPTH, MAX_NODES, MAX_PROPERTIES, MAX_PATHS, MAX_PATH_CHARS = 1 << 20, 32, 20_000, 10_000, 200, 512


class _Invalid(ValueError):
    pass


class _Paths:
    """Distinct paths in order, up to the bounds."""

    def __init__(self):
        self.seen: dict[str, None] = {}
        self.cut = False

    def add(self, path: str) -> None:
        if path in self.seen:
            return
        if len(self.seen) >= MAX_PATHS or len(path) > MAX_PATH_CHARS:
            self.cut = True
            return
        self.seen[path] = None


def _result(status: str, root: str | None, paths: _Paths, properties: int) -> dict:
    return {"status": "partial" if status == "parsed" and paths.cut else status, "root": root, "paths": list(paths.seen), "properties": properties, "truncated": paths.cut}


def _pairs(pairs: list[tuple[str, object]]) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise _Invalid("repeated property")
    return out


def _constant(name: str) -> None:
    raise _Invalid(name)


def json_paths(text: str | None) -> dict:
    """Paths ``a``, ``a.b`` and ``a[]``: one for each property and each array that holds something."""
    paths, properties, nodes = _Paths(), 0, 0
    if text is None or len(text.encode("utf-8", "surrogatepass")) > MAX_BYTES:
        return _result("partial" if text else "invalid", None, paths, 0) | {"truncated": bool(text)}
    try:
        value = json.loads(text.removeprefix("﻿"), object_pairs_hook=_pairs, parse_constant=_constant)
        text.encode()
    except (ValueError, RecursionError):
        return _result("invalid", None, paths, 0)
    root = "object" if isinstance(value, dict) else "array" if isinstance(value, list) else "scalar"
    stack: list[tuple[object, str, int]] = [(value, "", 1)]
    while stack:
        node, path, depth = stack.pop()
        nodes += 1
        if depth > MAX_DEPTH or nodes > MAX_NODES:
            paths.cut = True
            continue
        if isinstance(node, dict):
            below = []
            for name, child in node.items():
                if any(0xD800 <= ord(c) <= 0xDFFF for c in name):
                    return _result("invalid", root, _Paths(), 0)
                if properties >= MAX_PROPERTIES:
                    paths.cut = True
                    break
                properties += 1
                at = f"{path}.{name}" if path else name
                below.append((child, at, depth + 1))
            for child, at, deep in below:
                paths.add(at)
            stack += reversed(below)
        elif isinstance(node, list):
            at = f"{path}[]"
            if node or path:
                paths.add(at)
            stack += reversed([(child, at, depth + 1) for child in node if isinstance(child, (dict, list))])
    return _result("parsed", root, paths, properties)


def xml_paths(text: str | None) -> dict:
    """Paths ``a/b`` of elements and ``a/b/@c`` of attributes; document types are refused."""
    paths, count, open_ = _Paths(), 0, []
    if text is None or len(text.encode("utf-8", "surrogatepass")) > MAX_BYTES:
        return _result("partial" if text else "invalid", None, paths, 0) | {"truncated": bool(text)}
    root: list[str] = []
    nodes = 0

    def start(name: str, attributes: dict[str, str]) -> None:
        nonlocal count, nodes
        nodes += 1
        local = name.rpartition("}")[2]
        open_.append(local)
        if not root:
            root.append(local)
        if len(open_) > MAX_DEPTH or nodes > MAX_NODES:
            paths.cut = True
            return
        here = "/".join(open_)
        paths.add(here)
        for attribute in attributes:
            if not attribute.startswith("xmlns"):
                count += 1
                paths.add(f"{here}/@{attribute.rpartition('}')[2]}")

    def refuse(*_: object) -> None:
        raise _Invalid("document type")

    parser = expat.ParserCreate(namespace_separator="}")
    parser.StartElementHandler = start
    parser.EndElementHandler = lambda _: open_.pop()
    parser.StartDoctypeDeclHandler = refuse
    parser.ExternalEntityRefHandler = refuse
    try:
        parser.Parse(text, True)
    except (expat.ExpatError, _Invalid, ValueError):
        return _result("invalid", None, _Paths(), 0)
    return _result("parsed", root[0] if root else None, paths, count)


@arrow_function(SHAPE)
def json_structure(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([json_paths(t) for t in texts], columns=["status", "root", "paths", "properties", "truncated"])


@arrow_function(SHAPE)
def xml_structure(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([xml_paths(t) for t in texts], columns=["status", "root", "paths", "properties", "truncated"])


def image_header(content: Column) -> Column:
    """struct(format, width, height) of PNG and GIF data, null for anything else.  A PNG's first
    chunk must be IHDR with the right checksum and sizes above 0."""
    number = lambda at: F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("long")
    short = lambda at: F.conv(F.concat(F.hex(F.substring(content, at + 1, 1)), F.hex(F.substring(content, at, 1))), 16, 10).cast("long")
    is_png = (F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A") & (number(9) == 13) & (F.hex(F.substring(content, 13, 4)) == "49484452") & (F.crc32(F.substring(content, 13, 17)) == number(30)) & (number(17) > 0) & (number(21) > 0)
    is_gif = F.hex(F.substring(content, 1, 6)).isin("474946383761", "474946383961") & (F.length(content) >= 13) & (short(7) > 0) & (short(9) > 0)
    made = lambda form, w, h: F.struct(F.lit(form).alias("format"), w.alias("width"), h.alias("height"))
    return F.when(is_png, made("png", number(17), number(21))).when(is_gif, made("gif", short(7), short(9)))
