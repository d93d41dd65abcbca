"""ZIP and ASAR archives as tables of entries.

Each archive is opened where its bytes lie (mapInArrow over id and content) and its entries stream out
one record batch after another.  An archive that breaks a rule gives a single row with status
``invalid`` and the reason; nothing is extracted to disk, so paths are checked, not trusted.
"""

from __future__ import annotations

import io
import json
import struct
import unicodedata
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ENTRIES = "container string, ord int, path string, kind string, size long, content binary, link_target string, status string, error string"
# Bounds on one archive.
MAX_ENTRIES, MAX_NODES, MAX_HEADER_BYTES, MAX_LINK_HOPS, MAX_DEPTH = 25_000, 100_000, 64 << 20, 40, 8


class Broken(ValueError):
    """The archive breaks a rule; all of it is refused."""


def checked_path(path: str) -> str:
    """The path with ``/`` only, refused if it is rooted, climbs, or has empty or unusable segments."""
    plain = path.replace("\\", "/")
    parts = plain.split("/")
    if not plain or plain.startswith("/") or ":" in parts[0] or any(p in ("", ".", "..") or "\0" in p for p in parts):
        raise Broken(f"unsafe path: {path!r}")
    return plain


def path_key(path: str) -> str:
    """Paths with one key are the same file on some systems."""
    return unicodedata.normalize("NFC", path).upper()


def check_conflicts(paths: list[str]) -> None:
    """No path twice, and none both a file and a directory."""
    keys = [path_key(p) for p in paths]
    if len(set(keys)) != len(keys):
        raise Broken("two entries have one path")
    files = set(keys)
    for key in keys:
        at = key.find("/")
        while at >= 0:
            if key[:at] in files:
                raise Broken("an entry is both a file and a directory")
            at = key.find("/", at + 1)


def declared_zip_entries(content: bytes) -> int | None:
    """The entry count in the end-of-central-directory record (or its 64-bit form); None if not found."""
    at = content.rfind(b"PK\x05\x06", max(0, len(content) - 65_557))
    if at < 0 or at + 22 > len(content):
        return None
    count = struct.unpack_from("<H", content, at + 10)[0]
    locator = at - 20
    if count == 0xFFFF and locator >= 0 and content[locator : locator + 4] == b"PK\x06\x07":
        wide = struct.unpack_from("<Q", content, locator + 8)[0]
        if wide + 56 <= len(content) and content[wide : wide + 4] == b"PK\x06\x06":
            return struct.unpack_from("<Q", content, wide + 32)[0]
    return count


def zip_entries(content: bytes, max_entries: int = MAX_ENTRIES, max_bytes: int = 1 << 30) -> Iterator[tuple]:
    """(path, kind, size, content, link target) of the files of a ZIP, in path order."""
    if (declared_zip_entries(content) or 0) > max_entries:
        raise Broken("too many entries")
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
        infos = [i for i in archive.infolist() if not i.is_dir() and (i.external_attr >> 28) != 0xA]
        if len(infos) > max_entries:
            raise Broken("too many entries")
        named = sorted(((checked_path(i.filename), i) for i in infos), key=lambda x: (x[0].upper(), x[0]))
        check_conflicts([p for p, _ in named])
        if sum(i.file_size for _, i in named) > max_bytes:
            raise Broken("the entries are too large")
        for path, info in named:
            data = archive.read(info)
            if len(data) != info.file_size:
                raise Broken("an entry has another size than declared")
            yield path, "file", len(data), data, None
    except (zipfile.BadZipFile, NotImplementedError, RuntimeError, zlib.error, EOFError, OSError) as e:
        raise Broken(str(e)) from e


def _pairs(pairs: list[tuple[str, object]]) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise Broken("the header repeats a name")
    return out


def asar_header(content: bytes) -> tuple[dict, int]:
    """The header's tree and the offset at which file data begins."""
    if len(content) < 16:
        raise Broken("too short")
    four, header, payload, text = struct.unpack_from("<IIII", content)
    if four != 4 or header > MAX_HEADER_BYTES or header + 8 > len(content) or payload > header - 4 or text > payload - 4:
        raise Broken("the header sizes do not fit")
    try:
        tree = json.loads(content[16 : 16 + text].decode("utf-8"), object_pairs_hook=_pairs)
    except (ValueError, RecursionError) as e:
        raise Broken(f"the header is not JSON: {e}") from e
    if not isinstance(tree, dict) or not isinstance(tree.get("files"), dict):
        raise Broken("the header has no files")
    return tree, 8 + header


def asar_entries(content: bytes, max_nodes: int = MAX_NODES) -> Iterator[tuple]:
    """(path, kind, size, content, link target); kinds file, dir, link and unpacked."""
    tree, base = asar_header(content)
    found: list[tuple[str, str, int, int, str | None]] = []
    stack: list[tuple[dict, str]] = [(tree["files"], "")]
    while stack:
        files, above = stack.pop()
        for name, node in files.items():
            if len(found) >= max_nodes:
                raise Broken("too many nodes")
            if "/" in name or "\\" in name or not isinstance(node, dict):
                raise Broken("a node is malformed")
            path = checked_path(f"{above}{name}")
            if "files" in node:
                if not isinstance(node["files"], dict):
                    raise Broken("a directory is malformed")
                found.append((path, "dir", 0, 0, None))
                stack.append((node["files"], path + "/"))
            elif "link" in node:
                found.append((path, "link", 0, 0, checked_path(str(node["link"]))))
            else:
                size = node.get("size")
                if not isinstance(size, int) or isinstance(size, bool) or size < 0:
                    raise Broken("a size is malformed")
                if node.get("unpacked"):
                    found.append((path, "unpacked", size, 0, None))
                    continue
                offset = node.get("offset")
                if not isinstance(offset, str) or not offset.isdigit() or base + int(offset) + size > len(content):
                    raise Broken("a file lies outside the archive")
                found.append((path, "file", size, int(offset), None))
    kinds = {p: (k, t) for p, k, _, _, t in found}
    if len({path_key(p) for p in kinds}) != len(found):
        raise Broken("two entries have one path")
    ranges = sorted({(o, o + s) for _, k, s, o, _ in found if k == "file" and s})
    for (_, stop), (start, _) in zip(ranges, ranges[1:], strict=False):
        if start < stop:
            raise Broken("two files overlap in part")
    for path, kind, _, _, target in found:
        hops = 0
        while kind == "link":
            hops += 1
            if hops > MAX_LINK_HOPS or target not in kinds:
                raise Broken(f"the link {path!r} leads nowhere")
            kind, target = kinds[target]
    for path, kind, size, offset, target in sorted(found, key=lambda x: (x[0].upper(), x[0])):
        yield path, kind, size, content[base + offset : base + offset + size] if kind == "file" else None, target


def _expand(reader: Callable[[bytes], Iterator[tuple]], batch_bytes: int = 8 << 20):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["container", "ord", "path", "kind", "size", "content", "link_target", "status", "error"]
        types = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string(), pa.string(), pa.string()]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for part in batches:
            for name, content in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                rows: list[tuple] = []
                try:
                    # An archive is judged whole before any of it is passed on.
                    rows = [(name, i, *entry, "ok", None) for i, entry in enumerate(reader(content.as_py() or b""))]
                except Broken as e:
                    rows = [(name, 0, "", "archive", 0, None, None, "invalid", str(e))]
                held, size = [], 0
                for row in rows:
                    held.append(row)
                    size += len(row[5] or b"")
                    if size >= batch_bytes:
                        yield batch(held)
                        held, size = [], 0
                if held:
                    yield batch(held)

    return run


def expand_zip(files: DataFrame) -> DataFrame:
    """Entries of every ZIP in ``files`` (id, content)."""
    return files.select("id", "content").mapInArrow(_expand(zip_entries), ENTRIES)


def expand_asar(files: DataFrame) -> DataFrame:
    """Entries of every ASAR archive in ``files`` (id, content)."""
    return files.select("id", "content").mapInArrow(_expand(asar_entries), ENTRIES)


def expand_nested(files: DataFrame, max_depth: int = MAX_DEPTH) -> tuple[DataFrame, DataFrame | None]:
    """(files, archives): every file with those inside ASAR archives, and archives inside those, to
    ``max_depth`` rounds; and one row for each archive: container, depth, counts, complete, error.

    Rounds are unions over entries, so the plan's length is bounded by the depth.  Without any archive, which
    the names alone tell, there are no rounds and ``archives`` is None.
    """
    is_asar = F.lower("relative_path").endswith(".asar")
    level = files.select("id", "relative_path", "size", "content", "origin")
    if level.where(is_asar).select("id").isEmpty():
        return level, None
    out, archives = level, None
    for depth in range(1, max_depth + 1):
        entries = expand_asar(level.where(is_asar))
        stats = entries.groupBy("container").agg(
            F.lit(depth).alias("depth"),
            F.count_if(F.col("kind") == "file").alias("files"),
            F.count_if(F.col("kind") == "unpacked").alias("unpacked"),
            F.count_if(F.col("kind") == "link").alias("links"),
            F.bool_and(F.col("status") == "ok").alias("complete"),
            F.max("error").alias("error"),
        )
        archives = stats if archives is None else archives.unionByName(stats)
        inner = entries.where("kind = 'file' and status = 'ok'")
        path = F.concat("container", F.lit("/"), "path")
        level = inner.select(path.alias("id"), path.alias("relative_path"), "size", "content", F.struct(F.lit("asar").alias("kind"), F.col("container").alias("container"), F.col("path").alias("entry"), F.lit(depth).alias("depth")).alias("origin"))
        out = out.unionByName(level)
        if depth < max_depth and level.where(is_asar).limit(1).count() == 0:
            break
    return out, archives
