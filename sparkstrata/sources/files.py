"""File inventory: paths, contents, digests, pruning and sidecars.

``scan`` reads through Spark's binaryFile source, so any store that Spark can list will do; one row a
file, with its content as bytes.  Everything after it takes tables.  Symbolic links exist in local
folders only; those are walked without following links, and what lies behind one is left out.
"""

from __future__ import annotations

import os
from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import directory, extension, file_name, has_excluded_directory, stem
from ..functions.text import fold

#: Directories that hold no sources of their own.
EXCLUDED_DIRECTORIES = [".git", ".svn", ".hg", ".vs", ".idea", "bin", "obj", "node_modules", ".venv", "venv", "artifacts"]
#: Default bounds of one input.
MAX_FILES, MAX_TOTAL_BYTES, MAX_FILE_BYTES, MAX_ENTRIES = 25_000, 20 << 30, 4 << 30, 100_000


def origin(kind: str, container: Column | None = None, entry: Column | None = None, depth: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(F.lit(kind).alias("kind"), (container if container is not None else none).alias("container"), (entry if entry is not None else none).alias("entry"), (depth if depth is not None else F.lit(0)).cast("int").alias("depth"))


def qualified(spark: SparkSession, root: str) -> tuple[str, bool]:
    """The root as Spark names it in its files' paths, and whether it is a directory."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    full = store.makeQualified(path)
    return full.toString().rstrip("/"), store.getFileStatus(full).isDirectory()


def _local_folder(base: str) -> str | None:
    return unquote(urlparse(base).path) if base.startswith("file:") and "%" in base else base.removeprefix("file://").removeprefix("file:") if base.startswith("file:") else None


def _walk(folder: str) -> tuple[list[str], list[tuple[str, str]]]:
    """Relative paths of empty files, and (path, warning) of links and of what can't be read, of a local folder."""
    empty, warned, stack, seen = [], [], [""], 0
    while stack:
        inside = stack.pop()
        try:
            entries = sorted(os.scandir(os.path.join(folder, inside)), key=lambda e: e.name)
        except OSError:
            warned.append((inside, "the directory can't be read"))
            continue
        for entry in entries:
            seen += 1
            if seen > MAX_ENTRIES:
                raise ValueError(f"the input has more than {MAX_ENTRIES} entries")
            path = f"{inside}/{entry.name}" if inside else entry.name
            if entry.is_symlink():
                warned.append((path, "a link is not followed"))
            elif entry.is_dir(follow_symlinks=False):
                stack.append(path)
            elif entry.stat(follow_symlinks=False).st_size == 0:
                empty.append(path)
    return empty, warned


def _listed(spark: SparkSession, base: str, directory_: bool) -> tuple[list[str], list[tuple[str, str]]]:
    """As ``_walk``; Spark's file sources pass over files without content, so those are listed on the driver."""
    if not directory_:
        return [], []
    if (folder := _local_folder(base)) is not None and os.path.isdir(folder):
        return _walk(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    empty, seen, files = [], 0, path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
    while files.hasNext():
        seen += 1
        if seen > MAX_ENTRIES:
            raise ValueError(f"the input has more than {MAX_ENTRIES} entries")
        status = files.next()
        if status.getLen() == 0:
            empty.append(status.getPath().toString()[len(base) + 1 :])
    return empty, []


def _raw(spark: SparkSession, root: str) -> tuple[DataFrame, list[str], list[tuple[str, str]]]:
    """relative_path, length, content of files with content; paths of empty files; warnings."""
    base, directory_ = qualified(spark, root)
    empty, warned = _listed(spark, base, directory_)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base).select("path", "length", "content")
    # What follows the root itself, wherever else its name recurs, is the logical path.
    path = F.when(F.startswith("path", F.lit(base + "/")), F.substring("path", len(base) + 2, 1 << 30)).otherwise(F.substring_index("path", "/", -1))
    named = raw.withColumn("relative_path", path)
    if links := [p for p, w in warned if "link" in w]:
        behind = F.exists(F.array(*(F.lit(p) for p in links)), lambda p: (F.col("relative_path") == p) | F.startswith("relative_path", F.concat(p, F.lit("/"))))
        named = named.where(~behind)
    return named, empty, warned


def scan(spark: SparkSession, root: str, source_mode: bool = False, excluded: list[str] | None = None, max_file_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """Id, relative_path, file_name, size, content, origin of the files below ``root``.

    The size bound reaches the file listing; in source mode files below excluded directories go.
    ``scan_warnings`` names what is left out.
    """
    named, empty, _ = _raw(spark, root)
    none = spark.createDataFrame([(p,) for p in empty], "relative_path string").select("relative_path", F.lit(0).cast("long").alias("size"), F.lit(bytearray()).alias("content"))
    out = named.where(F.col("length") <= max_file_bytes).select("relative_path", F.col("length").alias("size"), "content").unionByName(none)
    if source_mode:
        out = out.where(~has_excluded_directory(F.col("relative_path"), excluded or EXCLUDED_DIRECTORIES))
    return out.select(F.col("relative_path").alias("id"), "relative_path", file_name(F.col("relative_path")).alias("file_name"), "size", "content", origin("directory").alias("origin"))


def scan_warnings(spark: SparkSession, root: str, max_file_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """File, warning of links, of directories that can't be read and of files above the size bound."""
    named, _, warned = _raw(spark, root)
    large = named.where(F.col("length") > max_file_bytes).select(F.col("relative_path").alias("file"), F.lit("the file is too large").alias("warning"))
    return spark.createDataFrame(warned, "file string, warning string").unionByName(large)


def source_text(content: Column, most: int = 1 << 20) -> Column:
    """The text of a source file of at most ``most`` bytes that is UTF-8 throughout, without its mark; else null."""
    plain = F.when(F.startswith(content, F.lit(bytearray(b"\xef\xbb\xbf"))), F.substring(content, 4, F.lit(most))).otherwise(content)
    return F.when(F.octet_length(content) <= most, F.try_validate_utf8(plain.cast("string")))


def digests(files: DataFrame) -> DataFrame:
    """Adds sha256, the SHA-256 of the content in hexadecimal."""
    return files.withColumn("sha256", F.sha2("content", 256))


def unpacked_sidecars(entries: DataFrame, files: DataFrame) -> DataFrame:
    """Unpacked archive entries (container, path, size) with the file beside the archive that holds each:
    ``<container>.unpacked/<path>`` of the declared size; ``sidecar`` is null where there is none."""
    want = fold(F.concat("container", F.lit(".unpacked/"), "path"))
    have = files.select(fold(F.col("relative_path")).alias("key"), F.col("id").alias("sidecar"), F.col("size").alias("have"))
    return entries.withColumn("key", want).join(have, "key", "left").withColumn("sidecar", F.when(F.col("have") == F.col("size"), F.col("sidecar"))).drop("key", "have")


def suppress(files: DataFrame, used: DataFrame) -> DataFrame:
    """files that no archive entry stands for (used: id)."""
    return files.join(used.select("id"), "id", "left_anti")


def orphan_sidecars(files: DataFrame) -> DataFrame:
    """Files that lie in an ``.asar.unpacked`` directory and were not used by any archive."""
    return files.where(fold(F.col("relative_path")).rlike(r"\.ASAR\.UNPACKED/")).select("id", F.concat(F.lit("unused sidecar: "), "relative_path").alias("warning"))


def app_host_sidecars(files: DataFrame) -> DataFrame:
    """Libraries that belong to an executable: same directory and stem, and a ``.runtimeconfig.json`` there."""
    place = lambda d: d.select("id", fold(directory(F.col("relative_path"))).alias("dir"), "relative_path")
    kind = lambda suffix: place(files.where(fold(extension(F.col("relative_path"))) == suffix)).withColumn("stem", fold(stem(F.col("relative_path"))))
    config = place(files.where(fold(F.col("relative_path")).endswith(".RUNTIMECONFIG.JSON"))).withColumn("stem", fold(F.regexp_replace(file_name(F.col("relative_path")), r"(?i)\.runtimeconfig\.json$", "")))
    hosts = kind(".EXE").select(F.col("id").alias("host"), "dir", "stem")
    return kind(".DLL").select("id", "dir", "stem").join(config.select("dir", "stem").distinct(), ["dir", "stem"], "left_semi").join(hosts, ["dir", "stem"]).select("host", "id")
