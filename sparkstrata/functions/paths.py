"""Logical paths as Column expressions.  Both separators are accepted; ``/`` is written."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import fold


def slashed(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(slashed(path), "/"), -1)


def extension(path: Column) -> Column:
    """The last extension with its dot, or an empty string."""
    return F.regexp_extract(file_name(path), r"(\.[^.]+)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def directory(path: Column) -> Column:
    """What precedes the last separator; a separator at the start is no directory."""
    return F.regexp_extract(slashed(path), r"^(.+)/[^/]*$", 1)


def segments(path: Column) -> Column:
    return F.filter(F.split(slashed(path), "/"), lambda s: s != "")


def directory_segments(path: Column) -> Column:
    return segments(directory(path))


def common_prefix(a: Column, b: Column) -> Column:
    """How many leading elements of two arrays are equal without case."""
    pairs = F.zip_with(a, b, lambda x, y: fold(x) == fold(y))
    differ = F.array_position(F.transform(pairs, lambda e: F.coalesce(e, F.lit(False)).cast("int")), 0)
    return F.when(F.size(pairs) == 0, F.lit(0)).when(differ > 0, (differ - 1).cast("int")).otherwise(F.size(pairs))


def ancestors(path: Column) -> Column:
    """The directories above a path, from the nearest to the root (an empty string)."""
    parts = directory_segments(path)
    n = F.size(parts)
    return F.transform(F.sequence(n, F.lit(0), F.lit(-1)), lambda k: F.when(k > 0, F.array_join(F.slice(parts, 1, F.greatest(k, F.lit(1))), "/")).otherwise(F.lit("")))


def resolve(base_directory: Column, relative: Column) -> Column:
    """The relative path seen from a directory, ``.`` and ``..`` worked out; null if it leaves the
    root, is rooted, or has a drive."""
    target = slashed(relative)
    steps = F.concat(segments(F.concat(base_directory, F.lit("/"))), F.filter(F.split(target, "/"), lambda s: ~s.isin("", ".")))
    start = F.struct(F.array().cast("array<string>").alias("at"), F.lit(True).alias("ok"))
    up = lambda s: F.struct(F.when(F.size(s["at"]) > 1, F.slice(s["at"], 1, F.greatest(F.size(s["at"]) - 1, F.lit(1)))).otherwise(F.array().cast("array<string>")).alias("at"), (s["ok"] & (F.size(s["at"]) > 0)).alias("ok"))
    down = lambda s, x: F.struct(F.concat(s["at"], F.array(x)).alias("at"), s["ok"].alias("ok"))
    out = F.aggregate(steps, start, lambda s, x: F.when(x == "..", up(s)).otherwise(down(s, x)), lambda s: F.when(s["ok"], F.array_join(s["at"], "/")))
    return F.when(~target.rlike(r"^(/|[A-Za-z]:)"), out)


def has_excluded_directory(path: Column, names: list[str]) -> Column:
    """whether any directory above the leaf bears one of the names."""
    wanted = [n.upper() for n in names]
    return F.exists(directory_segments(path), lambda s: fold(s).isin(wanted))
