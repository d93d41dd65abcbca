"""Validation: rows that break a rule, and verdicts on whole documents.

Nothing here drops data silently: the violations are rows, and a caller decides what they void
(one result, one archive or the run).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.paths import ancestors, slashed
from ..functions.text import fold


def duplicate_keys(df: DataFrame, keys: list[str | Column]) -> DataFrame:
    """Keys that more than one row has, with their number."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def strict_json(text: Column) -> Column:
    """V1: the parsed value; null where the text is not JSON or repeats a property."""
    return F.try_parse_json(text)


def consistent_counts(declared: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """V2: declared (key, declared_count, truncated) against rows: ok where as many are there, or fewer
    and the declaration says so."""
    n = rows.groupBy(key).agg(F.count("*").alias("n"))
    have = F.coalesce("n", F.lit(0))
    return declared.join(n, key, "left").select(key, (have <= F.col("declared_count")).alias("bounded"), ((have == F.col("declared_count")) | (F.col("truncated") & (have <= F.col("declared_count")))).alias("ok"))


def one_classification(calls: DataFrame, site: list[str], kinds: list[str], target: str, tail: str) -> DataFrame:
    """V5: per call site, whether its rows agree on ``kinds`` and, where a tail call, on one target."""
    per = calls.groupBy(*site).agg(F.count_distinct(F.struct(*kinds)).alias("kinds"), F.bool_or(tail).alias("tail"), F.count(target).alias("known"), F.count("*").alias("n"))
    return per.select(*site, ((F.col("kinds") == 1) & (~F.col("tail") | ((F.col("n") == 1) & (F.col("known") == 1)))).alias("ok"))


def tail_call_rule(indirect: Column, tail: Column, caller: Column, target: Column, version: Column) -> Column:
    """V6: a tail call is direct, to a known other function; only version 3 has the field."""
    legal = ~F.coalesce(tail, F.lit(False)) | (~indirect & target.isNotNull() & (target != caller))
    return legal & F.when(version >= 3, tail.isNotNull()).otherwise(tail.isNull())


def overlapping_intervals(df: DataFrame, group: list[str], offset: str, size: str) -> DataFrame:
    """V8: intervals, ordered by offset and size, that begin before an earlier one ends; identical
    ranges are allowed and count once."""
    ranges = df.select(*group, F.col(offset).alias("low"), (F.col(offset) + F.col(size)).alias("high")).where("high > low").distinct()
    w = W.partitionBy(*group).orderBy("low", "high").rowsBetween(W.unboundedPreceding, -1)
    return ranges.withColumn("before", F.max("high").over(w)).where("low < before").drop("before")


def file_directory_conflicts(df: DataFrame, group: list[str], path: str) -> DataFrame:
    """V9: paths that are a file here and a directory above another file."""
    used = df.select(*group, F.explode(F.filter(ancestors(F.col(path)), lambda d: d != "")).alias("dir")).select(*group, fold(F.col("dir")).alias("key")).distinct()
    return df.withColumn("key", fold(slashed(F.col(path)))).join(used, [*group, "key"], "left_semi").drop("key")


def same_input(results: DataFrame, inputs: DataFrame, key: str, digest: str) -> DataFrame:
    """Results whose recorded digest is that of the input they claim; the others are dropped whole."""
    return results.join(inputs.select(key, digest), [key, digest], "left_semi")


def check_ranges(options: dict[str, float], ranges: dict[str, tuple[float, float]]) -> None:
    """Raises on the first option outside its range."""
    for name, (low, high) in ranges.items():
        if name in options and not low <= options[name] <= high:
            raise ValueError(f"{name} must lie between {low} and {high}")


def pseudocode_evidence(rows: DataFrame, limit: int, total_limit: int) -> DataFrame:
    """V7: per file, whether its pseudocode rows (file, sha256, status, code) are well formed."""
    chars = F.coalesce(F.length("code"), F.lit(0))
    fine = F.col("sha256").rlike("^[0-9a-f]{64}$") & F.col("status").isin("success", "failed", "timeout", "truncated") & (F.col("status").isin("success", "truncated") == F.col("code").isNotNull()) & (chars <= limit)
    return rows.groupBy("file").agg((F.bool_and(F.coalesce(fine, F.lit(False))) & (F.sum(chars) <= total_limit)).alias("ok"))
