"""Order, distinctness and bounded retention.

``ord`` columns carry the input's order, since rows in Spark have none; every operator that keeps the
first of equals names the columns that decide.  What one group keeps is decided inside that group:
groups must be bounded by the caller's data model (a run, a file, a customer).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import fold


def canonical_order(df: DataFrame, path: str) -> DataFrame:
    """O1: without case first, then by code unit."""
    return df.orderBy(fold(F.col(path)), path)


def archive_order(df: DataFrame, depth: str, path: str) -> DataFrame:
    """O2: by depth, then path without case, then by code unit."""
    return df.orderBy(depth, fold(F.col(path)), path)


def reference_order(df: DataFrame, ord: str) -> DataFrame:
    """References by source, kind and target; those that tie keep the order of the input (``ord``)."""
    return df.orderBy("source", "kind", "target", ord)


def distinct_first(df: DataFrame, keys: list[Column], ord: str, carry: list[str]) -> DataFrame:
    """Of rows equal under ``keys`` the first by ``ord``, with its ``carry`` columns.

    A grouped minimum, so equal rows merge before the shuffle.
    """
    named = [k.alias(f"_k{i}") for i, k in enumerate(keys)]
    first = df.groupBy(*named).agg(F.min(F.struct(F.col(ord), *carry)).alias("_f"))
    return first.select("_f.*")


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int, rank: str = "rn") -> DataFrame:
    """The first n rows of each group, numbered."""
    w = W.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def cap_with_flag(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """B1: the first n rows of each group, and whether the group had more."""
    w = W.partitionBy(*group)
    numbered = df.withColumn("rn", F.row_number().over(w.orderBy(*order))).withColumn("_all", F.count("*").over(w))
    return numbered.where(F.col("rn") <= n).withColumn("truncated", F.col("_all") > n).drop("_all")


def cap_with_overflow(df: DataFrame, group: list[str], ord: str, text: str, n: int) -> DataFrame:
    """The first n messages of each group, and one more that counts the rest."""
    kept = top_per_group(df.select(*group, ord, text), group, [F.col(ord)], n).select(*group, F.col("rn").cast("int").alias("position"), text)
    rest = df.groupBy(*group).agg((F.count("*") - n).alias("_more")).where("_more > 0")
    return kept.unionByName(rest.select(*group, F.lit(n + 1).alias("position"), F.concat(F.col("_more").cast("string"), F.lit(" more")).alias(text)))


def greedy_budget(df: DataFrame, group: list[str], order: list[str], cost: str, budget: int, most_rows: int | None = None) -> DataFrame:
    """B2: rows in order while they fit; a row that does not fit is skipped, and later smaller ones
    may still fit.  Skipping makes this a fold over the group, not a running sum."""
    items = F.sort_array(F.collect_list(F.struct(*order, F.col(cost).cast("long").alias("_cost"))))
    none = F.array().cast("array<int>")
    start = F.struct(F.lit(0).cast("long").alias("spent"), F.lit(0).alias("at"), none.alias("kept"))
    fits = lambda s, x: (s["spent"] + x["_cost"] <= budget) & ((F.size(s["kept"]) < most_rows) if most_rows is not None else F.lit(True))
    step = lambda s, x: F.struct(
        F.when(fits(s, x), s["spent"] + x["_cost"]).otherwise(s["spent"]).alias("spent"),
        (s["at"] + 1).alias("at"),
        F.when(fits(s, x), F.concat(s["kept"], F.array(s["at"] + 1))).otherwise(s["kept"]).alias("kept"),
    )
    folded = df.groupBy(*group).agg(items.alias("_items")).withColumn("_kept", F.aggregate("_items", start, step, lambda s: s["kept"]))
    return folded.select(*group, F.explode("_kept").alias("_i"), "_items").select(*group, F.element_at("_items", F.col("_i")).alias("_x")).select(*group, *(F.col(f"_x.{c}").alias(c) for c in order), F.col("_x._cost").alias(cost))


def prefix_budget(df: DataFrame, group: list[str], order: list[Column], cost: str, budget: int, largest: int) -> DataFrame:
    """Rows in order until the budget is spent; then nothing more is taken.  A row above
    ``largest`` is left out by itself and spends nothing."""
    w = W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.where(F.col(cost) <= largest).withColumn("running", F.sum(cost).over(w).cast("long")).where(F.col("running") <= budget)


def require_budget(df: DataFrame, cost: str, most_rows: int, budget: int) -> DataFrame:
    """The rows, or a failure of the whole job where they are too many or too large."""
    totals = df.agg(F.count("*").alias("_n"), F.coalesce(F.sum(cost), F.lit(0)).alias("_s"))
    checked = totals.select(F.assert_true((F.col("_n") <= most_rows) & (F.col("_s") <= budget), F.lit("the input exceeds its budget")).alias("_ok"))
    checked.collect()
    return df


def cap_values(values: Column, n: int) -> Column:
    """Struct of the first n distinct values and whether there were more."""
    out = F.array_distinct(values)
    return F.struct(F.slice(out, 1, n).alias("values"), (F.size(out) > n).alias("truncated"))


def all_versions(attributes: Column, elements: Column) -> Column:
    """Versions given as attributes, then those given as elements; null lists are empty."""
    none = F.array().cast("array<string>")
    return F.concat(F.coalesce(attributes, none), F.coalesce(elements, none))


def merge_sorted_values(values: Column, n: int | None = None) -> Column:
    """Distinct elements, the first of each kept; the first n, if given."""
    out = F.array_distinct(values)
    return F.slice(out, 1, n) if n is not None else out
