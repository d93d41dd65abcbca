"""Counts and histograms over the tables of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def conditional_counts(df: DataFrame, group: list[str], counts: dict[str, Column], sums: dict[str, Column] | None = None) -> DataFrame:
    """One row a group (or one in all) of counts of rows for which a condition holds, and of
    sums that count null as 0."""
    made = [F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in counts.items()]
    made += [F.coalesce(F.sum(F.coalesce(c, F.lit(0))), F.lit(0)).cast("long").alias(n) for n, c in (sums or {}).items()]
    return df.groupBy(*group).agg(*made) if group else df.agg(*made)


def package_summary(files: DataFrame, dependencies: DataFrame) -> DataFrame:
    """A1: the counts of one package, of files (category, is_managed, size, type_count, method_count, error)
    and dependencies (resolved)."""
    c = F.col
    left = conditional_counts(
        files,
        [],
        {
            "files": F.lit(True),
            "executables": c("category") == "executable",
            "libraries": c("category") == "library",
            "archives": c("category") == "archive",
            "managed": c("is_managed"),
            "failed": c("error").isNotNull(),
        },
        {"bytes": c("size"), "types": c("type_count"), "methods": c("method_count")},
    )
    right = conditional_counts(dependencies, [], {"dependencies": F.lit(True), "resolved": c("resolved"), "unresolved": ~c("resolved")})
    return left.join(F.broadcast(right))  # one row each


def histogram_top(df: DataFrame, group: list[str], code: str, n: int) -> DataFrame:
    """A4: per group the n most frequent codes, ties by code, with their counts and rank."""
    counted = df.groupBy(*group, code).agg(F.count("*").alias("n"))
    w = W.partitionBy(*group).orderBy(F.desc("n"), code)
    return counted.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def index_members(df: DataFrame, key: Column, member: str) -> DataFrame:
    """Name to its members, sorted, and their number."""
    return df.groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(member)).alias("members"))


def unique_names(df: DataFrame, name: str, ord: str, replacement: Column) -> DataFrame:
    """Rows whose name another row has, without case, get the replacement and are marked incomplete."""
    again = F.count("*").over(W.partitionBy(F.upper(F.col(name)))) > 1
    return df.withColumn("duplicate", again).withColumn(name, F.when(F.col("duplicate"), replacement).otherwise(F.col(name)))


def alias_duplicates(df: DataFrame, group: list[str], value: str, name: str, ord: str) -> DataFrame:
    """Of members with one value the first is the variant, later ones are its aliases."""
    w = W.partitionBy(*group, value).orderBy(ord)
    return df.withColumn("canonical", F.first(name).over(w)).withColumn("is_alias", F.row_number().over(w) > 1)


def project_counts(projects: DataFrame, **tables: DataFrame) -> DataFrame:
    """A5: each project (project) with the number of its rows in every table (project, …), 0 where there are none.
    Each table is counted before it is joined."""
    out = projects.select("project").distinct()
    for name, table in tables.items():
        out = out.join(table.groupBy("project").agg(F.count("*").alias(name)), "project", "left")
    return out.select("project", *(F.coalesce(name, F.lit(0)).cast("long").alias(name) for name in tables))


def methods_with_code(types: DataFrame, methods: str = "methods", code: str = "il") -> DataFrame:
    """Assembly and the number of its methods that have code, summed over types (assembly, array of methods)."""
    have = F.size(F.filter(F.coalesce(methods, F.array().cast(types.schema[methods].dataType)), lambda m: F.coalesce(F.size(m[code]), F.lit(0)) > 0))
    return types.groupBy("assembly").agg(F.sum(have).cast("long").alias("methods_with_code"))


def project_warnings(projects: DataFrame) -> DataFrame:
    """Warnings that count the incomplete projects and those with notes (project, complete, notes), if any."""
    counts = conditional_counts(projects, [], {"incomplete": ~F.coalesce("complete", F.lit(False)), "noted": F.coalesce(F.size("notes"), F.lit(0)) > 0})
    said = lambda kind, text: F.struct(F.lit(kind).alias("kind"), F.col(kind).alias("projects"), F.concat(F.col(kind).cast("string"), F.lit(text)).alias("warning"))
    made = F.array(said("incomplete", " projects are incomplete"), said("noted", " projects have notes"))
    return counts.select(F.explode(F.filter(made, lambda w: w["projects"] > 0)).alias("w")).select("w.*")


def code_files(files: DataFrame, images: DataFrame, types: DataFrame) -> tuple[DataFrame, DataFrame]:
    """files (id) that are no executable image, and those with a type at least; both by keys alone."""
    return files.join(images.select("id").distinct(), "id", "left_anti"), files.join(types.select("id").distinct(), "id", "left_semi")


def first_by_id(wanted: DataFrame, components: DataFrame, ord: str) -> DataFrame:
    """Each wanted id with the first component (by ``ord``) that has it, or nulls."""
    rest = [c for c in components.columns if c not in ("id", ord)]
    first = components.groupBy("id").agg(F.min_by(F.struct(*rest), ord).alias("_c"))
    return wanted.join(first, "id", "left").select(*wanted.columns, *(F.col(f"_c.{c}").alias(c) for c in rest))
