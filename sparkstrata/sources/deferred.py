"""Deferred content of markup: sections, the keys in their headers, and what makes them incomplete.

A section (record type 37) says how many bytes follow that are built only when asked for.  They begin
with a header of keys, each with the position of its value and the resources local to it; the values
follow.  ``records`` are those of ``resources.markup_records``, one row each with the stream's ``id``; a
``section`` is a struct of that id and the section's offset, so that it is one key for every stream.
Errors are rows (id, ord, error), ``ord`` being that of the record they were found at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators.graph import union_all
from ..operators.resolve import interval_lookup

# Record types.
ELEMENT_STARTS, ELEMENT_END, SECTION = (3, 47), 4, 37
STRING_KEY, TYPE_KEY, COMPLEX_KEY, COMPLEX_KEY_END = 38, 39, 40, 41
VERBOSE_LOCAL, VERBOSE_LOCAL_END, LOCAL_REFERENCE, LOCAL = 48, 49, 50, 55
MAX_KEYS = 10_000
WIDTH = 4096


def records_table(markup: DataFrame) -> DataFrame:
    """One row a record of markup (id, m)."""
    return markup.select("id", F.explode("m.records").alias("r")).select("id", "r.*")


def sections(records: DataFrame, sizes: DataFrame) -> DataFrame:
    """Id, section, ord, content_start, content_end, owner_start, error of every section.

    ``sizes`` (id, size) holds the streams' lengths.  The content must stay in the stream, end where the
    innermost open element ends, and begin after the sections before it; the first rule that is broken
    is the error.  Sound sections end with their owners, so they nest as elements do, and the
    largest end so far tells whether one lies in another.
    """
    start = F.col("type").isin(*ELEMENT_STARTS)
    step = F.when(start, 1).when(F.col("type") == ELEMENT_END, -1).otherwise(0)
    w = W.partitionBy("id").orderBy("ord")
    deep = records.where(F.col("type").isin(*ELEMENT_STARTS, ELEMENT_END, SECTION)).withColumn("level", F.sum(step).over(w.rowsBetween(W.unboundedPreceding, 0)) + (F.col("type") == ELEMENT_END).cast("int"))
    # On one level starts and ends take turns: a section's owner is the last start, which the next end closes.
    level = W.partitionBy("id", "level").orderBy("ord")
    owned = deep.select(
        "*",
        F.last(F.when(start, F.col("start")), ignorenulls=True).over(level.rowsBetween(W.unboundedPreceding, -1)).alias("owner_start"),
        F.first(F.when(F.col("type") == ELEMENT_END, F.col("start")), ignorenulls=True).over(level.rowsBetween(1, W.unboundedFollowing)).alias("owner_end"),
    ).where(F.col("type") == SECTION)
    found = owned.select("id", F.struct("id", "start").alias("section"), "ord", "start", F.col("stop").cast("long").alias("content_start"), (F.col("stop") + F.col("number").cast("long")).alias("content_end"), "number", "owner_start", "owner_end")
    closing = records.where(F.col("type") == ELEMENT_END).select("id", F.col("start").cast("long").alias("content_end"), F.lit(True).alias("closed"))
    told = found.join(sizes, "id").join(closing, ["id", "content_end"], "left")
    error = (
        F.when(F.col("number").isNull(), "the size is malformed")
        .when((F.col("number") < 0) | (F.col("content_end") > F.col("size")), "the content leaves the data")
        .when(F.col("closed").isNull(), "the content ends at no element's end")
        .when(F.col("owner_start").isNull() | F.col("owner_end").isNull() | (F.col("owner_end") != F.col("content_end")), "the content does not end where its owner does")
    )
    before = F.max(F.when(F.col("alone").isNull(), F.col("content_end"))).over(w.rowsBetween(W.unboundedPreceding, -1))
    checked = told.withColumn("alone", error).withColumn("error", F.coalesce("alone", F.when(F.col("start") < before, "sections overlap")))
    return checked.select("id", "section", "ord", "content_start", "content_end", "owner_start", "error")


@dataclass
class Headers:
    """``keys``: id, section, key_ord, ord, kind, ref, position, content_start (of the values), content_end.
    ``local``: section, key_ord, local_id, ord, kind, ref.  ``errors``: id, section, ord, error; a section with
    one has neither keys nor local resources."""

    keys: DataFrame
    local: DataFrame
    errors: DataFrame


def headers(records: DataFrame, sound: DataFrame) -> Headers:
    """The headers of ``sound`` sections (id, section, content_start, content_end).

    A header lasts to the first record that is no key, no local resource and inside none; from
    there the values start.  What a header can't hold, or what leaves the content, is an error.
    """
    t = F.col("type")
    bounds = sound.select("id", "section", F.col("content_start").alias("low"), F.col("content_end").alias("high"))
    inside = interval_lookup(records, bounds, ["id"], "start", width=WIDTH)
    by = W.partitionBy("section").orderBy("ord")
    so_far, whole = by.rowsBetween(W.unboundedPreceding, 0), W.partitionBy("section")
    opens, closes = t.isin(COMPLEX_KEY, VERBOSE_LOCAL), t.isin(COMPLEX_KEY_END, VERBOSE_LOCAL_END)
    nested = inside.withColumn("depth", F.sum(F.when(opens, 1).when(closes, -1).otherwise(0)).over(so_far))
    of_header = t.isin(STRING_KEY, TYPE_KEY, LOCAL, LOCAL_REFERENCE) | opens | closes | (F.col("depth") > 0)
    bodied = nested.withColumn("body", F.min(F.when(~of_header, F.col("ord"))).over(whole)).withColumn("values_start", F.coalesce(F.min(F.when(~of_header, F.col("start"))).over(whole).cast("long"), F.col("high")))
    head = bodied.where(F.col("body").isNull() | (F.col("ord") < F.col("body")))
    top = F.col("depth") == F.when(opens, 1).otherwise(0)
    key, local = t.isin(STRING_KEY, TYPE_KEY, COMPLEX_KEY) & top, t.isin(LOCAL, VERBOSE_LOCAL) & top
    numbered = head.withColumn("key_ord", F.sum(key.cast("int")).over(so_far) - 1).withColumn("last", F.max("ord").over(whole))
    error = (
        F.when(F.col("stop") > F.col("high"), "a record leaves the content")
        .when(t.isin(STRING_KEY, TYPE_KEY, LOCAL) & F.col("ref").isNull(), "a record of the header is malformed")
        .when((F.col("depth") < 0) | ((t == LOCAL_REFERENCE) & top), "a record does not belong in the header")
        .when(local & (F.col("key_ord") < 0), "a local resource has no key")
        .when((F.col("ord") == F.col("last")) & (F.col("depth") > 0), "a key or resource does not end")
    )
    marked = numbered.withColumn("error", error).withColumn("bad", F.max(F.col("error").isNotNull()).over(whole))
    bad, good = marked.where("error is not null").select("id", "section", "ord", "error"), marked.where(~F.col("bad"))
    some = marked.where(key | F.col("bad")).select("section").distinct()
    empty = sound.where("content_end > content_start").join(some, "section", "left_anti")
    errors = bad.unionByName(empty.select("id", "section", "ord", F.lit("the content has no keys").alias("error")))
    kind = F.when(t == STRING_KEY, "string").when(t == TYPE_KEY, "type").otherwise("complex")
    keys = good.where(key).select("id", "section", "key_ord", "ord", kind.alias("kind"), "ref", F.col("number").cast("long").alias("position"), F.col("values_start").alias("content_start"), F.col("high").alias("content_end"))
    of_kind = F.when(t == VERBOSE_LOCAL, "verbose").when(F.col("flags") == 0, "string-reference").when(F.col("flags") == 1, "type-reference").when(F.col("flags") == 2, "property-reference").otherwise("unknown")
    place = F.row_number().over(W.partitionBy("section", "key_ord").orderBy("ord")) - 1
    return Headers(keys, good.where(local).select("section", "key_ord", place.alias("local_id"), "ord", of_kind.alias("kind"), "ref"), errors)


def cap_keys(keys: DataFrame, most: int = MAX_KEYS) -> tuple[DataFrame, DataFrame]:
    """X11: (the first ``most`` keys of each stream with ``whole``, errors).  Where a section loses a key the end of
    its last kept value isn't known: its keys are not ``whole`` and get no ranges."""
    number = F.row_number().over(W.partitionBy("id").orderBy("ord"))
    counted = keys.withColumn("number", number).withColumn("whole", F.max("number").over(W.partitionBy("section")) <= most)
    over = counted.where(F.col("number") == most + 1).select("id", "section", "ord", F.lit(f"more than {most} keys").alias("error"))
    return counted.where(F.col("number") <= most).drop("number"), over


def unscoped_references(references: DataFrame, ranges: DataFrame, scoped: DataFrame) -> DataFrame:
    """References (id, ord, offset) inside the value ranges (id, low, high) that no property scope
    (id, offset) holds, as errors."""
    inside = interval_lookup(references, ranges.select("id", "low", "high"), ["id"], "offset", width=WIDTH)
    return inside.join(scoped.select("id", "offset").distinct(), ["id", "offset"], "left_anti").select("id", "ord", F.lit("a reference has no property scope").alias("error")).distinct()


def status(streams: DataFrame, keys: DataFrame, *errors: DataFrame) -> DataFrame:
    """Id, keys, complete, error of streams (id, tree_complete, values_truncated).

    The first error in the order of the records is the message.  With any key an incomplete element
    tree or values that were cut make the whole stream incomplete, after all other errors.
    """
    first = union_all(*(e.select("id", "ord", "error") for e in errors)).groupBy("id").agg(F.min(F.struct("ord", "error")).alias("first"))
    n = keys.groupBy("id").agg(F.count("*").alias("keys"))
    joined = streams.join(n, "id", "left").join(first, "id", "left").withColumn("keys", F.coalesce("keys", F.lit(0)).cast("long"))
    late = F.when((F.col("keys") > 0) & ~F.col("tree_complete"), "the element tree is incomplete").when((F.col("keys") > 0) & F.col("values_truncated"), "property values were cut")
    return joined.withColumn("error", F.coalesce("first.error", late)).select("id", "keys", F.col("error").isNull().alias("complete"), "error")
