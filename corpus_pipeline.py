"""A training corpus in five stages, each an operator of ``sparkstrata.llm``.

Every stage reads what its predecessor kept and returns the columns of ``documents``; the last returns
the drawn rows with their epoch and position as well.  ``run`` writes each stage's result to the
shared scratch folder and reads it again, so a lost executor costs one stage at most.  Every stage
works on whole texts of any length, keeps extra columns whatever their names, and gives no rows for
an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkstrata.llm import quality
from sparkstrata.llm.decontaminate import drop_leaks
from sparkstrata.llm.mixing import mix, realise
from sparkstrata.llm.neardup import near_duplicates
from sparkstrata.llm.scratch import Scratch, bounded_batches, remove_all
from sparkstrata.llm.substrings import remove_repeats

#: A passage is cut where so many consecutive words stand in an earlier document.
PASSAGE_WORDS = 50


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, weighed with its site's and path's rates, finds good."""
    remove_all(spark)
    bounded_batches(spark)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.judge(docs, model, Scratch(spark, "quality")).where("keep").select("row.*")  # rows with null or repeated ids are judged each


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicate texts one row stays, of those with the smallest id.

    Rows go one by one, not by id: of rows that share an id only those with a text like another's are
    dropped.  Rows without an id, and texts without words, stay.
    """
    remove_all(spark)
    bounded_batches(spark)
    scratch = Scratch(spark, "neardup")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text", F.struct("*").alias("row"))
    # Further texts of an id are nodes of their own, numbered after all ids.
    ids = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min("text_key").alias("one"), F.max("text_key").alias("other"))
    top = ids.agg(F.max("doc_id")).first()[0] or 0
    more = rows.select("doc_id", "text_key").join(ids.where("one <> other"), "doc_id").where("text_key <> one").select("doc_id", "text_key").distinct()
    more = scratch.table(more.withColumn("node", F.monotonically_increasing_id() + F.lit(max(top, 0) + 1)), "further")
    nodes = rows.select("doc_id", "text_key", "text")
    if not more.isEmpty():
        nodes = nodes.join(more, ["doc_id", "text_key"], "left").withColumn("doc_id", F.coalesce("node", "doc_id"))
    told = scratch.table(near_duplicates(nodes.select("doc_id", "text"), scratch).where("n_shingles > 0 and doc_id is not null").withColumnRenamed("doc_id", "node"), "rows")
    told = told.join(more.select("node", F.col("doc_id").alias("of")), "node", "left").withColumn("doc_id", F.coalesce("of", "node"))
    dropped = told.where("not kept").select("doc_id", "text_key").distinct()
    stay = rows.join(dropped, ["doc_id", "text_key"], "left_anti").select("doc_id", "text_key", "row")
    # Rows repeated with one id and one text: one of them.
    again = scratch.table(told.where("kept").groupBy("doc_id", "text_key").count().where("count > 1").select("doc_id", "text_key"), "again")
    single = stay.join(again, ["doc_id", "text_key"], "left_anti").select("row")
    repeated = stay.join(again, ["doc_id", "text_key"]).groupBy("doc_id", "text_key").agg(F.first("row").alias("row")).select("row")
    return single.unionByName(repeated).select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier document has; null texts, and rows without an id, stay."""
    remove_all(spark)
    bounded_batches(spark)
    return remove_repeats(docs, window=PASSAGE_WORDS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found; null and empty texts stay."""
    remove_all(spark)
    bounded_batches(spark)
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's weight draws them, with epoch and position; rows without an id or
    without words are never drawn."""
    remove_all(spark)
    bounded_batches(spark)
    return realise(docs, mix(docs, Scratch(spark, "mixing"))).select("row.*", F.col("epoch").alias("mix_epoch"), F.col("position").alias("mix_position"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", near_duplicate_stage),
    ("substring dedup", substring_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mixing_stage),
]

#: Fitted classifiers and sketches have no SQL; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, previous = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        out = Scratch(spark, "pipeline")
        Scratch.made.remove(out)  # a stage's result is read by the next one: only then it may go
        docs = out.table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if previous is not None:
            previous.remove()
        out.sweep()  # nor do the shuffles of finished stages add up on the disks
        previous = out
    return STAGES[-1][1](spark, docs, sf_dir)
