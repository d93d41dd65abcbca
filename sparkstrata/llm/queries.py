"""Queries over the driver's tables, one for each operator of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import quality, toxicity
from .ann import nearest
from .chat import digests, format_examples
from .decontaminate import find_leaks
from .mixing import mix
from .neardup import near_duplicates
from .scratch import Scratch, bounded_batches
from .substrings import removal_digests
from .urlrules import judge
from .warc import read_back, write_archive


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"), Scratch(spark, "mixing")).withColumn("weight", F.round("weight", 9))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return near_duplicates(read(spark, sf_dir, "documents"), Scratch(spark, "neardup"), shingle_words=4, percent=80).drop("text_key")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from rows whose crc32(doc_id) mod 5 is not 0 and scores every row."""
    bounded_batches(spark)
    documents = read(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    machine = toxicity.train(documents, read(spark, sf_dir, "labels"), "toxic", usable=~held_out)
    scored = toxicity.score(documents, machine)
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


#: (verdict, host, path) of the query's fixed rules.
URL_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def op4_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A url that ends in a document's number is labelled bad where that document's quality is 0."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    quality = read(spark, sf_dir, "labels").where("quality is not null").groupBy("doc_id").agg((F.max("quality") == 0).cast("int").alias("bad"))
    number = F.regexp_extract("url", r"/(\d{1,18})(?:\.[a-z]+)?/?(?:[?#].*)?$", 1)
    labelled = pages.select("url", F.when(number != "", number.cast("long")).alias("doc_id")).where("doc_id is not null").join(quality, "doc_id").select("url", "bad")
    return judge(pages, Scratch(spark, "urls"), URL_RULES, labelled).withColumn("bad_rate", F.round("bad_rate", 9))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, Scratch(spark, "ann"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.range(1).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.explode(F.array(*(F.struct(F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(said).alias("text")) for i, role in enumerate(("user", "assistant"))))).alias("t"),
    )
    examples = Scratch(spark, "chat").table(format_examples(conversations.unionByName(extra.select("conv_id", "t.*"))), "examples")
    return digests(examples)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    return read_back(write_archive(read(spark, sf_dir, "pages"), scratch), scratch)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's source is its site, its source and language are its path."""
    bounded_batches(spark)
    documents = read(spark, sf_dir, "documents")
    model = quality.train(documents, read(spark, sf_dir, "labels"))
    return quality.judge(documents, model, Scratch(spark, "quality"), columns=("doc_id", "source")).select("row.*", "evidence", "site_rate", "path_rate", "score", "keep")


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return removal_digests(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_toxicity": op3_toxicity,
    "op4_url_templates": op4_url_templates,
    "op5_decontaminate": op5_decontaminate,
    "op6_neighbours": op6_neighbours,
    "op7_chat": op7_chat,
    "op8_warc": op8_warc,
    "op9_quality": op9_quality,
    "op10_substrings": op10_substrings,
}
