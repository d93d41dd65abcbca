"""Bounded samples of labelled documents, on which classifiers are fitted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, max_rows: int, usable: Column | None = None) -> DataFrame:
    """doc_id, label, text of at most ``max_rows`` labelled documents, chosen by the hash of their ids.

    Of a document labelled more than once the largest label counts; null ids and labels don't.  Of
    rows that share an id the smallest text stands for all; such rows are merged before the shuffle.
    The chosen ids are bounded by ``max_rows``, so they are broadcast; only chosen texts are shuffled.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label is not null")
    if usable is not None:
        known = known.where(usable)
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("label").alias("label"), F.min("text").alias("text"))
