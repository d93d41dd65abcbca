"""Files as they arrive: classification and counts over a stream of new files.

The batch operators are column expressions, so they hold for streams as they are; what a stream adds
is the watermark that bounds the state of windowed counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.classify import classify

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def arriving_files(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_trigger).load(folder)


def classified(files: DataFrame) -> DataFrame:
    """path, arrived, size, sha256, category, format of each file."""
    kind = classify(F.col("path"), F.substring("content", 1, 64))
    return files.select("path", F.col("modificationTime").alias("arrived"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), kind.alias("k")).select("path", "arrived", "size", "sha256", "k.category", "k.format")


def first_of_each_content(files: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """The first arrival of each content; digests are forgotten once the watermark has passed."""
    return files.withWatermark("arrived", lateness).dropDuplicatesWithinWatermark(["sha256"])


def counts_by_window(files: DataFrame, lateness: str = "1 hour", width: str = "10 minutes") -> DataFrame:
    return files.withWatermark("arrived", lateness).groupBy(F.window("arrived", width), "category").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
