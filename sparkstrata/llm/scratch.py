"""Tables that cut lineage, kept in the folder that all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.  Only in local mode may it be unset; then one is made."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    root = "file://" + tempfile.mkdtemp(prefix="strata-scratch-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


class Scratch:
    """Parquet tables under one fresh folder; ``drop`` removes those no longer read, ``remove`` all."""

    made: list[Scratch] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        Scratch.made.append(self)
        self.base = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.base}/{self.n:03d}-{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back: later work starts from the files, whatever executor is lost."""
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def _delete(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            self._delete(table._scratch_path)

    def remove(self) -> None:
        self._delete(self.base)
        if self in Scratch.made:
            Scratch.made.remove(self)

    def sweep(self) -> None:
        """Spark keeps the shuffle files of a finished query until the driver collects the objects that
        stand for it; ask for that, so that a chain of steps does not hold all its shuffles at once."""
        gc.collect()
        self.spark._jvm.System.gc()


def remove_all(spark: SparkSession) -> None:
    """Remove the scratch tables of steps whose results have been written."""
    for scratch in list(Scratch.made):
        scratch.remove()


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most ``rows`` rows, so that a worker holds a few MB of text at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))
