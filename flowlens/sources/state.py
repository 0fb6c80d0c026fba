"""Fitted state on shared storage: small tables, model folders and what is available."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import DataFrame, SparkSession, functions as F

from flowlens.session import require_checkpoint_dir


def save_table(df: DataFrame, path: str) -> None:
    """A fitted table (scaler statistics, threshold, bin edges) as one Parquet file."""
    df.coalesce(1).write.mode("overwrite").parquet(path)


def load_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


class Registry:
    """Spark ML models of any class under one folder, by name."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def save(self, name: str, model) -> None:
        model.write().overwrite().save(f"{self.root}/{name}")

    def load(self, name: str):
        """The model, read by the class that its own metadata names."""
        return DefaultParamsReader.loadParamsInstance(f"{self.root}/{name}", self.spark)

    def has(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/metadata")
        conf = self.spark._jsparkSession.sessionState().newHadoopConf()
        return path.getFileSystem(conf).exists(path)

    def available(self, names: list[str]) -> dict[str, object]:
        """Models whose folder is there; one that is there but can't be read is an error."""
        return {name: self.load(name) for name in names if self.has(name)}

    def table(self, names: list[str]) -> DataFrame:
        """(model, available) rows for a list of expected names."""
        return self.spark.createDataFrame(
            [(n, self.has(n)) for n in names], "model string, available boolean"
        )


@contextmanager
def shared(*frames: DataFrame):
    """Keep frames that several jobs read; blocks spill to disk and are rebuilt if lost."""
    for f in frames:
        f.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield frames if len(frames) > 1 else frames[0]
    finally:
        for f in frames:
            f.unpersist()


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder of rows that are no longer needed."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def written(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder and read from there, for results that several steps read."""
    path = f"{require_checkpoint_dir(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def files_of(spark: SparkSession, folder: str) -> tuple:
    """Names, sizes and times of the Parquet files and folders in a folder, which tell whether it has changed."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/*.parquet")
    found = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(where)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in found or ()))


MOST_ROWS = 1_000_000  # rows that a task of a training job holds; each costs a forest of 100 trees about half a kB


def part_rows(df: DataFrame) -> tuple[int, int]:
    """Rows of the largest part, and of all."""
    counts = df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"))
    row = counts.agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    return row[0], row[1]


def spread(df: DataFrame) -> DataFrame:
    """The rows over all of the session's tasks, before work that is heavy per row, if they lie in fewer parts
    or most of them in a few.

    A file's splits may be many and yet be empty: all rows of a row group come in one of them. So rows are
    counted (which reads no column); a table whose parts are alike stays where it is.
    """
    tasks = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < tasks:
        return df.repartition(tasks)
    largest, total = part_rows(df)
    return df if 2 * largest * tasks <= 3 * total or largest <= 1000 else dealt(df, total)


def dealt(df: DataFrame, rows: int, most: int = MOST_ROWS) -> DataFrame:
    """The rows in equal parts of at most ``most`` rows, as many for every task."""
    tasks = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(tasks * max(1, -(-rows // (tasks * most))))
