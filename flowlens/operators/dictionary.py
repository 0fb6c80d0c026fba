"""Codes for columns of any number of values: a dictionary that is a table, not a list.

Values are counted, sorted over ranges, and numbered inside each range; the ranges' sizes give every
range its first number. So codes are the values' places in sorted order, whoever counts them, and no
list of values meets in one task or the driver. Rows get their codes by a join. Values that many rows
share are broadcast (a thousand at most); rows that need no shuffled join carry a spread key
through it, so that neither a frequent value nor nulls meet in one task.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from flowlens.session import require_checkpoint_dir
from flowlens.sources.state import load_table

FREQUENT = 1000  # a value of more than one row in so many is broadcast
SPREAD = 1024


@dataclass(frozen=True)
class Dictionary:
    """One table (value, code, n) per column, in a folder that all nodes share."""

    folder: str
    columns: list[str]
    sizes: list[int]  # values per column
    rows: int

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str], folder: str | None = None) -> Dictionary:
        """Codes from 0 in the sorted order of each column's own type, nulls left out."""
        spark, columns = df.sparkSession, list(columns)
        folder = folder or f"{require_checkpoint_dir(spark)}/dictionary-{uuid.uuid4().hex}"
        sizes = []
        for i, c in enumerate(columns):
            counts = df.where(F.col(f"`{c}`").isNotNull()).groupBy(F.col(f"`{c}`").alias("value")).agg(F.count(F.lit(1)).alias("n"))
            ranged = counts.repartitionByRange("value").withColumn("part", F.spark_partition_id())
            ranged.write.parquet(f"{folder}/ranges/{i}")  # fixes which value is in which range
            ranged = spark.read.schema(ranged.schema).parquet(f"{folder}/ranges/{i}")
            parts = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("size"))  # a row per range
            first = F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
            inside = F.row_number().over(Window.partitionBy("part").orderBy("value")) - 1
            placed = ranged.withColumn("inside", inside).join(F.broadcast(parts.select("part", first.alias("first"))), "part")
            placed.select("value", (F.col("first") + F.col("inside")).alias("code"), "n").write.parquet(f"{folder}/codes/{i}")
            sizes.append(load_table(spark, f"{folder}/codes/{i}").count())
        return cls(folder, columns, sizes, df.count())

    def table(self, spark: SparkSession, column: str) -> DataFrame:
        return load_table(spark, f"{self.folder}/codes/{self.columns.index(column)}")

    def transform(self, df: DataFrame, suffix: str = "_code", strict: bool = False) -> DataFrame:
        """Adds a code (long) per column: null for nulls, and for values that weren't there, which ``strict`` refuses."""
        for c in self.columns:
            known, value, out = self.table(df.sparkSession, c), F.col(f"`{c}`"), f"{c}{suffix}"
            often = F.col("n") * FREQUENT > self.rows
            top = known.where(often).select(F.col("value").alias("__top"), F.col("code").alias("__first"))
            rest = known.where(~often).select(F.col("value").alias("__value"), F.col("code").alias("__second"))
            df = df.join(F.broadcast(top), value == F.col("__top"), "left").withColumn(
                "__key", F.when(F.col("__first").isNull(), value))
            lost = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SPREAD)).cast("int")
            df = df.withColumn("__salt", F.when(F.col("__key").isNull(), lost).otherwise(-1))
            met = (F.col("__key") == F.col("__value")) & (F.col("__salt") == F.col("__one"))
            df = df.join(rest.withColumn("__one", F.lit(-1)), met, "left").withColumn(out, F.coalesce("__first", "__second"))
            if strict:
                unknown = F.concat(F.lit(f"column {c} holds a value without a code: "), value.cast("string"))
                df = df.withColumn(out, F.when(value.isNotNull() & F.col(out).isNull(), F.raise_error(unknown).cast("long")).otherwise(F.col(out)))
            df = df.drop("__top", "__first", "__key", "__salt", "__value", "__second", "__one")
        return df

    def dummies(self, df: DataFrame, out: str = "dummies") -> DataFrame:
        """Adds one sparse vector with a 1 at each column's code, columns one behind the other; nulls
        and values without a code have none."""
        names = [f"__code{i}" for i in range(len(self.columns))]
        coded = self.transform(df, "__c")
        for c, n, size in zip(self.columns, names, self.sizes):
            coded = coded.withColumn(n, F.coalesce(f"`{c}__c`", F.lit(size)).cast("double")).drop(f"{c}__c")
        hot = [f"{n}_hot" for n in names]
        spark = df.sparkSession
        # the encoder learns sizes from the largest codes, which one row states
        most = spark.createDataFrame([tuple(float(max(s - 1, 0)) for s in self.sizes)], ", ".join(f"{n} double" for n in names))
        encoder = OneHotEncoder(inputCols=names, outputCols=hot, handleInvalid="keep", dropLast=True).fit(most)
        return VectorAssembler(inputCols=hot, outputCol=out).transform(encoder.transform(coded)).drop(*names, *hot)
