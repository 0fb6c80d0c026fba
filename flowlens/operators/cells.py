"""Rows that Spark's trees can't tell apart, as one weighted row.

Spark's trees see of a row the label and, for each feature, between which of at most ``maxBins - 1`` thresholds its
value lies. Boosting without row sampling adds up rows alike in these, so a table of such cells with their
numbers of rows gives the same trees (sums round differently), and a round costs by cells, not by rows.
The thresholds are those that Spark takes, from the rows that it draws for them.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from flowlens.session import ship_package
from flowlens.sources.state import dealt, shared

LEAST_DRAWN = 10_000  # rows that Spark draws for thresholds, or maxBins squared if that is more


def drawn(df: DataFrame, array: str, bins: int, seed: int) -> tuple[np.ndarray, float]:
    """The values that Spark's fit of these rows draws for its thresholds, and the number of rows it expects to draw."""
    spark, rows, most = df.sparkSession, df.count(), max(bins * bins, LEAST_DRAWN)
    some, share = df.select(array), 1.0
    if most < rows:
        share = most / rows
        seed = spark._jvm.org.apache.spark.util.random.XORShiftRandom(seed).nextInt()
        picked = some._jdf.toJavaRDD().sample(False, share, seed)
        some = DataFrame(spark._jsparkSession.createDataFrame(picked, some._jdf.schema()), spark)
    return np.array([r[0] for r in some.collect()], float), share * rows


def thresholds(values: np.ndarray, expected: float, bins: int) -> np.ndarray:
    """Increasing thresholds of one feature: halfway between neighbouring values, if there are more than ``bins``
    where steps of equal numbers of rows end. Rows that the draw lacks count as noughts, as in Spark."""
    found, n = np.unique(values[values != 0], return_counts=True)
    n, missing = n.astype(float), expected - float(n.sum())
    if missing > np.finfo(float).eps * n.sum() * 100:
        at = int(np.searchsorted(found, 0.0))
        found, n = np.insert(found, at, 0.0), np.insert(n, at, missing)
    if len(found) <= bins:
        return (found[:-1] + found[1:]) / 2
    step, reached, cuts = expected / bins, np.cumsum(n), []
    target = step
    for i in range(1, len(found)):
        if abs(reached[i - 1] - target) < abs(reached[i] - target):
            cuts.append((found[i - 1] + found[i]) / 2)
            target += step
    return np.array(cuts)


def numbers(array: Column, cuts: list[np.ndarray]) -> Column:
    """For every feature the number of cuts below the value; a value that is none is above all."""

    @F.arrow_udf("array<int>")
    def of(values: pa.Array) -> pa.Array:
        x = values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), len(cuts))
        out = np.empty(x.shape, np.int32)
        for j, c in enumerate(cuts):
            out[:, j] = np.searchsorted(c, x[:, j], "left")
        return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * len(cuts)), pa.array(out.ravel()))

    return of(array)


class BinnedModel(Model):
    """A model of bins' numbers that takes rows: they are cut into bins on the way."""

    def __init__(self, model, cuts: list[np.ndarray]):
        super().__init__()
        self.model, self.cuts = model, cuts

    def _transform(self, df: DataFrame) -> DataFrame:
        ship_package(df.sparkSession)
        name, own = "__bins", self.model.getFeaturesCol()
        binned = array_to_vector(numbers(vector_to_array(own), self.cuts).cast("array<double>"))
        return self.model.copy({self.model.featuresCol: name}).transform(df.withColumn(name, binned)).drop(name)


@contextmanager
def cells(df: DataFrame, held: str, bins: int, seed: int) -> Iterator[tuple[DataFrame, list[np.ndarray]]]:
    """Kept rows (features, y, held, n) of (features, y, held), and the thresholds; features are numbers of bins.

    Thresholds come from the rows that aren't held out. One that ends a bin without such rows is left out: of splits that
    part the rows alike, Spark takes the first.
    """
    ship_package(df.sparkSession)
    rows = df.withColumn("x", vector_to_array("features")).drop("features")
    values, expected = drawn(rows.where(~F.col(held)), "x", bins, seed)
    cuts = [thresholds(v, expected, min(bins, round(expected))) for v in values.T]
    grouped = rows.withColumn("x", numbers(F.col("x"), cuts)).groupBy("x", "y", held).agg(F.count(F.lit(1)).cast("double").alias("n"))
    with shared(grouped):
        used: list[list[int]] = [[] for _ in cuts]
        for j, b in grouped.where(~F.col(held)).select(F.posexplode("x")).distinct().orderBy("pos", "col").collect():  # bins at most
            used[j].append(b)
        places = [np.searchsorted(u[:-1], np.arange(len(c) + 1)).tolist() for c, u in zip(cuts, used)]
        place = F.array(*[F.array(*[F.lit(float(p)) for p in of]) for of in places])
        x = F.transform("x", lambda b, j: F.get(F.get(place, j), b))
        table = dealt(grouped.select(array_to_vector(x).alias("features"), "y", held, "n"), grouped.count())
        with shared(table):
            table.count()
            grouped.unpersist()
            yield table, [c[u[:-1]] for c, u in zip(cuts, used)]
