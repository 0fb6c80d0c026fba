"""Encoding and scaling with statistics learned from the train split."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import StringIndexerModel, VectorAssembler
from pyspark.sql import DataFrame, SparkSession, functions as F

from flowlens.functions.bounds import vocabularies
from flowlens.functions.stats import clean_numeric
from flowlens.sources.state import load_table, save_table


def dummy_name(column: str, value: str) -> str:
    return f"{column}_{value}"


@dataclass(frozen=True)
class OneHot:
    """Dummies over a fixed vocabulary per column, all levels kept; null gives all zeros."""

    levels: dict[str, list[str]]

    @classmethod
    def fit(cls, stacked: DataFrame, columns: Sequence[str], limit: int = 1000) -> OneHot:
        """Vocabulary of the stacked train and test rows, one scan, size checked."""
        return cls(vocabularies(stacked, columns, limit))

    def names(self, column: str | None = None) -> list[str]:
        wanted = [column] if column else list(self.levels)
        return [dummy_name(c, v) for c in wanted for v in self.levels[c]]

    def transform(self, df: DataFrame) -> DataFrame:
        """Other columns first, then the dummies in column and value order."""
        rest = [F.col(c) for c in df.columns if c not in self.levels]
        made = [
            F.when(F.col(c) == F.lit(v), 1).otherwise(0).alias(dummy_name(c, v))
            for c, values in self.levels.items()
            for v in values
        ]
        return df.select(*rest, *made)

    def reconstruct(self, df: DataFrame, column: str) -> DataFrame:
        """Value of the first largest dummy of a column; an all-zero row gives the first."""
        names = self.names(column)
        cells = F.array(*[F.col(f"`{n}`") for n in names])
        at = F.array_position(cells, F.array_max(cells))
        name = F.element_at(F.array(*[F.lit(n) for n in names]), at.cast("int"))
        return df.withColumn(column, F.replace(name, F.lit(f"{column}_"), F.lit("")))

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(i, c, v) for i, (c, vs) in enumerate(self.levels.items()) for v in [None, *vs]]
        save_table(spark.createDataFrame(rows, "pos int, column string, value string"), path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> OneHot:
        """Levels come back sorted as texts, a column without values with none."""
        levels: dict[str, list[str]] = {}
        for r in load_table(spark, path).orderBy("pos", "value").collect():  # one row per level
            levels.setdefault(r["column"], []).extend([] if r["value"] is None else [r["value"]])
        return cls(levels)


def label_encode(df: DataFrame, columns: Sequence[str], limit: int = 1000) -> DataFrame:
    """Each column replaced by the position of its value in sorted order.

    All vocabularies come from one size-checked scan.
    """
    levels = vocabularies(df, columns, limit)
    model = StringIndexerModel.from_arrays_of_labels(
        [[str(v) for v in levels[c]] for c in columns],
        inputCols=list(columns), outputCols=[f"__{c}" for c in columns],
    )
    coded = model.transform(df)
    return coded.select(
        *[F.col(f"__{c}").cast("int").alias(c) if c in columns else F.col(c) for c in df.columns]
    )


def fit_target(train: DataFrame, column: str, out: str = "y", limit: int = 1000) -> StringIndexerModel:
    """Target classes of the train split in sorted order; ``.labels`` names them.

    The class list is size checked. Applying it to a class outside it raises an error.
    """
    return StringIndexerModel.from_labels(
        [str(v) for v in vocabularies(train, [column], limit)[column]],
        inputCol=column, outputCol=out, handleInvalid="error",
    )


@dataclass(frozen=True)
class Standardizer:
    """(x - mean) / population std of the train rows; a zero std divides by one."""

    stats: dict[str, tuple[float, float]]

    @classmethod
    def fit(cls, train: DataFrame, columns: Sequence[str]) -> Standardizer:
        row = train.agg(
            *[
                F.struct(F.avg(v), F.stddev_pop(v)).alias(f"s{i}")
                for i, v in enumerate(clean_numeric(train, c) for c in columns)
            ]
        ).first()
        return cls({c: (row[i][0], row[i][1] or 1.0) for i, c in enumerate(columns)})

    def transform(self, df: DataFrame, prefix: str = "z_") -> DataFrame:
        """Scaled columns beside the rest; constants in a projection, no join."""
        return df.withColumns(
            {
                f"{prefix}{c}": (F.col(f"`{c}`") - F.lit(mean)) / F.lit(std)
                for c, (mean, std) in self.stats.items()
            }
        )

    def outputs(self, prefix: str = "z_") -> list[str]:
        return [f"{prefix}{c}" for c in self.stats]

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(i, c, m, s) for i, (c, (m, s)) in enumerate(self.stats.items())]
        return spark.createDataFrame(rows, "pos int, column string, mean double, std double")

    def save(self, spark: SparkSession, path: str) -> None:
        save_table(self.table(spark), path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Standardizer:
        rows = load_table(spark, path).orderBy("pos").collect()  # one row per column
        return cls({r["column"]: (r["mean"], r["std"]) for r in rows})


def save_order(spark: SparkSession, columns: Sequence[str], path: str) -> None:
    """The feature order a model was trained with."""
    save_table(spark.createDataFrame(list(enumerate(columns)), "pos int, column string"), path)


def load_order(spark: SparkSession, path: str) -> list[str]:
    return [r["column"] for r in load_table(spark, path).orderBy("pos").collect()]  # one row per feature


def assemble(df: DataFrame, columns: Sequence[str], out: str = "features") -> DataFrame:
    """Feature vector in the given column order; a null cell is an error."""
    return VectorAssembler(
        inputCols=list(columns), outputCol=out, handleInvalid="error"
    ).transform(df)
