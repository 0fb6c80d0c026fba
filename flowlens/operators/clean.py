"""Cleaning: meta column, duplicates, targets, row filters and lookups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from flowlens.fixed import FLOW_CATEGORIES, META, NORMAL_LABEL, TARGETS, UNKNOWN
from flowlens.functions.labels import binary, category
from flowlens.functions.sampling import hash_order


def drop_meta(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*(names or (META,)))


def distinct_rows(df: DataFrame, row_id: str | None = "row_id") -> DataFrame:
    """Full-row duplicates collapsed, keeping the smallest row id; nulls compare equal.

    An aggregate on all other columns: copies of a row meet in the map-side step, so a row
    repeated a billion times reaches the shuffle once per task.
    """
    if row_id is None:
        return df.distinct()
    keys = [c for c in df.columns if c != row_id]
    return df.groupBy(*keys).agg(F.min(row_id).alias(row_id)).select(*df.columns)


def dedup_train(
    df: DataFrame, row_id: str | None = "row_id", origin: str = "origin"
) -> DataFrame:
    """Duplicates leave the train split only; the test split is untouched."""
    train = distinct_rows(df.where(F.col(origin) == "train"), row_id)
    return train.unionByName(df.where(F.col(origin) != "train"))


def dedup_report(df: DataFrame, keys: Sequence[str], origin: str = "origin") -> DataFrame:
    """Rows before and after train-only dedup, from one aggregate over the key columns."""
    groups = df.groupBy(origin, *keys).agg(F.count("*").alias("copies"))
    after = F.when(F.col(origin) == "train", F.count("*")).otherwise(F.sum("copies"))
    return (
        groups.groupBy(origin)
        .agg(F.sum("copies").alias("before"), after.alias("after"))
        .withColumn("removed", F.col("before") - F.col("after"))
    )


def duplicate_count(df: DataFrame, keys: Sequence[str], origin: str = "origin") -> DataFrame:
    """Rows beyond the first of each group of equal rows, per split."""
    groups = df.groupBy(origin, *keys).agg((F.count("*") - 1).alias("extra"))
    return groups.groupBy(origin).agg(F.sum("extra").alias("duplicates"))


def add_targets(
    df: DataFrame,
    label: str = "label",
    groups: Mapping[str, Sequence[str]] = FLOW_CATEGORIES,
    normal: str = NORMAL_LABEL,
) -> DataFrame:
    return df.withColumns(
        {
            "attack_category": category(F.col(label), groups),
            "binary_label": binary(F.col(label), normal),
        }
    )


def add_category_by_lookup(df: DataFrame, table: DataFrame, label: str = "label") -> DataFrame:
    """Category through a mapping table; for maps kept as data rather than code.

    No broadcast hint: the table's size is the caller's, so Spark decides from its statistics.
    """
    found = df.join(table, label, "left")
    return found.withColumn("attack_category", F.coalesce("attack_category", F.lit(UNKNOWN)))


def feature_columns(df: DataFrame, drop: Sequence[str] = TARGETS) -> list[str]:
    return [c for c in df.columns if c not in drop]


def numeric_columns(
    df: DataFrame, drop: Sequence[str] = TARGETS, prefixes: Sequence[str] = ()
) -> list[str]:
    """Numeric columns that are neither targets nor dummies of a nominal column."""
    lead = tuple(f"{p}_" for p in prefixes)
    return [
        f.name
        for f in df.schema.fields
        if f.name not in drop
        and isinstance(f.dataType, T.NumericType)
        and not (lead and f.name.startswith(lead))
    ]


def preview(df: DataFrame, n: int = 5, row_id: str = "row_id") -> DataFrame:
    return df.orderBy(row_id).limit(n)


def shape(df: DataFrame, origin: str = "origin") -> DataFrame:
    """Rows and columns per split, the tag itself not counted."""
    width = len([c for c in df.columns if c != origin])
    return df.groupBy(origin).agg(
        F.count("*").alias("n_rows"), F.lit(width).cast("long").alias("n_cols")
    )


def column_types(df: DataFrame) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in df.schema.fields]


def normal_only(df: DataFrame) -> DataFrame:
    return df.where(F.col("binary_label") == 0)


def known_only(df: DataFrame) -> DataFrame:
    return df.where(F.col("attack_category") != UNKNOWN)


def unknown_report(df: DataFrame, origin: str = "origin") -> DataFrame:
    unknown = F.col("attack_category") == UNKNOWN
    return df.groupBy(origin).agg(
        F.count_if(~unknown).alias("kept"), F.count_if(unknown).alias("excluded")
    )


def part(df: DataFrame, name: str, origin: str = "origin") -> DataFrame:
    """One split of a stacked table, by tag."""
    return df.where(F.col(origin) == name)


def stack_splits(train: DataFrame, test: DataFrame, origin: str = "origin") -> DataFrame:
    return train.withColumn(origin, F.lit("train")).unionByName(
        test.withColumn(origin, F.lit("test"))
    )


def lookup(df: DataFrame, ids: Sequence[int], row_id: str = "row_id") -> DataFrame:
    """Several rows by id in one scan; the filter reaches the Parquet reader."""
    return df.where(F.col(row_id).isin(list(ids)))


def random_pick(
    df: DataFrame,
    seed: int = 42,
    pool: Column | None = None,
    row_id: str = "row_id",
    order=hash_order,
) -> DataFrame:
    rows = df if pool is None else df.where(pool)
    return rows.orderBy(order(F.col(row_id), seed), F.col(row_id)).limit(1)


def first_by_class(df: DataFrame, y: str = "binary_label", row_id: str = "row_id") -> DataFrame:
    return df.groupBy(y).agg(F.min(row_id).alias(row_id))
