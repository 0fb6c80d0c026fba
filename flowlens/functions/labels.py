"""Label expressions: raw name to category, binary target, class index to name."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flowlens.fixed import FLOW_CATEGORIES, NORMAL_LABEL, UNKNOWN


def category(label: Column, groups: Mapping[str, Sequence[str]] = FLOW_CATEGORIES) -> Column:
    """Exact, case-sensitive lookup; anything else, null included, is ``Unknown``."""
    out = F
    for name, members in groups.items():
        out = out.when(label.isin(list(members)), F.lit(name))
    return out.otherwise(F.lit(UNKNOWN))


def binary(label: Column, normal: str = NORMAL_LABEL) -> Column:
    """0 for the normal label, 1 for everything else including null."""
    return F.when(label == normal, F.lit(0)).otherwise(F.lit(1))


def category_table(
    spark: SparkSession, groups: Mapping[str, Sequence[str]] = FLOW_CATEGORIES
) -> DataFrame:
    """The same mapping as a (label, attack_category) table, one row per known label."""
    rows = [(m, name) for name, members in groups.items() for m in members]
    return spark.createDataFrame(rows, "label string, attack_category string")


def class_name(index: Column, names: Sequence[str]) -> Column:
    """Name of a 0-based class index; null when out of range."""
    return F.get(F.array(*[F.lit(n) for n in names]), index.cast("int"))
