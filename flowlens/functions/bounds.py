"""Checked collection of small vocabularies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


class TooManyValues(ValueError):
    """A column meant to hold a small vocabulary holds more values than allowed."""


class UnlistedValues(ValueError):
    """Rows hold values, or nulls, that the caller's list of classes leaves out."""


def refuse_unlisted(df: DataFrame, column: str, values: Sequence) -> None:
    """Raises when a row's class is missing from the list; reads one column.

    A report on some classes is asked for by a filter before it, never by a short list.
    """
    other = df.where(~F.coalesce(F.col(column).isin(list(values)), F.lit(False))).select(column)
    found = other.distinct().limit(10).collect()
    if found:
        raise UnlistedValues(f"column {column!r} also holds {[r[0] for r in found]}")


def vocabulary(df: DataFrame, column: str, limit: int = 1000) -> list:
    """Sorted distinct non-null values of one column; refuses to pull more than ``limit``."""
    return vocabularies(df, [column], limit)[column]


def vocabularies(df: DataFrame, columns: Sequence[str], limit: int = 1000) -> dict[str, list]:
    """Sorted distinct non-null values per column in one scan, each list at most ``limit`` long.

    Values travel as strings inside the job and come back in the column's own type.
    """
    columns = list(columns)
    pairs = F.array(
        *[
            F.struct(F.lit(i).alias("i"), F.col(c).cast("string").alias("v"))
            for i, c in enumerate(columns)
        ]
    )
    seen = (
        df.select(F.explode(pairs).alias("p"))
        .select("p.i", "p.v")
        .where(F.col("v").isNotNull())
        .distinct()
        .limit(limit * len(columns) + 1)
    )
    typed = seen.select(
        "i", *[F.when(F.col("i") == i, F.col("v")).cast(df.schema[c].dataType).alias(f"c{i}")
               for i, c in enumerate(columns)]
    ).collect()
    out = {c: sorted(r[f"c{i}"] for r in typed if r["i"] == i) for i, c in enumerate(columns)}
    for c, values in out.items():
        if len(values) > limit:
            raise TooManyValues(f"column {c!r} has more than {limit} distinct values")
    if len(typed) > limit * len(columns):
        raise TooManyValues(f"columns {columns} together exceed {limit} values each")
    return out
