"""Repeatable orders for sampling; a function of the row id, so retried tasks agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def hash_order(row_id: Column, seed: int = 42) -> Column:
    return F.xxhash64(row_id, F.lit(seed))


def lattice_order(row_id: Column, seed: int = 42) -> Column:
    """Multiplicative order that any SQL engine computes alike; ids count modulo 2**31."""
    return (F.pmod(row_id, F.lit(2147483648)) * F.lit(2654435761) + F.lit(seed)) % F.lit(4294967296)


def sample_rows(
    df: DataFrame, k: int, row_id: str = "row_id", seed: int = 42, order=hash_order
) -> DataFrame:
    """Exactly k rows (or all) without replacement: each task keeps its own best k."""
    return df.orderBy(order(F.col(row_id), seed), F.col(row_id)).limit(k)
