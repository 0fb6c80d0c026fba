"""Guarded statistics that agree with the pandas and NumPy definitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T


def clean_numeric(df: DataFrame, name: str) -> Column:
    """Column as double with NaN turned into null, so it is ignored as a missing value."""
    c = F.col(f"`{name}`").cast("double")
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c), c)
    return c


def corrected_skewness(c: Column) -> Column:
    """Bias-corrected skewness: 0 for a constant column, null below three values."""
    n = F.count(c).cast("double")
    factor = F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))
    constant = F.min(c) == F.max(c)
    return F.when(n < 3, None).when(constant, 0.0).otherwise(F.skewness(c) * factor)


def pearson(a: Column, b: Column) -> Column:
    """Pearson r over the pairs where both sides are present; null when a side is constant."""
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    flat = (F.min(x) == F.max(x)) | (F.min(y) == F.max(y))
    r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    return F.when(~flat, r)


def share(part: Column, whole: Column) -> Column:
    """part / whole in percent, null when the whole is zero."""
    return F.try_divide(part * 100.0, whole)


def ratio_or_zero(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))
