"""Profiling: counts, balance, summaries, skew, zeros, outliers, box data, histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from flowlens.functions.bounds import refuse_unlisted
from flowlens.functions.quantiles import exact_quantiles
from flowlens.functions.stats import clean_numeric, corrected_skewness, share


def row_counts(df: DataFrame, origin: str = "origin") -> DataFrame:
    return df.groupBy(origin).agg(F.count("*").alias("n"))


def frequencies(df: DataFrame, column: str) -> DataFrame:
    """Value counts, largest first, ties by value; nulls are not counted."""
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), column)
    )


def class_share(df: DataFrame, column: str) -> DataFrame:
    """Value counts with their share of the total, which is a one-row subquery."""
    counts = frequencies(df, column)
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("share_pct", F.bround(F.try_divide(F.col("n") * 100.0, total), 1))


def imbalance(df: DataFrame, y: str = "binary_label") -> DataFrame:
    one, zero = F.count_if(F.col(y) == 1), F.count_if(F.col(y) == 0)
    return df.agg(F.try_divide(one.cast("double"), zero.cast("double")).alias("ratio"))


def binary_counts(df: DataFrame, y: str = "binary_label") -> DataFrame:
    return df.agg(
        F.count_if(F.col(y) == 0).alias("n_normal"), F.count_if(F.col(y) == 1).alias("n_attack")
    )


def null_cells(df: DataFrame, columns: Sequence[str], origin: str = "origin") -> DataFrame:
    """Missing cells over all columns, counted per row before the aggregate."""
    per_row = sum((F.col(c).isNull().cast("int") for c in columns), F.lit(0))
    return df.groupBy(origin).agg(F.sum(per_row).alias("null_cells"))


def distinct_counts(df: DataFrame, columns: Sequence[str], exact: bool = True) -> DataFrame:
    """Distinct non-null values per column. Exact: partial distinct per (column, value)."""
    if not exact:
        return _long(df.agg(*[F.approx_count_distinct(c).alias(c) for c in columns]), "n_distinct")
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in columns]
    )
    return (
        df.select(F.explode(pairs).alias("p"))
        .select("p.column", "p.v")
        .where(F.col("v").isNotNull())
        .distinct()
        .groupBy("column")
        .agg(F.count("*").alias("n_distinct"))
    )


def numeric_summary(df: DataFrame, columns: Sequence[str], **options) -> DataFrame:
    """count, mean, sample std, min, exact quartiles and max; one row per column."""
    vals = {c: clean_numeric(df, c) for c in columns}
    quartiles = exact_quantiles(df, vals, (0.25, 0.5, 0.75), **options)
    stats = df.agg(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.count(v).alias("n"),
                F.avg(v).alias("mean"),
                F.stddev_samp(v).alias("std"),
                F.min(v).alias("min"),
                *[F.lit(x).cast("double").alias(q) for q, x in zip(("q25", "q50", "q75"), quartiles[c])],
                F.max(v).alias("max"),
            ).alias(f"s{i}")
            for i, (c, v) in enumerate(vals.items())
        ]
    )
    return stats.select(F.inline(F.array(*stats.columns)))


def _long(one_row: DataFrame, value: str, ids: Sequence[str] = ()) -> DataFrame:
    """One wide row of equally typed statistics to (column, value) rows."""
    cols = [c for c in one_row.columns if c not in ids]
    return one_row.unpivot(list(ids), cols, "column", value)


def skew_rank(df: DataFrame, columns: Sequence[str], k: int | None = 10) -> DataFrame:
    wide = df.agg(*[corrected_skewness(clean_numeric(df, c)).alias(c) for c in columns])
    return _top(_long(wide, "skewness"), "skewness", k)


def zero_share(df: DataFrame, columns: Sequence[str], above: float | None = None) -> DataFrame:
    """Zeros in percent of all rows, nulls in the denominator; optionally strictly above a cut."""
    wide = df.agg(
        *[share(F.count_if(clean_numeric(df, c) == 0), F.count("*")).alias(c) for c in columns]
    )
    out = _long(wide, "zero_pct")
    if above is not None:
        out = out.where(F.col("zero_pct") > above)
    return out.orderBy(F.desc("zero_pct"), "column")


def _top(df: DataFrame, value: str, k: int | None) -> DataFrame:
    ordered = df.orderBy(F.desc_nulls_last(value), "column")
    return ordered if k is None else ordered.limit(k)


def _fences(q1: float | None, q3: float | None) -> tuple[float | None, float | None]:
    if q1 is None:
        return None, None
    reach = 1.5 * (q3 - q1)
    return q1 - reach, q3 + reach


def _outside(v: Column, low: float | None, high: float | None) -> Column:
    return (v < F.lit(low).cast("double")) | (v > F.lit(high).cast("double"))


def iqr_outliers(
    df: DataFrame, columns: Sequence[str], k: int | None = 15, **options
) -> DataFrame:
    """Rows strictly outside the quartile fences, per column; fences enter as constants."""
    vals = {c: clean_numeric(df, c) for c in columns}
    cut = {c: _fences(*q) for c, q in exact_quantiles(df, vals, (0.25, 0.75), **options).items()}
    wide = df.agg(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.lit(cut[c][0]).cast("double").alias("lower"),
                F.lit(cut[c][1]).cast("double").alias("upper"),
                F.count_if(_outside(v, *cut[c])).alias("outliers"),
            ).alias(f"s{i}")
            for i, (c, v) in enumerate(vals.items())
        ]
    )
    return _top(wide.select(F.inline(F.array(*wide.columns))), "outliers", k)


def box_stats(
    df: DataFrame, by: str, groups: Sequence[str], columns: Sequence[str], log: bool = True, **options
) -> DataFrame:
    """Quartiles and whiskers per group and column, values through log1p by default.

    Whiskers are the furthest values inside the fences. Groups are a bounded label set; rows
    combine map-side to one row per group, however large a group is. A row of a group that is
    not named is an error.
    """
    refuse_unlisted(df, by, groups)
    vals = {}
    for c in columns:
        v = clean_numeric(df, c)
        vals[c] = F.when(v > -1, F.log1p(v)) if log else v
    got = exact_quantiles(df, vals, (0.25, 0.5, 0.75), F.col(by), groups, **options)

    rows = []
    for g in groups:
        cells = [(*got[g, c], *_fences(got[g, c][0], got[g, c][2])) for c in columns]
        rows.append((g, *[x for cell in cells for x in cell]))
    parts = ("q1", "median", "q3", "low", "high")
    names = [f"{part}{i} double" for i in range(len(cells)) for part in parts]
    kind = df.schema[by].dataType.simpleString()
    fences = df.sparkSession.createDataFrame(rows, ", ".join([f"`{by}` {kind}", *names]))

    stats = []
    for i, (c, v) in enumerate(vals.items()):
        kept = F.when(v.between(F.col(f"low{i}"), F.col(f"high{i}")), v)
        stats.append(
            F.struct(
                F.lit(c).alias("column"), F.count(v).alias("n"),
                *[F.first(f"{q}{i}").alias(q) for q in parts[:3]],
                F.min(kept).alias("whisker_low"), F.max(kept).alias("whisker_high"),
            ).alias(f"s{i}")
        )
    wide = df.join(F.broadcast(fences), by).groupBy(by).agg(*stats)  # one fence row per group
    return wide.select(by, F.inline(F.array(*[f"s{i}" for i in range(len(stats))])))


def histogram(
    df: DataFrame,
    columns: Sequence[str],
    bins: int = 40,
    by: str | None = None,
    groups: Sequence = (),
) -> DataFrame:
    """Equal-width counts per column (and class), each on its own range, last bin closed.

    Only non-empty bins are returned. A constant column is centred in a range of width one.
    Ranges come from one wide aggregate and enter the second pass as constants, so no row is
    joined; a row of a class that is not named is an error.
    """
    if by:
        refuse_unlisted(df, by, groups)
    key = [by] if by else []
    vals = [clean_numeric(df, c) for c in columns]
    bounds = df.groupBy(*key).agg(*[F.struct(F.min(v), F.max(v), F.count(v)) for v in vals])
    ranges = {r[0] if by else None: r[len(key):] for r in bounds.collect()}  # one row per class

    def constants(g) -> Column:
        cells = []
        for low, high, total in ranges[g]:
            if low is not None and low == high:
                low, high = low - 0.5, high + 0.5
            cells.append(F.struct(*[
                F.lit(x).cast(kind).alias(name)
                for x, kind, name in ((low, "double", "low"), (high, "double", "high"), (total, "long", "total"))
            ]))
        return F.array(*cells)

    known = constants(None) if not by else None
    for g in ranges if by else ():
        hit = F.col(by) == F.lit(g)
        known = F.when(hit, constants(g)) if known is None else known.when(hit, constants(g))
    out = [*key, "column", "bin", "n", "left_edge", "density"]
    if known is None:
        kinds = [f"`{by}` {df.schema[by].dataType.simpleString()}"] if by else []
        kinds += ["column string", "bin int", "n long", "left_edge double", "density double"]
        return df.sparkSession.createDataFrame([], ", ".join(kinds))

    def place(i: int) -> Column:
        low, high = (F.get(known, F.lit(i))[x] for x in ("low", "high"))
        at = F.floor((vals[i] - low) / (high - low) * bins)
        return F.least(at, F.lit(bins - 1)).cast("int")

    cells = F.array(*[F.struct(F.lit(i).alias("pos"), place(i).alias("bin")) for i in range(len(vals))])
    counted = (
        df.select(*key, F.inline(cells))
        .where(F.col("bin").isNotNull())
        .groupBy(*key, "pos", "bin")
        .agg(F.count("*").alias("n"))
        .withColumn("at", F.get(known, F.col("pos")))
    )
    width = (F.col("at.high") - F.col("at.low")) / bins
    return counted.select(
        *key, F.get(F.array(*[F.lit(c) for c in columns]), F.col("pos")).alias("column"), "bin", "n",
        (F.col("at.low") + F.col("bin") * width).alias("left_edge"),
        (F.col("n") / (F.col("at.total") * width)).alias("density"),
    ).select(*out)
