"""Relations between columns: correlation and contingency tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from flowlens.functions.bounds import vocabulary
from flowlens.functions.stats import clean_numeric, pearson
from flowlens.session import ship_package

OTHER = "(other)"


def correlations(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(a, b, r) for the given pairs: one pass for means, one for sums of centred products.

    Centring first keeps the sums accurate. A constant column gives null. Pairs with a
    column that has missing values are computed over the rows where both are present.
    """
    columns = list(dict.fromkeys(c for pair in pairs for c in pair))
    vals = {c: clean_numeric(df, c) for c in columns}
    row = df.agg(
        F.count("*"),
        *[F.struct(F.count(v), F.avg(v), F.min(v), F.max(v)) for v in vals.values()],
    ).first()
    total, facts = row[0], dict(zip(columns, row[1:]))
    flat = {c for c, (n, _, lo, hi) in facts.items() if n == 0 or lo == hi}
    holes = {c for c, (n, *_) in facts.items() if n < total}
    centred = {c: v - F.lit(facts[c][1]).cast("double") for c, v in vals.items()}
    square = {c: F.sum(centred[c] * centred[c]) for c in columns}

    def r(a: str, b: str) -> Column:
        if a in flat or b in flat:
            return F.lit(None).cast("double")
        if a in holes or b in holes:
            return pearson(vals[a], vals[b])
        return F.sum(centred[a] * centred[b]) / F.sqrt(square[a] * square[b])

    wide = df.agg(
        *[
            F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), r(a, b).alias("r")).alias(f"p{i}")
            for i, (a, b) in enumerate(pairs)
        ]
    )
    return wide.select(F.inline(F.array(*wide.columns)))


def correlation_pairs(df: DataFrame, columns: Sequence[str], expressions: int = 300) -> DataFrame:
    """(a, b, r) for every pair a before b in column order, over the rows where both are present.

    One pass for means, then one for the sums of centred products of all pairs at once. Where no cell is
    missing and the pairs are at most ``expressions`` many, these are aggregate expressions. Otherwise each
    task adds up five columns x columns matrices and gives one row per pair, so the shuffle
    holds pairs x tasks rows whatever the number of rows. Both read r off the same sums by the same
    formula. A pair with a constant side gives null.
    """
    columns = list(columns)
    if len(columns) < 2:
        return df.sparkSession.createDataFrame([], "a string, b string, r double")
    cells = df.select(*[clean_numeric(df, c).alias(f"c{i}") for i, c in enumerate(columns)])
    total, *facts = cells.agg(F.count(F.lit(1)), *[F.struct(F.avg(c), F.count(c)) for c in cells.columns]).first()
    means = [mean or 0.0 for mean, _ in facts]
    if total and all(n == total for _, n in facts) and len(columns) * (len(columns) - 1) // 2 <= expressions:
        return _pairs_by_expressions(cells, means, columns)
    ship_package(df.sparkSession)
    upper = np.triu_indices(len(columns), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = PairSums(len(means))
        for batch in batches:
            sums.add(np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]) - means)
        if sums.rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(upper[0]), pa.array(upper[1]), *[pa.array(v[upper]) for v in sums.parts()]],
                names=["i", "j", *PairSums.NAMES],
            )

    kinds = ", ".join(f"{n} double" for n in PairSums.NAMES)
    merge = {"low": F.min, "high": F.max}
    whole = cells.mapInArrow(run, f"i long, j long, {kinds}").groupBy("i", "j").agg(
        *[merge.get(n[:-2], F.sum)(n).alias(n) for n in PairSums.NAMES]
    )
    # Every pair is there also when no row is; columns x columns literals.
    names = [(i, j, columns[i], columns[j]) for i, j in combinations(range(len(columns)), 2)]
    pairs = df.sparkSession.createDataFrame(names, "i long, j long, a string, b string")
    return pairs.join(whole, ["i", "j"], "left").select("a", "b", _r(F.col).alias("r"))


def _r(part) -> Column:
    """The coefficient from a pair's sums, named as in PairSums."""
    flat = (part("low_x") >= part("high_x")) | (part("low_y") >= part("high_y"))
    spread = lambda c: F.sqrt(part("n") * part(f"sq_{c}") - part(f"sum_{c}") * part(f"sum_{c}"))
    r = F.try_divide(part("n") * part("prod") - part("sum_x") * part("sum_y"), spread("x") * spread("y"))
    return F.when(~flat, r)


def _pairs_by_expressions(cells: DataFrame, means: Sequence[float], columns: Sequence[str]) -> DataFrame:
    """The pairs of columns without missing cells: sums per column, and a product per pair."""
    names = [f"c{i}" for i in range(len(columns))]
    at = {c: F.col(c) - F.lit(m) for c, m in zip(names, means)}
    pairs = list(combinations(range(len(columns)), 2))
    one = cells.agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        *[f(v).alias(f"{k}_{c}") for c, v in at.items() for k, f in
          (("sum", F.sum), ("sq", lambda v: F.sum(v * v)), ("low", F.min), ("high", F.max))],
        *[F.sum(at[f"c{i}"] * at[f"c{j}"]).alias(f"prod_{i}_{j}") for i, j in pairs],
    )

    def row(i: int, j: int) -> Column:
        def part(name: str) -> Column:
            kind, _, side = name.partition("_")
            return F.col("n" if name == "n" else f"prod_{i}_{j}" if name == "prod" else f"{kind}_c{i if side == 'x' else j}")

        return F.struct(F.lit(columns[i]).alias("a"), F.lit(columns[j]).alias("b"), _r(part).alias("r"))

    return one.select(F.inline(F.array(*[row(i, j) for i, j in pairs])))


class PairSums:
    """Sums over the rows where both columns of a pair are present, NaN being missing."""

    NAMES = ["n", "sum_x", "sum_y", "sq_x", "sq_y", "prod", "low_x", "high_x", "low_y", "high_y"]

    def __init__(self, width: int):
        self.rows = 0
        self.sums = np.zeros((4, width, width))  # n, sum, square and product by (column, partner)
        self.low, self.high = np.full((width, width), np.inf), np.full((width, width), -np.inf)

    def add(self, x: np.ndarray) -> None:
        if not len(x):
            return
        self.rows += len(x)
        here = ~np.isnan(x)
        v, m = np.where(here, x, 0.0), here.astype(float)
        self.sums += [m.T @ m, v.T @ m, (v * v).T @ m, v.T @ v]
        lows, highs = np.where(here, x, np.inf), np.where(here, x, -np.inf)
        full = here.all(axis=0)
        self._bounds(full, lows, highs)
        for j in np.flatnonzero(~full):
            self._bounds(j, lows[here[:, j]], highs[here[:, j]])

    def _bounds(self, partner, lows: np.ndarray, highs: np.ndarray) -> None:
        if len(lows):
            low, high = lows.min(axis=0), highs.max(axis=0)
            if np.ndim(partner):
                low, high = low[:, None], high[:, None]
            self.low[:, partner] = np.minimum(self.low[:, partner], low)
            self.high[:, partner] = np.maximum(self.high[:, partner], high)

    def parts(self) -> list[np.ndarray]:
        n, total, square, product = self.sums
        return [n, total, total.T, square, square.T, product, self.low, self.high, self.low.T, self.high.T]


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Strict lower triangle in long form: row feature, column feature, r."""
    return correlation_pairs(df, columns).select(
        F.col("b").alias("row"), F.col("a").alias("column"), "r"
    )


def high_pairs(df: DataFrame, columns: Sequence[str], cut: float = 0.90) -> DataFrame:
    """Pairs strictly beyond the cut in absolute value, sorted by signed r."""
    return (
        correlation_pairs(df, columns)
        .where(F.abs("r") > cut)
        .withColumn("r", F.bround("r", 3))
        .orderBy(F.desc("r"), "a", "b")
    )


def label_correlation(
    df: DataFrame, columns: Sequence[str], y: str, k: int | None = 20
) -> DataFrame:
    """Absolute correlation with the label, largest first, constant columns last."""
    out = (
        correlations(df, [(c, y) for c in columns])
        .select(F.col("a").alias("column"), F.abs("r").alias("abs_r"))
        .orderBy(F.desc_nulls_last("abs_r"), "column")
    )
    return out if k is None else out.limit(k)


def top_values(df: DataFrame, column: str, k: int) -> DataFrame:
    """The k most frequent values, ties by value."""
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(column)
        .count()
        .orderBy(F.desc("count"), column)
        .limit(k)
        .select(column)
    )


def keep_top_values(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """Rows whose value is among the k most frequent; the broadcast side has k rows."""
    return df.join(F.broadcast(top_values(df, column, k)), column, "left_semi")


def crosstab(df: DataFrame, a: str, b: str, values: Sequence | None = None) -> DataFrame:
    """Zero-filled contingency table, one column per value of ``b``.

    Values outside a given list, and nulls, are counted in the column ``(other)``.
    """
    values = list(values) if values is not None else vocabulary(df, b)
    listed = F.coalesce(F.col(b).isin(values), F.lit(False))
    cells = [F.count_if(F.col(b) == F.lit(v)).alias(str(v)) for v in values]
    return df.groupBy(a).agg(*cells, F.count_if(~listed).alias(OTHER)).orderBy(a)
