"""Reports on per-row feature contributions.

A row's contributions travel as one array of (feature, value, contribution) next to its
``row_id``. Per-row reports (top k, waterfall, pairing) sort inside that array and need no
shuffle; only per-feature reports aggregate, and those combine map-side to one row per feature.
Arrays are unpacked with the outer generators: the inner ones make the optimizer add a size
filter below, which would sort every array a second time.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowlens.functions.scores import direction, either_contains, rule_token
from flowlens.sources.state import written


def pack(values: Mapping[str, tuple[Column, Column]]) -> Column:
    """Array of (feature, value, contribution) from one value and contribution per feature."""
    return F.array(
        *[
            F.struct(
                F.lit(name).alias("feature"),
                v.cast("double").alias("value"),
                c.cast("double").alias("contribution"),
            )
            for name, (v, c) in values.items()
        ]
    )


def to_long(df: DataFrame, items: str = "items") -> DataFrame:
    keep = [c for c in df.columns if c != items]
    return df.select(*keep, F.inline_outer(items)).where(F.col("feature").isNotNull())


def ranked(items: Column) -> Column:
    """Array sorted by absolute contribution, largest first, ties by feature name."""
    keyed = F.transform(
        items,
        lambda x: F.struct(
            (-F.abs(x["contribution"])).alias("key"), x["feature"].alias("feature"),
            x["value"].alias("value"), x["contribution"].alias("contribution"),
        ),
    )
    return F.transform(
        F.array_sort(keyed),
        lambda x: F.struct(
            x["feature"].alias("feature"), x["value"].alias("value"),
            x["contribution"].alias("contribution"),
        ),
    )


def _top(df: DataFrame, k: int, items: str) -> DataFrame:
    return df.withColumn("__top", F.slice(ranked(F.col(items)), 1, k)).drop(items)


def _unpack(df: DataFrame, array: str, keep: list[str]) -> DataFrame:
    """(keep, pos, x) for every element of an array column."""
    out = df.select(*keep, F.posexplode_outer(array).alias("pos", "x"))
    return out.where(F.col("pos").isNotNull())


def topk(df: DataFrame, k: int = 12, items: str = "items") -> DataFrame:
    """The k strongest features of every row with rank, four-digit value and direction."""
    top = _top(df, k, items)
    keep = [c for c in top.columns if c != "__top"]
    return _unpack(top, "__top", keep).select(
        *keep,
        (F.col("pos") + 1).alias("rank"),
        F.col("x.feature").alias("feature"),
        F.bround("x.contribution", 4).alias("contribution"),
        direction(F.col("x.contribution")).alias("direction"),
    )


def waterfall(df: DataFrame, k: int = 15, base: str = "base", items: str = "items") -> DataFrame:
    """Steps from the base value to the score of every row.

    Rank 1 is the strongest feature and ends at the score; each rank starts where the next
    one ends, the remaining features form one ``other`` step that starts at the base.
    """
    keep = [c for c in df.columns if c != items]
    sorted_once = df.withColumn("__o", ranked(F.col(items)))  # own column: used several times below
    order = F.col("__o")
    rest = F.slice(order, k, F.greatest(F.size(order) - k + 1, F.lit(0)))
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x["contribution"])
    other = F.struct(
        F.lit("other").alias("feature"), F.lit(None).cast("double").alias("value"),
        add(rest).alias("contribution"),
    )
    steps = F.when(F.size(order) > k - 1, F.concat(F.slice(order, 1, k - 1), F.array(other)))
    shown = sorted_once.withColumn("__s", F.coalesce(steps, order)).withColumn(
        "score", F.col(base) + add(F.col("__s"))
    )
    return _unpack(shown, "__s", [*keep, "score", "__s"]).select(
        *keep,
        "score",
        (F.col("pos") + 1).alias("rank"),
        F.col("x.feature").alias("feature"),
        F.col("x.contribution").alias("contribution"),
        (F.col("score") - add(F.slice("__s", F.lit(1), F.col("pos")))).alias("end_at"),
    ).withColumn("start_at", F.col("end_at") - F.col("contribution"))


def feature_stats(df: DataFrame, items: str = "items", by: tuple[str, ...] = ()) -> DataFrame:
    """mean, max and population std of |contribution| per feature."""
    a = F.abs(F.col("contribution"))
    return (
        to_long(df.select(*by, items), items)
        .groupBy(*by, "feature")
        .agg(F.avg(a).alias("mean_abs"), F.max(a).alias("max_abs"), F.stddev_pop(a).alias("std_abs"))
    )


def global_rank(stats: DataFrame, k: int = 20, by: tuple[str, ...] = ()) -> DataFrame:
    """1-based rank by mean, statistics rounded to four digits; one row per feature."""
    order = Window.partitionBy(*by).orderBy(F.desc("mean_abs"), "feature")
    out = stats.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return out.select(
        *by, "rank", "feature", *[F.bround(c, 4).alias(c) for c in ("mean_abs", "max_abs", "std_abs")]
    )


def summary_points(df: DataFrame, k: int = 20, items: str = "items") -> DataFrame:
    """All (feature, value, contribution) points of the k strongest features overall.

    The contributions are computed once and written, as both steps read them."""
    df = written(df)
    top = feature_stats(df, items).orderBy(F.desc("mean_abs"), "feature").limit(k)
    return to_long(df, items).join(F.broadcast(top.select("feature")), "feature", "left_semi")


def agreement(left: DataFrame, right: DataFrame, k: int = 15) -> DataFrame:
    """Features in the top k of both models, by name."""
    top = lambda d: d.orderBy(F.desc("mean_abs"), "feature").limit(k).select("feature")
    return top(left).intersect(top(right)).orderBy("feature")


def agreement_table(left: DataFrame, right: DataFrame, k: int = 15) -> DataFrame:
    """Both top-k lists side by side, absent entries null."""
    def top(d, tag):
        r = global_rank(d, k)
        return r.select("feature", F.col("rank").alias(f"rank_{tag}"), F.col("mean_abs").alias(f"mean_{tag}"))

    joined = top(left, "a").join(top(right, "b"), "feature", "full_outer")
    return joined.withColumn("in_both", F.col("rank_a").isNotNull() & F.col("rank_b").isNotNull())


def pair_ranks(
    left: DataFrame, right: DataFrame, k: int = 10, row_id: str = "row_id", items: str = "items"
) -> DataFrame:
    """Two explanation lists of the same row side by side, one row per rank, with a match flag.

    Both sides meet as one array per row, so the join moves rows, not features.
    """
    names = lambda d, tag: _top(d, k, items).select(
        row_id, F.transform("__top", lambda x: x["feature"]).alias(tag)
    )
    both = names(left, "left_f").join(names(right, "right_f"), row_id, "full_outer")
    empty = F.array().cast("array<string>")
    zipped = F.arrays_zip(
        F.coalesce("left_f", empty).alias("l"), F.coalesce("right_f", empty).alias("r")
    )
    return _unpack(both.withColumn("__z", zipped), "__z", [row_id]).select(
        row_id,
        (F.col("pos") + 1).alias("rank"),
        F.col("x.l").alias("left_feature"),
        F.col("x.r").alias("right_feature"),
        F.coalesce(F.col("x.l") == F.col("x.r"), F.lit(False)).alias("matches"),
    )


def pair_rank_tables(left: DataFrame, right: DataFrame, keys: tuple[str, ...] = ("rank",)) -> DataFrame:
    """Two given ranked lists zipped by rank; an absent partner is null."""
    l, r = left.withColumnRenamed("feature", "left_feature"), right.withColumnRenamed("feature", "right_feature")
    return l.join(r, list(keys), "full_outer")


def text_match(df: DataFrame, feature: str, condition: str) -> DataFrame:
    """First token of a rule and whether it and the feature contain one another."""
    token = rule_token(F.col(condition))
    return df.withColumn("token", token).withColumn(
        "matches", either_contains(F.col(feature), F.col("token"))
    )
