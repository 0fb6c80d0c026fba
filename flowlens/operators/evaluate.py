"""Classification quality from (actual, predicted) pairs.

Every measure derives from one grouped count, so a table of any size shuffles at most
classes x classes rows per task, and any number of models is scored in the same pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowlens.functions.bounds import vocabularies
from flowlens.functions.stats import ratio_or_zero

METRICS = ["accuracy", "precision", "recall", "f1"]


def _pct(c: Column, digits: int = 2) -> Column:
    return F.bround(c * 100, digits)


def confusion_counts(
    df: DataFrame, y: str = "y", p: str = "prediction", by: Sequence[str] = ()
) -> DataFrame:
    """Observed (actual, predicted) cells with their counts."""
    return df.groupBy(*by, F.col(y).alias("actual"), F.col(p).alias("predicted")).agg(
        F.count("*").alias("n")
    )


def confusion_matrix(
    df: DataFrame, y: str = "y", p: str = "prediction", labels: Sequence | None = None
) -> DataFrame:
    """Every cell over the sorted union of labels, zero where nothing was observed.

    Observed cells outside a given list, or with a null side, are returned as well.
    """
    if labels is None:
        seen = vocabularies(df, [y, p])
        labels = sorted({*seen[y], *seen[p]})
    known = F.array(*[F.lit(v) for v in labels])
    cells = (
        df.sparkSession.range(1)
        .select(F.explode(known).alias("actual"))
        .select("actual", F.explode(known).alias("predicted"))
    )
    blank = cells.withColumn("n", F.lit(0).cast("long"))
    both = blank.unionByName(confusion_counts(df, y, p)) if labels else confusion_counts(df, y, p)
    return both.groupBy("actual", "predicted").agg(F.sum("n").alias("n"))


def binary_cells(
    df: DataFrame, y: str = "y", p: str = "prediction", by: Sequence[str] = ()
) -> DataFrame:
    """Counts of the four outcomes; whatever is not 1, null included, counts as the other class."""
    yes, hit = (F.col(c).eqNullSafe(F.lit(1)) for c in (y, p))
    return df.groupBy(*by).agg(
        F.count_if(~yes & ~hit).alias("tn"),
        F.count_if(~yes & hit).alias("fp"),
        F.count_if(yes & ~hit).alias("fn"),
        F.count_if(yes & hit).alias("tp"),
    )


def rates_of(cells: DataFrame) -> DataFrame:
    """False positive and false negative rates in percent beside the cells, 0 without a base."""
    rate = lambda a, b: _pct(ratio_or_zero(F.col(a), F.col(a) + F.col(b)))
    return cells.withColumns({"fpr": rate("fp", "tn"), "fnr": rate("fn", "tp")})


def metrics_of(cells: DataFrame) -> DataFrame:
    """Metrics of class 1 beside the cells in percent, two digits, 0 on an empty denominator."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return cells.withColumns({
        "accuracy": _pct(ratio_or_zero(tp + tn, tp + tn + fp + fn)),
        "precision": _pct(ratio_or_zero(tp, tp + fp)),
        "recall": _pct(ratio_or_zero(tp, tp + fn)),
        "f1": _pct(ratio_or_zero(2 * tp, 2 * tp + fp + fn)),
    })


def error_rates(
    df: DataFrame, y: str = "y", p: str = "prediction", by: Sequence[str] = ()
) -> DataFrame:
    return rates_of(binary_cells(df, y, p, by))


def binary_metrics(
    df: DataFrame, y: str = "y", p: str = "prediction", by: Sequence[str] = ()
) -> DataFrame:
    return metrics_of(binary_cells(df, y, p, by)).select(*by, *METRICS)


def per_class(
    df: DataFrame, y: str = "y", p: str = "prediction", by: Sequence[str] = ()
) -> DataFrame:
    """Unrounded precision, recall, F1 and support of every class that occurs."""
    cells = confusion_counts(df, y, p, by)
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)
    sides = F.array(
        F.struct(F.col("actual").alias("label"), F.col("n").alias("support"),
                 F.lit(0).cast("long").alias("predicted"), hit.cast("long").alias("tp")),
        F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("support"),
                 F.col("n").alias("predicted"), F.lit(0).cast("long").alias("tp")),
    )
    sums = cells.select(*by, F.inline(sides)).groupBy(*by, "label").agg(
        *[F.sum(c).alias(c) for c in ("support", "predicted", "tp")]
    )
    return sums.withColumns(
        {
            "precision": ratio_or_zero(F.col("tp"), F.col("predicted")),
            "recall": ratio_or_zero(F.col("tp"), F.col("support")),
            "f1": ratio_or_zero(2 * F.col("tp"), F.col("support") + F.col("predicted")),
        }
    )


def _weighted(c: str) -> Column:
    return ratio_or_zero(F.sum(F.col(c) * F.col("support")), F.sum("support"))


def weighted_metrics(
    df: DataFrame,
    y: str = "y",
    p: str = "prediction",
    by: Sequence[str] = (),
    percent: bool = True,
) -> DataFrame:
    """Support-weighted metrics; in percent with two digits, or raw fractions."""
    out = lambda c: _pct(c) if percent else c
    return per_class(df, y, p, by).groupBy(*by).agg(
        out(ratio_or_zero(F.sum("tp"), F.sum("support"))).alias("accuracy"),
        *[out(_weighted(m)).alias(m) for m in METRICS[1:]],
    )


def metrics(
    df: DataFrame, task: str, y: str = "y", p: str = "prediction", by: Sequence[str] = ()
) -> DataFrame:
    """Binary or weighted metrics by task name, with the task as a column."""
    score = {"binary": binary_metrics, "multiclass": weighted_metrics}[task]
    return score(df, y, p, by).withColumn("task", F.lit(task))


def class_report(df: DataFrame, y: str = "y", p: str = "prediction") -> DataFrame:
    """One row per class plus accuracy, macro average and weighted average, four digits.

    As in the printed report, the accuracy row fills the f1 column only.
    """
    classes = per_class(df, y, p)
    label = F.col("label").cast("string").alias("label")
    four = lambda c, name: F.bround(c, 4).alias(name)
    support = F.sum("support").alias("support")
    total = classes.agg(
        F.array(
            F.struct(
                F.lit("accuracy").alias("label"),
                F.lit(None).cast("double").alias("precision"),
                F.lit(None).cast("double").alias("recall"),
                four(ratio_or_zero(F.sum("tp"), F.sum("support")), "f1"), support,
            ),
            F.struct(F.lit("macro avg").alias("label"),
                     *[four(F.avg(m), m) for m in METRICS[1:]], support),
            F.struct(F.lit("weighted avg").alias("label"),
                     *[four(_weighted(m), m) for m in METRICS[1:]], support),
        ).alias("rows")
    )
    return classes.select(label, *[four(F.col(m), m) for m in METRICS[1:]], "support").unionByName(
        total.select(F.inline("rows"))
    )


def best_model(table: DataFrame, metric: str = "f1") -> DataFrame:
    """Model with the highest metric per task, the first name among equals."""
    first = F.min(F.struct((-F.col(metric)).alias("neg"), F.col("model").alias("model")))
    return table.groupBy("task").agg(first.alias("b")).select(
        "task", F.col("b.model").alias("model"), (-F.col("b.neg")).alias(metric)
    )


def metric_profile(table: DataFrame, names: Sequence[str] = METRICS) -> DataFrame:
    """(task, model, metric, value) rows for side-by-side charts."""
    return table.unpivot(["task", "model"], list(names), "metric", "value")


def max_flags(table: DataFrame, names: Sequence[str] = METRICS) -> DataFrame:
    """Profile with a flag on the best value per metric; windows over one row per model."""
    best = F.max("value").over(Window.partitionBy("task", "metric"))
    return metric_profile(table, names).withColumn("is_max", F.col("value") == best)


def stack_predictions(df: DataFrame, y: str, models: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """One prediction column per model to (keep, y, model, prediction) rows."""
    return df.unpivot([*keep, y], list(models), "model", "prediction")
