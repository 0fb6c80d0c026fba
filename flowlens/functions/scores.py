"""Row-local expressions on scores, probabilities, errors and contributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def decide(p: Column, cut: float = 0.5) -> Column:
    """1 when the score is strictly above the cut."""
    return (p > cut).cast("int")


def argmax(scores: Column) -> Column:
    """0-based position of the first largest element."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def direction(v: Column, positive: str = "attack", other: str = "normal") -> Column:
    return F.when(v > 0, positive).otherwise(other)


def confidence(proba: Column, prediction: Column) -> Column:
    """Probability of the predicted class in percent, one digit."""
    return F.bround(F.get(proba, prediction.cast("int")) * 100, 1)


def baseline_gap(p: Column) -> Column:
    """Distance from the 50 % line in percentage points."""
    return F.abs(p - 0.5) * 100


def baseline_side(p: Column) -> Column:
    return F.when(p > 0.5, "up").otherwise("down")


def squared_error(x: Column, r: Column) -> Column:
    """Mean squared difference of two equally long arrays."""
    total = F.aggregate(
        F.zip_with(x, r, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v
    )
    return total / F.size(x)


def mean_square(cols: Sequence[Column]) -> Column:
    """Mean of squares across columns: the error of a reconstruction by the mean."""
    total = cols[0] * cols[0]
    for c in cols[1:]:
        total = total + c * c
    return total / F.lit(float(len(cols)))


def exceeds(error: Column, threshold: float | Column) -> Column:
    return (error > threshold).cast("int")


def rule_token(condition: Column) -> Column:
    """First token of a rule, as the text-based comparison uses it."""
    return F.split(condition, " ")[0]


def either_contains(a: Column, b: Column) -> Column:
    return a.contains(b) | b.contains(a)
