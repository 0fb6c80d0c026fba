"""Model registry, training, scoring and model-level reports on Spark ML."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LogisticRegression,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from flowlens.functions.quantiles import exact_quantiles
from flowlens.functions.scores import argmax, confidence, baseline_gap, baseline_side
from flowlens.functions.stats import clean_numeric
from flowlens.operators import cells, celltrees, evaluate, network
from flowlens.operators.boosting import SoftmaxBoosting
from flowlens.session import require_checkpoint_dir
from flowlens.sources.state import MOST_ROWS, dealt, part_rows, shared

HIDDEN = [256, 128, 64]
SEED = 42
ALIASES = {"xgboost": "gradient_boosting"}
# Memory for split statistics per task: more nodes per pass means fewer passes over the rows.
TREE_MEMORY_MB = 1024
# A row's place in every tree is kept (4 bytes each, up to three versions) while that takes a few GB in all.
KEPT_PLACES = 1 << 29


def _forest(classes, rows, **p):
    p = {"numTrees": 100, "maxDepth": 10, "seed": SEED, "maxMemoryInMB": TREE_MEMORY_MB, **p}
    if rows and rows * p["numTrees"] <= KEPT_PLACES:
        p = {"cacheNodeIds": True, "checkpointInterval": -1, **p}  # the same model, without walks from the roots
    return RandomForestClassifier(**p)


def _boosting(classes, rows, **p):
    """Spark's booster for two classes, the softmax booster for more."""
    if classes > 2:
        return SoftmaxBoosting(classes=classes, **p)
    return GBTClassifier(**{"maxIter": 100, "seed": SEED, "maxMemoryInMB": TREE_MEMORY_MB, **p})


def _one_vs_rest(classes, rows, **p):
    return OneVsRest(classifier=_boosting(2, rows, **p), parallelism=min(classes, 8))


def _tree(classes, rows, **p):
    return DecisionTreeClassifier(**{"maxDepth": 20, "seed": SEED, "maxMemoryInMB": TREE_MEMORY_MB, **p})


def _logistic(classes, rows, **p):
    """No own scaling: inputs are standardised. The penalty is one over the row count."""
    penalty = 1.0 / rows if rows else 0.0
    return LogisticRegression(**{"maxIter": 1000, "standardization": False, "regParam": penalty, **p})


FACTORIES = {
    "random_forest": _forest,
    "gradient_boosting": _boosting,
    "decision_tree": _tree,
    "logistic_regression": _logistic,
}
OTHERS = {"one_vs_rest_boosting": _one_vs_rest}  # by name only, in no set of models


def get_model(name: str, classes: int = 2, rows: int | None = None, **params):
    """Estimator by name; forest depth is a parameter because Spark needs a bound (30 at most)."""
    key = ALIASES.get(name, name)
    known = FACTORIES | OTHERS
    if key not in known:
        raise ValueError(f"unknown model {name!r}, choose from {list(known)}")
    return known[key](classes, rows, **params)


def train(estimator, df: DataFrame, features: str = "features", label: str = "y"):
    return _columns(estimator, features, label).fit(df)


def _columns(estimator, features, label):
    estimator = estimator.copy()
    if isinstance(estimator, OneVsRest):
        estimator.setClassifier(_columns(estimator.getClassifier(), features, label))
    return estimator.setFeaturesCol(features).setLabelCol(label)


def _parts(df: DataFrame) -> tuple[DataFrame, int]:
    """Training rows in parts that a task can hold, and their number: a forest keeps a count per row and tree."""
    largest, rows = part_rows(df)
    return (df if largest <= MOST_ROWS else dealt(df, rows, MOST_ROWS)), rows


def train_all(
    df: DataFrame,
    names: Sequence[str],
    classes: int = 2,
    params: dict[str, dict] | None = None,
    parallelism: int = 1,
) -> dict[str, object]:
    """Several models on the same kept feature rows, optionally as concurrent Spark jobs.

    Boosting rounds build on one another; the checkpoint folder cuts their lineage. Trees of many rows are
    fitted on cells, see ``celltrees``.
    """
    require_checkpoint_dir(df.sparkSession)
    slim, rows = _parts(df.select("features", "y"))
    with shared(slim):

        def one(name):
            estimator = get_model(name, classes, rows, **(params or {}).get(name, {}))
            made = celltrees.fit(estimator, slim) if rows >= celltrees.LEAST_ROWS else None
            return made or train(estimator, slim)

        with ThreadPoolExecutor(max(1, parallelism)) as pool:
            return dict(zip(names, pool.map(one, names)))


def score(model, df: DataFrame, keep: Sequence[str] = ("row_id", "y")) -> DataFrame:
    """(keep, prediction, p): class and, where the model has them, class probabilities."""
    out = model.transform(df)
    p = [vector_to_array("probability").alias("p")] if "probability" in out.columns else []
    return out.select(*keep, F.col("prediction").cast("int").alias("prediction"), *p)


def detail(scored: DataFrame) -> DataFrame:
    """Binary scores with probabilities, confidence, verdict and distance from the 50 % line."""
    p0, p1 = F.get("p", F.lit(0)), F.get("p", F.lit(1))
    keep = [c for c in scored.columns if c != "p"]
    return scored.select(
        *keep,
        p0.alias("p_normal"),
        p1.alias("p_attack"),
        confidence(F.col("p"), F.col("prediction")).alias("confidence"),
        (F.col("prediction") == F.col("y")).alias("correct"),
        baseline_gap(p1).alias("gap"),
        baseline_side(p1).alias("side"),
    )


def importances(model, names: Sequence[str], k: int | None = 20) -> DataFrame:
    """(feature, importance) of a tree model, strongest first; models without them are refused."""
    if not hasattr(model, "featureImportances"):
        raise ValueError("only tree models carry feature importances")
    from pyspark.sql import SparkSession

    values = model.featureImportances.toArray()
    out = SparkSession.getActiveSession().createDataFrame(
        [(n, float(v)) for n, v in zip(names, values)], "feature string, importance double"
    ).orderBy(F.desc("importance"), "feature")
    return out if k is None else out.limit(k)


def score_all(
    models: Mapping[str, object], df: DataFrame, keep: Sequence[str] = ("row_id", "y"),
    flags: Mapping[str, Column] | None = None,
) -> DataFrame:
    """(keep, model, prediction, p) of every row by every model, from one scan of the rows.

    ``flags`` adds predictions that columns of the rows already hold, with p null.
    """
    def cell(name: str, prediction: Column, p: Column) -> Column:
        return F.struct(
            F.lit(name).alias("model"), prediction.cast("int").alias("prediction"),
            p.cast("array<double>").alias("p"),
        )

    cells = [cell(n, c, F.lit(None)) for n, c in (flags or {}).items()]
    out = df
    for i, (name, model) in enumerate(models.items()):
        out = model.transform(out)
        p = vector_to_array("probability") if "probability" in out.columns else F.lit(None)
        out = out.withColumn(f"__m{i}", cell(name, F.col("prediction"), p))
        out = out.drop("prediction", "probability", "rawPrediction")
        cells.append(F.col(f"__m{i}"))
    return out.select(*keep, F.inline(F.array(*cells)))


def compare(scored: DataFrame, task: str) -> DataFrame:
    """One metric row per model of (model, y, prediction) rows, counted in one grouped pass."""
    return evaluate.metrics(scored, task, by=["model"])


def tail_split(df: DataFrame, row_id: str = "row_id", fraction: float = 0.1) -> Column:
    """True for the last share of rows in id order, the validation rows."""
    cut = exact_quantiles(df, {"id": clean_numeric(df, row_id)}, (1 - fraction,))["id"][0]
    return F.col(row_id) > F.lit(cut)


def log_loss(scored: DataFrame) -> float:
    """Mean negative log probability of the true class."""
    p = F.greatest(F.get("p", F.col("y").cast("int")), F.lit(1e-15))
    return scored.agg(F.avg(-F.log(p))).first()[0]


@dataclass(frozen=True)
class Fitted:
    """A model with its (iteration, train_loss, validation_loss) history."""

    model: object
    history: list[tuple[int, float, float]]

    def history_table(self, spark) -> DataFrame:
        return spark.createDataFrame(
            self.history, "iteration int, train_loss double, validation_loss double"
        )


def fit_mlp(
    df: DataFrame,
    classes: int,
    validation: Column,
    epochs: int = 50,
    patience: int = 5,
    hidden: Sequence[int] = tuple(HIDDEN),
    batch: int = 256,
    seed: int = SEED,
) -> Fitted:
    """Multi-layer perceptron by mini-batches, stopped by the held-out loss; see ``network``."""
    width = len(df.select("features").first()["features"])
    shape = network.Shape((width, *hidden, classes))
    return Fitted(*network.fit(df, shape, validation, epochs=epochs, patience=patience, batch=batch, seed=seed))


BY_ROW = {"minInstancesPerNode", "subsamplingRate"}  # parameters that tell rows alike apart


def fit_boosting(df: DataFrame, validation: Column, **params) -> Fitted:
    """Boosted trees that stop when the validation error stops falling.

    Rows that the trees can't tell apart are boosted as one weighted row, see ``cells``.
    """
    require_checkpoint_dir(df.sparkSession)
    stop = {"validationIndicatorCol": "held_out", "validationTol": 0.001}
    marked, _ = _parts(df.withColumn("held_out", validation).select("features", "y", "held_out"))
    if BY_ROW & set(params):
        with shared(marked):
            return _boosted(get_model("gradient_boosting", **stop, **params), marked)
    plain = get_model("gradient_boosting", **stop, **params)
    with shared(marked), cells.cells(marked, "held_out", plain.getMaxBins(), plain.getSeed()) as (few, cuts):
        marked.unpersist()
        # as many bins as make Spark look at every cell for its thresholds: there are none but between the bins
        most = max(plain.getMaxBins(), math.isqrt(few.where("NOT held_out").count()) + 1)
        fit = _boosted(plain.copy({plain.maxBins: most}).setWeightCol("n"), few)
    return Fitted(cells.BinnedModel(fit.model, cuts), fit.history)


def _boosted(estimator, marked: DataFrame) -> Fitted:
    model = train(estimator, marked)
    sides = [model.evaluateEachIteration(marked.where(F.col("held_out") == held)) for held in (False, True)]
    return Fitted(model, [(i + 1, float(a), float(b)) for i, (a, b) in enumerate(zip(*sides))])
