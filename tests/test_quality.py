"""Metrics from counts against Spark's evaluator and hand-made edge cases."""

import math

from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.sql import functions as F

from flowlens.operators import contributions, evaluate
from flowlens.functions import scores


def pairs(spark, rows):
    return spark.createDataFrame(rows, "y int, prediction int")


def test_weighted_equals_evaluator(spark):
    df = spark.range(5000).select(
        F.pmod(F.xxhash64("id"), F.lit(4)).cast("int").alias("y"),
        F.pmod(F.xxhash64("id", F.lit(7)), F.lit(5)).cast("int").alias("prediction"),
    )
    got = evaluate.weighted_metrics(df, percent=False).first()
    names = {"accuracy": "accuracy", "precision": "weightedPrecision", "recall": "weightedRecall", "f1": "f1"}
    cast = df.select(F.col("y").cast("double"), F.col("prediction").cast("double"))
    for mine, theirs in names.items():
        want = MulticlassClassificationEvaluator(labelCol="y", metricName=theirs).evaluate(cast)
        assert math.isclose(got[mine], want, rel_tol=1e-9), mine


def test_class_never_predicted_and_class_never_seen(spark):
    df = pairs(spark, [(0, 0), (0, 0), (1, 0), (0, 2)])
    by = {r["label"]: r for r in evaluate.class_report(df).collect()}
    assert (by["1"]["precision"], by["1"]["recall"], by["1"]["f1"], by["1"]["support"]) == (0, 0, 0, 1)
    assert (by["2"]["precision"], by["2"]["support"]) == (0, 0)
    assert by["accuracy"]["f1"] == 0.5 and by["accuracy"]["precision"] is None
    cells = {(r["actual"], r["predicted"]): r["n"] for r in evaluate.confusion_matrix(df).collect()}
    assert len(cells) == 9 and cells[2, 2] == 0 and cells[0, 0] == 2


def test_no_negatives_no_positives(spark):
    only_pos = evaluate.error_rates(pairs(spark, [(1, 1), (1, 0)])).first()
    assert (only_pos["fpr"], only_pos["fnr"]) == (0.0, 50.0)
    only_neg = evaluate.error_rates(pairs(spark, [(0, 1)])).first()
    assert (only_neg["fpr"], only_neg["fnr"]) == (100.0, 0.0)
    assert evaluate.binary_metrics(pairs(spark, [(1, 0)])).first()["precision"] == 0


def test_best_model_takes_the_first_name(spark):
    t = spark.createDataFrame([("binary", "b", 90.0), ("binary", "a", 90.0), ("binary", "c", 80.0)],
                              "task string, model string, f1 double")
    assert evaluate.best_model(t).first()["model"] == "a"


def test_strict_cuts(spark):
    df = spark.createDataFrame([(0.5, [0.4, 0.4, 0.2])], "p double, a array<double>")
    row = df.select(
        scores.decide(F.col("p")).alias("c"), scores.argmax(F.col("a")).alias("m"),
        scores.exceeds(F.col("p"), 0.5).alias("e"), scores.direction(F.lit(0.0)).alias("d"),
    ).first()
    assert tuple(row) == (0, 0, 0, "normal")


def test_pair_ranks_with_missing_side(spark):
    def side(rows):
        item = "array<struct<feature:string,value:double,contribution:double>>"
        return spark.createDataFrame(rows, f"row_id long, items {item}")

    left = side([(1, [("a", 0.0, 1.0), ("b", 0.0, -2.0)]), (2, [("a", 0.0, 1.0)])])
    right = side([(1, [("b", None, 0.5)])])
    got = sorted(map(tuple, contributions.pair_ranks(left, right).collect()))
    assert got == [(1, 1, "b", "b", True), (1, 2, "a", None, False), (2, 1, "a", None, False)]


def test_waterfall_ends_at_score(spark):
    item = "array<struct<feature:string,value:double,contribution:double>>"
    df = spark.createDataFrame(
        [(1, 0.5, [("a", 0.0, 1.0), ("b", 0.0, -2.0), ("c", 0.0, 0.25), ("d", 0.0, 0.1)])],
        f"row_id long, base double, items {item}",
    )
    rows = contributions.waterfall(df, 3).orderBy("rank").collect()
    assert [r["feature"] for r in rows] == ["b", "a", "other"]
    assert math.isclose(rows[0]["end_at"], 0.5 + 1 - 2 + 0.35) and math.isclose(rows[-1]["start_at"], 0.5)
    assert all(math.isclose(a["start_at"], b["end_at"]) for a, b in zip(rows, rows[1:]))
    assert contributions.waterfall(df, 5).count() == 4
