"""Known answers: properties of models, scores and attributions that SQL can state."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from flowlens.operators import anomaly, encode, training
from flowlens.plans.frames import EV, EV_NUM, LI, ev, li, table
from flowlens.plans.models import TREE_NAMES, event_attributions, event_models, event_vectors
from flowlens.plans.registry import query

TREES = {
    "random_forest": {"numTrees": 20, "maxDepth": 3, "featureSubsetStrategy": "all"},
    "gradient_boosting": {"maxIter": 10, "maxDepth": 2},
    "decision_tree": {"maxDepth": 3},
}


def _separable(spark, sf):
    """Target: line number above 3. The tax is the second feature and of no use."""
    rows = li(spark, sf).select("l_linenumber", "l_tax", "origin", (F.col("l_linenumber") > 3).cast("int").alias("y"))
    return encode.assemble(rows, ["l_linenumber", "l_tax"])


def _separable_models(spark, sf, names=tuple(TREES)):
    return training.train_all(_separable(spark, sf).where("origin = 'train'"), list(names), params=TREES)


@query("separable_trees", f"""WITH {LI}, m AS (SELECT unnest(['random_forest', 'gradient_boosting', 'decision_tree']) AS model)
SELECT model, l_linenumber, CASE WHEN l_linenumber > 3 THEN 1 ELSE 0 END AS prediction, count(*) AS n
FROM li, m GROUP BY 1, 2, 3""")
def separable_trees(spark, sf):
    """Predictions of the three tree models on a separable target equal the target."""
    scored = training.score_all(_separable_models(spark, sf), _separable(spark, sf), ["l_linenumber"])
    return scored.groupBy("model", "l_linenumber", "prediction").agg(F.count("*").alias("n"))


@query("separable_importance", """SELECT model, feature, CAST(feature = 'l_linenumber' AS INTEGER)::DOUBLE AS importance
FROM (SELECT unnest(['random_forest', 'decision_tree']) AS model),
     (SELECT unnest(['l_linenumber', 'l_tax']) AS feature)""")
def separable_importance(spark, sf):
    """All importance lies on the one useful feature."""
    names, out = ("random_forest", "decision_tree"), None
    models = _separable_models(spark, sf, names)
    for name in names:
        part = training.importances(models[name], ["l_linenumber", "l_tax"], None).withColumn("model", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@query("logistic_class_share", f"""WITH {LI}
SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS flag,
       round_even(avg(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END), 4) AS share FROM li GROUP BY 1""")
def logistic_class_share(spark, sf):
    """Without a penalty, one 0/1 feature gives each group's share of class 1."""
    rows = li(spark, sf).select(
        (F.col("l_returnflag") == "R").cast("int").alias("flag"), (F.col("l_linestatus") == "O").cast("int").alias("y"),
    )
    ready = encode.assemble(rows, ["flag"])
    model = training.train_all(ready, ["logistic_regression"], params={"logistic_regression": {"regParam": 0.0, "tol": 1e-12}})
    scored = training.score_all(model, ready, ["flag"])
    return scored.groupBy("flag").agg(F.bround(F.avg(F.col("p")[1]), 4).alias("share"))


@query("components_full_rank", """SELECT label AS y, count(*) AS n, count(*) AS without_error FROM embeddings GROUP BY 1""")
def components_full_rank(spark, sf):
    """With all components kept, no row has a reconstruction error."""
    rows = table(spark, sf, "embeddings").select(
        F.col("label").alias("y"), array_to_vector(F.col("embedding").cast("array<double>")).alias("features")
    )
    errors = anomaly.PcaDetector.fit(rows, k=1 << 30).errors(rows)
    return errors.groupBy("y").agg(
        F.count("*").alias("n"), F.count_if(F.col("error") < 1e-9).alias("without_error")
    )


_SCORE_SQL = """SELECT origin, model, count(*) AS n, count(*) AS sums_to_one, count(*) AS right_confidence,
       count(*) AS right_verdict, sum(binary_label)::BIGINT AS n_attack
FROM ev, (SELECT unnest(['random_forest', 'gradient_boosting', 'decision_tree']) AS model) GROUP BY 1, 2"""


@query("score_properties", f"WITH {EV} {_SCORE_SQL}")
def score_properties(spark, sf):
    """Per model and split: probabilities, confidence and verdict of every scored row hold together."""
    scored = training.detail(training.score_all(event_models(spark, sf), event_vectors(spark, sf), ["origin", "y"]))
    high = F.greatest("p_normal", "p_attack")
    sure = F.col("p_attack") > 0.5
    return scored.groupBy("origin", "model").agg(
        F.count("*").alias("n"),
        F.count_if(F.abs(F.col("p_normal") + F.col("p_attack") - 1) < 1e-9).alias("sums_to_one"),
        F.count_if(F.abs(F.col("confidence") - 100 * high) < 0.051).alias("right_confidence"),
        F.count_if(F.col("correct") == (sure == (F.col("y") == 1))).alias("right_verdict"),
        F.sum("y").alias("n_attack"),
    )


@query("attribution_adds_up", f"""WITH {EV}
SELECT model, count(*) AS n, count(*) AS exact
FROM ev, (SELECT unnest(['random_forest', 'gradient_boosting', 'decision_tree']) AS model) GROUP BY 1""")
def attribution_adds_up(spark, sf):
    """Base and contributions of every row add up to the model's score, for all tree models."""
    models = event_models(spark, sf)
    target = training.score_all(models, event_vectors(spark, sf), ["row_id"])
    total = F.aggregate("items", F.col("base"), lambda s, i: s + i["contribution"])
    parts = event_attributions(spark, sf, TREE_NAMES).select("row_id", "model", total.alias("total"))
    p = F.col("p")[1]
    # boosting explains its margin, half the log odds
    reached = F.when(F.col("model") == "gradient_boosting", 1 / (1 + F.exp(-2 * F.col("total")))).otherwise(F.col("total"))
    return target.join(parts, ["row_id", "model"]).groupBy("model").agg(
        F.count("*").alias("n"), F.count_if(F.abs(p - reached) < 1e-9).alias("exact")
    )
