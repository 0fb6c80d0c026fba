"""Training, scoring and explanation queries on the given tables.

Fitted models are kept per table folder, because several queries explain the same model, for as long as
the folder's files stay as they are.
"""

from __future__ import annotations

import uuid
from functools import wraps

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from flowlens.operators import anomaly, attribution, clean, contributions, encode, surrogate, training
from flowlens.plans import marts
from flowlens.plans.frames import EV_NUM, ev, table
from flowlens.plans.registry import query
from flowlens.session import require_checkpoint_dir
from flowlens.sources import spread
from flowlens.sources.state import files_of

_KEPT: dict[tuple, object] = {}


def forget_models() -> None:
    _KEPT.clear()


def _once(fn):
    @wraps(fn)
    def call(spark, sf):
        key = (fn.__name__, spark.sparkContext.applicationId, sf, files_of(spark, sf))
        if key not in _KEPT:
            _KEPT[key] = fn(spark, sf)
        return _KEPT[key]

    return call


LI_FEATURES = ["l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_quantity"]
LI_NOMINAL = ["l_returnflag", "l_linestatus"]
NET_CUT = 50000.0  # about the median of the net price


def _item_rows(spark, sf):
    """Line items: id, split and whether the net price, which is no feature, is above the cut.

    No column of the table is unique, so the id is a hash of the whole row.
    """
    raw = table(spark, sf, "lineitem")
    return raw.select(
        F.xxhash64(*raw.columns).alias("row_id"), *LI_FEATURES, *LI_NOMINAL,
        (F.col("l_extendedprice") * (1 - F.col("l_discount")) > NET_CUT).cast("int").alias("y"),
        F.when(F.col("l_shipdate") >= F.lit("2000-10-01").cast("timestamp_ntz"), "test")
        .otherwise("train").alias("origin"),
    )


@_once
def _item_encoders(spark, sf):
    """Dummies and scaler, fitted once per table."""
    rows = _item_rows(spark, sf)
    hot = encode.OneHot.fit(rows, LI_NOMINAL)
    cols = [*LI_FEATURES, *hot.names()]
    return hot, encode.Standardizer.fit(clean.part(hot.transform(rows), "train"), cols)


def item_vectors(spark, sf):
    hot, scaler = _item_encoders(spark, sf)
    wide = scaler.transform(hot.transform(spread(_item_rows(spark, sf))))
    return encode.assemble(wide, scaler.outputs()).select("row_id", "origin", "y", "features")


def _item_fit(spark, sf, name, **params):
    key = ("item", name, spark.sparkContext.applicationId, sf, files_of(spark, sf))
    if key not in _KEPT:
        train = clean.part(item_vectors(spark, sf), "train")
        _KEPT[key] = training.train_all(train, [name], params={name: params})[name]
    return _KEPT[key]


def _item_scores(spark, sf, name):
    model = _item_fit(spark, sf, name)
    return training.detail(training.score(model, item_vectors(spark, sf), ["row_id", "origin", "y"]))


@query("rf_scores")
def rf_scores(spark, sf):
    return _item_scores(spark, sf, "random_forest")


@query("gbt_scores")
def gbt_scores(spark, sf):
    return _item_scores(spark, sf, "gradient_boosting")


@query("dt_scores")
def dt_scores(spark, sf):
    return _item_scores(spark, sf, "decision_tree")


@query("lr_scores")
def lr_scores(spark, sf):
    return _item_scores(spark, sf, "logistic_regression")


@query("importance_top20")
def importance_top20(spark, sf):
    _, scaler = _item_encoders(spark, sf)
    return training.importances(_item_fit(spark, sf, "random_forest"), list(scaler.stats), 20)


ML_NAMES = list(training.FACTORIES)


@query("model_comparison")
def model_comparison(spark, sf):
    """Test metrics of the four classifiers, the network and the component-based detector."""
    rows = item_vectors(spark, sf)
    train, test = clean.part(rows, "train"), clean.part(rows, "test")
    models = {n: _item_fit(spark, sf, n) for n in ML_NAMES} | {"mlp": _item_network(spark, sf).model}
    detector = anomaly.PcaDetector.fit(train.where("y = 0"), k=4)
    flags = {"pca_detector": F.col("flag")}
    return training.compare(training.score_all(models, detector.transform(test), ["y"], flags), "binary")


@_once
def _item_network(spark, sf):
    rows = clean.part(item_vectors(spark, sf), "train")
    return training.fit_mlp(rows, 2, F.pmod("row_id", F.lit(10)) == 0)


def _vectors(spark, sf):
    return spread(table(spark, sf, "embeddings")).select(
        F.col("vec_id").alias("row_id"), F.col("label").cast("double").alias("y"),
        array_to_vector(F.col("embedding").cast("array<double>")).alias("features"),
    )


def _vector_parts(spark, sf):
    """Train and test rows of the embeddings: every fifth id is held out."""
    rows = _vectors(spark, sf)
    held = F.col("row_id") % 5 == 4
    return rows.where(~held), rows.where(held)


@_once
def _network(spark, sf):
    rows, _ = _vector_parts(spark, sf)
    return training.fit_mlp(rows, 10, F.col("row_id") % 5 == 3)


@query("mlp_scores")
def mlp_scores(spark, sf):
    scored = training.score(_network(spark, sf).model, _vectors(spark, sf))
    return scored.select("row_id", "y", "prediction", F.array_max("p").alias("p_best"))


@query("mlp_history")
def mlp_history(spark, sf):
    return _network(spark, sf).history_table(spark)


# One-vs-rest trains rounds x classes trees one after another; see README.
ONE_VS_REST_ROUNDS = 10


def _vector_models(spark, sf, names=ML_NAMES):
    """Named models of the embeddings; those that a query doesn't score aren't fitted for it."""
    key = lambda n: ("vector", n, spark.sparkContext.applicationId, sf, files_of(spark, sf))
    missing = [n for n in names if key(n) not in _KEPT]
    if missing:
        made = training.train_all(_vector_parts(spark, sf)[0], missing, 10)
        _KEPT.update({key(n): m for n, m in made.items()})
    return {n: _KEPT[key(n)] for n in names}


@query("softmax_scores")
def softmax_scores(spark, sf):
    name = "gradient_boosting"
    return training.score(_vector_models(spark, sf, [name])[name], _vector_parts(spark, sf)[1])


@query("gbt_ovr_scores")
def gbt_ovr_scores(spark, sf):
    name = "one_vs_rest_boosting"
    fewer = {name: {"maxIter": ONE_VS_REST_ROUNDS}}
    model = training.train_all(_vector_parts(spark, sf)[0], [name], 10, fewer)[name]
    return training.score(model, _vector_parts(spark, sf)[1])


@query("training_history")
def training_history(spark, sf):
    """Train and validation loss of boosted trees with early stopping."""
    rows = clean.part(item_vectors(spark, sf), "train")
    return training.fit_boosting(rows, F.pmod("row_id", F.lit(10)) == 0, maxIter=100).history_table(spark)


@query("multiclass_comparison")
def multiclass_comparison(spark, sf):
    """Weighted metrics of all multiclass models over the held-out embeddings."""
    models = _vector_models(spark, sf) | {"mlp": _network(spark, sf).model}
    test = _vector_parts(spark, sf)[1].withColumn("y", F.col("y").cast("int"))
    return training.compare(training.score_all(models, test, ["y"]), "multiclass")


@query("pca_anomaly")
def pca_anomaly(spark, sf):
    """Embeddings flagged by their distance from the main directions of labels 0 to 8."""
    rows = _vectors(spark, sf)
    detector = anomaly.PcaDetector.fit(rows.where("y < 9"), k=32)
    return detector.transform(rows).select("row_id", "y", "error", "flag")


# --- explanations on events ---

TREE_NAMES = ["random_forest", "gradient_boosting", "decision_tree"]


@_once
def _event_scaler(spark, sf):
    return encode.Standardizer.fit(clean.part(ev(spark, sf), "train"), EV_NUM)


def event_vectors(spark, sf):
    scaler = _event_scaler(spark, sf)
    scaled = scaler.transform(spread(ev(spark, sf)))
    return encode.assemble(scaled, scaler.outputs()).select(
        "row_id", "origin", F.col("binary_label").alias("y"), *scaler.outputs(), "features"
    )


def _event_fit(spark, sf, name):
    """A tree model as the registry makes it: none is smaller for the sake of explanations."""
    key = ("event", name, spark.sparkContext.applicationId, sf, files_of(spark, sf))
    if key not in _KEPT:
        train = clean.part(event_vectors(spark, sf), "train")
        _KEPT[key] = training.train_all(train, [name])[name]
    return _KEPT[key]


def event_models(spark, sf, names=TREE_NAMES):
    """Named tree models; those that a query doesn't explain aren't fitted for it."""
    return {n: _event_fit(spark, sf, n) for n in names}


def event_trees(spark, sf, names=TREE_NAMES):
    trees = {}
    for n, m in event_models(spark, sf, names).items():
        key = ("trees", n, spark.sparkContext.applicationId, sf, files_of(spark, sf))
        if key not in _KEPT:
            _KEPT[key] = attribution.trees_of(m)
        trees[n] = _KEPT[key]
    return trees


def event_attributions(spark, sf, names):
    """Contributions for every event by every named model, from one scan."""
    return attribution.attribute_all(
        event_vectors(spark, sf), event_trees(spark, sf, names), EV_NUM, keep=("origin", "y"))


def _forest_attributions(spark, sf):
    return event_attributions(spark, sf, ["random_forest"]).drop("model")


@query("tree_attribution")
def tree_attribution(spark, sf):
    return contributions.to_long(event_attributions(spark, sf, TREE_NAMES))


@query("attribution_topk")
def attribution_topk(spark, sf):
    return contributions.topk(_forest_attributions(spark, sf), 3)


@query("attribution_waterfall")
def attribution_waterfall(spark, sf):
    return contributions.waterfall(_forest_attributions(spark, sf), 4)


@query("attribution_rank")
def attribution_rank(spark, sf):
    """Global rank over all rows; the attribution job is distributed and needs no sample."""
    parts = _forest_attributions(spark, sf)
    return contributions.global_rank(contributions.feature_stats(parts), 20)


@query("attribution_points")
def attribution_points(spark, sf):
    return contributions.summary_points(_forest_attributions(spark, sf), 3)


@query("attribution_agreement")
def attribution_agreement(spark, sf):
    names = ["random_forest", "gradient_boosting"]
    stats = contributions.feature_stats(event_attributions(spark, sf, names), by=("model",))
    one = lambda n: stats.where(F.col("model") == n).drop("model")
    return contributions.agreement_table(*map(one, names), k=3)


@_once
def event_context(spark, sf):
    scaler = _event_scaler(spark, sf)
    train = clean.part(event_vectors(spark, sf), "train")
    return surrogate.Context.fit(train, scaler.outputs())


def _surrogates(spark, sf, labels=None, names=("random_forest",)):
    """Rules for every test row."""
    rows, models = clean.part(event_vectors(spark, sf), "test"), event_models(spark, sf, names)
    return surrogate.explain_all(rows, models, event_context(spark, sf), 5, labels)


@query("local_surrogate")
def local_surrogate(spark, sf):
    return _surrogates(spark, sf, [0, 1]).drop("model")


@query("rule_table")
def rule_table(spark, sf):
    return surrogate.rule_table(_surrogates(spark, sf).drop("model"))


@query("attribution_vs_surrogate")
def attribution_vs_surrogate(spark, sf):
    """The strongest features of both methods side by side for every test row."""
    rows = clean.part(event_vectors(spark, sf), "test")
    name = "random_forest"
    left = attribution.attribute(rows, None, EV_NUM, trees=event_trees(spark, sf, [name])[name])
    rules = _surrogates(spark, sf, [1]).drop("model").withColumn("feature", F.regexp_replace("feature", "^z_", ""))
    return contributions.pair_ranks(left, surrogate.as_items(rules), 5)


@query("scored_instances")
def scored_instances(spark, sf):
    return marts.scored(event_models(spark, sf), event_vectors(spark, sf))


@query("trained_performance")
def trained_performance(spark, sf):
    """The performance mart of the trained tree models over the test events."""
    test = clean.part(event_vectors(spark, sf), "test")
    return marts.performance(training.score_all(event_models(spark, sf), test, ["y"]))


@query("explanation_mart")
def explanation_mart(spark, sf):
    """The mart of the three tree models: ranks and waterfalls of all events, rules of the test rows, as
    read again from the folders they were written to."""
    root = f"{require_checkpoint_dir(spark)}/explanations-{uuid.uuid4().hex}"
    marts.write_explanations(event_attributions(spark, sf, TREE_NAMES), _surrogates(spark, sf, names=TREE_NAMES), root)
    return marts.read_explanations(spark, root)
