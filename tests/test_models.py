"""Registry, training, detectors, tree attributions and local surrogates."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from flowlens.operators import anomaly, attribution, boosting, contributions, draws, network, surrogate, training
from flowlens.plans import marts
from flowlens.sources.state import Registry, part_rows, spread

NAMES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def rows(spark):
    u = lambda i: F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1000)) / 500.0 - 1
    raw = spark.range(3000).select(F.col("id").alias("row_id"), *[u(i).alias(n) for i, n in enumerate(NAMES)])
    signal = F.col("a") + 0.6 * F.col("b") * F.col("c")
    return raw.select(
        "row_id", *NAMES, (signal > 0.1).cast("int").alias("y"),
        array_to_vector(F.array(*NAMES)).alias("features"),
    ).repartition(4).cache()


def test_registry(spark):
    with pytest.raises(ValueError, match="random_forest"):
        training.get_model("nothing")
    assert training.get_model("random_forest").getNumTrees() == 100
    assert training.get_model("decision_tree").getMaxDepth() == 20
    assert training.get_model("xgboost").getMaxIter() == 100
    assert training.get_model("logistic_regression", rows=50).getRegParam() == 0.02
    assert training.get_model("gradient_boosting", 3).getOrDefault("rounds") == 100
    assert type(training.get_model("one_vs_rest_boosting", 3)).__name__ == "OneVsRest"


@pytest.fixture(scope="module")
def models(rows):
    small = {
        "random_forest": {"numTrees": 5, "maxDepth": 4}, "gradient_boosting": {"maxIter": 4, "maxDepth": 3},
        "decision_tree": {"maxDepth": 9}, "logistic_regression": {},
    }
    return training.train_all(rows, list(small), params=small, parallelism=2)


def test_scores_and_comparison(spark, rows, models):
    table = training.compare(training.score_all(models, rows), "binary")
    got = {r["model"]: r["accuracy"] for r in table.collect()}
    assert set(got) == set(models) and min(got.values()) > 75
    detail = training.detail(training.score(models["random_forest"], rows)).first()
    assert abs(detail["p_normal"] + detail["p_attack"] - 1) < 1e-9
    assert detail["correct"] == (detail["prediction"] == detail["y"])
    top = training.importances(models["random_forest"], NAMES, 2).collect()
    assert top[0]["feature"] == "a" and len(top) == 2
    with pytest.raises(ValueError):
        training.importances(models["logistic_regression"], NAMES)


@pytest.mark.parametrize("name", ["random_forest", "decision_tree", "gradient_boosting"])
def test_contributions_add_up(rows, models, name):
    model = models[name]
    parts = attribution.attribute(rows, model, NAMES)
    total = F.col("base") + F.aggregate("items", F.lit(0.0), lambda s, x: s + x["contribution"])
    column = "rawPrediction" if name == "gradient_boosting" else "probability"
    score = model.transform(rows).select("row_id", F.get(vector_to_array(column), F.lit(1)).alias("score"))
    gap = parts.select("row_id", total.alias("t")).join(score, "row_id").agg(F.max(F.abs(F.col("t") - F.col("score"))))
    assert gap.first()[0] < 1e-9


def leaves(trees):
    """(value, {feature: (low, high, share)}) of every leaf, from the arrays."""
    for tree in trees.trees:
        for n in np.flatnonzero(tree.leaf):
            value, sides = tree.value[n], {}
            while n:
                f, cut = tree.feature[n], tree.cut[n]
                low, high, share = sides.get(f, (-np.inf, np.inf, tree.share[n]))
                sides[f] = (max(low, cut), high, share) if tree.right[n] else (low, min(high, cut), share)
                n = tree.parent[n]
            yield value, sides


def brute(trees, x, width):
    """Shapley values from the definition: expected leaf value for every known feature set."""
    boxes = list(leaves(trees))

    def worth(known):
        total = 0.0
        for w, sides in boxes:
            for f, (lo, hi, share) in sides.items():
                w *= float(lo < x[f] <= hi) if f in known else share
            total += w
        return total

    out = np.zeros(width)
    for j in range(width):
        others = [f for f in range(width) if f != j]
        for k in range(width):
            for s in combinations(others, k):
                weight = factorial(k) * factorial(width - k - 1) / factorial(width)
                out[j] += weight * (worth({*s, j}) - worth(set(s)))
    return out


@pytest.mark.parametrize("name", ["random_forest", "decision_tree", "gradient_boosting"])
@pytest.mark.parametrize("most", [0, attribution.TABLE_FEATURES])
def test_contributions_match_the_definition(rows, models, name, most, monkeypatch):
    monkeypatch.setattr(attribution, "TABLE_FEATURES", most)
    trees = attribution.trees_of(models[name])
    x = np.array([r["features"].toArray() for r in rows.orderBy("row_id").limit(5).collect()])
    want = np.array([brute(trees, r, 4) for r in x])
    assert np.allclose(attribution.contributions_of(x, trees), want, atol=1e-12)


def grown(rng, width, depth, root=1000.0):
    """A random tree as the node rows that a saved model has."""
    table, todo, ids = {}, [(0, depth, root)], iter(range(1, 1 << 30))
    while todo:
        i, deep, n = todo.pop()
        if not deep or n < 2 or rng.random() < 0.1:
            table[i] = (0, i, rng.normal(), None, n, -1, -1, -1, [], -1)
            continue
        left, right, part = next(ids), next(ids), n * rng.uniform(0.1, 0.9)
        table[i] = (0, i, 0.0, None, n, left, right, int(rng.integers(width)), [float(rng.normal())], -1)
        todo += [(left, deep - 1, part), (right, deep - 1, n - part)]
    return table


@pytest.mark.parametrize("width", [3, 9])
def test_trees_of_many_features_and_missing_values(width):
    rng = np.random.default_rng(0)
    made = [attribution._arranged(grown(rng, width, 7), lambda n: n[2]) for _ in range(4)]
    trees = attribution.Trees(made, 0.0)
    x = rng.normal(size=(4, width))
    filled = x.copy()
    x[0, 0], filled[0, 0] = np.nan, np.inf
    want = np.array([brute(trees, r, width) for r in filled])
    assert np.allclose(attribution.contributions_of(x, trees), want, atol=1e-12)


def test_both_kernels_agree_on_a_deep_tree(monkeypatch):
    rng = np.random.default_rng(1)
    trees = attribution.Trees([attribution._arranged(grown(rng, 5, 14, 1e6), lambda n: n[2])], 0.0)
    x = rng.normal(size=(300, 5))
    table = attribution.contributions_of(x, trees)
    monkeypatch.setattr(attribution, "TABLE_FEATURES", 0)
    assert np.allclose(attribution.contributions_of(x, trees), table, atol=1e-9)


def test_attribution_refuses_linear_models(models):
    with pytest.raises(ValueError):
        attribution.trees_of(models["logistic_regression"])


def test_surrogate_signs_follow_a_linear_model(rows, models):
    context = surrogate.Context.fit(rows, NAMES)
    some = rows.where("row_id in (3, 99, 1234)")
    rules = surrogate.explain(some, models["logistic_regression"], context, 4, [1], samples=800)
    again = surrogate.explain(some.repartition(1), models["logistic_regression"], context, 4, [1], samples=800)
    assert sorted(map(str, rules.collect())) == sorted(map(str, again.collect()))
    values = {r["row_id"]: r["a"] for r in some.collect()}
    edges = context.edges[0]
    for r in rules.where("feature = 'a'").collect():
        if values[r["row_id"]] > edges[2]:
            assert r["weight"] > 0
        if values[r["row_id"]] <= edges[0]:
            assert r["weight"] < 0
    both = surrogate.rule_table(
        surrogate.explain(some, models["logistic_regression"], context, 4, [0, 1], samples=200)
    )
    turned = {(r["row_id"], r["feature"], r["label"]): r["direction"] for r in both.where("weight <> 0").collect()}
    assert all(turned.get((i, f, 1 - l), d) == d for (i, f, l), d in turned.items())


def test_surrogate_moves_no_rows(rows, models):
    context = surrogate.Context.fit(rows, NAMES)
    rules = surrogate.explain(rows, models["logistic_regression"], context, 4, [1], samples=5)
    plan = rules._jdf.queryExecution().executedPlan().toString()
    assert plan.split("InMemoryTableScan")[0].count("Exchange") == 0, plan


def test_context_round_trip(spark, rows, tmp_path):
    context = surrogate.Context.fit(rows, NAMES)
    context.save(spark, str(tmp_path))
    assert surrogate.Context.load(spark, str(tmp_path)) == context


def test_full_rank_components_leave_no_error(spark, rows, tmp_path):
    full = anomaly.PcaDetector.fit(rows, k=4)
    assert full.errors(rows).agg(F.max("error")).first()[0] < 1e-12
    low = anomaly.PcaDetector.fit(rows.where("y = 0"), k=2)
    short, long = (d.select("row_id", F.col("error").alias(n)) for d, n in ((low.errors(rows), "s"), (low.reconstruct(rows), "l")))
    assert short.join(long, "row_id").agg(F.max(F.abs(F.col("s") - F.col("l")))).first()[0] < 1e-12
    share = low.transform(rows.where("y = 0")).agg(F.avg("flag")).first()[0]
    assert 0.045 < share < 0.055
    low.save(spark, str(tmp_path))
    assert anomaly.PcaDetector.load(spark, str(tmp_path)).cut == low.cut


def test_network_stops_early(rows):
    fit = training.fit_mlp(rows, 2, training.tail_split(rows), epochs=6, patience=2, hidden=(6,))
    losses = [h[2] for h in fit.history]
    best = training.log_loss(training.score(fit.model, rows.where(training.tail_split(rows))))
    assert abs(best - min(losses)) < 1e-9 and len(losses) <= 6


def test_network_learns(rows):
    held = F.col("row_id") % 4 == 0
    fit = training.fit_mlp(rows.where(~held), 2, F.col("row_id") % 4 == 1, hidden=(16, 8), batch=32)
    losses = [h[2] for h in fit.history]
    assert losses[1] < losses[0]
    linear = training.train_all(rows.where(~held), ["logistic_regression"])
    both = training.compare(training.score_all(linear | {"mlp": fit.model}, rows.where(held)), "binary")
    got = {r["model"]: r["accuracy"] for r in both.collect()}
    assert got["mlp"] > got["logistic_regression"] and got["mlp"] > 90


def test_models_share_one_scan(rows, models):
    plan = training.compare(training.score_all(models, rows), "binary")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("InMemoryTableScan") == 1


def test_boosting_with_validation(rows):
    fit = training.fit_boosting(rows, training.tail_split(rows), maxIter=6, maxDepth=2)
    assert fit.history[0][1] > fit.history[-1][1]


def test_boosting_by_cells_is_boosting_by_rows(spark, monkeypatch):
    """The losses and scores of Spark's fit of all rows, thresholds from the rows it draws; what is fitted has fewer rows."""
    u = lambda i, n: F.pmod(F.xxhash64("row_id", F.lit(i)), F.lit(n))
    raw = spark.range(24000).withColumnRenamed("id", "row_id").select("row_id", (u(1, 90) / 9.0).alias("a"), (u(2, 4) - 1.0).alias("b"), (u(3, 25) / 5.0).alias("c"))
    raw = raw.withColumn("y", (F.col("a") * F.col("c") + F.col("b") + u(4, 9) / 3.0 > 25).cast("int"))
    many = raw.withColumn("features", array_to_vector(F.array("a", "b", "c"))).repartition(4).cache()
    fitted, train = [], training.train
    monkeypatch.setattr(training, "train", lambda e, df: fitted.append(df.count()) or train(e, df))
    held = F.col("row_id") % 10 == 0
    new, old = (training.fit_boosting(many, held, maxIter=4, maxDepth=4, **p) for p in ({}, {"minInstancesPerNode": 1}))
    assert fitted[1] == 24000 and fitted[0] <= 2 * 2 * 32 * 4 * 25
    assert np.allclose(new.history, old.history, rtol=1e-9)
    p = [training.score(f.model, many).orderBy("row_id").select(F.col("p")[1]).toPandas().to_numpy() for f in (new, old)]
    assert np.allclose(*p, atol=1e-9)


def test_thresholds_as_spark_finds_them():
    from flowlens.operators.cells import thresholds

    assert thresholds(np.array([1.0, 3, 3, 7]), 4, 32).tolist() == [2, 5]
    assert thresholds(np.array([0.0, 2, 2]), 3, 32).tolist() == [1]
    assert thresholds(np.array([1.0, 3]), 4, 32).tolist() == [0.5, 2]  # two expected rows are missing
    assert thresholds(np.arange(1.0, 101), 100, 4).tolist() == [25.5, 50.5, 75.5]
    assert thresholds(np.full(9, 4.0), 9, 32).tolist() == []


def test_marts(spark, rows, models, tmp_path):
    trees = {n: attribution.trees_of(models[n]) for n in ("random_forest", "decision_tree")}
    parts = attribution.attribute_all(rows, trees, NAMES)
    context = surrogate.Context.fit(rows, NAMES)
    some = rows.where("row_id < 5")
    rules = surrogate.explain_all(some, {n: models[n] for n in trees}, context, 4, samples=50)
    marts.write_explanations(parts, rules, str(tmp_path), 3)
    ranks = spark.read.parquet(f"{tmp_path}/global_rank")
    assert ranks.where("model = 'random_forest' and rank = 1").first()["feature"] == "a"
    assert spark.read.parquet(f"{tmp_path}/waterfall").count() == 2 * 3000 * 3
    assert spark.read.parquet(f"{tmp_path}/rules").select("model").distinct().count() == 2
    assert marts.scored(models, rows).groupBy("model").count().count() == 4
    one = [contributions.feature_stats(parts.where(F.col("model") == n)) for n in trees]
    table = contributions.agreement_table(*one, k=2)
    assert table.where("in_both").count() >= 1


def known_classes(spark, n=1200, classes=10):
    """Ten classes that two features tell apart, one of them in no order; a third is missing at times."""
    u = lambda i: F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1000)) / 1000.0
    raw = spark.range(n).select("id", u(1).alias("a"), u(2).alias("b"), F.when(u(3) > 0.5, float("nan")).otherwise(u(4)).alias("c"))
    y = F.floor(F.col("a") * 5) + 5 * (F.col("b") > 0.4).cast("int")
    return raw.select(
        F.col("id").alias("row_id"), F.pmod(y * 7, F.lit(classes)).cast("int").alias("y"),
        array_to_vector(F.array("a", "b", "c")).alias("features"),
    )


def test_softmax_boosting(spark, tmp_path):
    rows = known_classes(spark).repartition(3).cache()
    fit = boosting.SoftmaxBoosting(classes=10, rounds=12, depth=4).setLabelCol("y").fit(rows.where("row_id < 900"))
    scored = training.score(fit, rows.where("row_id >= 900"))
    assert scored.where("prediction = y").count() > 0.9 * scored.count()
    assert scored.where(F.abs(F.aggregate("p", F.lit(0.0), lambda s, v: s + v) - 1) > 1e-9).count() == 0
    assert fit.numRounds == 12 and fit.featureImportances.argmax() < 2 and abs(fit.featureImportances.values.sum() - 1) < 1e-9
    store = Registry(spark, str(tmp_path))
    store.save("soft", fit)
    again = training.score(store.load("soft"), rows.where("row_id >= 900"))
    assert again.exceptAll(scored).count() == 0
    with pytest.raises(ValueError, match="labels"):
        boosting.SoftmaxBoosting(classes=3, rounds=1).setLabelCol("y").fit(rows)


def test_softmax_histograms_give_the_best_split(spark):
    """The first round's root split, its gain and leaf values by definition."""
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 9, size=(80, 2)).astype(float), rng.integers(0, 3, size=80)
    rows = spark.createDataFrame([(int(b), [float(v) for v in a]) for a, b in zip(x, y)], "y int, x array<double>").repartition(4)
    rows = rows.select("y", array_to_vector("x").alias("features"))
    fit = boosting.SoftmaxBoosting(classes=3, rounds=1, depth=1, rate=1.0, least=0.0, gain=-1.0).setLabelCol("y").fit(rows)
    told = fit._told()
    share = np.bincount(y) / len(y)
    assert np.allclose(np.exp(told["prior"]), share)
    for k in range(3):
        g, h = share[k] - (y == k), np.full(len(y), share[k] * (1 - share[k]))
        worth = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)  # noqa: E731, B023
        gains = {(f, c): worth(x[:, f] <= c) + worth(x[:, f] > c) for f in (0, 1) for c in range(8)}
        one = told["rounds"][0]
        f, cut = one["feature"][k][0], told["cuts"][one["feature"][k][0]][one["cut"][k][0]]
        assert abs(gains[f, cut] - max(gains.values())) < 1e-9
        left = x[:, f] <= cut
        assert np.allclose(one["value"][k][1:3], [-g[m].sum() / (h[m].sum() + 1) for m in (left, ~left)])


def test_network_gradient():
    rng = np.random.default_rng(4)
    for shape, y in ((network.Shape((3, 5, 4)), rng.integers(0, 4, size=7)), (network.Shape((3, 4, 3), False), rng.normal(size=(7, 3)))):
        w, x = shape.start(1) + 0.01, rng.normal(size=(7, 3))
        grad, _ = shape.slope(w, x, y)
        for i in rng.integers(0, shape.size, size=20):
            near = [shape.losses(shape.outputs(w + d * (np.arange(shape.size) == i), x)[-1], y).mean() for d in (1e-6, -1e-6)]
            assert abs((near[0] - near[1]) / 2e-6 - grad[i]) < 1e-6


def test_network_keeps_its_state(rows):
    """Epochs of one task are the same as one long run, and averaging equal tasks changes nothing."""
    held, one = F.col("row_id") % 50 == 0, rows.where("row_id < 600").coalesce(1)
    shape = network.Shape((4, 6, 2))
    marked = one.select(held.alias("held"), "y", vector_to_array("features").alias("x"))
    w = shape.start(1)
    now = network.Optimiser(w, np.zeros_like(w), np.zeros_like(w))
    for epoch in (1, 2):
        now, _, _ = network._epoch(marked, shape, now, epoch, 100, 0.01, 7, True)
    got = marked.where("NOT held").collect()
    x, y = np.array([r["x"] for r in got]), np.array([r["y"] for r in got])
    own = network.Optimiser(w.copy(), np.zeros_like(w), np.zeros_like(w))
    for epoch in (1, 2):
        order = np.random.default_rng([7, epoch, 0]).permutation(np.flatnonzero(~np.array([r["held"] for r in marked.collect()])))
        every = np.array([r["x"] for r in marked.collect()]), np.array([r["y"] for r in marked.collect()])
        for at in range(0, len(order), 100):
            some = order[at : at + 100]
            own = own.step(shape.slope(own.w, every[0][some], every[1][some])[0], 0.01)
    assert len(x) == len(y) == len(order) and now.steps == own.steps and np.allclose(now.w, own.w, atol=1e-12)


def test_network_stops_when_nothing_gets_better(rows):
    """Labels that the features say nothing of: the held-out loss turns, and the best weights are kept."""
    noise = rows.where("row_id < 800").withColumn("y", F.pmod(F.xxhash64("row_id", F.lit(99)), F.lit(2)).cast("int"))
    fit = training.fit_mlp(noise, 2, F.col("row_id") % 4 == 1, epochs=50, patience=5, hidden=(64, 32), batch=32)
    losses = [h[2] for h in fit.history]
    assert len(losses) < 50 and len(losses) == losses.index(min(losses)) + 1 + 5
    with pytest.raises(ValueError, match="hold out"):
        training.fit_mlp(noise, 2, F.lit(False))


def test_rules_of_a_constant_model(rows):
    """A model that ignores the features: all weights are zero and the intercept is its probability."""
    flat = rows.withColumn("y", F.pmod("row_id", F.lit(2)).cast("int")).withColumn("features", array_to_vector(F.array(*[F.lit(0.0)] * 4)))
    model = training.train_all(flat, ["logistic_regression"])["logistic_regression"]
    context = surrogate.Context.fit(rows, NAMES)
    got = surrogate.explain(rows.where("row_id < 20"), model, context, 4, [1], samples=300).collect()
    assert len(got) == 80 and max(abs(r["weight"]) for r in got) < 1e-9 and max(abs(r["intercept"] - 0.5) for r in got) < 1e-6


def test_normal_equations_equal_a_fit_of_all_rows():
    rng = np.random.default_rng(5)
    z, p, w = rng.integers(0, 2, size=(400, 8)).astype(float), rng.random((400, 2)), rng.random(400)
    parts = [surrogate.Sums.of(z[i : i + 130], p[i : i + 130], w[i : i + 130]) for i in range(0, 400, 130)]
    total = parts[0] + parts[1] + parts[2] + parts[3]
    for used in ([0, 3, 5], list(range(8))):
        coef, intercept, r2 = total.ridge(1, used, 1.0)
        zc, yc = z[:, used] - np.average(z[:, used], axis=0, weights=w), p[:, 1] - np.average(p[:, 1], weights=w)
        want = np.linalg.solve((zc * w[:, None]).T @ zc + np.eye(len(used)), (zc * w[:, None]).T @ yc)
        assert np.allclose(coef, want) and abs(r2 - (1 - w @ (yc - zc @ want) ** 2 / (w @ yc**2))) < 1e-9
        assert abs(intercept - (np.average(p[:, 1], weights=w) - np.average(z[:, used], axis=0, weights=w) @ want)) < 1e-9
    assert len(total.select(1, 3)) == 3 and len(total.select(1, 7)) == 7


def test_explanations_stay_where_the_rows_are(rows, models):
    context = surrogate.Context.fit(rows, NAMES)
    trees = {n: attribution.trees_of(models[n]) for n in ("random_forest", "decision_tree")}
    some = rows.sparkSession.range(100).select(F.col("id").alias("row_id"), array_to_vector(F.array(*[F.rand(i) for i in range(4)])).alias("features"))
    for df in (attribution.attribute_all(some, trees, NAMES), surrogate.explain_all(some, {n: models[n] for n in trees}, context, 4, samples=20)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and plan.count("Range (") == 1


def test_mart_replaces_one_model(spark, rows, models, tmp_path):
    context, some = surrogate.Context.fit(rows, NAMES), rows.where("row_id < 40")
    names = ("random_forest", "decision_tree")

    def write(chosen, frame, k):
        parts = attribution.attribute_all(frame, {n: attribution.trees_of(models[n]) for n in chosen}, NAMES)
        rules = surrogate.explain_all(frame, {n: models[n] for n in chosen}, context, 3, [1], samples=30)
        marts.write_explanations(parts, rules, str(tmp_path), k)

    write(names, some, 3)
    before = marts.read_explanations(spark, str(tmp_path)).where("model = 'random_forest'").collect()
    write(names[1:], rows.where("row_id < 10"), 2)
    after = marts.read_explanations(spark, str(tmp_path))
    assert sorted(map(str, after.where("model = 'random_forest'").collect())) == sorted(map(str, before))
    counts = {r["part"]: r["count"] for r in after.where("model = 'decision_tree'").groupBy("part").count().collect()}
    assert counts == {"global_rank": 4, "waterfall": 20, "rules": 30}


@pytest.mark.parametrize("name", ["random_forest", "decision_tree", "gradient_boosting", "logistic_regression"])
def test_array_scores_equal_the_models(rows, models, name):
    got = [(r["features"].toArray(), r["p"]) for r in models[name].transform(rows).select(
        "features", vector_to_array("probability").alias("p")).limit(400).collect()]
    x, want = np.array([g[0] for g in got]), np.array([g[1] for g in got])
    assert np.allclose(surrogate.scorer_of(models[name])(x), want, atol=1e-9)


def test_neighbours_of_both_kinds_agree(rows, models):
    """Spark rows scored by transform and arrays scored in the batch give the same weights, up to their draws."""
    context, some = surrogate.Context.fit(rows, NAMES), rows.where("row_id in (5, 77)")
    fits = []
    for hide in (False, True):
        with pytest.MonkeyPatch.context() as patch:
            if hide:
                patch.setattr(surrogate, "scorer_of", lambda m: None)
            got = surrogate.explain_all(some, {n: models[n] for n in ("random_forest", "logistic_regression")}, context, 4, [1], samples=6000)
            fits.append({(r["row_id"], r["model"], r["feature"]): (r["weight"], r["condition"], r["p"]) for r in got.collect()})
    assert set(fits[0]) == set(fits[1]) and len(fits[0]) == 16
    for k, (w, condition, p) in fits[0].items():
        other = fits[1][k]
        assert condition == other[1] and abs(p - other[2]) < 1e-9 and abs(w - other[0]) < 0.03


def test_only_rows_of_few_parts_are_spread(spark):
    many = spark.range(0, 100, 1, 64)
    assert spread(many) is many
    assert spread(spark.range(0, 100, 1, 1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_rows_of_one_row_group_are_spread(spark, tmp_path):
    """A file of one row group comes in many splits, all but one without rows."""
    spark.range(0, 40_000, 1, 1).write.parquet(str(tmp_path / "t"))
    small = {"spark.sql.files.maxPartitionBytes": "4096", "spark.sql.files.openCostInBytes": "1"}
    try:
        for key, value in small.items():
            spark.conf.set(key, value)
        df, tasks = spark.read.parquet(str(tmp_path / "t")), spark.sparkContext.defaultParallelism
        assert df.rdd.getNumPartitions() >= tasks and part_rows(df) == (40_000, 40_000)
        largest, n = part_rows(spread(df))
        assert n == 40_000 and 2 * largest * tasks <= 3 * n
    finally:
        for key in small:
            spark.conf.unset(key)


def test_training_holds_few_rows_a_task(rows, monkeypatch):
    monkeypatch.setattr(training, "MOST_ROWS", 100)
    made, n = training._parts(rows.select("features", "y"))
    assert n == 3000 and part_rows(made)[0] <= 150 and part_rows(made)[1] == 3000


def test_trees_of_few_cells_are_explained_together(rows, models, monkeypatch):
    """By tables of feature sets, without going through the trees' kernels."""
    def none(tree):
        raise AssertionError("a tree was explained alone")

    monkeypatch.setattr(attribution, "_table_kernel", none)
    monkeypatch.setattr(attribution, "_level_kernel", none)
    x = np.array([r["features"].toArray() for r in rows.orderBy("row_id").limit(6).collect()])
    for name in ("random_forest", "decision_tree", "gradient_boosting"):
        trees = attribution.trees_of(models[name])
        cut = trees.trees[0].cut[1], trees.trees[0].feature[1]
        x[0, cut[1]] = cut[0]  # on a threshold
        x[1, cut[1]] = 1e300
        want = np.array([brute(trees, r, 4) for r in x])
        assert np.allclose(attribution.contributions_of(x, trees), want, atol=1e-12)
        odd = x.copy()
        odd[1, cut[1]] = np.nan
        assert np.allclose(attribution.contributions_of(odd, trees), want, atol=1e-12)


def test_digits_count_edges_below():
    rng = np.random.default_rng(3)
    for edges in ([0.5], [], np.unique(rng.normal(size=40)), [0, 1e-9, 2e-9, 1.0], [-1e300, 0.0, 1e300], np.unique(rng.lognormal(sigma=6, size=31))):
        edges = np.array(edges, float)
        v = np.concatenate([rng.normal(size=100), rng.lognormal(sigma=6, size=100), edges, np.nextafter(edges, np.inf), [np.inf, -np.inf]])
        for some in (v, np.append(v, np.nan)):
            assert (attribution.Digits.of(edges)(some) == np.searchsorted(edges, some)).all()


@pytest.mark.parametrize("name", ["random_forest", "decision_tree", "gradient_boosting"])
def test_score_tables_equal_the_trees(rows, models, name):
    scorer = surrogate.scorer_of(models[name])
    x = np.array([r["features"].toArray() for r in rows.limit(500).collect()])
    many = scorer.many(10**8)
    assert many is not scorer and scorer.many(1) is scorer
    assert np.allclose(many(x), scorer(x), atol=1e-12)


def test_models_that_are_not_explained_are_not_fitted(spark, monkeypatch):
    from flowlens.plans import models as plans

    asked = []
    frame = spark.createDataFrame([("train",)], "origin string")
    monkeypatch.setattr(plans, "_KEPT", {})
    monkeypatch.setattr(plans, "event_vectors", lambda spark, sf: frame)
    monkeypatch.setattr(plans.training, "train_all", lambda df, names: asked.extend(names) or {n: n for n in names})
    assert plans.event_models(spark, "/none", ["random_forest"]) == {"random_forest": "random_forest"} and asked == ["random_forest"]
    plans.event_models(spark, "/none")
    assert asked == ["random_forest", "gradient_boosting", "decision_tree"]


def test_network_takes_no_notice_of_the_batch_size():
    import pyarrow as pa

    sizes = lambda parts, n: [b.num_rows for b in network._blocks(iter([pa.RecordBatch.from_arrays([pa.array(range(p))], ["x"]) for p in parts]), n)]
    assert sizes([512, 88], 1000) == [600] and sizes([3, 0, 4, 5], 5) == [5, 5, 2] and sizes([], 5) == []


def test_forests_keep_the_places_of_rows(rows, monkeypatch):
    """While they are few; the model is the same."""
    assert training.get_model("random_forest", rows=1000).getCacheNodeIds()
    assert not training.get_model("random_forest", rows=10**9).getCacheNodeIds()
    made = []
    for most in (training.KEPT_PLACES, 0):
        monkeypatch.setattr(training, "KEPT_PLACES", most)
        model = training.train_all(rows, ["random_forest"], params={"random_forest": {"numTrees": 3, "maxDepth": 6}})["random_forest"]
        made.append(model.toDebugString.split("\n", 1)[1])
    assert made[0] == made[1]


def test_softmax_scores_fits_only_the_booster(spark, monkeypatch):
    from flowlens.plans import models as plans

    asked = []
    monkeypatch.setattr(plans, "_KEPT", {})
    monkeypatch.setattr(plans, "_vector_parts", lambda spark, sf: (None, None))
    monkeypatch.setattr(plans.training, "train_all", lambda df, names, classes: asked.extend(names) or {n: n for n in names})
    monkeypatch.setattr(plans.training, "score", lambda model, df: model)
    assert plans.softmax_scores(spark, "/none") == "gradient_boosting" and asked == ["gradient_boosting"]
    assert set(plans._vector_models(spark, "/none")) == set(plans.ML_NAMES) and sorted(asked) == sorted(plans.ML_NAMES)


def test_softmax_nodes_by_columns():
    """Rows go down the levels as the definition says; leaves keep theirs, also with the largest bins."""
    rng = np.random.default_rng(5)
    grown = boosting._Round(2, 3)
    grown.feature[0, [0, 1, 2, 5]], grown.cut[0, [0, 1, 2, 5]] = [2, 0, 1, 2], [100, 30, 254, 200]
    bins = rng.integers(0, 256, size=(300, 3)).astype(np.uint8)
    for levels in range(4):
        own = []
        for row in bins:
            at = 0
            for _ in range(levels):
                at = at if grown.feature[0, at] < 0 else 2 * at + 1 + int(row[grown.feature[0, at]] > grown.cut[0, at])
            own.append(at)
        assert grown.node_of(np.ascontiguousarray(bins.T), 0, levels).tolist() == own
        assert not grown.node_of(np.ascontiguousarray(bins.T), 1, levels).any()


def in_one_task(chosen, context, x, samples=400, labels=None):
    """Rules of rows by the code of a task, by (id, model, label, feature)."""
    import pyarrow as pa

    around = surrogate._array_neighbours(context, samples, 42)
    offsets = pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(x))), pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))], ["id", "x"])
    run = surrogate._whole(list(chosen), x.shape[1], labels, list(chosen.values()), around, 0.75 * x.shape[1] ** 0.5)
    return {(r["id"], r["model"], r["label"], r["pos"]): r for b in run(iter([batch])) for r in b.to_pylist()}


def test_rules_by_tables_draw_once_and_equal_rules_by_values(rows, models, monkeypatch):
    """All models are explained by one draw a row; the rules are those of the neighbours' values."""
    context = surrogate.Context.fit(rows, NAMES)
    x = np.array([r["features"].toArray() for r in rows.orderBy("row_id").limit(30).collect()])
    chosen, drawn = {n: surrogate.scorer_of(models[n]) for n in ("random_forest", "gradient_boosting", "decision_tree")}, []
    philox = np.random.Philox
    with monkeypatch.context() as patch:
        patch.setattr(np.random, "Philox", lambda **k: drawn.append(k) or philox(**k))
        for labels in (None, [0, 1]):
            got, n = in_one_task(chosen, context, x, 20_000, labels), len(drawn)
            drawn.clear()
            assert n == len(x)  # not once a model
            with monkeypatch.context() as alone:
                alone.setattr(surrogate.TreeScorer, "cells", lambda self, rows: 0)
                want = in_one_task(chosen, context, x, 20_000, labels)
                drawn.clear()
            assert set(got) == set(want) and len(got) == len(x) * 3 * 4 * len(labels or [0])
            for k, r in got.items():
                assert r["bin"] == want[k]["bin"] and r["p"] == want[k]["p"]
                assert all(abs(r[c] - want[k][c]) < 1e-9 for c in ("weight", "intercept", "r2"))


def test_draws_tell_cells_to_the_last_bit():
    """Draws next to a threshold's own, and bins that are one value."""
    rng = np.random.default_rng(4)
    for mean, std, low, high in ((3.0, 0.01, 2.9, 3.1), (0.0, 1.0, -1.0, 1.0), (5.0, 0.0, 5.0, 5.0), (-1e6, 3.0, -1e6 - 4, -1e6 + 9)):
        edges = np.unique(np.concatenate([[low, mean, high], rng.uniform(low - 0.1, high + 0.1, 20)]))
        value = lambda z: np.minimum(np.maximum(mean + std * z, low), high)  # noqa: E731, B023
        told = draws.last_below(value, edges)
        near = told[np.isfinite(told)]
        z = np.concatenate([near, np.nextafter(near, np.inf), rng.normal(size=1000), [-39.0, 39.0]])
        want = (value(z)[:, None] > edges).sum(axis=1)
        assert ((z[:, None] > told).sum(axis=1) == want).all()
        cells = draws.Cells.of([edges], [np.empty(0)], [[np.array([v])] for v in (mean, std, low, high)])
        assert (cells.around(np.zeros((len(z), 1)), z[:, None])[1][0] == want).all()
