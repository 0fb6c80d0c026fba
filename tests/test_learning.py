"""Dictionaries, the bottleneck detector and published versions."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from flowlens.operators import anomaly, attribution, celltrees, dictionary, encode, forest, publish, training
from flowlens.session import require_checkpoint_dir


def test_dictionary(spark):
    rng = np.random.default_rng(1)
    words = [None if i % 50 == 0 else "hot" if i % 3 else f"w{rng.integers(3000)}" for i in range(4000)]
    numbers = [int(rng.integers(-500, 500)) for _ in words]
    df = spark.createDataFrame([(i, w, n, "kept") for i, (w, n) in enumerate(zip(words, numbers))], "id long, word string, n int, `__top` string").drop("__top").repartition(5)
    known = dictionary.Dictionary.fit(df, ["word", "n"])
    code_w = {w: i for i, w in enumerate(sorted({w for w in words if w is not None}))}
    code_n = {n: i for i, n in enumerate(sorted(set(numbers)))}
    assert known.sizes == [len(code_w), len(code_n)] and len(code_w) > 500
    for r in known.transform(df).collect():
        assert (r["word_code"], r["n_code"]) == (code_w.get(words[r["id"]]), code_n[numbers[r["id"]]])
    for r in known.dummies(df).select("id", F.unwrap_udt("dummies").alias("v")).collect():
        want = [] if words[r["id"]] is None else [code_w[words[r["id"]]]]
        want.append(len(code_w) + code_n[numbers[r["id"]]])
        assert list(r["v"]["indices"]) == want and r["v"]["size"] == len(code_w) + len(code_n)
    other = spark.createDataFrame([(1, "never", 10**6), (2, None, None)], "id long, word string, n int")
    assert {tuple(r) for r in known.transform(other).select("word_code", "n_code").collect()} == {(None, None)}
    assert known.dummies(other).where(F.size(F.unwrap_udt("dummies")["indices"]) > 0).count() == 0
    with pytest.raises(Exception, match="without a code"):
        known.transform(other, strict=True).collect()
    none = dictionary.Dictionary.fit(df.limit(0), ["word"])
    assert none.sizes == [0] and none.transform(df).where("word_code IS NOT NULL").count() == 0


def test_network_detector_follows_a_curve(spark, tmp_path):
    """Normal rows lie on an arc; others near the arc's middle, where components see nothing unusual."""
    t = F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0 * np.pi
    odd = F.col("id") % 10 == 9
    near = lambda v, m: F.when(odd, m + v * 0.05).otherwise(v)
    cells = F.array(near(F.cos(t), 0.0), near(F.sin(t), 2 / np.pi), near(F.cos(2 * t), 0.0), near(F.sin(2 * t), 0.0))
    rows = spark.range(3000).select("id", odd.cast("int").alias("y"), array_to_vector(cells).alias("features"))
    normal = rows.where("y = 0").repartition(2).cache()
    net = anomaly.NetworkDetector.fit(normal, F.col("id") % 7 == 0, hidden=(32, 2), rate=0.005, epochs=60, patience=20, batch=32)
    pca = anomaly.PcaDetector.fit(normal, k=2)
    caught = {n: d.transform(rows).where("y = 1").agg(F.avg("flag")).first()[0] for n, d in (("net", net), ("pca", pca))}
    wrong = net.transform(rows).where("y = 0").agg(F.avg("flag")).first()[0]
    assert caught["net"] > 0.8 > 0.2 > caught["pca"] and 0.04 < wrong < 0.06
    net.save(spark, str(tmp_path))
    again = anomaly.NetworkDetector.load(spark, str(tmp_path))
    assert again.cut == net.cut and again.transform(rows).agg(F.sum("flag")).first() == net.transform(rows).agg(F.sum("flag")).first()


def bundle(spark, shift=0.0):
    rows = spark.range(200).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("kind"), (F.col("id") * 0.1 + shift).alias("x"),
                                   (F.col("id") > 90).cast("int").alias("y"))
    hot = encode.OneHot.fit(rows, ["kind"])
    scaler = encode.Standardizer.fit(rows, ["x"])
    order = ["z_x", *hot.names()]
    ready = encode.assemble(scaler.transform(hot.transform(rows)), order)
    model = training.train_all(ready, ["decision_tree"], params={"decision_tree": {"maxDepth": 2}})["decision_tree"]
    return publish.Bundle(model, hot, scaler, order), ready


def test_versions(spark, tmp_path, monkeypatch):
    root, (first, ready), (second, _) = str(tmp_path / "models"), bundle(spark), bundle(spark, 5.0)
    with pytest.raises(FileNotFoundError):
        publish.load(spark, root)
    one = publish.publish(spark, root, first)
    seen = []
    save = publish.save_order

    def reading_meanwhile(*args):
        seen.append((publish.versions(spark, root), publish.load(spark, root).scaler))
        return save(*args)

    monkeypatch.setattr(publish, "save_order", reading_meanwhile)
    two = publish.publish(spark, root, second)
    assert seen == [([one], first.scaler)] and publish.versions(spark, root) == [one, two]
    last = publish.load(spark, root)
    assert (last.scaler, last.hot, last.order) == (second.scaler, second.hot, second.order)
    old = publish.load(spark, root, one)
    assert old.model.transform(ready).select("prediction").exceptAll(first.model.transform(ready).select("prediction")).count() == 0
    first.scaler.save(spark, f"{root}/{two}/scaler")
    with pytest.raises(publish.Mismatch):
        publish.load(spark, root)


def chained(spark, n=1500):
    """Classes that change at every second value of one feature: a tree must tell hundreds of intervals apart."""
    u = F.pmod(F.xxhash64("id"), F.lit(100_000)) / 100_000.0
    return spark.range(n).select(F.col("id").alias("row_id"), (F.floor(u * 400) % 2).cast("int").alias("y"), array_to_vector(F.array(u, u * 0 + 1)).alias("features"))


def test_deep_forest(spark, monkeypatch):
    monkeypatch.setattr(forest, "TOP_DEPTH", 4)
    rows = chained(spark).repartition(3).cache()
    deep = forest.fit(rows, trees=12)
    flat = training.train_all(rows, ["random_forest"], params={"random_forest": {"numTrees": 12, "maxDepth": 4}})["random_forest"]
    right = lambda m: m.transform(rows).where("prediction = y").count() / 1500
    assert right(deep) > 0.97 > 0.7 > right(flat) and deep.depth() > 8
    assert list(deep.featureImportances) == [1.0, 0.0]
    again = forest.fit(rows.repartition(5), trees=12)
    assert [sorted(map(str, t.values())) for t in again.tables.values()] != [] and right(again) > 0.97
    parts = attribution.attribute(rows, None, ["a", "b"], trees=deep.trees())
    total = parts.select("row_id", (F.col("base") + F.aggregate("items", F.lit(0.0), lambda s, x: s + x["contribution"])).alias("t"))
    gap = deep.transform(rows).select("row_id", F.get(vector_to_array("probability"), F.lit(1)).alias("p")).join(total, "row_id")
    assert gap.agg(F.max(F.abs(F.col("p") - F.col("t")))).first()[0] < 1e-9


def test_deep_forest_grows_the_top_until_groups_are_small(spark, monkeypatch):
    monkeypatch.setattr(forest, "TOP_DEPTH", 2)
    rows, depths = chained(spark, 800).cache(), []
    train = training.train_all
    monkeypatch.setattr(forest.training, "train_all", lambda *a, **k: depths.append(a[3]["random_forest"]["maxDepth"]) or train(*a, **k))
    many = rows.withColumn("y", F.pmod("row_id", F.lit(3)).cast("int"))
    deep = forest.fit(many, 3, trees=4, most_rows=60)
    assert depths[0] == 2 and len(depths) > 1 and deep.transform(many).where("prediction = y").count() > 600
    same = rows.withColumn("features", array_to_vector(F.array(F.lit(1.0), F.lit(2.0))))
    with pytest.raises(ValueError, match="a leaf of"):
        forest.fit(same, trees=1, most_rows=60)


def test_finished_tree_by_definition():
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 6, size=(60, 2)).astype(float), rng.integers(0, 3, size=60)
    counts = np.eye(3)[y] * rng.integers(1, 4, size=60)[:, None]
    gini = lambda c: c.sum() - (c**2).sum() / c.sum()
    f, cut = forest.best_split(x, counts, np.arange(2), 2)
    left = {(j, c): gini(counts[x[:, j] <= c].sum(axis=0)) + gini(counts[x[:, j] > c].sum(axis=0)) for j in (0, 1) for c in range(5)}
    assert abs(left[f, int(np.floor(cut))] - min(left.values())) < 1e-9
    nodes = forest.finished(x, counts, rng)
    for i, row in enumerate(x):
        at = 0
        while nodes[at][0] >= 0:
            at = nodes[at][0] + int(row[nodes[at][1]] > nodes[at][2])
        same = (x == row).all(axis=1)
        assert np.allclose(nodes[at][3], counts[same].sum(axis=0)) or (nodes[at][3] > 0).sum() == 1
    draws = forest.bootstrap(np.arange(20_000), 3, 42)
    assert abs(draws.mean() - 1) < 0.03 and abs(draws.var() - 1) < 0.05 and abs(np.corrcoef(draws, forest.bootstrap(np.arange(20_000), 4, 42))[0, 1]) < 0.03


def test_importances_of_a_forest_that_is_too_large_for_the_driver(spark, monkeypatch):
    """They are those of the whole trees by definition, and no node below the upper parts is fetched for them."""
    monkeypatch.setattr(forest, "TOP_DEPTH", 3)
    rng = np.random.default_rng(6)
    rows = spark.createDataFrame([(i, int(rng.integers(2)), [float(v) for v in rng.normal(size=3)]) for i in range(400)], "row_id long, y int, x array<double>")
    deep = forest.fit(rows.select("row_id", "y", array_to_vector("x").alias("features")).repartition(3), trees=5)
    want = np.zeros(3)
    for table in deep.tables.values():
        gains = np.zeros(3)
        pure = lambda n: n[4] * (np.array(n[3]) ** 2).sum() / np.sum(n[3]) ** 2
        for n in table.values():
            if n[5] >= 0:
                gains[n[7]] += max(0.0, pure(table[n[5]]) + pure(table[n[6]]) - pure(n))
        want += gains / gains.sum() / 5
    nodes = sum(map(len, deep.top.values()))
    assert sum(map(len, deep.tables.values())) > 2 * nodes
    monkeypatch.setattr(attribution, "MAX_NODES", nodes)
    again = forest.DeepForest(deep.top, deep.below, 2, 3)
    assert np.allclose(again.featureImportances.toArray(), want, atol=1e-12)
    with pytest.raises(ValueError, match="more than"):
        again.trees()


def test_groups_of_a_forest_have_as_many_rows_as_fit(spark, monkeypatch):
    """Narrow rows make large groups, so the upper part isn't grown deeper with more thresholds; wide rows don't."""
    asked = []
    monkeypatch.setattr(forest, "_top", lambda rows, classes, most, **k: asked.append(most) or {})
    for width in (5, 64):
        rows = spark.range(2).select(F.col("id").alias("row_id"), F.lit(1).alias("y"), array_to_vector(F.array(*[F.lit(0.0)] * width)).alias("features"))
        forest.fit(rows)
    assert asked == [(32 << 20) // 40, forest.MOST_ROWS]


def labelled(spark, n=4000):
    """Rows of few distinct values and a noisy label, whose cells hold several rows each."""
    u = lambda i, k: F.pmod(F.xxhash64("id", F.lit(i)), F.lit(k)).cast("double")
    x = [u(0, 9), u(1, 5) - 2, u(2, 3) / 7, u(3, 60)]
    y = F.when(u(4, 10) < 8, (x[0] + 2 * x[1] > 4).cast("int")).otherwise((u(5, 2) > 0).cast("int"))
    return spark.range(n).select(F.col("id").alias("row_id"), y.alias("y"), array_to_vector(F.array(*x)).alias("features")).repartition(3).cache()


SMALL_TREES = {
    "random_forest": {"numTrees": 40, "maxDepth": 6}, "decision_tree": {"maxDepth": 8}, "gradient_boosting": {"maxIter": 5, "maxDepth": 3}}


def test_trees_of_many_rows_are_fitted_on_cells(spark, monkeypatch):
    """Single and boosted trees are those of the rows; a forest is one of other draws."""
    rows, made = labelled(spark), {}
    for least in (1, 10**9):
        monkeypatch.setattr(celltrees, "LEAST_ROWS", least)
        if least > 1:
            monkeypatch.setattr(celltrees, "fit", None)  # not asked
        made[least] = training.train_all(rows, list(SMALL_TREES), params=SMALL_TREES)
    told = lambda m: [r[0].toArray() for r in m.transform(rows).orderBy("row_id").select("probability").collect()]
    for name in SMALL_TREES:
        a, b = (made[k][name] for k in (1, 10**9))
        p, q = np.array(told(a)), np.array(told(b))
        if name == "random_forest":
            assert a.getNumTrees == 40 and a.numClasses == 2 and abs(p - q).mean() < 0.03 and p.std() > 0.15
            assert abs(a.featureImportances.toArray() - b.featureImportances.toArray()).max() < 0.05
        else:
            assert np.allclose(p, q, atol=1e-9)
            assert np.allclose(a.featureImportances.toArray(), b.featureImportances.toArray(), atol=1e-9)
        trees = attribution.trees_of(a)
        x = np.array([r[0].toArray() for r in rows.orderBy("row_id").select("features").limit(50).collect()])
        total = trees.base + attribution.contributions_of(x, trees).sum(axis=1)
        assert np.allclose(1 / (1 + np.exp(-2 * total)) if name == "gradient_boosting" else total, p[:50, 1], atol=1e-9)
        # counts of rows, not of cells, tell how many go each way
        assert np.allclose(trees.base, attribution.trees_of(b).base, atol=0.02 if name == "random_forest" else 1e-9)


def test_forests_of_cells_draw_rows(spark, monkeypatch):
    """A tree's root holds as many rows as were drawn, about as many as there are; the model doesn't depend on parts of the rows."""
    monkeypatch.setattr(celltrees, "LEAST_ROWS", 1)
    rows, params = labelled(spark), {"random_forest": {"numTrees": 30, "maxDepth": 3}}
    one = training.train_all(rows, ["random_forest"], params=params)["random_forest"]
    path = f"{require_checkpoint_dir(spark)}/forest-of-cells"
    one.write().overwrite().save(path)
    tables = attribution.node_tables(spark, path, "forest")
    roots = np.array([t[0][4] for t in tables.values()])
    assert len(roots) == 30 and abs(roots.mean() - 4000) < 60 and 20 < roots.std() < 130  # Poisson: 63
    for table in tables.values():
        for n in table.values():
            if n[5] >= 0:
                left, right = table[n[5]], table[n[6]]
                assert n[3] == [a + b for a, b in zip(left[3], right[3])] and n[4] == sum(n[3]) and min(left[4], right[4]) >= 1
                assert left[5] >= 0 or right[5] >= 0 or left[2] != right[2]  # pruned as Spark's trees
    assert {n[7] for t in tables.values() for n in t.values() if n[1] == 0} > {0}  # not all trees may use all features
    monkeypatch.setattr(celltrees, "HISTOGRAMS", 100)  # few nodes at a time
    again = training.train_all(rows, ["random_forest"], params=params)["random_forest"]
    assert again.toDebugString.split("\n", 1)[1] == one.toDebugString.split("\n", 1)[1]


def test_split_of_a_level_by_definition():
    rng = np.random.default_rng(8)
    x, y, w = rng.integers(0, 7, size=(3, 300)).astype(np.uint8), rng.integers(0, 3, 300), rng.integers(1, 4, 300).astype(float)
    node = rng.integers(0, 4, 300)
    total = np.array([np.bincount(y[node == k], w[node == k], 3) for k in range(4)])
    chosen = np.array([[True, True, False], [False, True, True], [True, True, True], [False, False, True]])
    gain, feature, cut, left = celltrees._best(x, y, w, node, total, [7, 7, 7], chosen)
    gini = lambda c: 1 - ((c / c.sum()) ** 2).sum()
    for k in range(4):
        want = {}
        for j in np.flatnonzero(chosen[k]):
            for b in range(6):
                side = (node == k) & (x[j] <= b)
                c = np.bincount(y[side], w[side], 3)
                want[j, b] = gini(total[k]) - c.sum() / total[k].sum() * gini(c) - (total[k] - c).sum() / total[k].sum() * gini(total[k] - c)
        best = max(want.values())
        assert abs(gain[k] - best) < 1e-12 and abs(want[feature[k], cut[k]] - best) < 1e-12
        assert (left[k] == np.bincount(y[(node == k) & (x[feature[k]] <= cut[k])], w[(node == k) & (x[feature[k]] <= cut[k])], 3)).all()


def test_fits_that_cells_cannot_tell_go_by_row(spark, monkeypatch):
    monkeypatch.setattr(celltrees, "LEAST_ROWS", 1)
    rows = labelled(spark, 500)
    for name, odd in (("random_forest", {"subsamplingRate": 0.5}), ("decision_tree", {"minInstancesPerNode": 3}), ("gradient_boosting", {"subsamplingRate": 0.5})):
        estimator = training.get_model(name, 2, 500, **odd)
        assert celltrees.fit(training._columns(estimator, "features", "y"), rows) is None
    assert celltrees.fit(training.get_model("logistic_regression"), rows) is None
    monkeypatch.setattr(celltrees, "MOST_CELLS", 3)
    model = training.train_all(rows, ["random_forest"], params=SMALL_TREES)["random_forest"]
    assert model.getNumTrees == 40


def test_small_nodes_are_finished_as_large_ones(monkeypatch):
    """Row by row, with the same draws, splits, thresholds and numbers of nodes."""
    rng = np.random.default_rng(9)
    for classes, wide in ((2, False), (3, True)):
        x = np.round(rng.normal(size=(700, 5)), 6 if wide else 1)
        counts = np.eye(classes)[rng.integers(0, classes, 700)] * rng.integers(1, 4, 700)[:, None]
        called, made, by_rows = [], [], forest.finished_by_rows
        monkeypatch.setattr(forest, "finished_by_rows", lambda *a: called.append(1) or by_rows(*a))
        for few in (0, 16):
            monkeypatch.setattr(forest, "FEW_ROWS", few)
            made.append(forest.finished(x, counts, np.random.default_rng(1)))
            assert bool(called) == bool(few)
        assert len(made[0]) > 300 and (made[0] == made[1]).all()
        monkeypatch.setattr(forest, "finished_by_rows", by_rows)
        x[3, 2] = np.nan
        assert len(forest.finished(x, counts, np.random.default_rng(1))) > 300
