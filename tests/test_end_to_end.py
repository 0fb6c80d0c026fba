"""A whole run on flow records: text files to marts, as the README shows it."""

import random

from pyspark.sql import functions as F

from flowlens import fixed
from flowlens.operators import anomaly, attribution, clean, contributions, encode, profile, relate, surrogate, training
from flowlens.plans import marts
from flowlens.sources import load_split, read_raw_pair, with_row_id, write_processed

LABELS = ["normal"] * 6 + ["neptune", "smurf", "satan", "guess_passwd"]


def lines(n, seed, extra=()):
    rng = random.Random(seed)
    for _ in range(n):
        label = rng.choice([*LABELS, *extra])
        bad = label != "normal"
        row = {c: 0 for c in fixed.FLOW_COLUMNS}
        row.update(
            duration=rng.randint(0, 9), src_bytes=rng.randint(0, 400) * (1 if not bad else 3),
            dst_bytes=rng.randint(0, 900), count=rng.randint(1, 20) + 60 * bad, srv_count=rng.randint(1, 30),
            serror_rate=round(rng.random() * (0.2 + 0.8 * bad), 2), same_srv_rate=round(rng.random(), 2),
            protocol_type=rng.choice(["tcp", "udp"]), service=rng.choice(["http", "ftp", "private"]),
            flag=rng.choice(["SF", "S0"]), label=label, difficulty_level=rng.randint(0, 21),
        )
        yield ",".join(str(row[c]) for c in fixed.FLOW_COLUMNS)


def test_text_to_marts(spark, tmp_path):
    (tmp_path / "train.txt").write_text("\n".join(lines(600, 1)) + "\n")
    (tmp_path / "test.txt").write_text("\n".join(lines(200, 2, ["never_listed"])) + "\n")
    raw = with_row_id(read_raw_pair(spark, f"{tmp_path}/train.txt", f"{tmp_path}/test.txt"))
    flows = clean.add_targets(clean.dedup_train(clean.drop_meta(raw)))
    write_processed(flows, f"{tmp_path}/flows")
    flows = load_split(spark, f"{tmp_path}/flows")

    numbers = clean.numeric_columns(flows, [*fixed.TARGETS, "row_id"])
    assert len(numbers) == 38
    train = clean.part(flows, "train")
    summary = {r["column"]: r for r in profile.numeric_summary(train, numbers).collect()}
    import pandas as pd

    pdf = train.select(numbers).toPandas()
    want = pdf.describe()
    for c in numbers:
        r = summary[c]
        got = [r[k] for k in ("n", "mean", "std", "min", "q25", "q50", "q75", "max")]
        assert all(abs(a - b) < 1e-9 * max(1, abs(b)) for a, b in zip(got, want[c])), c
    skew = {r["column"]: r["skewness"] for r in profile.skew_rank(train, numbers, None).collect()}
    assert all(abs(skew[c] - pdf[c].skew()) < 1e-8 for c in numbers)
    corr = pdf.corr()
    for r in relate.correlation_pairs(train, numbers).collect():  # 703 pairs, constant columns among them
        w = corr.loc[r["a"], r["b"]]
        assert (r["r"] is None and w != w) or abs(r["r"] - w) < 1e-9
    named = train.where(F.col("attack_category").isin("Normal", "DoS"))
    boxes = profile.box_stats(named, "attack_category", ["Normal", "DoS"], fixed.KEY_FEATURES)
    assert boxes.count() == 12
    assert relate.crosstab(relate.keep_top_values(train, "service"), "service", "attack_category").count() == 3

    hot = encode.OneHot.fit(flows, fixed.NOMINAL)
    wide = hot.transform(flows)
    cols = clean.feature_columns(wide, [*fixed.TARGETS, "row_id", "origin"])
    assert cols == numbers + hot.names()
    scaler = encode.Standardizer.fit(clean.part(wide, "train"), cols)
    rows = encode.assemble(scaler.transform(wide), scaler.outputs()).select(
        "row_id", "origin", "attack_category", F.col("binary_label").alias("y"), *scaler.outputs(), "features"
    )
    train, test = clean.part(rows, "train"), clean.part(rows, "test")
    params = {"random_forest": {"numTrees": 10, "maxDepth": 6}, "gradient_boosting": {"maxIter": 5}}
    models = training.train_all(train, list(training.FACTORIES), params=params)
    table = training.compare(training.score_all(models, test), "binary")
    assert table.agg(F.min("accuracy")).first()[0] > 80

    target = encode.fit_target(train, "attack_category")
    many = clean.known_only(rows)
    assert clean.part(many, "test").count() < test.count()
    coded = target.transform(many.drop("y")).withColumn("y", F.col("y").cast("int"))
    multi = training.train_all(clean.part(coded, "train"), ["decision_tree"], len(target.labels))
    scored = training.score_all(multi, clean.part(coded, "test"))
    assert training.compare(scored, "multiclass").first()["accuracy"] > 40

    detector = anomaly.PcaDetector.fit(train.where("y = 0"), k=8)
    flagged = detector.transform(test)
    assert flagged.where("flag = 1 and y = 1").count() > flagged.where("flag = 1 and y = 0").count()

    trees = {n: attribution.trees_of(models[n]) for n in ("random_forest", "gradient_boosting", "decision_tree")}
    parts = attribution.attribute_all(test, trees, cols, keep=("y",))
    context = surrogate.Context.fit(train, scaler.outputs())
    one = test.orderBy("row_id").limit(3)
    rules = surrogate.explain_all(one, {"random_forest": models["random_forest"]}, context, 15, samples=300)
    assert rules.groupBy("row_id").count().where("count = 15").count() == 3
    marts.write_explanations(parts, rules, f"{tmp_path}/marts")
    top = spark.read.parquet(f"{tmp_path}/marts/global_rank").where("rank = 1")
    assert {r["feature"] for r in top.collect()} == {"count"}
    ranked = contributions.topk(parts.where("model = 'random_forest'"), 12)
    assert ranked.groupBy("row_id").count().where("count <> 12").count() == 0
