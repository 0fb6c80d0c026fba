"""Flow records end to end: reading, cleaning, targets, encoding, scaling, streaming."""

import math

import pytest
from pyspark.sql import functions as F

from flowlens import fixed
from flowlens.functions.bounds import TooManyValues, UnlistedValues, vocabulary
from flowlens.functions.labels import category_table
from flowlens.operators import anomaly, clean, encode, evaluate, profile, relate, training
from flowlens.sources import flows as src
from flowlens.sources.state import Registry, load_table, save_table, shared, spread
from flowlens.streaming import flag_stream, read_stream, write_stream


def flow(label="normal", difficulty=20, **over):
    values = {c: 0 for c in fixed.FLOW_COLUMNS}
    values.update(protocol_type="tcp", service="http", flag="SF", label=label, difficulty_level=difficulty)
    values.update(over)
    return ",".join("" if values[c] is None else str(values[c]) for c in fixed.FLOW_COLUMNS)


TRAIN = [
    flow(src_bytes=181, serror_rate=0.25),
    flow(src_bytes=181, serror_rate=0.25, difficulty=3),
    flow("neptune", service="private", count=123),
    flow("NORMAL", src_bytes="NA"),
    flow("brand_new", service=None),
    flow("guess_passwd", src_bytes=181, serror_rate=0.25),
]
TEST = [flow("mscan", protocol_type="icmp"), flow("mscan", protocol_type="icmp"), flow("ps", flag="REJ")]


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("raw")
    for name, lines in (("train.txt", TRAIN), ("test.txt", TEST)):
        (folder / name).write_text("\n".join(lines) + "\n")
    return src.with_row_id(src.read_raw_pair(spark, str(folder / "train.txt"), str(folder / "test.txt")))


def test_schema_and_groups():
    assert len(fixed.FLOW_COLUMNS) == 43
    assert [len(g) for g in (fixed.BASIC, fixed.CONTENT, fixed.TRAFFIC, fixed.HOST)] == [9, 13, 9, 10]
    assert {k: len(v) for k, v in fixed.ATTACK_GROUPS.items()} == {"DoS": 10, "Probe": 6, "R2L": 15, "U2R": 7}


def test_missing_values_are_null_not_malformed(raw):
    assert raw.where(F.col("src_bytes").isNull()).select("label").first()[0] == "NORMAL"
    assert raw.where(F.col("service").isNull()).select("label").first()[0] == "brand_new"
    assert raw.select("row_id").distinct().count() == 9


def test_cleaning(raw):
    slim = clean.drop_meta(raw)
    kept = clean.dedup_train(slim)
    assert kept.groupBy("origin").count().orderBy("origin").collect() == [("test", 3), ("train", 5)]
    normal = kept.where("label = 'normal'").select("row_id").collect()
    assert [r[0] for r in normal] == [raw.agg(F.min("row_id")).first()[0]]
    # before the meta column goes, the two copies still differ
    keys = [c for c in raw.columns if c not in ("row_id", "origin")]
    extra = {r["origin"]: r["duplicates"] for r in clean.duplicate_count(raw, keys).collect()}
    assert extra == {"train": 0, "test": 1}


def test_targets(spark, raw):
    done = clean.add_targets(raw)
    got = {r["label"]: (r["attack_category"], r["binary_label"]) for r in done.collect()}
    assert got == {
        "normal": ("Normal", 0), "neptune": ("DoS", 1), "NORMAL": ("Unknown", 1),
        "brand_new": ("Unknown", 1), "guess_passwd": ("R2L", 1), "mscan": ("Probe", 1), "ps": ("U2R", 1),
    }
    nul = clean.add_targets(spark.createDataFrame([(None,)], "label string")).first()
    assert (nul["attack_category"], nul["binary_label"]) == ("Unknown", 1)
    by_table = clean.add_category_by_lookup(raw, category_table(spark))
    assert {r["label"]: r["attack_category"] for r in by_table.collect()} == {k: v[0] for k, v in got.items()}


def test_one_hot_union_and_reconstruct(raw):
    hot = encode.OneHot.fit(raw, fixed.NOMINAL)
    assert hot.names("protocol_type") == ["protocol_type_icmp", "protocol_type_tcp"]  # icmp only in test
    wide = hot.transform(raw)
    assert wide.columns[-len(hot.names()):] == hot.names()
    sums = wide.select("label", sum((F.col(n) for n in hot.names("service")), F.lit(0)).alias("s"))
    assert {r["label"]: r["s"] for r in sums.collect()}["brand_new"] == 0
    back = {r["label"]: r["service"] for r in hot.reconstruct(wide, "service").collect()}
    assert back["neptune"] == "private" and back["brand_new"] == "http"
    features = clean.numeric_columns(wide, ["row_id", "difficulty_level"], fixed.NOMINAL)
    assert len(features) == 38


def test_label_and_target_encoding(raw):
    coded = encode.label_encode(raw.where("service is not null"), ["protocol_type", "service"])
    assert {r["service"] for r in coded.collect()} == {0, 1}
    cat = clean.add_targets(raw)
    model = encode.fit_target(clean.part(cat, "train"), "attack_category")
    assert list(model.labels) == ["DoS", "Normal", "R2L", "Unknown"]
    with pytest.raises(Exception):
        model.transform(clean.part(cat, "test")).collect()


def test_scaling_constant_and_population_std(spark):
    train = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    test = spark.createDataFrame([(5.0, 7.0)], "a double, b double")
    scaler = encode.Standardizer.fit(train, ["a", "b"])
    assert scaler.stats == {"a": (2.0, 1.0), "b": (5.0, 1.0)}
    assert tuple(scaler.transform(test).select("z_a", "z_b").first()) == (3.0, 2.0)
    assert [tuple(r) for r in scaler.transform(train).select("z_a", "z_b").collect()] == [(-1, 0), (1, 0)]


def test_round_trips(spark, raw, tmp_path):
    done = clean.add_targets(clean.drop_meta(raw))
    src.write_processed(done, f"{tmp_path}/pq")
    train = src.load_split(spark, f"{tmp_path}/pq", "train")
    assert train.count() == 6
    assert "PartitionFilters: [isnotnull(origin" in train._jdf.queryExecution().toString()
    assert src.load_split(spark, f"{tmp_path}/pq").count() == 9
    src.write_csv(done, f"{tmp_path}/csv")
    again = src.read_processed_csv(spark, f"{tmp_path}/csv", done.schema)
    assert again.exceptAll(done).count() == 0 and again.count() == 9
    scaler = encode.Standardizer.fit(done, ["src_bytes", "count"])
    scaler.save(spark, f"{tmp_path}/scaler")
    assert encode.Standardizer.load(spark, f"{tmp_path}/scaler") == scaler
    anomaly.save_threshold(spark, 0.75, f"{tmp_path}/cut")
    assert anomaly.load_threshold(spark, f"{tmp_path}/cut") == 0.75
    save_table(done, f"{tmp_path}/t")
    with shared(load_table(spark, f"{tmp_path}/t")) as kept:
        assert kept.storageLevel.useMemory and kept.count() == 9
    assert spread(done).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    hot = encode.OneHot.fit(done, ["protocol_type", "service"])
    hot.save(spark, f"{tmp_path}/hot")
    assert encode.OneHot.load(spark, f"{tmp_path}/hot") == hot
    encode.save_order(spark, ["b", "a"], f"{tmp_path}/order")
    assert encode.load_order(spark, f"{tmp_path}/order") == ["b", "a"]


def test_missing_model_is_left_out(spark, tmp_path):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler

    models = Registry(spark, str(tmp_path))
    df = spark.createDataFrame([(1.0,)], "a double")
    models.save("a", Pipeline(stages=[VectorAssembler(inputCols=["a"], outputCol="f")]).fit(df))
    labelled = spark.createDataFrame([(1.0, 1), (0.0, 0)] * 5, "a double, y int")
    ready = VectorAssembler(inputCols=["a"], outputCol="features").transform(labelled)
    models.save("bare", training.train_all(ready, ["decision_tree"])["decision_tree"])
    assert training.score(models.load("bare"), ready, ["y"]).where("y <> prediction").count() == 0
    assert list(models.available(["a", "gone"])) == ["a"]
    assert {tuple(r) for r in models.table(["a", "gone"]).collect()} == {("a", True), ("gone", False)}


def test_vocabulary_refuses_to_grow(spark):
    with pytest.raises(TooManyValues):
        vocabulary(spark.range(50).withColumn("s", F.col("id").cast("string")), "s", 10)


def test_edges_of_profiles(spark):
    nan = float("nan")
    df = spark.createDataFrame(
        [(1.0, 4.0, nan, 1), (2.0, 4.0, 1.0, 0), (3.0, 4.0, 2.0, 1), (10.0, 4.0, 3.0, 1)],
        "x double, k double, n double, y int",
    )
    skew = {r["column"]: r["skewness"] for r in profile.skew_rank(df, ["x", "k"]).collect()}
    assert skew["k"] == 0 and math.isclose(skew["x"], 1.763632614803888, rel_tol=1e-9)
    rank = relate.label_correlation(df, ["k", "x", "n"], "y").collect()
    assert rank[-1]["column"] == "k" and rank[-1]["abs_r"] is None
    assert {r["r"] is None for r in relate.correlation_pairs(df, ["x", "k"]).collect()} == {True}
    pair = relate.correlation_pairs(df, ["x", "n"]).first()
    assert math.isclose(pair["r"], 0.9176629354822472, rel_tol=1e-9)  # the row with NaN drops out
    wide = df.select(*[(F.col("x") * (i + 1) + F.col("y") * i).alias(f"c{i}") for i in range(18)])
    fast = {(r["a"], r["b"]): r["r"] for r in relate.correlation_pairs(wide, wide.columns).collect()}
    slow = {(r["a"], r["b"]): r["r"] for r in relate.correlations(wide, list(fast)).collect()}
    assert len(fast) == 153 and all(math.isclose(fast[k], slow[k], rel_tol=1e-9) for k in fast)
    zero = spark.createDataFrame([(0.0,)] * 9 + [(1.0,)], "z double")
    assert profile.zero_share(zero, ["z"], 90).count() == 0
    assert profile.histogram(df, ["k"]).first()["n"] == 4
    assert profile.imbalance(df.where("y = 1"), "y").first()[0] is None


def test_outliers_are_strict(spark):
    values = [1.0, 2.0, 3.0, 4.0, 5.0, 8.0, 8.000001]  # quartiles 2.5 and 6.5, fences -3.5 and 12.5
    df = spark.createDataFrame([(v,) for v in [*values[:5], 6.5, 12.5]], "v double")
    q = profile.numeric_summary(df, ["v"]).first()
    row = profile.iqr_outliers(df, ["v"]).first()
    upper = q["q75"] + 1.5 * (q["q75"] - q["q25"])
    assert row["upper"] == upper and row["outliers"] == sum(v > upper for v in [6.5, 12.5])
    on_fence = spark.createDataFrame([(v,) for v in [0.0, 1.0, 1.0, 1.0, 2.0, 2.0, 2.0, 3.5]], "v double")
    assert profile.iqr_outliers(on_fence, ["v"]).first()["outliers"] == 0


def test_top_values_break_ties_by_name(spark):
    df = spark.createDataFrame([(s,) for s in "bbaaccd"], "s string")
    assert [r[0] for r in relate.top_values(df, "s", 2).collect()] == ["a", "b"]


def test_stream_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("\n".join(l for l in TRAIN if "NA" not in l) + "\n")
    (tmp_path / "in" / "b.txt").write_text("\n".join(TEST) + "\n")
    batch = src.read_raw(spark, f"{tmp_path}/in")
    detector = anomaly.MeanDetector.fit(batch, ["src_bytes", "count"], F.col("label") == "normal")
    query = write_stream(
        flag_stream(read_stream(spark, f"{tmp_path}/in"), detector), f"{tmp_path}/out", f"{tmp_path}/cp"
    )
    query.awaitTermination(120)
    cols = ["label", "attack_category", "binary_label", "error", "flag"]
    got = sorted(map(str, spark.read.parquet(f"{tmp_path}/out").select(cols).collect()))
    assert got == sorted(map(str, flag_stream(batch, detector).select(cols).collect())) and len(got) == 8


def test_missing_tokens_and_malformed_fields(spark, tmp_path):
    from pyspark.sql import types as T

    schema = T.StructType().add("n", T.IntegerType()).add("x", T.DoubleType()).add("s", T.StringType())
    (tmp_path / "a.txt").write_text(" 1 , 2.5 , normal \nNaN,null,N/A\n3.0,,x\n")
    for read in (src.read_raw, read_stream):
        folder = str(tmp_path)
        df = read(spark, folder, schema)
        if df.isStreaming:
            query = write_stream(df, f"{folder}-out", f"{folder}-cp")
            query.awaitTermination(120)
            df = spark.read.parquet(f"{folder}-out")
        assert {tuple(r) for r in df.collect()} == {(1, 2.5, "normal"), (None, None, None), (3, None, "x")}
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "b.txt").write_text("1x,2,a\n")
    with pytest.raises(Exception, match="malformed n: 1x"):
        src.read_raw(spark, f"{tmp_path}/b", schema).collect()


def test_unlisted_classes_stay_or_are_refused(spark):
    df = spark.createDataFrame([(2, 1), (0, 0), (None, 1), (1, None)], "y int, prediction int")
    cells = {(r["actual"], r["predicted"]): r["n"] for r in evaluate.confusion_matrix(df, labels=[0, 1]).collect()}
    assert cells == {(0, 0): 1, (0, 1): 0, (1, 0): 0, (1, 1): 0, (2, 1): 1, (None, 1): 1, (1, None): 1}
    assert sum(evaluate.binary_cells(df).first()) == 4
    assert {r["y"]: r["(other)"] for r in relate.crosstab(df, "y", "prediction", [0]).collect()} == {2: 1, 0: 0, None: 1, 1: 1}
    for report in (profile.box_stats, lambda d, by, g, c: profile.histogram(d, c, 4, by, g)):
        with pytest.raises(UnlistedValues):
            report(df, "y", [0, 1], ["prediction"])


def test_pairs_of_empty_and_partly_constant_columns(spark):
    df = spark.createDataFrame([(1.0, 5.0, None), (2.0, 5.0, 1e-13), (3.0, 6.0, 2e-13)], "a double, b double, c double")
    got = {(r["a"], r["b"]): r["r"] for r in relate.correlation_pairs(df, ["a", "b", "c"]).collect()}
    assert math.isclose(got["a", "c"], 1) and math.isclose(got["b", "c"], 1)
    assert [r["r"] for r in relate.correlation_pairs(df.where("a > 9"), ["a", "b"]).collect()] == [None]
    part = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (None, 6.0)], "a double, b double")
    assert relate.correlation_pairs(part, ["a", "b"]).first()["r"] is None  # b is constant where a is present
