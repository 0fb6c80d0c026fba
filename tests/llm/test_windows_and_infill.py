"""Benchmark windows and fill-in-middle against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from flowlens.llm import decontaminate, infill, queries
from tests.llm import brute
from tests.oracle import compare, connect

SMALL = "/root/testdata/sf0.001"
PASSAGE = "Alpha beta, gamma; delta epsilon zeta ETA theta iota kappa lambda mu nu xi"
BENCH = [
    (1, PASSAGE), (2, PASSAGE), (3, PASSAGE + " omicron pi"), (4, "short item"), (5, None), (6, " ,. "), (None, "漢字 çà"),
    (7, "short item"), (7, "Wholly other words that never come in any of the texts at all here"),
]
DOCS = [
    (0, None), (1, ""), (2, "..."), (3, PASSAGE), (4, f"before {PASSAGE} omicron pi. After"), (5, PASSAGE.replace("theta", "x")),
    (6, "a SHORT  item, short-item short"), (7, "item short"), (8, f"{PASSAGE}\n{PASSAGE.lower()}"), (None, PASSAGE), (None, PASSAGE),
    (None, "clean"), (9, "漢字 ÇÀ 漢字,çà"), (10, "w " * 50_000 + PASSAGE + " w" * 50_000), (11, PASSAGE), (11, PASSAGE), (11, "else"),
    (12, "Alpha beta gamma delta epsilon zeta eta theta iota"),
]


def frames(spark, docs=DOCS, bench=BENCH):
    return (
        spark.createDataFrame(docs, "doc_id long, text string").withColumns({"words": F.lit(1), "key": F.lit("k"), "copies": F.lit(2)}),
        spark.createDataFrame(bench, "item_id long, text string"),
    )


def listed(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("part_bytes", [1 << 26, 1500])
def test_windows(spark, part_bytes):
    docs, bench = frames(spark)
    want = sorted(brute.contamination(DOCS, BENCH), key=str)
    assert listed(decontaminate.decisions(docs.repartition(3), bench, part_bytes=part_bytes)) == want


def test_windows_of_random_words(spark):
    rng = random.Random(4)
    draw = lambda n: " ".join(rng.choice("abcd") for _ in range(n))
    docs = [(i, draw(rng.randrange(60))) for i in range(120)]
    bench = [(i, draw(rng.randrange(1, 5) if i % 9 == 0 else rng.randrange(5, 14))) for i in range(40)]
    a, b = frames(spark, docs, bench)
    for n in (10, 4):
        assert listed(decontaminate.decisions(a, b, n=n)) == sorted(brute.contamination(docs, bench, n), key=str)


def test_nothing_to_find(spark):
    docs, bench = frames(spark)
    assert decontaminate.decisions(docs.limit(0), bench).count() == 0
    none = bench.where("item_id IN (5, 6)")
    assert listed(decontaminate.decisions(docs, none)) == sorted(brute.contamination(DOCS, BENCH[4:6]), key=str)
    assert listed(decontaminate.clean(docs, bench.limit(0))) == listed(docs)


def test_removal(spark):
    docs, bench = frames(spark)
    clean = {r[0]: not r[5] for r in brute.contamination(DOCS, BENCH)}
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns
    assert listed(kept.select("doc_id", "text")) == sorted(
        [(i, t) for (i, t), d in zip(DOCS, brute.contamination(DOCS, BENCH)) if not d[5]], key=str)
    cut = {r["doc_id"]: r["text"] for r in decontaminate.clean(docs, bench, remove="spans").where("doc_id IS NOT NULL").collect()}
    assert cut[3] == "" and cut[4] == "before . After" and cut[8] == "" and cut[9] == "漢字 ÇÀ "
    assert cut[6] == "a  short" and cut[0] is None and cut[10] == "w " * 50_000 + " w" * 50_000
    assert all(cut[i] == t for i, t in DOCS if i not in (None, 11) and clean[i])
    some = decontaminate.clean(docs, bench, least_share=0.5).where("doc_id = 10").count()
    assert some == 1
    with pytest.raises(ValueError):
        decontaminate.clean(docs, bench, remove="words")


def test_window_plan_stays_in_the_jvm(spark):
    docs, bench = frames(spark)
    per, _ = decontaminate.found(docs, bench)
    plan = per._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert not any(p in plan for p in ("Python", "InPandas", "InArrow", "NestedLoop", "Cartesian"))


def infill_rows():
    rng = random.Random(9)
    signs = [*"aZz@[`{ 1é漢😀\n<PSM>", "word", "é", "Ünicode", "\x00"]
    rows = [(i, "".join(rng.choice(signs) for _ in range(rng.randrange(40)))) for i in range(400)]
    return rows + [
        (None, "null id"), (None, None), (900, None), (901, ""), (902, "has <P> in it"), (903, "<S"), (904, "x" * 300_000),
        (905, "ab 漢" * 2_000_000), (906, "one"), (906, "one"), (907, "<"), (908, "<M>"), (909, "\x80\x7f"),
    ]


def test_infill(spark):
    rows = infill_rows()
    docs = spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id long, text string, N int, output string").repartition(3)
    made = infill.transform(docs)
    assert made.columns == ["doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = made.withColumn("back", infill.restored(F.col("output"), F.col("form"))).drop("text").collect()
    want = [(i, *brute.infill(i, t), t or "") for i, t in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert infill.transform(docs.limit(0)).count() == 0
    text_called_output = docs.select("doc_id", F.col("text").alias("output"))
    again = infill.transform(text_called_output, text="output").drop("text")
    assert sorted(map(tuple, again.collect()), key=str) == sorted([w[:-1] for w in want], key=str)


def test_infill_forms_are_all_there():
    forms = [brute.infill(i, "some text, cut somewhere")[1] for i in range(2000)]
    assert 1360 < forms.count("psm") < 1520 and 300 < forms.count("spm") < 420


@pytest.mark.parametrize("name", ["op12_decontaminate", "op13_fill_in_middle"])
def test_against_sql(spark, name):
    assert compare(queries.QUERIES[name](spark, SMALL), connect(SMALL), queries.ORACLES[name]) == []


def test_bytes_that_are_no_text(spark):
    """Bytes that aren't UTF-8 pass through unharmed."""
    df = spark.range(40).select(F.col("id").alias("doc_id"), F.expr("cast(unhex('61FF62E282C3A92020') as string)").alias("text"))
    made = infill.transform(df).withColumn("back", infill.restored(F.col("output"), F.col("form")))
    assert made.where(F.hex(F.col("back").cast("binary")) != "61FF62E282C3A92020").count() == 0
