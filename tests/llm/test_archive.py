"""What the archive's shards depend on, and what a second write does."""

import pytest
from pyspark.sql import functions as F

from flowlens.llm import warc
from tests.llm import brute


def written(spark, tmp_path, name, rows, **options):
    out = f"file://{tmp_path}/{name}"
    made = warc.write(rows, out, **options).collect()
    return out, {r["name"]: (tmp_path / name / r["name"]).read_bytes() for r in made}, made


def pages(spark, n=400):
    return spark.range(n).select(
        F.col("id").alias("page_id"), F.concat(F.lit("http://x/"), "id").alias("url"),
        F.repeat(F.concat(F.lit("text "), F.col("id") % 50), (F.col("id") % 7 * 20).cast("int")).alias("html"))


def test_same_files_whatever_the_settings(spark, tmp_path):
    key, found = "spark.sql.shuffle.partitions", []
    was = spark.conf.get(key)
    try:
        for i, (n, parts) in enumerate(((8, 1), (3, 7))):
            spark.conf.set(key, n)
            found.append(written(spark, tmp_path, f"s{i}", pages(spark).repartition(parts), shard_bytes=9000, roll_bytes=700)[1])
    finally:
        spark.conf.set(key, was)
    assert found[0] == found[1] and len({n.split("-")[1] for n in found[0]}) > 10


def test_an_outlying_id_and_one_hot_id_leave_shards_even(spark, tmp_path):
    far = spark.createDataFrame([(10**15, "far", "x" * 300)], "page_id long, url string, html string")
    hot = spark.range(300).select(F.lit(77).cast("long").alias("page_id"), F.concat(F.lit("u"), "id").alias("url"),
                                  F.concat(F.lit("y" * 280), "id").alias("html"))
    rows = pages(spark).unionByName(far).unionByName(hot).repartition(5)
    total = rows.agg(F.sum(F.octet_length("html"))).first()[0]
    out, _, made = written(spark, tmp_path, "a", rows, shard_bytes=9000)
    sizes = {}
    per = {r["shard"]: 0 for r in made}
    assert sorted(per) == list(range(len(per))) and abs(len(per) - total / 9000) <= 1
    got = warc.read(spark, out).select(F.input_file_name(), "page_id", "payload_bytes").collect()
    assert len(got) == 701 and sum(r["payload_bytes"] for r in got) == total
    for r in made:
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["records"]
    assert max(sizes.values()) < 701 / 4


def test_second_write_is_refused_and_the_first_stays(spark, tmp_path):
    out, files, _ = written(spark, tmp_path, "w", pages(spark, 60))
    with pytest.raises(FileExistsError):
        warc.write(pages(spark, 30), out)
    assert {n: (tmp_path / "w" / n).read_bytes() for n in files} == files
    assert warc.read(spark, out).count() == 60 and [p.name for p in (tmp_path / "w").iterdir() if p.name == "_temporary"] == []


def test_cuts_by_brute_force(spark):
    rows = [(None, "a", 5), (3, None, 9), (3, "a", 9), (3, "b", 0), (9, "a", 40), (9, "a", 40), (10, "z", 1), (11, "z", 8)]
    slim = spark.createDataFrame([(i, brute.sha(str(n))[:40], u, n) for i, u, n in rows], "page_id long, sha1 string, url string, n long")
    want, before, seen = [], 0, set()
    order = sorted({(i is not None, i or 0, brute.sha(str(n))[:40], u is not None, u or "") for i, u, n in rows})
    sizes = {}
    for i, u, n in rows:
        key = (i is not None, i or 0, brute.sha(str(n))[:40], u is not None, u or "")
        sizes[key] = sizes.get(key, 0) + n
    for key in order:
        if before // 10 not in seen:
            seen.add(before // 10)
            want.append(key)
        before += sizes[key]
    assert warc._starts(slim.repartition(4), 10) == want
