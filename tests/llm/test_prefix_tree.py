"""The prefix tree against brute force, and tree contraction on shapes of its own."""

import random

import pytest
from pyspark.sql import functions as F

from flowlens.llm import prefix_tree, queries
from tests.llm import brute
from tests.oracle import compare, connect

SMALL = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"


def listed(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def check(spark, rows, parts=3):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"node": F.lit(1), "part": F.lit("x")}).repartition(parts)
    assert listed(prefix_tree.report(df)) == sorted(brute.prefix_tree(rows), key=str)


def test_small_conversations(spark):
    rng = random.Random(5)
    rows = []
    for c in [*range(0, 330), -7, -100, -101, 10**12, 10**12 + 5]:
        for t in range(rng.randrange(9)):
            rows.append((c, rng.choice([t, t, t, 0, None]), rng.choice(["user", "assistant", None, ""]), rng.choice(["", "yes", "no", "é漢😀", None])))
    rows += [(None, 1, "user", "lost"), (7, 3, "user", "same"), (7, 3, "user", "same"), (7, 3, "user", "same")]
    check(spark, rows)


def test_one_long_conversation_and_many_copies(spark):
    text = [("user" if t % 2 else "assistant", f"w{t % 7}") for t in range(9000)]
    rows = [(200, t, *text[t]) for t in range(9000)] + [(100, t, *text[t]) for t in range(4500)]
    rows += [(c, t, "user", "hello") for c in range(1000, 2500) for t in range(2)] + [(c, 0, None, None) for c in range(5000, 5200)]
    rows += [(300, 0, "a", "x" * 100_000), (301, 0, "a", "x" * 100_000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(8)
    got = listed(prefix_tree.report(df))
    assert got == sorted(brute_of_long(rows), key=str)


def brute_of_long(rows):
    """brute.prefix_tree with chained digests in place of whole prefixes."""
    import zlib

    own, made, members, above, chars = {}, {}, {}, {}, {}
    for c, turn, role, text in sorted(rows, key=lambda r: (r[0], r[1])):
        own.setdefault(c, []).append((role or "", text or ""))
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    for c in sorted(made):
        at = ""
        members.setdefault(at, []).append(c)
        above[at], chars[at] = (None, 0), 0
        for d, turn in enumerate(made[c], 1):
            new = brute.sha(f"{at}|{turn!r}")
            above[new], chars[new] = (at, d), len(turn[1])
            members.setdefault(new, []).append(c)
            at = new
    total, kids = {p: [0, (len(m) - 1) * chars[p]] for p, m in members.items()}, dict.fromkeys(members, 0)
    for p in members:
        if p:
            kids[above[p][0]] += 1
    for p in sorted(members, key=lambda p: -above[p][1]):
        total[p][0] += not kids[p]
        if p:
            for i in (0, 1):
                total[above[p][0]][i] += total[p][i]
    out = []
    for p, m in members.items():
        parent, depth = above[p]
        ends = ",".join(str(c) for c in m if len(made[c]) == depth)
        out.append((m[0], depth, members[parent][0] if p else None, len(m), kids[p], *total[p], brute.sha(ends)))
    return out


def test_empty_and_lost(spark):
    assert prefix_tree.report(spark.createDataFrame([], SCHEMA)).count() == 0
    assert prefix_tree.report(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA)).count() == 0
    check(spark, [(150, None, None, None)], 1)


def tree_of(spark, parents, values):
    kids = [parents.count(i) for i in range(len(parents))]
    rows = [(i, p, k, v) for i, (p, k, v) in enumerate(zip(parents, kids, values))]
    return spark.createDataFrame(rows, "node long, parent long, n_children long, v long")


@pytest.mark.parametrize("shape", ["chain", "star", "random", "broom", "forest"])
def test_contraction(spark, shape):
    rng, n = random.Random(6), 600
    parents = {
        "chain": [None, *range(n - 1)], "star": [None] + [0] * (n - 1), "random": [None] + [rng.randrange(i) for i in range(1, n)],
        "broom": [None, *range(299), *[299] * 300], "forest": [None if i % 50 == 0 else i - 1 - (i % 3 > 1) * (i % 50 > 2) for i in range(n)],
    }[shape]
    values = [rng.randrange(100) for _ in parents]
    want, log = list(values), []
    for i in range(len(parents) - 1, -1, -1):
        if parents[i] is not None:
            want[parents[i]] += want[i]
    got = prefix_tree.subtree_totals(tree_of(spark, parents, values), ["v"], log=log)
    assert sorted(map(tuple, got.collect())) == list(enumerate(want))
    assert len(log) <= {"star": 2}.get(shape, 26)  # a chain of 600 would take 600 rounds of raking


def test_ring_is_refused(spark):
    ring = spark.createDataFrame([(1, 2, 2, 0), (2, 1, 2, 0)], "node long, parent long, n_children long, v long")
    with pytest.raises(ValueError, match="ring"):
        prefix_tree.subtree_totals(ring, ["v"])


def test_against_sql(spark):
    name = "op11_prefix_tree"
    assert compare(queries.QUERIES[name](spark, SMALL), connect(SMALL), queries.ORACLES[name]) == []
