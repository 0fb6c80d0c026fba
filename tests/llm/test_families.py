"""Large families of near copies: split classes and buckets give the links of brute force."""

import math
import random

import pytest

from flowlens.llm import common, near
from tests.llm import brute


def family(rng, n, words=120, most=14, start=0):
    """Copies of one text with some words changed: many just above and just below the threshold."""
    base = [f"w{rng.randrange(900)}" for _ in range(words)]
    out = []
    for i in range(n):
        copy = list(base)
        for _ in range(rng.randrange(most)):
            copy[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out.append((start + i, " ".join(copy)))
    return out


@pytest.mark.parametrize("words,percent", [(3, 85), (5, 80)])
def test_families_are_split_without_loss(spark, monkeypatch, words, percent):
    monkeypatch.setattr(near, "PAIRS_AT_ONCE", 7)
    monkeypatch.setattr(near, "MEMBERS_AT_ONCE", 5)
    rng = random.Random(12)
    rows = family(rng, 160) + family(rng, 60, 60, 9, 1000) + [(2000 + i, f"alone {i} " * 30) for i in range(40)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near.decisions(docs, words=words, percent=percent).collect()}
    assert got == brute.near(rows, words, percent)


@pytest.mark.parametrize("percent,one_in", [(85, 1.8e10), (80, 2.0e7)])
def test_the_estimate_loses_less_than_the_bands(percent, one_in):
    j, limit = percent / 100, near.lowest_estimate(percent) * near.REGISTERS
    below = sum(math.comb(near.REGISTERS, e) * j**e * (1 - j) ** (near.REGISTERS - e) for e in range(int(limit)))
    assert below <= near.band_miss(percent) / 10 and 0.8 * one_in < 1 / near.band_miss(percent) < 1.2 * one_in


def test_release_touches_its_own_tables_only(spark):
    held, docs = [], spark.createDataFrame(family(random.Random(1), 12), "doc_id long, text string")
    mine = near.decisions(docs)
    with common.tables_in(held):
        theirs = near.decisions(docs)
        assert theirs.count() == 12
    assert held
    common.release(held)
    assert held == [] and mine.count() == 12
    with pytest.raises(Exception, match="(?i)not.exist|no such"):
        theirs.count()
