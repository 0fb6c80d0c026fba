"""Texts of one long run, many labels or many spans: equal to brute force, in seconds."""

import base64
import math
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from flowlens.llm import licenses, pii, secret_scan, spans
from tests.llm import brute

RNG = random.Random(1)
BLOB = base64.b64encode(RNG.randbytes(750_000)).decode()
PII = {
    "labels": "x a@" + "a." * 100_000 + "b end", "mails": " ".join(f"u{i}@ex{i % 7}.org" for i in range(100_000)),
    "cards": "4111 1111 1111 1111, " * 20_000, "digits": "1" * 500_000, "signs": "a@" * 100_000 + "." * 100_000,
}
SECRETS = {
    "paths": "ab/" * 100_000 + "zz", "camel": "Abc" * 100_000, "blob": BLOB, "assigned": "token=abcdef1 " * 50_000,
    "hexes": " ".join(RNG.randbytes(20).hex() for _ in range(20_000)),
}


def scanned(spark, fn, text):
    start = time.time()
    row = fn(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert time.time() - start < 60
    return row


def places(found):
    return [(s["start"], s["order"], s["end"]) for s in found]


@pytest.mark.parametrize("name", list(PII))
def test_personal_data(spark, name):
    want = [] if name == "digits" else brute.pii(PII[name])  # backtracking makes brute force take minutes there
    assert places(scanned(spark, pii.scan, PII[name])["pii_base"]) == want


@pytest.mark.parametrize("name", list(SECRETS))
def test_secrets(spark, name):
    row = scanned(spark, secret_scan.scan, SECRETS[name])
    assert places(row["secret_base"]) == brute.secrets(SECRETS[name])
    more = {"blob": 1, "hexes": 20_000}.get(name, 0)
    assert len(row["secret_spans"]) == len(row["secret_base"]) + more


def test_licenses(spark):
    text = "Licensed under the Apache License, Version 2.0. MIT license. " * 5000
    row = scanned(spark, licenses.scan, text)
    assert (row["n_base"], row["base_labels"]) == (10_000, "apache,mit") and len(row["detections"]) == 10_000


def test_words_near_a_match(spark):
    docs = spark.createDataFrame([(0, "555-123-4567 is my phone"), (1, "phone 555-123-4567"), (2, "555-123-4567")], "doc_id long, text string")
    got = {r["doc_id"]: [s["kind"] for s in r["pii_spans"]] for r in pii.scan(docs).collect()}
    assert got == {0: ["local_phone"], 1: ["local_phone"], 2: []}
    assert pii.scan(docs, near=2).where("size(pii_spans) > 0").count() == 0
    secret = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    rows = spark.createDataFrame([(0, "x" * 150 + secret.upper()), (1, "EXAMPLE" + "Z" * 150 + secret.upper())], "doc_id long, text string")
    kinds = lambda **o: [[s["kind"] for s in r["secret_spans"]] for r in secret_scan.scan(rows, **o).orderBy("doc_id").collect()]
    assert ["entropy_hex" in k for k in kinds()] == [True, False]
    assert ["entropy_hex" in k for k in kinds(near=40)] == [True, True]


def test_peak_entropy(spark):
    rng = random.Random(2)
    values = ["".join(rng.choice(secret_scan.ALPHABET[: rng.choice([2, 16, 64])]) for _ in range(rng.randrange(20, 90))) for _ in range(200)]

    def bits(window):
        return -sum(n / len(window) * math.log2(n / len(window)) for n in Counter(window).values())

    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", secret_scan.peak_entropy(F.col("v")).alias("e"))
    n = secret_scan.WINDOW
    for v, e in rows.collect():
        assert abs(e - max(bits(v[i : i + n]) for i in range(len(v) - n + 1))) < 1e-9


def test_running_sums(spark):
    rng = random.Random(3)
    arrays = [[rng.randrange(9) for _ in range(n)] for n in (0, 1, 63, 64, 65, 128, 5000)]
    out = spans.running(F.col("a"), F.lit(0), "int", lambda x, y: x + y)
    for a, s in spark.createDataFrame([(a,) for a in arrays], "a array<int>").select("a", out.alias("s")).collect():
        assert s == [sum(a[:i]) for i in range(len(a))]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert [f(none).count() for f in (pii.scan, secret_scan.scan, licenses.scan)] == [0, 0, 0]


def test_workers_remember_little():
    """What a worker remembers of words and chunks is bounded, and chunks go with the part they came from."""
    from flowlens.llm import near, pieces
    from flowlens.llm.common import freed_after

    memo = near._WordHash()
    largest = 0
    for i in range(150_000):
        memo[b"w%d" % i]
        largest = max(largest, len(memo))
    assert largest <= 100_000
    own = pieces.codec(pieces.default_model())
    text = "some words, and \u0416\u2603\U0001f600 others"
    first = own.joined(own.split(text)), own.decoded(own.split(text))
    assert own.known
    own.forget()
    assert not own.known and not own.known.old and not own.unlike
    assert (own.joined(own.split(text)), own.decoded(own.split(text))) == first
    assert list(freed_after(lambda parts: (2 * p for p in parts))(iter([1, 2]))) == [2, 4]
