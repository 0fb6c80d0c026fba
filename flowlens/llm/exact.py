"""Exact duplicates by composable polynomial fingerprints, confirmed chunk by chunk.

A text without its white space is cut into chunks; every chunk is hashed on its own as a
polynomial over the prime 2**61 - 1, and the hashes of neighbouring chunks combine by shifting
the left one by the length of the right: h(ab) = h(a) * B**len(b) + h(b). All chunks of a batch of
documents are hashed side by side, however long one document is.

Equal fingerprints only propose. Texts that may share one are cut into chunks again, and the
least and greatest chunk at each place of a group are kept: they are equal at every place
exactly when all its texts are. That is an aggregate combined before its shuffle, so a group
of any size never meets in one task and two chunks are all that is held of it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from flowlens.llm.common import (
    SPACE, extended, kept_table, lookup, numbered, possible_member, text_or_empty, with_python, without_names,
)

PRIME = (1 << 61) - 1
BASE = 0x0B5C_9E37_79B9_7F4A
WORD_BYTES = 4  # a polynomial's symbol; the last one of a text is filled up with zero bytes
CHUNK = 2048  # symbols hashed as one polynomial
AT_ONCE = 1 << 17  # bytes hashed side by side
COMPARED = 1 << 16  # characters compared at once


def mulmod(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2**61 - 1 for reduced 64-bit numbers, by halves."""
    a, b = np.asarray(a, np.uint64), np.asarray(b, np.uint64)
    m31, m30, p = np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1), np.uint64(PRIME)
    s30, s31, s61 = np.uint64(30), np.uint64(31), np.uint64(61)
    ah, al, bh, bl = a >> s31, a & m31, b >> s31, b & m31
    mid = al * bh + ah * bl
    x = ((ah * bh) << np.uint64(1)) + (mid >> s30) + ((mid & m30) << s31) + al * bl
    x = (x & p) + (x >> s61)
    return np.where(x >= p, x - p, x)


def powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    for i in range(1, n):
        out[i] = int(out[i - 1]) * base % PRIME
    return out


class Fingerprint:
    """Polynomial hash over chunks; ``modulus_bits`` narrows it for tests of collisions."""

    def __init__(self, modulus_bits: int = 61, chunk: int = CHUNK):
        self.mask, self.chunk = (1 << modulus_bits) - 1, chunk
        self.powers = powers(BASE, chunk)
        self.shift = [int(v) for v in powers(BASE, chunk + 1)]

    def chunk_hashes(self, symbols: np.ndarray, starts: np.ndarray) -> list[int]:
        """Hash of each chunk symbols[starts[i]:starts[i + 1]], every one on its own."""
        ends = np.append(starts[1:], len(symbols))
        exponent = np.repeat(ends - 1, ends - starts) - np.arange(len(symbols))
        terms = mulmod(symbols.astype(np.uint64) + np.uint64(1), self.powers[exponent])
        low = np.add.reduceat(terms & np.uint64(0xFFFFFFFF), starts).tolist()  # below 2**43
        high = np.add.reduceat(terms >> np.uint64(32), starts).tolist()
        return [((h << 32) + v) % PRIME for h, v in zip(high, low)]

    def of(self, texts: list[bytes]) -> list[int]:
        """The fingerprint of each text; some texts at a time, so that the arrays stay in cache."""
        out, held, size = [], [], 0
        for t in texts:
            held.append(t)
            size += len(t)
            if size >= AT_ONCE:
                out += self._of_some(held)
                held, size = [], 0
        return out + self._of_some(held)

    def _of_some(self, texts: list[bytes]) -> list[int]:
        filled = [t + bytes(-len(t) % WORD_BYTES) for t in texts]
        starts, owner, offset = [], [], 0
        for i, t in enumerate(filled):
            n = len(t) // WORD_BYTES
            starts += range(offset, offset + n, self.chunk)
            owner += [i] * -(-n // self.chunk)
            offset += n
        result = [0] * len(texts)
        if offset:
            symbols, at = np.frombuffer(b"".join(filled), "<u4"), np.array(starts)
            sizes = np.diff(np.append(at, offset)).tolist()
            for i, h, n in zip(owner, self.chunk_hashes(symbols, at), sizes):
                result[i] = (result[i] * self.shift[n] + h) % PRIME
        return [r & self.mask for r in result]


def fingerprints(df: DataFrame, text: str, modulus_bits: int = 61) -> DataFrame:
    """Adds fp, n_bytes (of the text without white space), text_sha256, n_points (of the text)."""
    with_python(df.sparkSession)
    schema = extended(df, ("fp", "long"), ("n_bytes", "long"), ("text_sha256", "string"), ("n_points", "long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Fingerprint(modulus_bits)
        for batch in batches:
            values = [v or "" for v in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            plain = [b"".join(v.encode().split()) for v in values]  # splits at just these six bytes
            prints = hasher.of(plain)
            added = [
                pa.array(prints, pa.int64()), pa.array(map(len, plain), pa.int64()),
                pa.array([hashlib.sha256(t).hexdigest() for t in plain], pa.string()),
                pa.array(map(len, values), pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], schema.names)

    return df.mapInArrow(run, schema)


def _id_order(doc_id: str) -> Column:
    """Most characters first, then the smallest id; null ids last."""
    return F.struct(
        (-F.col("n_points")).alias("less"), F.col(doc_id).isNull().alias("null"), F.col(doc_id).alias("id")
    )


def _collided(docs: DataFrame, slim: DataFrame, text: str, modulus_bits: int) -> DataFrame:
    """Fingerprints whose texts differ somewhere: chunkwise comparison of all that may be equal."""
    several = slim.groupBy("fp", "n_bytes").count().where("count > 1")
    several = several.withColumn("key", F.xxhash64("fp", "n_bytes"))
    texts = fingerprints(docs.select(F.col(text).alias("text")), "text", modulus_bits)
    texts = texts.withColumn("key", F.xxhash64("fp", "n_bytes"))
    some = possible_member(texts, "key", several, "several").where("several")
    plain = F.regexp_replace(text_or_empty("text"), SPACE, "")
    places = F.sequence(F.lit(0), F.floor(F.greatest(F.length(plain) - 1, F.lit(0)) / COMPARED).cast("int"))
    chunks = some.withColumn("plain", plain).select(
        "fp", "n_bytes", F.explode(places).alias("place"), "plain"
    ).select("fp", "n_bytes", "place", F.expr(f"substring(plain, place * {COMPARED} + 1, {COMPARED})").alias("chunk"))
    ends = chunks.groupBy("fp", "n_bytes", "place").agg(F.min("chunk").alias("lo"), F.max("chunk").alias("hi"))
    return ends.where("lo <> hi").select("fp", "n_bytes").distinct()


def _decided(docs: DataFrame, doc_id: str, text: str, modulus_bits: int = 61) -> tuple[DataFrame, DataFrame]:
    """Slim rows (id, prints, digest, part) and one row per group of equal texts."""
    slim = kept_table(fingerprints(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")), "text", modulus_bits).drop("text"))
    collided = kept_table(_collided(docs, slim, text, modulus_bits))
    split = F.lit("")
    if collided.limit(1).count():  # such groups are parted by the digests of their whole texts
        bad = collided.withColumn("bad", F.lit(True))
        slim = slim.join(bad, ["fp", "n_bytes"], "left")
        split = F.when(F.col("bad"), F.col("text_sha256")).otherwise("")
    slim = slim.withColumn("part", split).drop("bad")
    best = _id_order("id")
    groups = slim.groupBy("fp", "n_bytes", "part").agg(F.count(F.lit(1)).alias("group_size"), F.min(best).alias("best"))
    return slim, kept_table(groups)


KEYS = ["fp", "n_bytes", "part"]


def decisions(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", modulus_bits: int = 61) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, n_points.

    Texts are equal when they are without white space (a null text is empty; empty texts are
    equal). The row with the most characters stays, then the smallest id, null ids last. Rows
    of one group that tie in both are all marked kept here; ``dedup`` keeps one of them.
    """
    slim, groups = _decided(docs, doc_id, text, modulus_bits)
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    rows = lookup(slim, groups, KEYS, "group_size", total)
    keep = F.col("best.id")
    return rows.select(
        F.col("id").alias("doc_id"), keep.alias("keep_id"), "group_size",
        (_id_order("id") == F.col("best")).alias("kept"), "text_sha256", "n_points",
    )


def dedup(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", modulus_bits: int = 61) -> DataFrame:
    """The rows that stay, with the caller's columns; of rows that tie, one.

    Texts that are surely alone pass by without a shuffle; only rows of groups are joined.
    """
    plain, at = numbered(docs)
    ident, words = at[doc_id], at[text]
    _, groups = _decided(plain, ident, words, modulus_bits)
    key = F.xxhash64("fp", "n_bytes")
    several = groups.where("group_size > 1").withColumn("key", key)
    rows = fingerprints(plain, words, modulus_bits).withColumn("key", key)
    rows = possible_member(rows, "key", several, "several")
    alone = rows.where("NOT several").select(*plain.columns)
    # the winner of each group is named by prints, length and id, so a large group spreads out
    winner = groups.select(*[F.col(k).alias(f"w_{k}") for k in KEYS], (-F.col("best.less")).alias("w_points"), F.col("best.id").alias("w_id"))
    met = rows.where("several").join(
        winner,
        (F.col("fp") == F.col("w_fp")) & (F.col("n_bytes") == F.col("w_n_bytes")) & (F.col("n_points") == F.col("w_points"))
        & F.col(ident).eqNullSafe(F.col("w_id")) & F.col("w_part").isin("", F.col("text_sha256")),
    )
    one = met.dropDuplicates([f"w_{k}" for k in KEYS]).select(*plain.columns)
    return alone.unionByName(one).toDF(*docs.columns)
