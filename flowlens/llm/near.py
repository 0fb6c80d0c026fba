"""Near duplicates by HyperMinHash registers, confirmed on full shingle sets.

Every distinct shingle set is a class; the rest works on classes. A class's sketch has 128
minima of 32-bit hashes, each kept as its count of leading zeros and ten mantissa bits.
Bands of four compressed registers name buckets. Two sets of similarity 0.85 share a band's
registers with probability 0.52, so all 32 bands miss them once in 1.9e10 times (once in 2.1e7
at 0.8).

Members of a bucket are compared with its first member only. What is linked this way is joined
to components; members outside a bucket's largest component are then compared with one member
of that. What is still open is settled: members of one bucket in different components become
a pair if they can be linked at all, which parity bits tell without error: each element flips one
of 512 bits, so two sets differ in at least as many elements as their bits differ in. So no
group is expanded into pairs, and no link between components is skipped.

Candidates pass if their Jaccard estimate, corrected for registers that agree by accident, reaches a
limit that a pair at the threshold falls below with a tenth of the probability that all bands miss it (an exact
binomial tail); all those are confirmed on the whole sets. So a link at the threshold is lost once in 1.7e10
(0.85) or 1.9e7 (0.8), and stronger ones more rarely.

A class in many pairs and a bucket of many members are split: their pairs are dealt to numbered parts, and the
class's set, or one side of the bucket, is there once for each part.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flowlens.llm.common import batches_of, extended, freed_after, kept_table, lookup, numbered, possible_member, with_python

BANDS, ROWS = 32, 4
REGISTERS = BANDS * ROWS
MANTISSA = 10
WORDS, PERCENT = 5, 80
PARITY_BITS = 512
WORD_MEMO = 100_000  # remembered words of a task; only speed depends on it
PAIRS_AT_ONCE = 4096  # of one class, before its set is there more than once
SETS_AT_ONCE = 512  # rows with texts or sets that a Python worker is sent together
MEMBERS_AT_ONCE = 1024  # of one bucket, before its members are compared block by block
CLASS = "decimal(38,0)"
_RNG = np.random.Generator(np.random.PCG64(20240229))
FACTORS = _RNG.integers(1, 1 << 31, (2, REGISTERS // 2), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_UPPER_TO_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _WordHash(dict):
    """64-bit hash of a word, remembered for frequent words."""

    def __missing__(self, word: bytes) -> int:
        value = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(self) >= WORD_MEMO:
            self.clear()
        self[word] = value
        return value


def shingles(text: str, words: int, memo: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; fewer words are one shingle."""
    found = text.encode().translate(_UPPER_TO_LOWER).split()  # splits at just the six ASCII blanks
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, found), np.uint64, len(found))
    n = min(words, len(h))
    rolled = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        rolled = _mix(rolled * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(rolled)])
    return np.unique(rolled)


def registers(minima: np.ndarray) -> np.ndarray:
    """Leading zeros and mantissa bits of 32-bit minima."""
    value = minima.astype(np.float64)
    length = np.frexp(value)[1]  # bits needed; 0 for 0
    shift = np.maximum(length - 1 - MANTISSA, 0).astype(np.uint64)
    mantissa = (minima >> shift) & np.uint64((1 << MANTISSA) - 1)
    return ((32 - length).astype(np.uint64) << np.uint64(MANTISSA) | mantissa).astype(np.uint16)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """128 compressed registers of a non-empty set: 64 orders of each half of its hashes."""
    lowest = np.full(FACTORS.shape, 0xFFFFFFFF, np.uint32)
    for start in range(0, len(hashes), 1024):  # a block stays in cache, however long the text
        halves = hashes[start : start + 1024].view(np.uint32).reshape(-1, 2)
        for half in (0, 1):
            h = np.multiply.outer(FACTORS[half], np.ascontiguousarray(halves[:, half]))
            np.minimum(lowest[half], h.min(axis=1), out=lowest[half])
    return registers(lowest.ravel().astype(np.uint64))


def chance(n: int, m: int) -> float:
    """Probability that the minima of two disjoint sets fall into one register value."""
    total, scale = 0.0, 2.0**-MANTISSA
    for zeros in range(33):
        lo, hi = (0.0, 2.0**-32) if zeros == 32 else (2.0 ** -(zeros + 1), 2.0**-zeros)
        mine = (1 - lo) ** n - (1 - hi) ** n
        other = (1 - lo) ** m - (1 - hi) ** m
        total += mine * other
    return total * scale


def estimate(equal: int, n: int, m: int) -> float:
    """Jaccard similarity from the share of equal registers, without the chance agreements."""
    c = chance(n, m)
    return max(0.0, (equal / REGISTERS - c) / (1 - c))


def band_miss(percent: int) -> float:
    """Probability that no band of a pair at the threshold agrees."""
    return (1 - (percent / 100) ** ROWS) ** BANDS


def lowest_estimate(percent: int) -> float:
    """The estimate that a pair at the threshold falls below with at most a tenth of ``band_miss``."""
    j, tail, equal = percent / 100, 0.0, 0
    while True:
        tail += math.comb(REGISTERS, equal) * j**equal * (1 - j) ** (REGISTERS - equal)
        if tail > band_miss(percent) / 10:
            return equal / REGISTERS
        equal += 1


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def parity(hashes: np.ndarray) -> list[int]:
    """512 bits, each the parity of the number of elements that fall on it."""
    bits = np.bincount((hashes >> np.uint64(20)).astype(np.int64) % PARITY_BITS, minlength=PARITY_BITS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64).tolist()


def _class_id(hashes: np.ndarray) -> Decimal:
    """126 bits of the set's digest, as a number that Spark compares and hashes as a whole."""
    digest = hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()
    return Decimal(int.from_bytes(digest, "little") >> 2)


def _sets(df: DataFrame, text: str, words: int, *, sketches: bool, sets: bool) -> DataFrame:
    """Adds k (the class: a digest of the set), n_shingles, and on demand sketch and shingle_set."""
    with_python(df.sparkSession)
    more = [("k", CLASS), ("n_shingles", "long")]
    more += [("sketch", "binary")] if sketches else []
    more += [("shingle_set", "binary"), ("parity", "array<long>")] if sets else []
    schema = extended(df, *more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _WordHash()
        for batch in batches:
            keys, counts, drawn, whole, odd = [], [], [], [], []
            for value in batch.column(batch.schema.get_field_index(text)):
                h = shingles(value.as_py() or "", words, memo)
                keys.append(_class_id(h))
                counts.append(len(h))
                if sketches:
                    drawn.append(sketch(h).tobytes() if len(h) else b"")
                if sets:
                    whole.append(h.tobytes())
                    odd.append(parity(h))
            added = [pa.array(keys, pa.decimal128(38, 0)), pa.array(counts, pa.int64())]
            added += [pa.array(drawn, pa.binary())] if sketches else []
            added += [pa.array(whole, pa.binary()), pa.array(odd, pa.list_(pa.int64()))] if sets else []
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], schema.names)

    return df.mapInArrow(freed_after(run), schema)


def _bands(classes: DataFrame) -> DataFrame:
    """One row (bucket, k) per class and band; a bucket is the hash of a band's registers."""
    width = 2 * ROWS  # bytes
    names = [F.xxhash64(F.substring("sketch", i * width + 1, width), F.lit(i)) for i in range(BANDS)]
    return classes.where("n_shingles > 0").select("k", F.explode(F.array(*names)).alias("bucket"))


def _crowded(bands: DataFrame) -> DataFrame:
    """The rows of buckets with two members at least, with the bucket's first member."""
    hubs = bands.groupBy("bucket").agg(F.min("k").alias("hub"), F.count(F.lit(1)).alias("members")).where("members > 1")
    hubs = kept_table(hubs)
    total = hubs.agg(F.sum("members")).first()[0] or 0
    return kept_table(lookup(bands, hubs, ["bucket"], "members", total).select("bucket", "k", "hub"))


def _with_sets(docs: DataFrame, needed: DataFrame, text: str, doc_id: str, words: int) -> DataFrame:
    """k, sketch and shingle_set of the needed classes (k, best id); texts are read again for them."""
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).withColumn("ik", F.xxhash64(F.col("id")))
    some = possible_member(rows, "ik", needed.withColumn("ik", F.xxhash64(F.col("rep"))), "needed").where("needed")
    found = _sets(some.select("id", "text"), "text", words, sketches=True, sets=True).drop("text")
    right = needed.select(F.col("k").alias("nk"), "rep")
    found = found.join(right, (F.col("k") == F.col("nk")) & F.col("id").eqNullSafe(F.col("rep")), "left_semi")
    return kept_table(found.select("k", "n_shingles", "sketch", "shingle_set", "parity").dropDuplicates(["k"]))


def _dealt(pairs: DataFrame, sets: DataFrame, side: str, total: int) -> DataFrame:
    """The pairs with the sketch and set of one side. A class with many pairs has its set once for each part of them."""
    many = pairs.groupBy(side).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > PAIRS_AT_ONCE)
    many = kept_table(many.withColumn("parts", F.ceil(F.col("n") / PAIRS_AT_ONCE).cast("int")))
    other = "b" if side == "a" else "a"
    parts = F.coalesce("parts", F.lit(1))
    dealt = lookup(pairs, many, [side], "n", total, "left").withColumn("part", F.pmod(F.xxhash64(other), parts).cast("int"))
    held = sets.select(F.col("k").alias(side), F.col("sketch").alias(f"s{side}"), F.col("shingle_set").alias(f"h{side}"))
    held = held.join(many, side, "left").withColumn("part", F.explode_outer(F.sequence(F.lit(0), parts - 1))).drop("n", "parts")
    return dealt.drop("n", "parts").join(held, [side, "part"]).drop("part")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough; ``pairs`` is a written table."""
    total = pairs.count()
    both = _dealt(_dealt(pairs, sets, "a", total), sets, "b", total)
    least = lowest_estimate(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {f.name: batch.column(i) for i, f in enumerate(batch.schema)}
            good = []
            for sa, sb, ha, hb in zip(at["sa"], at["sb"], at["ha"], at["hb"]):
                x, y = (np.frombuffer(h.as_py(), np.uint64) for h in (ha, hb))
                equal = int((np.frombuffer(sa.as_py(), np.uint16) == np.frombuffer(sb.as_py(), np.uint16)).sum())
                good.append(estimate(equal, len(x), len(y)) >= least and linked(x, y, percent))
            mask = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([at["a"].filter(mask), at["b"].filter(mask)], ["a", "b"])

    return both.mapInArrow(freed_after(run), f"a {CLASS}, b {CLASS}")


def components(edges: DataFrame) -> DataFrame:
    """(k, component): the smallest class reachable over the edges (a, b).

    Every round each node tells its neighbours, and its present component's head, the
    smallest component it knows; heads' news reach their members by a second lookup, so the
    number of rounds follows the logarithm of a component's width.
    """
    turned = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    both = kept_table(edges.select("a", "b").unionByName(turned).distinct())
    total = both.count()
    nodes = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("degree"))
    nodes = kept_table(nodes.select(F.col("a").alias("k"), "degree", F.least("a", "m").alias("c")))
    while True:
        told = lookup(both, nodes.select(F.col("k").alias("b"), "degree", "c"), ["b"], "degree", total)
        news = told.groupBy(F.col("a").alias("k")).agg(F.min("c").alias("n"))
        step = kept_table(nodes.join(news, "k").withColumn("n", F.least("n", "c")))
        heads = step.groupBy("c").agg(F.min("n").alias("best"), F.count(F.lit(1)).alias("members"))
        changed = heads.where("best <> c").limit(1).count()
        if not changed:
            return nodes.select("k", F.col("c").alias("component"))
        moved = lookup(step, heads, ["c"], "members", total)
        nodes = kept_table(moved.select("k", "degree", F.col("best").alias("c")))


def _mixed(bands: DataFrame, owner: DataFrame) -> DataFrame:
    """(bucket, k, c, members): the rows of buckets that hold several components c."""
    member = bands.join(owner, "k", "left").select("bucket", "k", F.coalesce("component", "k").alias("c"))
    ends = member.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("members"))
    several = kept_table(ends.where("lo <> hi").select("bucket", "members"))
    total = several.agg(F.sum("members")).first()[0] or 0
    return kept_table(lookup(member, several, ["bucket"], "members", total))


def _second_stars(mixed: DataFrame) -> DataFrame:
    """Members outside a bucket's largest component, each with one member of that, which differs by bucket."""
    counts = mixed.groupBy("bucket", "c").agg(F.count(F.lit(1)).alias("n"), F.min_by("k", F.xxhash64("k", "bucket")).alias("hub"))
    top = counts.groupBy("bucket").agg(
        F.max_by(F.struct(F.col("c").alias("top"), "hub"), F.struct("n", "c")).alias("x"), F.sum("n").alias("size")
    )
    top = kept_table(top.select("bucket", "size", "x.top", "x.hub"))
    total = top.agg(F.sum("size")).first()[0] or 0
    pairs = lookup(mixed, top, ["bucket"], "size", total).where("c <> top")
    return pairs.select(F.col("hub").alias("a"), F.col("k").alias("b")).distinct()


def _open_pairs(mixed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Members of one bucket in different components whose sets may be similar enough by size
    and parity bits, each pair once."""
    known = mixed.select("bucket", "k", "c", "members").join(sets.select("k", "n_shingles", "parity"), "k")
    blocks = F.ceil(F.col("members") / MEMBERS_AT_ONCE).cast("int")
    own, every = F.pmod(F.xxhash64("k"), blocks).cast("int"), F.explode_outer(F.sequence(F.lit(0), blocks - 1))
    named = lambda x, block: known.select(
        F.col("bucket").alias(f"bucket_{x}"), block.alias(f"block_{x}"), *[F.col(n).alias(f"{n}_{x}") for n in ("k", "c", "n_shingles", "parity")])
    differ = F.lit(0)
    for i in range(PARITY_BITS // 64):
        differ = differ + F.bit_count(F.col("parity_a")[i].bitwiseXOR(F.col("parity_b")[i]))
    both = F.col("n_shingles_a") + F.col("n_shingles_b")
    can_link = (F.col("k_a") < F.col("k_b")) & (F.col("c_a") != F.col("c_b")) & ((100 + percent) * differ <= (100 - percent) * both)
    a, b = named("a", every), named("b", own)
    met = a.join(b, (F.col("bucket_a") == F.col("bucket_b")) & (F.col("block_a") == F.col("block_b")) & can_link)
    return met.select(F.col("k_a").alias("a"), F.col("k_b").alias("b")).distinct()


def _grouped(docs: DataFrame, doc_id: str, text: str, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Slim rows (id, k, n_shingles), and one row per class: k, size, component, and the
    component's smallest id and number of rows."""
    slim = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    slim = kept_table(_sets(slim, "text", words, sketches=True, sets=False).drop("text"))
    classes = kept_table(slim.where("n_shingles > 0").groupBy("k", "n_shingles").agg(
        F.count(F.lit(1)).alias("size"), F.min("id").alias("rep"), F.min("sketch").alias("sketch"),
    ))
    bands = _crowded(_bands(classes))
    needed = classes.join(bands.select("k").distinct(), "k", "left_semi").select("k", "rep")
    sets = _with_sets(docs, kept_table(needed), text, doc_id, words)
    stars = bands.where("k <> hub").select(F.col("hub").alias("a"), F.col("k").alias("b")).distinct()
    stars = kept_table(stars)
    edges = kept_table(_verified(stars, sets, percent))
    owner = components(edges)
    for pairs in (_second_stars, lambda mixed: _open_pairs(mixed, sets, percent)):
        more = kept_table(_verified(kept_table(pairs(_mixed(bands, owner))), sets, percent))
        if more.limit(1).count():
            edges = edges.unionByName(more)
            owner = components(edges)
    joined = kept_table(
        classes.select("k", "size", "rep").join(owner, "k", "left").withColumn("component", F.coalesce("component", "k"))
    )
    heads = joined.groupBy("component").agg(
        F.min("rep").alias("component_id"), F.sum("size").alias("component_size"), F.count(F.lit(1)).alias("members")
    )
    out = lookup(joined, heads, ["component"], "members", joined.count())
    return slim, kept_table(out.select("k", "size", "component", "component_id", "component_size"))


def decisions(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Words are runs without ASCII white space, A-Z lower-cased; a text with fewer words than a
    shingle is one shingle; a text without words (or null) has none and is alone: its
    component is itself. Rows with equal sets are linked. component_id is the smallest id
    reachable, null if all are null; rows of a component that repeat that id are all marked
    kept (``dedup`` keeps one of them).
    """
    with batches_of(docs.sparkSession, SETS_AT_ONCE):
        rows, classes = _grouped(docs, doc_id, text, words, percent)
    total = classes.agg(F.sum("size")).first()[0] or 0
    met = lookup(rows.where("n_shingles > 0"), classes, ["k"], "size", total)
    alone = rows.where("n_shingles = 0").withColumn("component_id", F.col("id"))
    out = met.select("id", "n_shingles", "component_id").unionByName(alone.select("id", "n_shingles", "component_id"))
    return out.select(
        F.col("id").alias("doc_id"), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def dedup(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT
) -> DataFrame:
    """One row of each component, that with the smallest id, with the caller's columns."""
    plain, at = numbered(docs)
    ident, content = at[doc_id], at[text]
    with batches_of(docs.sparkSession, SETS_AT_ONCE):
        _, classes = _grouped(plain, ident, content, words, percent)
    several = classes.where("component_size > 1")
    rows = _sets(plain, content, words, sketches=False, sets=False)
    rows = possible_member(rows, "k", several, "several")
    alone = rows.where("NOT several OR n_shingles = 0").select(*plain.columns)
    met = rows.where("several AND n_shingles > 0").join(
        classes.select("k", "component", F.col("component_id").alias("best_id")).withColumnRenamed("k", "ck"),
        (F.col("k") == F.col("ck")) & F.col(ident).eqNullSafe(F.col("best_id")),
    )
    one = met.dropDuplicates(["component"]).select(*plain.columns)
    return alone.unionByName(one).toDF(*docs.columns)
