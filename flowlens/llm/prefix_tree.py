"""The tree of conversation prefixes, and totals of every subtree by parallel tree contraction.

Conversations are numbered turn by turn in sorted ranges, so one of any length is spread over many
tasks. A prefix is known by sums of its turns' hashes, each mixed with its turn's place: such sums
add up over blocks of turns, and taking the last turn's away gives the parent's.

Totals of subtrees don't walk the tree level by level. Every round rakes (leaves give their totals to
their parents and go) and compresses (of nodes with one child, a set without neighbours is cut out of
its chains: the parent takes over the node's own values and its child). Both shrink the tree by a
share, so the rounds grow with the logarithm of its size, also where it is one long chain. A leaf's
total is known when it goes. A node cut out remembers its values and its child, and gets its total
when the rounds are re-expanded, last first: its own values and the child's total.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from flowlens.llm.common import extended, kept_table, lookup, text_or_empty

PRIME = (1 << 61) - 1
BLOCK = 4096  # turns that are summed in one window
HEADS, SHARED = 6, 100  # a conversation begins with up to HEADS - 1 turns of its hundred's first
PIECE = 512  # ids of one piece of a digest


# --- turns in order ---


def _ranged(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    order = [F.col(k).asc_nulls_first() for k in keys]
    return df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())


def numbered_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, place, digest, chars): turns of every conversation numbered from 1.

    Turns are sorted by turn (null first), then role, then the text's digest; rows equal in all
    three follow one another. Rows without a conversation are left out.
    """
    role, text = text_or_empty("role"), text_or_empty("text")
    slim = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"),
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"),
        F.length(text).cast("long").alias("chars"),
    )
    ranged = _ranged(slim, ["conv_id", "turn", "role", "digest"]).select("part", "conv_id", "digest", "chars")
    schema = extended(ranged, ("place", "long"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(1).to_numpy()
            starts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
            sizes = np.diff(np.append(starts, len(ids)))
            place = np.arange(1, len(ids) + 1) - np.repeat(starts, sizes)
            if ids[0] == last:
                place[: sizes[0]] += seen
            last, seen = ids[-1], int(place[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place, pa.int64())], schema.names)

    rows = kept_table(ranged.mapInArrow(number, schema))
    # a conversation goes on in a later range only at that range's start: a row or two per range
    edges = rows.groupBy("part").agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", "place")).alias("last"))
    ends = edges.select("part", F.col("last.conv_id").alias("conv_id"), F.col("last.place").alias("n"))
    begins = edges.where("first <> last.conv_id").select("part", F.col("first").alias("conv_id"), F.lit(0).cast("long").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    carried = ends.unionByName(begins).select("part", "conv_id", before.alias("before")).where("before > 0")
    return rows.join(F.broadcast(carried), ["part", "conv_id"], "left").select(
        "conv_id", (F.col("place") + F.coalesce("before", F.lit(0))).alias("place"), "digest", "chars")


def rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, depth, n, digest, chars) of the rebuilt conversations and (conv_id, n) of all.

    Conversation c begins with the first h turns of conversation c - c % 100 (as many as there are),
    and goes on with its own behind its first h; h is the CRC-32 of c's digits, modulo six.
    """
    base = F.col("conv_id") - F.col("conv_id") % SHARED
    own = rows.groupBy("conv_id").agg(F.max("place").alias("had"))
    own = own.select("conv_id", "had", base.alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).alias("h"))
    first = rows.where((F.col("conv_id") == base) & (F.col("place") < HEADS))
    heads = first.groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("place", "digest", "chars"))).alias("head"))
    convs = own.join(heads, "base", "left").withColumn("head", F.filter("head", lambda t: t["place"] <= F.col("h")))
    taken = F.when(F.col("head").isNull(), 0).otherwise(F.size("head")).cast("long")
    convs = convs.withColumn("taken", taken).withColumn("n", F.col("taken") + F.greatest(F.col("had") - F.col("h"), F.lit(0)))
    convs = kept_table(convs)
    given = convs.select("conv_id", "n", F.inline("head")).withColumnRenamed("place", "depth")
    total = convs.agg(F.sum("had")).first()[0] or 0
    tails = lookup(rows, convs.select("conv_id", "had", "h", "taken", "n"), ["conv_id"], "had", total).where("place > h")
    tails = tails.select("conv_id", "n", (F.col("place") - F.col("h") + F.col("taken")).alias("depth"), "digest", "chars")
    return given.unionByName(tails), convs.select("conv_id", "n")


# --- prefixes and their tree ---


def _modulo(c: Column) -> Column:
    return (c % F.lit(PRIME)).cast("long")


def prefixes(turns: DataFrame) -> DataFrame:
    """Adds a, b (the prefix that ends with the turn) and pa, pb (the one before it)."""
    terms = turns.withColumn("block", F.floor((F.col("depth") - 1) / BLOCK)).withColumns(
        {t: F.pmod(F.xxhash64(F.lit(t), "depth", "digest"), F.lit(PRIME)) for t in ("ta", "tb")})
    summed = lambda c: _modulo(F.sum(F.col(c).cast("decimal(20,0)")).over(
        Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)))
    inside = terms.withColumns({"a": summed("ta"), "b": summed("tb")})
    # long conversations only: what the blocks before add up to
    blocks = terms.where(F.col("n") > BLOCK).groupBy("conv_id", "block").agg(
        *[F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ("ta", "tb")])
    past = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select("conv_id", "block", *[_modulo(F.sum(c).over(past)).alias(f"c{c[1]}") for c in ("ta", "tb")])
    met = inside.join(carried.where("ca IS NOT NULL"), ["conv_id", "block"], "left")
    for c in ("a", "b"):
        met = met.withColumn(c, (F.col(c) + F.coalesce(f"c{c}", F.lit(0))) % PRIME)
        met = met.withColumn(f"p{c}", F.pmod(F.col(c) - F.col(f"t{c}"), F.lit(PRIME)))
    return met.select("conv_id", "depth", "n", "chars", "a", "b", "pa", "pb")


KEY = ["depth", "a", "b"]


def nodes(steps: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per different prefix: node and parent (structs of smallest member and depth; the root
    has no parent), the key, n_convs, n_children, chars. No conversation, no node."""
    found = steps.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("chars").alias("chars"),
        F.min("pa").alias("pa"), F.min("pb").alias("pb"))
    zero = [F.lit(0).cast("long").alias(k) for k in KEY]
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    none = F.lit(None).cast("long")
    root = root.select(*zero, "conv_id", "n_convs", F.lit(0).cast("long").alias("chars"), none.alias("pa"), none.alias("pb"))
    every = kept_table(found.unionByName(root))
    kids = every.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b"))
    known = every.join(kids.agg(F.count(F.lit(1)).alias("n_children")), KEY, "left").withColumn(
        "n_children", F.coalesce("n_children", F.lit(0)))
    known = kept_table(known.withColumn("node", F.struct("conv_id", "depth")))
    parents = known.where("n_children > 0").select(
        F.col("depth").alias("pdepth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("node").alias("parent"),
        F.col("n_children").alias("size"))
    below = known.where("depth > 0").withColumn("pdepth", F.col("depth") - 1)
    linked = lookup(below, parents, ["pdepth", "pa", "pb"], "size", known.count()).drop("pdepth", "size")
    top = known.where("depth = 0").withColumn("parent", F.lit(None).cast("struct<conv_id: bigint, depth: bigint>"))
    return linked.unionByName(top).select("node", "parent", *KEY, "n_convs", "n_children", "chars")


# --- digests of ids in order ---


def id_digests(rows: DataFrame, keys: Sequence[str], ident: str) -> DataFrame:
    """(keys, ends_sha256): SHA-256 of each group's ids, ascending, comma-joined.

    Sorted ranges write a group's ids as pieces of text; then a task streams the pieces of its groups in order
    and holds one piece and a hash at a time, however many ids a group has.
    """
    ranged = _ranged(rows.select(*keys, ident), [*keys, ident])
    width = len(keys)
    schema = extended(rows.select(*keys), ("part", "int"), ("piece", "long"), ("ids", "string"))
    done = extended(rows.select(*keys), ("ends_sha256", "string"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(i).to_numpy() for i in range(width)]
            fresh = np.append(True, reduce(np.logical_or, [c[1:] != c[:-1] for c in columns]))
            starts = np.flatnonzero(fresh)
            sizes = np.diff(np.append(starts, batch.num_rows))
            starts = np.concatenate([np.arange(s, s + n, PIECE) for s, n in zip(starts, sizes)])
            ends, ids = np.append(starts[1:], batch.num_rows), list(map(str, batch.column(width).to_pylist()))
            texts = [",".join(ids[s:e]) for s, e in zip(starts, ends)]
            yield pa.RecordBatch.from_arrays([
                *(batch.column(i).take(pa.array(starts)) for i in range(width)),
                batch.column(width + 1).take(pa.array(starts)), pa.array(np.arange(piece, piece + len(starts))), pa.array(texts),
            ], schema.names)
            piece += len(starts)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        for batch in batches:
            out = []
            for key, ids in zip(zip(*(batch.column(i).to_pylist() for i in range(width))), batch.column(width + 2).to_pylist()):
                if key == now:
                    sha.update(b",")
                else:
                    if sha:
                        out.append((*now, sha.hexdigest()))
                    now, sha = key, hashlib.sha256()
                sha.update(ids.encode())
            yield _batch(out, done)
        yield _batch([(*now, sha.hexdigest())] if sha else [], done)

    pieces = ranged.mapInArrow(cut, schema)
    ordered = pieces.repartition(*keys).sortWithinPartitions(*keys, "part", "piece")
    return ordered.mapInArrow(digest, done)


def _batch(rows: list[tuple], schema: StructType) -> pa.RecordBatch:
    kinds = [pa.string() if f.dataType.typeName() == "string" else pa.int64() for f in schema]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], schema.names)


# --- contraction ---


def _chosen(node: Column, parent: Column, child: Column, turn: int) -> Column:
    """Whether a node's draw is above its parent's and its child's: never true of two neighbours."""
    draw = lambda c: F.xxhash64(F.lit(turn), c)
    return (draw(node) > draw(parent)) & (draw(node) > draw(child))


def subtree_totals(tree: DataFrame, values: Sequence[str], *, log: list[tuple[int, int]] | None = None) -> DataFrame:
    """(node, values): the values (longs) summed over every node's subtree.

    ``tree`` has node, parent (null for a root; several roots are several trees), n_children and the
    values; nodes are unique and of any type that can be compared. Links must not form rings. ``log``
    is given (nodes, nodes cut out) of every round. An empty tree gives no rows.
    """
    names = list(values)
    live = kept_table(tree.select("node", "parent", "n_children", *[F.col(v).cast("long").alias(v) for v in names]))
    raked, cut = [], []
    left = live.count()
    while left:
        leaf = F.col("n_children") == 0
        raked.append(live.where(leaf).select("node", *names))
        up = live.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("node")).agg(
            *[F.sum(F.when(leaf, F.col(v)).otherwise(0)).alias(f"more_{v}") for v in names],
            F.count_if(leaf).alias("gone"), F.min(F.when(~leaf, F.col("node"))).alias("child"))
        inner = live.where(~leaf).join(up, "node").select(
            "node", "parent", (F.col("n_children") - F.col("gone")).alias("n_children"), "child",
            *[(F.col(v) + F.col(f"more_{v}")).alias(v) for v in names])
        unary = (F.col("n_children") == 1) & F.col("parent").isNotNull()
        pick = unary & _chosen(F.col("node"), F.col("parent"), F.col("child"), len(cut))
        inner = kept_table(inner.withColumn("pick", pick))
        out = inner.where("pick")
        cut.append(out.select("node", "child", *names))
        told = out.select(  # the child hears of its new parent, the parent gets the values
            F.inline(F.array(
                F.struct(F.col("child").alias("node"), F.col("parent").alias("over"), *[F.lit(0).cast("long").alias(f"more_{v}") for v in names]),
                F.struct(F.col("parent").alias("node"), F.lit(None).alias("over"), *[F.col(v).alias(f"more_{v}") for v in names]),
            )))
        news = told.groupBy("node").agg(F.max("over").alias("over"), *[F.sum(f"more_{v}").alias(f"more_{v}") for v in names])
        live = kept_table(inner.where("NOT pick").join(news, "node", "left").select(
            "node", F.coalesce("over", "parent").alias("parent"), "n_children",
            *[(F.col(v) + F.coalesce(f"more_{v}", F.lit(0))).alias(v) for v in names]))
        before, left = left, live.count()
        if log is not None:
            log.append((before, before - left))
        if left == before:
            raise ValueError("the links form a ring")
    # what a node cut out in a round waits for is the total of a node that stayed in that round; the
    # known totals are one table after each step back, so plans stay small and the tables grow by a share
    known = None
    for rake, out in zip(reversed(raked), reversed(cut)):
        if known is not None:
            below = known.select(F.col("node").alias("child"), *[F.col(v).alias(f"more_{v}") for v in names])
            solved = out.join(below, "child").select("node", *[(F.col(v) + F.col(f"more_{v}")).alias(v) for v in names])
            rake = kept_table(known.unionByName(rake).unionByName(solved))
        known = rake
    return live.select("node", *names) if known is None else known


def report(turns: DataFrame) -> DataFrame:
    """The prefix tree of the rebuilt conversations of rows (conv_id, turn, role, text), a row per node.

    conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves
    (childless nodes of the subtree), saved_tokens (code points that members share, summed over the
    subtree), ends_sha256 (of the ids of conversations that end there). Null roles and texts are empty, null
    turns come first, rows without a conversation are left out; repeated rows are turns of their own. An
    empty table has no tree and gives no rows. Other columns don't matter.
    """
    steps, convs = rebuilt(numbered_turns(turns))
    steps = kept_table(prefixes(steps))
    tree = nodes(steps, convs).withColumns({
        "n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("chars")})
    tree = kept_table(tree)
    totals = subtree_totals(tree, ["n_leaves", "saved_tokens"])
    ended = steps.where("depth = n").select(*KEY, "conv_id")
    turnless = convs.where("n = 0").select(*[F.lit(0).cast("long").alias(k) for k in KEY], "conv_id")
    digests = id_digests(ended.unionByName(turnless), KEY, "conv_id")
    rows = tree.drop("n_leaves", "saved_tokens").join(totals, "node").join(digests, KEY, "left")
    return rows.select(
        F.col("node.conv_id").alias("conv_id"), "depth", F.col("parent.conv_id").alias("parent_conv_id"), "n_convs", "n_children",
        "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
