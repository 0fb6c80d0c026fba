"""Exact linear quantiles whose memory need does not grow with the table.

Spark's ``percentile`` keeps one map entry per distinct value and merges them in one task.
Here a small mergeable sketch names two values around the wanted ranks (first scan), and a second scan
counts the rows below and on them and writes the values strictly between them, a small share of the table. A
frequent value is usually named by both ends, which settles the quantile at once; otherwise
the search goes on in the written values alone, until few are left, and those are ranked. The
sketch only proposes: the counts decide, so the result is exact; where it missed, which the counts
tell, that quantile is scanned for again with wider ends. Sketches meet in two levels, never all in
one task. Every column and group shares each scan, and only scalars reach the driver.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowlens.session import require_checkpoint_dir
from flowlens.sources.state import discard

SKETCH_SIZE = 2000
RANKED_ROWS = 1_000_000
MERGE_TASKS = 512


@dataclass
class _Search:
    """The one or two order statistics around one quantile, and the bracket they are in."""

    column: str
    group: object
    slot: int  # position of the quantile in the request
    ranks: tuple[int, int]  # 0-based, equal or adjacent
    inside: int
    margin: float
    below: int = 0
    low: float | None = None
    high: float | None = None
    values: list = field(default_factory=lambda: [None, None])

    def mine(self) -> Column:
        c = F.col(self.column)
        test = c.isNotNull() if self.group is None else c.isNotNull() & (F.col("g") == F.lit(self.group))
        if self.low is not None:
            test = test & (c >= F.lit(self.low)) & (c <= F.lit(self.high))
        return test

    def bracketed(self) -> Column:
        return F.when(self.mine(), F.col(self.column))

    def bracket(self) -> tuple:
        return self.column, self.group, self.low, self.high

    def ends(self) -> list[float]:
        lo, hi = ((r - self.below + 0.5) / self.inside for r in self.ranks)
        return [max(0.0, lo - self.margin), min(1.0, hi + self.margin)]

    def open(self) -> bool:
        return None in self.values

    def between(self, at: float) -> float:
        lo, hi = self.values
        return lo if lo == hi else lo + (hi - lo) * (at - self.ranks[0])


def exact_quantiles(
    df: DataFrame,
    exprs: Mapping[str, Column],
    probs: Sequence[float],
    by: Column | None = None,
    groups: Sequence | None = None,
    sketch_size: int = SKETCH_SIZE,
    ranked_rows: int = RANKED_ROWS,
) -> dict:
    """Quantiles of several numeric expressions, all of them sharing each scan.

    Nulls and NaN are ignored; an expression without values gives nulls. With ``by``, the result is
    keyed by (group, name) for the given, bounded list of groups, else by name.
    """
    keys = list(exprs)
    if not keys:
        return {}
    values = []
    for i, k in enumerate(keys):
        v = exprs[k].cast("double")
        values.append(F.when(~F.isnan(v), v).alias(f"v{i}"))
    if by is None:
        frame = df.select(*values)
    else:
        frame = df.where(by.isin(list(groups))).select(by.alias("g"), *values)
    found = _search(frame, probs, sketch_size, ranked_rows)
    empty = [None] * len(probs)
    if by is None:
        return {k: found.get((None, f"v{i}"), empty) for i, k in enumerate(keys)}
    return {(g, k): found.get((g, f"v{i}"), empty) for g in groups for i, k in enumerate(keys)}


def _sketched(frame: DataFrame, key: list[str], exprs: dict[str, Column], ends: dict, size: int):
    """Per group: row count ``n_`` and proposed values ``b_`` at the given ranks of each expression."""
    parts = (
        frame.select(*key, (F.spark_partition_id() % MERGE_TASKS).alias("salt"),
                     *[e.alias(c) for c, e in exprs.items()])
        .groupBy(*key, "salt")
        .agg(
            *[F.count(c).alias(f"n_{c}") for c in exprs],
            *[F.kll_sketch_agg_double(c, F.lit(size)).alias(f"s_{c}") for c in exprs],
        )
    )
    whole = parts.groupBy(*key).agg(
        *[F.sum(f"n_{c}").alias(f"n_{c}") for c in exprs],
        *[F.kll_merge_agg_double(f"s_{c}", F.lit(size)).alias(f"s_{c}") for c in exprs],
    )
    at = lambda c: F.kll_sketch_get_quantile_double(
        f"s_{c}", F.array(*[F.lit(float(e)) for e in ends[c]])
    )
    return whole.select(
        *key,
        *[f"n_{c}" for c in exprs],
        *[F.when(F.col(f"n_{c}") > 0, at(c)).alias(f"b_{c}") for c in exprs],
    ).collect()  # one row per group


def _search(frame: DataFrame, probs: Sequence[float], size: int, ranked_rows: int) -> dict:
    """Quantiles per (group, column); pairs without values are absent."""
    key = [c for c in frame.columns if c == "g"]
    cols = [c for c in frame.columns if c != "g"]
    margin = 2.3 / size**0.9  # about the sketch's rank error; a miss is counted and widened
    ends = [e for p in probs for e in (max(0.0, p - margin), min(1.0, p + margin))]
    first = _sketched(frame, key, {c: F.col(c) for c in cols}, {c: ends for c in cols}, size)
    searches, proposals = {}, []
    for row in first:
        g = row["g"] if key else None
        for c in cols:
            n = row[f"n_{c}"]
            for i, p in enumerate(probs if n else ()):
                at = p * (n - 1)
                s = _Search(c, g, i, (math.floor(at), math.ceil(at)), n, margin)
                searches.setdefault((g, c), []).append((s, at))
                proposals.append((s, *row[f"b_{c}"][2 * i : 2 * i + 2]))
    while proposals:
        missed = _scan(frame, proposals, size, ranked_rows)
        proposals = _propose(frame, missed, size) if missed else []
    return {pair: [s.between(at) for s, at in members] for pair, members in searches.items()}


def _slots(proposals: list[tuple]) -> dict[tuple, list[tuple]]:
    slots: dict[tuple, list[tuple]] = {}
    for s, lo, hi in proposals:
        slots.setdefault((s.column, s.slot), []).append((s, lo, hi))
    return slots


def _scan(frame: DataFrame, proposals: list[tuple], size: int, ranked_rows: int) -> list[_Search]:
    """One scan that counts around the proposed ends and writes what lies between; finishes the search
    in what was written. Returns the searches that the sketch missed."""
    slots, spark = _slots(proposals), frame.sparkSession
    grouped = proposals[0][0].group is not None
    ends = [{m.group: (lo, hi) for m, lo, hi in members} for members in slots.values()]
    joined, bounds = _with_ends(frame, ends, grouped)
    by, asked, near = (["g"] if grouped else []), [], []
    for i, ((column, _), (low, high)) in enumerate(zip(slots, bounds)):
        c = F.col(column)
        near.append((c > low) & (c < high))
        asked += [
            F.count_if(c < low).alias(f"u{i}"), F.count_if(c == low).alias(f"l{i}"),
            F.count_if((c == high) & (high > low)).alias(f"h{i}"),
        ]
    # rows without a value between any ends are one group, which combines before the shuffle
    held = F.array(*[F.when(near[i], F.col(column)) for i, (column, _) in enumerate(slots)])
    kept = joined.groupBy(*by, F.when(reduce(or_, near), held).alias("held")).agg(F.count(F.lit(1)).alias("n"), *asked)
    path = f"{require_checkpoint_dir(spark)}/between-{uuid.uuid4().hex}"
    kept.write.parquet(path)
    try:
        table, names = spark.read.schema(kept.schema).parquet(path), [f"{x}{i}" for i in range(len(slots)) for x in "ulh"]
        sums = table.groupBy(*by).agg(*[F.sum(n).alias(n) for n in names]).collect()
        counts = {r["g"] if grouped else None: r for r in sums}
        key = F.concat(F.col("slot").cast("string"), F.lit("|"), F.col("g").cast("string") if grouped else F.lit(""))
        values = table.where("held IS NOT NULL").select(*by, "n", F.posexplode("held").alias("slot", "v0")).where("v0 IS NOT NULL")
        between = values.select(key.alias("g"), "v0", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).select("g", "v0")
        rows = between.groupBy("g").agg(F.count("v0").alias("n"), F.min("v0").alias("a"), F.max("v0").alias("z")).collect()
        found, missed, rest = {r["g"]: (r["n"], r["a"], r["z"]) for r in rows}, [], []
        for i, members in enumerate(slots.values()):
            for s, lo, hi in members:
                name, r = f"{i}|{'' if s.group is None else _text(s.group)}", counts[s.group]
                mid, least, most = found.get(name, (0, None, None))
                if not _step(s, lo, hi, r[f"u{i}"], r[f"l{i}"], mid, r[f"h{i}"], least, most):
                    missed.append(s)
                elif s.open():
                    rest.append((s, name))
        if rest:
            _finish(between, rest, size, ranked_rows)
        return missed
    finally:
        discard(spark, path)


def _text(group: object) -> str:
    """A group's value as Spark casts it to a string."""
    return str(group).lower() if isinstance(group, bool) else str(group)


def _finish(between: DataFrame, rest: list[tuple[_Search, str]], size: int, ranked_rows: int) -> None:
    """The order statistics that lie among the written values (g, v0)."""
    inner = []
    for s, name in rest:
        lacking = [j for j in (0, 1) if s.values[j] is None]
        ranks = tuple(s.ranks[j] - s.below for j in (lacking[0], lacking[-1]))
        inner.append((s, lacking, _Search("v0", name, 0, ranks, s.inside, s.margin, 0, s.low, s.high)))
    todo = [t for *_, t in inner]
    while todo:
        few = [t for t in todo if t.inside <= ranked_rows]
        if few:
            _rank(between, few)
            todo = [t for t in todo if t.open()]
        if todo:
            _count(between, _propose(between, todo, size))
            todo = [t for t in todo if t.open()]
    for s, lacking, t in inner:
        for j in lacking:
            s.values[j] = t.values[0 if j == lacking[0] else 1]


def _propose(frame: DataFrame, searches: list[_Search], size: int) -> list[tuple]:
    """A smaller bracket for each search; searches in the same bracket share one sketch."""
    shared: dict[tuple, list[_Search]] = {}
    for s in searches:
        shared.setdefault(s.bracket(), []).append(s)
    named = {f"q{i}": members for i, members in enumerate(shared.values())}
    exprs = {q: members[0].bracketed() for q, members in named.items()}
    ends = {q: [e for s in members for e in s.ends()] for q, members in named.items()}
    row = _sketched(frame, [], exprs, ends, size)[0]
    return [
        (s, row[f"b_{q}"][2 * j], row[f"b_{q}"][2 * j + 1])
        for q, members in named.items()
        for j, s in enumerate(members)
    ]


def _count(frame: DataFrame, proposals: list[tuple]) -> None:
    """Count rows around the proposed ends; settle ranks on them or step between them.

    Groups share one aggregate per column and quantile, with their own ends by group value.
    """
    slots = _slots(proposals)
    grouped = proposals[0][0].group is not None
    ends = [{m.group: (lo, hi) for m, lo, hi in members} for members in slots.values()]
    frame, bounds = _with_ends(frame, ends, grouped)
    ask = []
    for i, ((column, _), (low, high)) in enumerate(zip(slots, bounds)):
        c = F.col(column)
        ask += [F.count_if(c < low).alias(f"u{i}"), F.count_if(c == low).alias(f"l{i}")]
        if any(lo < hi for lo, hi in ends[i].values()):
            between = F.when((c > low) & (c < high), c)
            ask += [
                F.count(between).alias(f"m{i}"),
                F.count_if((c == high) & (high > low)).alias(f"h{i}"),
                F.min(between).alias(f"a{i}"),
                F.max(between).alias(f"z{i}"),
            ]
    rows = frame.groupBy(*(["g"] if grouped else [])).agg(*ask).collect()  # one per group
    seen = {r["g"] if grouped else None: r.asDict() for r in rows}
    for i, members in enumerate(slots.values()):
        for s, lo, hi in members:
            r = seen[s.group]
            _step(s, lo, hi, *(r.get(f"{n}{i}") for n in ("u", "l", "m", "h", "a", "z")))


def _with_ends(frame: DataFrame, ends: list[dict], grouped: bool):
    """Frame and the (low, high) columns of every slot.

    Without groups the ends are constants; with groups they come from a broadcast table of
    one row per group.
    """
    if not grouped:
        return frame, [tuple(F.lit(x) for x in e[None]) for e in ends]
    groups = sorted({g for e in ends for g in e})
    rows = [(g, *[x for e in ends for x in e.get(g, (None, None))]) for g in groups]
    names = [f"{side}{i} double" for i in range(len(ends)) for side in ("lo", "hi")]
    kind = frame.schema["g"].dataType.simpleString()
    table = frame.sparkSession.createDataFrame(rows, ", ".join([f"g {kind}", *names]))
    joined = frame.join(F.broadcast(table), "g")
    return joined, [(F.col(f"lo{i}"), F.col(f"hi{i}")) for i in range(len(ends))]


def _step(s: _Search, lo, hi, under, on_lo, mid, on_hi, least, most) -> bool:
    """Settles what the counts tell, else steps between the ends; false if the ranks lie beyond them."""
    first_mid = under + on_lo
    first_hi = first_mid + (mid or 0)
    end = first_hi + (on_hi or 0)
    if s.ranks[0] < under or s.ranks[1] >= end:  # the sketch missed: ask wider next time
        s.margin = min(1.0, s.margin * 10)
        return False
    for j, r in enumerate(s.ranks):
        if r < first_mid:
            s.values[j] = lo
        elif r >= first_hi:
            s.values[j] = hi
        elif r == first_mid:
            s.values[j] = least
        elif r == first_hi - 1:
            s.values[j] = most
    if s.open():
        s.low, s.high, s.below, s.inside = least, most, first_mid, mid
    return True


def _rank(frame: DataFrame, searches: list[_Search]) -> None:
    """Read the order statistics off running totals of the value counts in small brackets."""
    slots: dict[tuple, list[_Search]] = {}
    for s in searches:
        slots.setdefault((s.column, s.slot), []).append(s)
    grouped = searches[0].group is not None
    ends = [{m.group: (m.low, m.high) for m in members} for members in slots.values()]
    frame, bounds = _with_ends(frame, ends, grouped)
    near = [F.col(c).between(low, high) for (c, _), (low, high) in zip(slots, bounds)]
    tagged = F.array(
        *[
            F.struct(F.lit(i).alias("id"), F.when(near[i], F.col(column)).alias("v"))
            for i, (column, _) in enumerate(slots)
        ]
    )
    key = ["id", "g"] if grouped else ["id"]
    counts = (
        frame.where(reduce(or_, near))
        .select(*key[1:], F.explode(tagged).alias("t"))
        .select(*key[1:], "t.id", "t.v")
        .where(F.col("v").isNotNull())
        .groupBy(*key, "v")
        .count()
    )
    upto = F.sum("count").over(Window.partitionBy(*key).orderBy("v"))
    members = {(i, s.group): s for i, found in enumerate(slots.values()) for s in found}
    kind = frame.schema["g"].dataType.simpleString() if grouped else "string"
    ranks = frame.sparkSession.createDataFrame(
        [(i, g, s.ranks[0] - s.below, s.ranks[1] - s.below) for (i, g), s in members.items()],
        f"id int, g {kind}, first long, last long",
    )
    hit = (F.col("upto") > F.col("first")) & (F.col("upto") - F.col("count") <= F.col("last"))
    totals = counts.withColumn("upto", upto).join(F.broadcast(ranks.select(*key, "first", "last")), key)
    for row in totals.where(hit).collect():  # at most two per search
        s = members[row["id"], row["g"] if grouped else None]
        for j, rank in enumerate((row["first"], row["last"])):
            if row["upto"] - row["count"] <= rank < row["upto"]:
                s.values[j] = row["v"]
