"""Places of regex matches as DataFrame expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MATCH = "array<struct<start: int, end: int, text: string, group: string, before: string, after: string>>"
SPAN = "array<struct<start: int, order: int, kind: string, end: int, score: double>>"
NEAR = 40  # characters kept of what stands before and behind a match, up to its neighbours
BLOCK = 64


def let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, zero: Column, kind: str, add) -> Column:
    """For each element of an array, what ``add`` makes of ``zero`` and the elements in front of it.

    Arrays can't be changed in place, and one that grows by an element costs a copy each time. So this is done in
    blocks: inside each, and over the blocks' totals; a million elements cost some dozens of copies each.
    ``add`` must be associative; ``kind`` is the type of its results.
    """
    def plain(a: Column) -> Column:
        start = F.struct(zero.cast(kind).alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
        step = lambda s, x: F.struct(
            add(s["at"], x).cast(kind).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
        return F.aggregate(a, start, step)["out"]

    def by_blocks(a: Column) -> Column:
        last = F.floor(F.greatest(F.size(a) - 1, F.lit(0)) / BLOCK).cast("int")
        return let(F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(a, i * BLOCK + 1, F.lit(BLOCK))), joined)

    def joined(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, zero.cast(kind), lambda s, x: add(s, x).cast(kind)))
        return let(plain(totals), lambda offset: F.flatten(F.transform(
            blocks, lambda b, i: F.transform(plain(b), lambda v: add(F.get(offset, i), v).cast(kind)))))

    return let(values, by_blocks)


def matches(text: Column, pattern: str, group: int = 0, near: int = NEAR) -> Column:
    """Start, end, text, one group and what is near (before, after), of all leftmost matches, in code points.

    A text is the pieces between its matches and the matches in turn, so running sums of their
    lengths are the places. A text without a match only costs the search.
    """
    found = lambda g: F.regexp_extract_all(text, F.lit(pattern), F.lit(g))

    def placed(gaps: Column) -> Column:
        zipped = F.arrays_zip(gaps, found(0), found(group), F.slice(gaps, F.lit(2), F.size(gaps))).cast(
            "array<struct<b: string, m: string, g: string, a: string>>")
        return let(F.filter(zipped, lambda x: x["m"].isNotNull()), numbered)

    def numbered(pairs: Column) -> Column:
        sizes = F.transform(pairs, lambda x: F.length(x["b"]) + F.length(x["m"]))
        at = running(sizes, F.lit(0), "int", lambda a, b: a + b)

        def one(x: Column, before: Column) -> Column:
            start = before + F.length(x["b"])
            return F.struct(
                start.alias("start"), (start + F.length(x["m"])).alias("end"), x["m"].alias("text"), x["g"].alias("group"),
                F.right(x["b"], F.lit(near)).alias("before"), F.left(x["a"], F.lit(near)).alias("after"),
            )

        return F.zip_with(pairs, at, one).cast(MATCH)

    places = let(F.split(text, pattern, -1), placed)
    return F.when(F.regexp_like(text, F.lit(pattern)), places).otherwise(F.array().cast(MATCH))


def as_spans(found: Column, order: int, kind: Column | str, score) -> Column:
    """Matches as spans of a kind; ``score`` maps a match to its score."""
    name = kind if callable(kind) else (lambda _: F.lit(kind))
    return F.transform(found, lambda s: F.struct(
        s["start"].alias("start"), F.lit(order).alias("order"), name(s).alias("kind"), s["end"].alias("end"),
        score(s).cast("double").alias("score"),
    )).cast(SPAN)


def together(*spans: Column) -> Column:
    """All spans, by start and then by kind."""
    return F.array_sort(F.concat(*spans))


def written(spans: Column) -> Column:
    """kind:start:end of the spans, joined by commas."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def mentions(beside: Column, words: list[str]) -> Column:
    return F.regexp_like(beside, F.lit(r"(?i)(?<![a-z])(?:" + "|".join(words) + ")"))
