"""Mixing sources to target weights by repeating and drawing whole documents.

Words are summed per source, the budget is shared by weight, and a source's repetition rate is
its target over its size. Every document appears floor(rate) times, and once more with a
probability equal to the fraction, drawn from a hash of the seed and the row: the same row
decides alike in every run and on every executor.

Source sums are the only shuffle (combined before it). Shares above the cap are settled by a
few aggregates over one row per source; the driver sees three numbers of each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from flowlens.llm.common import WORD, free_name, kept_table, lookup, numbered, text_or_empty, without_names

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
MAX_REPEATS = 2
SEED = 17
DIGITS = 13  # hex digits of the draw: 52 bits, exact in a double


def source_targets(
    docs: DataFrame, *, source: str = "source", text: str = "text", weights: Sequence[float] = WEIGHTS,
    budget: float = BUDGET, max_repeats: int = MAX_REPEATS,
) -> DataFrame:
    """One row per source: source, n_docs, source_size, weight, target, rate.

    Sources in code point order, null last, take the weights in turn and share ``budget`` times
    all words; a share above ``max_repeats`` times the source's words is cut to that and the
    rest is shared anew, until none is above. A source without words has target and rate 0.
    """
    sizes = docs.groupBy(F.col(source).alias("source")).agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.sum(F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")).alias("source_size"),
    )
    ranked = kept_table(_ranked(sizes, weights).withColumn("cap", max_repeats * F.col("source_size")))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    share = None  # words per unit of weight, for the sources below their cap
    while True:
        full = F.lit(False) if share is None else F.col("weight") * share >= F.col("cap")
        capped, weight = ranked.agg(
            F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)),
        ).first()
        following = (budget * total - capped) / weight if weight else None
        if following == share or following is None:
            break
        share = following
    target = F.col("cap").cast("double")
    if share is not None:
        target = F.when(F.col("weight") * share >= F.col("cap"), target).otherwise(F.col("weight") * share)
    return ranked.select(
        "source", "n_docs", "source_size", "weight", target.alias("target"),
        F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0).alias("rate"),
    )


def _ranked(sizes: DataFrame, weights: Sequence[float]) -> DataFrame:
    """Adds the weight by place in the order. Places are counted per range of sources, so no
    task sees all sources, however many there are."""
    parts = max(1, int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = [F.col("source").asc_nulls_last()]
    placed = kept_table(sizes.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    counts = placed.groupBy("_part").count()
    before = counts.select(  # one row per range
        "_part", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before")
    )
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1 + F.col("_before")
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    return placed.join(F.broadcast(before), "_part").withColumn("weight", turn).drop("_part", "_before")


def with_copies(
    docs: DataFrame, *, source: str = "source", text: str = "text", doc_id: str = "doc_id", seed: int = SEED,
    weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, max_repeats: int = MAX_REPEATS,
) -> DataFrame:
    """Every row with size, source_size, target, rate and copies (how often the mix takes it).

    Words are runs without ASCII white space; a null text has none. A null source is a source of
    its own. Rows equal in id and text draw alike; all other rows draw on their own. Caller
    columns of the added names are replaced. An empty table gives an empty table.
    """
    docs = without_names(docs, ["size", "source_size", "target", "rate", "copies"])
    per_source = kept_table(
        source_targets(docs, source=source, text=text, weights=weights, budget=budget, max_repeats=max_repeats)
    )
    key, null = free_name(docs, "_source_key"), free_name(docs, "_source_null")
    keyed = lambda df, column: df.withColumns({  # noqa: E731  nulls can't be joined on
        key: F.coalesce(F.col(column).cast("string"), F.lit("")), null: F.col(column).isNull()
    })
    total = per_source.agg(F.sum("n_docs")).first()[0] or 0
    facts = keyed(per_source, "source").drop("source", "weight")
    rows = lookup(keyed(docs, source), facts, [key, null], "n_docs", total).drop(key, null, "n_docs")
    rows = rows.withColumn("size", F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long"))
    drawn = F.md5(F.concat_ws("|", F.lit(str(seed)), text_or_empty(doc_id), text_or_empty(text)))
    draw = F.conv(F.substring(drawn, 1, DIGITS), 16, 10).cast("double") / float(16**DIGITS)
    whole = F.floor("rate")
    return rows.withColumn("copies", (whole + (draw < F.col("rate") - whole).cast("long")).cast("long"))


def mix(
    docs: DataFrame, *, source: str = "source", text: str = "text", doc_id: str = "doc_id", **options
) -> DataFrame:
    """The mixed rows: the caller's columns, each document as often as the mix takes it."""
    plain, at = numbered(docs)
    taken = with_copies(plain, source=at[source], text=at[text], doc_id=at[doc_id], **options)
    again = taken.where("copies > 0").withColumn("again", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return again.select(*plain.columns).toDF(*docs.columns)
