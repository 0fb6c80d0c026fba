"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from flowlens.session import require_checkpoint_dir, ship_package

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BITMAP_BITS = 1 << 22  # broadcast as at most 65,536 rows of two longs: 1 MB
HEAVY = 1000
Held = list[tuple[SparkSession, str]]
_HELD: ContextVar[Held | None] = ContextVar("held", default=None)


def text_or_empty(column: str | Column = "text") -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c.cast("string"), F.lit(""))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def kept_table(df: DataFrame) -> DataFrame:
    """The rows, written to the cluster's checkpoint folder and read from there; cuts the lineage.

    A written table also has its true size. What checkpoint() returns carries the planner's
    estimate on, and in loops of joins that number gets twice as long every round.
    """
    path = f"{require_checkpoint_dir(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    held = _HELD.get()
    if held is not None:
        held.append((df.sparkSession, path))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def tables_in(held: Held) -> Iterator[None]:
    """Tables kept inside are listed in ``held``, for ``release`` once what was made from them is written.
    Tables kept outside are nobody's and stay as long as the shared folder."""
    token = _HELD.set(held)
    try:
        yield
    finally:
        _HELD.reset(token)


def release(held: Held) -> None:
    """Deletes the listed tables."""
    while held:
        spark, path = held.pop()
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs run inside send at most so many rows at once to Python workers, for rows that may be large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, min(rows, int(was)) if int(was) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(key, was)


@contextmanager
def small_jobs(spark: SparkSession) -> Iterator[None]:
    """Jobs run inside compile no code for whole stages, which in loops of small jobs fills the driver's memory
    and is too long for the JVM to compile further."""
    key = "spark.sql.codegen.wholeStage"
    was = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, was)


Batches = Iterator[pa.RecordBatch]


def freed_after(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """The task's function; at a part's end the memory that it no longer uses goes back to the system, as Python
    workers live on and serve other stages."""

    def whole(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
                pool.release_unused()

    return whole


def with_python(spark: SparkSession) -> None:
    """Python workers will need this package."""
    ship_package(spark)


def extended(df: DataFrame, *more: tuple[str, str]) -> StructType:
    """The frame's schema and some columns (name, type) behind it."""
    schema = StructType(list(df.schema.fields))
    for name, kind in more:
        schema = schema.add(name, StructType.fromDDL(f"x {kind}")[0].dataType)
    return schema


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that the frame doesn't use (names are compared without case)."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name += "_"
    return name


def numbered(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The frame with columns renamed by place, and the new name of each old one. Operators that
    give the caller's columns back work on this, so no caller name can clash with theirs."""
    names = [f"c{i}_" for i in range(len(df.columns))]
    return df.toDF(*names), dict(zip(df.columns, names))


def without_names(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The frame with caller columns moved out of the way of those an operator adds."""
    added = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in added])


def possible_member(df: DataFrame, key: str, members: DataFrame, flag: str) -> DataFrame:
    """Adds ``flag``: false only where ``key`` (a long) is surely none of ``members``' keys.

    The members' keys become bits of a table of fixed size, so what is broadcast has at most
    BITMAP_BITS / 64 rows whatever the input. Rows flagged wrongly only cost work: callers
    decide those by an exact join. Members beyond the table's size flag more rows, no fewer.
    """
    bit = F.pmod(F.xxhash64(F.col(key)), F.lit(BITMAP_BITS))
    bits = (
        members.select(bit.alias("_bit"))
        .groupBy(F.floor(F.col("_bit") / 64).cast("long").alias("_word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(_bit % 64 as int))")).alias("_bits"))
    )
    return (
        df.withColumn("_bit", bit)
        .withColumn("_word", F.floor(F.col("_bit") / 64).cast("long"))
        .join(F.broadcast(bits), "_word", "left")
        .withColumn(
            flag,
            F.coalesce(F.expr("(shiftrightunsigned(_bits, cast(_bit % 64 as int)) & 1) = 1"), F.lit(False)),
        )
        .drop("_bit", "_word", "_bits")
    )


def lookup(
    rows: DataFrame, groups: DataFrame, keys: Sequence[str], size: str, total: int, how: str = "inner"
) -> DataFrame:
    """Inner or left join of rows with one row per group, where a group may hold any share of the rows.

    Groups of more than one row in HEAVY are at most HEAVY many: those are broadcast. In the
    shuffled join of the others no key holds more than that share of the rows.
    """
    keys = list(keys)
    heavy = groups.where(F.col(size) * HEAVY > total)
    light = groups.where(F.col(size) * HEAVY <= total)
    marked = rows.join(
        F.broadcast(heavy.select(*keys, F.lit(True).alias("_heavy"))), keys, "left"
    )
    big = rows.join(F.broadcast(heavy), keys)
    small = marked.where(F.col("_heavy").isNull()).drop("_heavy").join(light, keys, how)
    return big.unionByName(small)
