"""Flow tables: header-less text in, partitioned Parquet or header CSV out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from flowlens.fixed import FLOW_SCHEMA

# Texts that count as missing next to the empty field.
MISSING = [
    "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
    "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def as_text(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])


def typed(
    texts: DataFrame, schema: T.StructType = FLOW_SCHEMA, missing: Sequence[str] = MISSING
) -> DataFrame:
    """Text fields in the schema's types: blanks around them go, missing tokens become null
    and anything else that isn't a value of its type fails the job. Batch and stream share it."""
    cells = []
    for f in schema.fields:
        text = F.trim(F.col(f"`{f.name}`"))
        value = F.when((text != "") & ~text.isin(list(missing)), text)
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            # "3.0" is the whole number 3, as a reader sees it in a column with missing fields
            value = F.when(value.rlike(r"^[+-]?\d+\.0*$"), F.regexp_extract(value, r"^([+-]?\d+)", 1)).otherwise(value)
        cast = value.try_cast(f.dataType)
        wrong = F.raise_error(F.concat(F.lit(f"malformed {f.name}: "), value)).cast(f.dataType)
        cells.append(F.when(value.isNull() | cast.isNotNull(), cast).otherwise(wrong).alias(f.name))
    return texts.select(*cells)


# Every field is read as text and typed by ``typed``; a line with too few or too many fails.
RAW_OPTIONS = {"header": "false", "mode": "FAILFAST"}


def read_raw(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType = FLOW_SCHEMA,
    missing: Sequence[str] = MISSING,
) -> DataFrame:
    """Header-less delimited scan with a fixed schema, so no pass over the data infers types."""
    return typed(spark.read.schema(as_text(schema)).options(**RAW_OPTIONS).csv(path), schema, missing)


def read_raw_pair(
    spark: SparkSession, train: str, test: str, schema: T.StructType = FLOW_SCHEMA
) -> DataFrame:
    """Both files as one frame tagged with ``origin``."""
    parts = [
        read_raw(spark, p, schema).withColumn("origin", F.lit(o))
        for o, p in (("train", train), ("test", test))
    ]
    return parts[0].unionByName(parts[1])


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Unique id per row, from partition and position. Write the result once before using
    the id, so that every later job reads the same one."""
    return df.withColumn(name, F.monotonically_increasing_id())


def write_processed(df: DataFrame, path: str, by: str = "origin") -> None:
    """Parquet partitioned by split; tasks write what they hold, no shuffle."""
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def load_split(spark: SparkSession, path: str, origin: str | None = None) -> DataFrame:
    """The processed table, or one split of it by partition pruning."""
    df = spark.read.parquet(path)
    return df if origin is None else df.where(F.col("origin") == origin)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def read_processed_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Header CSV in the given schema; column names are checked against the header."""
    return (
        spark.read.schema(schema)
        .option("header", "true")
        .option("enforceSchema", "false")
        .csv(path)
    )
