"""The given tables seen as labelled flows, in Spark and in SQL.

``EV`` events by event type, ``LI`` line items, ``ORD`` orders, ``RULES`` labelled documents
with three rule-based predictions. The train/test tag is a cut in time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowlens.operators.clean import add_targets

EV_GROUPS = {"Normal": ["view"], "Browse": ["click"], "Trade": ["purchase"], "Fault": ["error"]}
EV_CLASSES = [*EV_GROUPS, "Unknown"]
EV_NUM = ["value", "user_id", "k", "log_value", "hour"]
LI_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "net", "k0"]
LI_KEY = ["l_returnflag", "l_linestatus", "l_linenumber", "l_quantity", "l_discount", "l_tax"]
RULE_MODELS = ["clean", "always", "long_text"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _origin(when: str, start: str):
    return F.when(F.col(when) >= F.lit(start).cast("timestamp_ntz"), "test").otherwise("train")


def ev(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "events").select(
        F.col("event_id").alias("row_id"),
        F.col("event_type").alias("label"),
        "value",
        "user_id",
        F.regexp_extract("props", r"(\d+)", 1).cast("int").alias("k"),
        F.log1p("value").alias("log_value"),
        F.hour("ts").alias("hour"),
        _origin("ts", "2024-01-25").alias("origin"),
    )
    return add_targets(raw, "label", EV_GROUPS, "view")


def li(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        "l_linenumber",
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"),
        F.lit(0.0).alias("k0"),
        (F.col("l_quantity") > 25).cast("int").alias("y"),
        _origin("l_shipdate", "2000-10-01").alias("origin"),
    )


def orders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("row_id"), "o_orderstatus", "o_orderpriority", "o_totalprice",
        _origin("o_orderdate", "2000-04-01").alias("origin"),
    )


def rules(spark: SparkSession, sf: str) -> DataFrame:
    """Quality labels with the answers of three fixed rules."""
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    joined = table(spark, sf, "labels").join(docs, "doc_id")
    return joined.select(
        F.col("doc_id").alias("row_id"),
        F.col("quality").alias("y"),
        (1 - F.col("toxic")).alias("clean"),
        F.lit(1).alias("always"),
        (F.col("n_chars") > 1000).cast("int").alias("long_text"),
    )


EV = r"""ev AS (
  SELECT event_id AS row_id, event_type AS label, value, user_id,
         CAST(regexp_extract(props, '(\d+)', 1) AS INTEGER) AS k,
         ln(1 + value) AS log_value, CAST(extract(hour FROM ts) AS INTEGER) AS hour,
         CASE WHEN ts >= TIMESTAMP '2024-01-25' THEN 'test' ELSE 'train' END AS origin,
         CASE event_type WHEN 'view' THEN 'Normal' WHEN 'click' THEN 'Browse'
              WHEN 'purchase' THEN 'Trade' WHEN 'error' THEN 'Fault' ELSE 'Unknown'
         END AS attack_category,
         CASE WHEN event_type = 'view' THEN 0 ELSE 1 END AS binary_label
  FROM events)"""
LI = """li AS (
  SELECT l_returnflag, l_linestatus, l_quantity, l_extendedprice, l_discount, l_tax,
         l_linenumber, l_extendedprice * (1 - l_discount) AS net, CAST(0 AS DOUBLE) AS k0,
         CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS y,
         CASE WHEN l_shipdate >= TIMESTAMP '2000-10-01' THEN 'test' ELSE 'train' END AS origin
  FROM lineitem)"""
ORD = """ord AS (
  SELECT o_orderkey AS row_id, o_orderstatus, o_orderpriority, o_totalprice,
         CASE WHEN o_orderdate >= TIMESTAMP '2000-04-01' THEN 'test' ELSE 'train' END AS origin
  FROM orders)"""
RULES = """rules AS (
  SELECT l.doc_id AS row_id, quality AS y, 1 - toxic AS clean, 1 AS always,
         CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END AS long_text
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


def union_columns(view: str, columns: list[str], item: str) -> str:
    """One SELECT per column, stacked; ``item`` is the select list with {c} for the column."""
    return " UNION ALL ".join(f"SELECT {item.format(c=c)} FROM {view}" for c in columns)
