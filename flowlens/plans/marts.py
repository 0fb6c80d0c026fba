"""Mart tables for dashboards, and the jobs that write them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from flowlens.fixed import UNKNOWN
from flowlens.operators import contributions, evaluate, surrogate, training
from flowlens.plans.frames import EV, EV_NUM, ev
from flowlens.plans.registry import query
from flowlens.sources.state import written


def dataset_kpis(df: DataFrame, n_features: int, n_models: int, origin: str = "origin") -> DataFrame:
    """Rows, class mix and sizes per split, from one pass."""
    return df.groupBy(origin).agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col("binary_label") == 0).alias("n_normal"),
        F.count_if(F.col("binary_label") == 1).alias("n_attack"),
        F.count_if(F.col("attack_category") == UNKNOWN).alias("n_unknown"),
        F.count_distinct("attack_category").alias("n_classes"),
        F.lit(n_features).cast("long").alias("n_features"),
        F.lit(n_models).cast("long").alias("n_models"),
    )


def performance(predictions: DataFrame) -> DataFrame:
    """Metrics, cells, rates and the best flag per model from (model, y, prediction) rows.

    All of it derives from the same cells, so the predictions are read once.
    """
    cells = evaluate.binary_cells(predictions, by=["model"])
    table = evaluate.metrics_of(evaluate.rates_of(cells)).withColumn("task", F.lit("binary"))
    order = Window.partitionBy("task").orderBy(F.desc("f1"), "model")
    return table.withColumn("is_best", F.row_number().over(order) == 1)


def scored(models: Mapping[str, object], rows: DataFrame) -> DataFrame:
    """Every row scored by every model in one scan: probabilities, confidence and verdict."""
    return training.detail(training.score_all(models, rows))


def explanation_ranks(attributions: DataFrame, k: int = 20) -> DataFrame:
    """Global ranks per model of attributions that name their model."""
    return contributions.global_rank(contributions.feature_stats(attributions, by=("model",)), k, ("model",))


def write_mart(df: DataFrame, path: str, order: Sequence[str] = (), by: str = "model") -> None:
    """Partitioned by model, and ordered inside, so that a lookup of a row reads one model's few files.

    Only the partitions of models that occur in ``df`` are replaced, when all their files are there.
    """
    keys = [by, *order]
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


MART = {"global_rank": ("rank",), "waterfall": ("row_id", "rank"), "rules": ("row_id", "label", "feature")}


def write_explanations(attributions: DataFrame, rules: DataFrame, root: str, k: int = 12) -> None:
    """Global ranks, per-row waterfalls and rule tables below ``root``, one folder each.

    Both frames name their model; models that aren't in them keep what was written before. The
    attributions are computed once.
    """
    attributions = written(attributions)
    tables = {
        "global_rank": explanation_ranks(attributions), "waterfall": contributions.waterfall(attributions, k),
        "rules": surrogate.rule_table(rules),
    }
    for name, df in tables.items():
        write_mart(df, f"{root}/{name}", MART[name])


def read_explanations(spark: SparkSession, root: str) -> DataFrame:
    """All three tables as (model, part, row_id, label, rank, feature, number, text)."""
    none = lambda kind: F.lit(None).cast(kind)
    table = lambda n: spark.read.parquet(f"{root}/{n}")
    ranks = table("global_rank").select(
        "model", F.lit("global_rank").alias("part"), none("long").alias("row_id"), none("int").alias("label"), "rank", "feature",
        F.col("mean_abs").alias("number"), none("string").alias("text"))
    falls = table("waterfall").select(
        "model", F.lit("waterfall"), F.col("row_id").cast("long"), none("int"), "rank", "feature", "contribution", none("string"))
    rules = table("rules").select(
        "model", F.lit("rules"), F.col("row_id").cast("long"), "label", none("int"), "feature", "weight",
        F.concat_ws(" -> ", "condition", "direction"))
    return ranks.union(falls).union(rules)


@query("dataset_kpis", f"""WITH {EV}
SELECT origin, count(*) AS n_rows, count(*) FILTER (binary_label = 0) AS n_normal,
       count(*) FILTER (binary_label = 1) AS n_attack,
       count(*) FILTER (attack_category = 'Unknown') AS n_unknown,
       count(DISTINCT attack_category) AS n_classes, CAST({len(EV_NUM)} AS BIGINT) AS n_features,
       CAST({len(training.FACTORIES)} AS BIGINT) AS n_models FROM ev GROUP BY 1""")
def dataset_kpis_query(spark, sf):
    return dataset_kpis(ev(spark, sf), len(EV_NUM), len(training.FACTORIES))
