"""Cleaning targets and the fitted detector applied to arriving flow files.

Only steps that look at one row at a time are used; they are the same functions as in batch,
so a stream and a batch run over the same files give the same rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.streaming import StreamingQuery

from flowlens.fixed import FLOW_CATEGORIES, FLOW_SCHEMA, NORMAL_LABEL
from flowlens.operators.anomaly import MeanDetector
from flowlens.operators.clean import add_targets
from flowlens.sources.flows import RAW_OPTIONS, as_text, typed


def read_stream(spark: SparkSession, folder: str, schema: T.StructType = FLOW_SCHEMA) -> DataFrame:
    return typed(spark.readStream.schema(as_text(schema)).options(**RAW_OPTIONS).csv(folder), schema)


def flag_stream(
    flows: DataFrame,
    detector: MeanDetector,
    groups: Mapping[str, Sequence[str]] = FLOW_CATEGORIES,
    normal: str = NORMAL_LABEL,
) -> DataFrame:
    return detector.transform(add_targets(flows, "label", groups, normal))


def write_stream(flagged: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends to Parquet until the input present now is used up."""
    return (
        flagged.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
