"""A training corpus from ``documents``: reject, deduplicate, mix, tokenize.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next stage's docs. A stage works on all that the one before kept. All but
the last return the columns of ``documents``; the last has one row per mixed document with its
tokens' number, ids and digests. Tables that a stage keeps in the shared folder go when the next one
begins, as its docs are written by then; nobody else's tables are touched.
"""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

from flowlens.llm import exact, mixing, near, pieces, quality
from flowlens.llm.common import Held, release, tables_in
from flowlens.session import require_checkpoint_dir

_HELD: Held = []
TEXTS_AT_ONCE = 512  # whole texts that a Python worker is sent together
WHOLE_STAGE = "spark.sql.codegen.wholeStage"
_WAS: list[str] = []


def _begin(spark: SparkSession, last: bool = False) -> None:
    """The docs are written: what the stage before kept can go, as can its frames, whose plans the driver's JVM
    holds until they are collected here. Large texts travel in small batches, also
    when the stage's result is computed, which is after its function has returned. Stages of hundreds of small jobs
    compile no code for whole stages, which fills the driver's memory; the last stage sets that back."""
    release(_HELD)
    gc.collect()
    if last:
        while _WAS:
            spark.conf.set(WHOLE_STAGE, _WAS.pop())
    else:
        _WAS.extend([] if _WAS else [spark.conf.get(WHOLE_STAGE)])
        spark.conf.set(WHOLE_STAGE, "false")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= TEXTS_AT_ONCE:
        spark.conf.set(key, TEXTS_AT_ONCE)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the fixed limits and aren't outliers of their language and source."""
    _begin(spark)
    with tables_in(_HELD):
        return quality.keep(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: the longest, then the smallest id."""
    _begin(spark)
    with tables_in(_HELD):
        return exact.dedup(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts linked by five-word shingles at a similarity of 0.8."""
    _begin(spark)
    with tables_in(_HELD):
        return near.dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeated and drawn so that the sources' words come near their targets."""
    _begin(spark)
    with tables_in(_HELD):
        return mixing.mix(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed rows' tokens: doc_id, source, n_tokens, token_ids, ids_sha256, decoded_sha256."""
    _begin(spark, last=True)
    rows = pieces.encode(docs)
    return rows.select("doc_id", "source", "n_tokens", "token_ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("sentencepiece", tokenize),
]
ORACLE_SQL = None  # robust estimates, linked groups and tokens aren't SQL; tests use brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the whole ``documents`` table of ``sf_dir``."""
    base = f"{require_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
