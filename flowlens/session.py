"""Session settings that matter for these jobs."""

from __future__ import annotations

import re
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def local_session(cores: int | str = "*", app: str = "flowlens", shuffle: int = 8) -> SparkSession:
    """Session for one machine. On a cluster, submit with the cluster's own settings."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def require_checkpoint_dir(spark: SparkSession) -> str:
    """Folder for iterative jobs: the one the cluster names, else a new one for local runs.

    A local master is the only case where a temporary folder is acceptable; on a cluster the
    executors do not share the driver's disk, so a missing setting is an error there.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current:
        return current
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):  # local-cluster has executors of its own
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="flowlens-checkpoint-")
    sc.setCheckpointDir(named)
    return named


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, once per application.

    Spark hands the archive to every executor. Nothing is done where the package already
    came as an archive, as with ``--py-files``.
    """
    sc, here = spark.sparkContext, Path(__file__).resolve().parent
    if sc.applicationId in _SHIPPED or not here.is_dir():
        return
    folder = tempfile.mkdtemp(prefix="flowlens-code-")
    sc.addPyFile(shutil.make_archive(f"{folder}/{here.name}", "zip", here.parent, here.name))
    _SHIPPED.add(sc.applicationId)
