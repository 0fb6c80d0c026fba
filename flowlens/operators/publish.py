"""A model with its encoders and feature order, published as one version.

A version is written beside those there are, and its manifest last: what has no finished manifest is no
version, so a reader sees a whole one, the last or a named one, whatever is being written. The
manifest holds a digest of encoders and order; on load the digest of what was read must be the same.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import SparkSession

from flowlens.operators.encode import OneHot, Standardizer, load_order, save_order
from flowlens.sources.state import Registry, load_table, save_table


class Mismatch(ValueError):
    """Encoders or order aren't those that the model was published with."""


@dataclass(frozen=True)
class Bundle:
    model: object
    hot: OneHot
    scaler: Standardizer
    order: list[str]

    def digest(self) -> str:
        levels = [[c, sorted(map(str, v))] for c, v in self.hot.levels.items()]
        told = [levels, [[c, *map(float, v)] for c, v in self.scaler.stats.items()], list(self.order)]
        return hashlib.sha256(json.dumps(told).encode()).hexdigest()


def _store(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path(root).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), path


def versions(spark: SparkSession, root: str) -> list[str]:
    """Names of the whole versions below ``root``, oldest first."""
    store, path = _store(spark, root)
    if not store.exists(path(root)):
        return []
    names = [f.getPath().getName() for f in store.listStatus(path(root))]
    return sorted(n for n in names if store.exists(path(f"{root}/{n}/manifest/_SUCCESS")))


def publish(spark: SparkSession, root: str, bundle: Bundle) -> str:
    """Writes a version and returns its name; two publishers at once give two versions."""
    name = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    at = f"{root}/{name}"
    Registry(spark, at).save("model", bundle.model)
    bundle.hot.save(spark, f"{at}/hot")
    bundle.scaler.save(spark, f"{at}/scaler")
    save_order(spark, bundle.order, f"{at}/order")
    save_table(spark.createDataFrame([(name, bundle.digest())], "version string, digest string"), f"{at}/manifest")
    return name


def load(spark: SparkSession, root: str, version: str | None = None) -> Bundle:
    """A version, the last one if none is named."""
    known = versions(spark, root)
    name = version or (known[-1] if known else None)
    if name not in known:
        raise FileNotFoundError(f"no version {version or ''} below {root}")
    at = f"{root}/{name}"
    found = Bundle(
        Registry(spark, at).load("model"), OneHot.load(spark, f"{at}/hot"), Standardizer.load(spark, f"{at}/scaler"),
        load_order(spark, f"{at}/order"))
    if found.digest() != load_table(spark, f"{at}/manifest").first()["digest"]:
        raise Mismatch(f"{at}: encoders or feature order were changed after the model was published")
    return found
