"""Session defaults the engine relies on (UTC, right-biased map merges, AQE)."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def build_session(app: str = "quillstream", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's defaults; keyword settings override them (dots as double underscores)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Set the runtime settings that results depend on in a session somebody else made."""
    for key in ("spark.sql.session.timeZone", "spark.sql.mapKeyDedupPolicy"):
        if spark.conf.get(key, None) != DEFAULTS[key]:
            spark.conf.set(key, DEFAULTS[key])
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one in single-machine runs."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
    return f"file://{os.path.join(tempfile.gettempdir(), 'quillstream-shared')}"
