"""The session that the engine's semantics rest on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings with a meaning for results: one zone, exact column names, errors on overflow; and adaptive execution.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.caseSensitive": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def session(app: str = "sluice", master: str | None = None, **more: str) -> SparkSession:
    """A session with the engine's settings. The cluster's own sizes (partitions, memory) stay as they are set."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **more}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
