"""The session settings under which results are defined: UTC, ANSI, adaptive execution."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "cadenza", **conf: str) -> SparkSession:
    """A session on whatever master the environment names; conf overrides or adds settings (dots as double underscores)."""
    builder = SparkSession.builder.appName(app)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
