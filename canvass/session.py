"""The session settings that the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build(name: str = "canvass", **conf: str) -> SparkSession:
    """A session in UTC with adaptive plans; master and sizes come from spark-submit."""
    builder = SparkSession.builder.appName(name)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    }
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
