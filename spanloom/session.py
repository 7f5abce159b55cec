"""Sessions with the settings that the operators count on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "spanloom", master: str | None = None, **settings: object) -> SparkSession:
    """A session in UTC with adaptive execution; `settings` use __ for the dots of Spark's names."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
    }
    for key, value in {**defaults, **{k.replace("__", "."): v for k, v in settings.items()}}.items():
        builder = builder.config(key, str(value))
    return builder.getOrCreate()
