"""Registered queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function of (spark, sf_dir) under its own name."""
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r6(value: Column | str) -> Column:
    """Rounded for comparison, without a negative zero."""
    return F.round(value, 6) + F.lit(0.0)


def q6(sql: str) -> str:
    return f"round({sql}, 6) + 0.0"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their time as integer milliseconds."""
    e = read(spark, sf_dir, "events")
    return e.select("event_id", "user_id", "event_type", "value", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))


EVENTS_SQL = "ev AS (SELECT event_id, user_id, event_type, value, CAST(epoch_us(ts) // 1000 AS BIGINT) AS ms FROM events)"
HOUR = 3_600_000


from spanloom.plans import analytic, audits, behaviour, evaluation, grouped, kernels, models, phase, relational, scalars, spectral, vitals  # noqa: E402,F401
