"""Sinks: exclusive tables, JSON rows, manifests, restartable appends."""

from __future__ import annotations

import datetime
import json
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators.sets import tagged_union


def write_new(df: DataFrame, path: str, form: str = "parquet", marked: bool = False) -> None:
    """Write a table, failing if the path has one. CSV has headers, `marked` ones a byte order mark for spreadsheets."""
    if form == "csv" and marked:
        df = df.withColumnRenamed(df.columns[0], "\ufeff" + df.columns[0])
    writer = df.write.mode("errorifexists")
    (writer.option("header", True).csv(path) if form == "csv" else writer.format(form).save(path))


def write_union(parts: dict[str, DataFrame], path: str, form: str = "csv") -> None:
    """Tables of different columns as one, with the name of each row's own; what a table lacks is empty."""
    write_new(tagged_union(parts), path, form)


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path holds a whole Parquet table: what a failed write leaves has no committed file."""
    try:
        spark.read.parquet(path)
    except AnalysisException:
        return False
    return True


def copy_tables(spark: SparkSession, source: str, target: str, names: Sequence[str]) -> DataFrame:
    """Copy the declared tables under `source` to `target`: (name, rows, digest) of each copy. Fails on one that is missing or there already."""
    rows = []
    for name in names:
        write_new(spark.read.parquet(f"{source}/{name}"), f"{target}/{name}")
        found = content_digest(spark.read.parquet(f"{target}/{name}"))
        rows.append((name, found["rows"], found["digest"]))
    return spark.createDataFrame(rows, "name string, rows long, digest string")


def write_models(models: DataFrame, path: str, keys: Sequence[str]) -> None:
    """A table of model parameters as JSON, one folder for each key."""
    models.write.mode("errorifexists").partitionBy(*keys).json(path)


def append_once(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Append the rows whose key isn't in the table yet, so a restarted job repeats nothing."""
    spark = df.sparkSession
    if table_exists(spark, path):
        df = df.join(spark.read.parquet(path).select(*keys), list(keys), "left_anti")
    df.write.mode("append").parquet(path)


def as_json(df: DataFrame) -> DataFrame:
    """One JSON text per row; nulls are left out and NaN is null."""
    clean = [F.nanvl(F.col(c), F.lit(None).cast(t)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    return df.select(F.to_json(F.struct(*clean)).alias("value"))


def content_digest(t: DataFrame) -> dict:
    r = t.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64(*t.columns).cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
    return {"rows": r["n"], "digest": str(r["h"]), "columns": t.columns}


def manifest(df: DataFrame, name: str, inputs: dict[str, DataFrame]) -> dict:
    """Row counts and content digests of a result and its inputs. A digest is the sum of row hashes, so order doesn't matter."""
    return {"name": name, "created": datetime.datetime.now(datetime.UTC).isoformat(), "spark": df.sparkSession.version,
            "result": content_digest(df), "inputs": {k: content_digest(v) for k, v in inputs.items()}}


def write_manifest(df: DataFrame, path: str, content: dict) -> None:
    """One JSON text file under `path`, in whatever file system it names."""
    df.sparkSession.createDataFrame([(json.dumps(content, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)
