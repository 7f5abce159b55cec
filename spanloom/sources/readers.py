"""Scans: event logs, timestamp files, marker logs, nested JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.functions.expressions import number
from spanloom.operators.contracts import monotonic


def csv_logs(spark: SparkSession, paths: str | Sequence[str], numeric: Sequence[str] = (), columns: Sequence[str] | None = None) -> DataFrame:
    """CSV files with headers as one table of strings, `numeric` columns coerced, and the file of each row."""
    df = spark.read.option("header", True).option("encoding", "UTF-8").csv(paths)
    df = df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])
    if columns:
        df = df.select(*columns)
    return df.withColumns({c: number(c) for c in numeric if c in df.columns}).withColumn("source_file", F.col("_metadata.file_path"))


def trials(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Event log without the probe rows."""
    df = csv_logs(spark, paths, ("is_probe", "absolute_onset_time", "rt", "correct", "is_no_go", "response"))
    return df.where(F.coalesce(F.col("is_probe"), F.lit(0)) != 1)


def timestamps(spark: SparkSession, path: str, rising: bool = False) -> DataFrame:
    """(source_file, frame_id, ts_ms) from headerless files: the third column, else the second; other rows go.

    With `rising` the job fails where the time of a file falls from one frame to the next.
    """
    df = spark.read.schema("a string, b string, c string").csv(path).select(
        F.col("_metadata.file_path").alias("source_file"), number("a", "double").cast("long").alias("frame_id"),
        F.coalesce(number("c"), number("b")).cast("long").alias("ts_ms"))
    known = df.where("frame_id is not null and ts_ms is not null")
    return monotonic(known, ["frame_id"], "ts_ms", ["source_file"]) if rising else known


def timestamp_matrix(spark: SparkSession, path: str) -> DataFrame:
    """As `timestamps` with both clocks; fails on a row without three numbers and on a receive clock that falls."""
    bad = F.raise_error(F.lit("a row hasn't three numbers")).cast("bigint")
    df = spark.read.schema("a string, b string, c string").csv(path).select(F.col("_metadata.file_path").alias("source_file"), *[
        F.coalesce(number(c).cast("long"), bad).alias(n) for c, n in (("a", "frame_id"), ("b", "ts_receive_ms"), ("c", "ts_process_ms"))])
    last = F.lag("ts_receive_ms").over(Window.partitionBy("source_file").orderBy("frame_id"))
    falls = F.raise_error(F.lit("the receive clock falls")).cast("boolean")
    return df.withColumn("__last", last).where(F.when(F.col("ts_receive_ms") < F.col("__last"), falls).otherwise(F.lit(True))).drop("__last")


def markers(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, event, detail, unix_ms) of a timeline log; rows without time go."""
    df = csv_logs(spark, path)
    return df.select("source_file", "event", "detail", number("unix_ms").cast("long").alias("unix_ms")).where("unix_ms is not null")


def nested_windows(spark: SparkSession, path: str, schema: str, array: str = "windows") -> DataFrame:
    """Rows of an array of structs in JSON documents, one file each."""
    df = spark.read.schema(f"{array} array<struct<{schema}>>").option("multiLine", True).json(path)
    return df.select(F.col("_metadata.file_path").alias("source_file"), F.posexplode(array).alias("position", "w")).select("source_file", "position", "w.*")


def manifests(spark: SparkSession, pattern: str) -> DataFrame:
    """(source_file, name, stage, manifest) of the JSON manifests that a path pattern finds, one document a file, as a map of texts."""
    text = spark.read.text(pattern, wholetext=True)
    parsed = F.from_json("value", "map<string,string>")
    rows = text.select(F.col("_metadata.file_path").alias("source_file"), parsed.alias("manifest")).where("manifest is not null")
    return rows.select("source_file", F.try_element_at("manifest", F.lit("name")).alias("name"), F.try_element_at("manifest", F.lit("stage")).alias("stage"), "manifest")


def marker_edges(df: DataFrame, lines: Sequence[str], by: Sequence[str], order: str) -> DataFrame:
    """(by, order, code): rising edges of the byte that digital lines make, least line first."""
    code = sum((F.shiftleft((F.coalesce(F.col(c), F.lit(0)) > 0.5).cast("int"), i) for i, c in enumerate(lines)), F.lit(0))
    rows = df.select(*by, order, code.alias("code"))
    last = F.lag("code", 1, 0).over(Window.partitionBy(*by).orderBy(order))
    return rows.withColumn("__last", last).where("code > 0 AND __last = 0").drop("__last")
