"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one only where nothing is named and all runs on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "local")):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="spanloom-")


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the cluster's checkpoint folder and go on from there."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """`df` written as a Parquet table in the shared folder and read from there: columns that aren't used aren't read."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, also where `body` uses it in a lambda."""
    return F.transform(F.array(value), body)[0]


def broadcast_if_few(df: DataFrame, rows: int = 50_000) -> DataFrame:
    """`df`, a checkpointed table, to be broadcast if it is counted to have at most `rows` rows; else joins shuffle it."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Rows of edges for which a round of components takes one more task.
EDGES_A_TASK = 50_000


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph: (node, component), component the smallest node reached.

    `edges` has two columns of one orderable type. Rows with a null end are ignored; a node whose
    only edge is a loop gets a row of its own. Large-star and small-star rounds alternate: every
    round is a few shuffles by node, hubs are split by the adaptive join, and only two scalars
    (edge count and checksum) reach the driver. Each round is checkpointed, so a lost executor
    costs one round at most. Few edges are read and written by few tasks, a core each at least: every
    task leaves files of its own, which take more disk than such edges do.
    """
    cores = edges.sparkSession.sparkContext.defaultParallelism
    a, b = edges.columns[:2]
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    pairs = cut(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        tasks = max(cores, state[0] // EDGES_A_TASK)
        pairs = pairs.coalesce(tasks)
        # large star: every node passes the least of its neighbourhood to its larger neighbours
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        pairs = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            pairs.where("u = v"))
        # small star: every node links its smaller neighbours, and itself, to the least of them; pairs that repeat, one for an edge at most, go after it
        least = pairs.groupBy("u").agg(F.min("v").alias("m"))
        pairs = pairs.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        pairs = cut(pairs.distinct().coalesce(tasks))
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots).groupBy("node").agg(
        F.min("component").alias("component"))
