"""Checks that a plan carries with it: they fail the job when a row breaks them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`df`, failing if a key repeats. Its shuffle by key serves a join on the key that follows."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    marked = df.withColumn("__n", n)
    failed = F.raise_error(F.concat(F.lit(f"repeated key ({', '.join(keys)}): "), F.to_json(F.struct(*keys))))
    return marked.where(F.when(F.col("__n") > 1, failed.cast("boolean")).otherwise(F.lit(True))).drop("__n")


def validated_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left", validate: str = "one_to_one") -> DataFrame:
    """Equi join that fails on repeated keys of the side(s) that `validate` calls one."""
    one_left, one_right = (x == "one" for x in validate.split("_to_"))
    left = unique(left, keys) if one_left else left
    return left.join(unique(right, keys) if one_right else right, list(keys), how)


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n) for every key that repeats."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def violations(df: DataFrame, not_null: Sequence[str] = (), allowed: dict[str, Sequence] | None = None,
               ranges: dict[str, tuple] | None = None) -> DataFrame:
    """One row (check, n) for every rule, counted in a single pass."""
    rules: dict[str, Column] = {f"null:{c}": F.col(c).isNull() for c in not_null}
    rules |= {f"enum:{c}": F.col(c).isNotNull() & ~F.col(c).isin(list(v)) for c, v in (allowed or {}).items()}
    rules |= {f"range:{c}": ~F.col(c).between(lo, hi) for c, (lo, hi) in (ranges or {}).items()}
    counts = df.agg(*[F.count_if(rule).alias(f"c{i}") for i, rule in enumerate(rules.values())])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(name).alias("check"), F.col(f"c{i}").alias("n"))
                                             for i, name in enumerate(rules)])).alias("r")).select("r.*")


def monotonic(df: DataFrame, order: Sequence[str], value: str, by: Sequence[str] = ()) -> DataFrame:
    """`df`, failing where `value` falls from one row to the next."""
    last = F.lag(value).over(Window.partitionBy(*by).orderBy(*order))
    marked = df.withColumn("__last", last)
    failed = F.raise_error(F.lit(f"{value} isn't monotonic")).cast("boolean")
    return marked.where(F.when(F.col(value) < F.col("__last"), failed).otherwise(F.lit(True))).drop("__last")


def exactly_one(df: DataFrame) -> DataFrame:
    """`df`, failing unless it has exactly one row."""
    n = df.agg(F.count("*").alias("__n"))
    ok = F.when(F.col("__n") != 1, F.raise_error(F.lit("not exactly one row")).cast("boolean")).otherwise(F.lit(True))
    return n.where(ok).join(df, F.lit(True), "left").drop("__n")


def expected(row: DataFrame, values: dict[str, int]) -> DataFrame:
    """A one-row table of counts, which must have these values; fails on another."""
    out = row
    for name, value in values.items():
        failed = F.raise_error(F.concat(F.lit(f"{name} is not {value}: "), F.col(name).cast("string"))).cast("long")
        out = out.withColumn(name, F.when(F.col(name) == value, F.col(name)).otherwise(failed))
    return out


def temporal_leaks(features: DataFrame, start: str, end: str) -> DataFrame:
    """`features` with leaks: whether the window of a feature, in seconds from the event, goes past the event or is empty."""
    return features.withColumn("leaks", (F.col(end) > 0) | (F.col(start) >= F.col(end)))
