"""Set operations and table comparison."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tagged_union(parts: dict[str, DataFrame], tag: str = "source") -> DataFrame:
    """Rows of all tables with the name of their own; columns that a table lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn(tag, F.lit(n)) for n, df in parts.items()])


def package_union(parts: dict[str, tuple[dict, DataFrame]], tag: str = "machine") -> DataFrame:
    """Union of packages whose signatures and column orders all agree; raises ValueError otherwise."""
    (first_name, (signature, table)), *rest = parts.items()
    for name, (other, df) in rest:
        if other != signature:
            raise ValueError(f"signatures of {first_name} and {name} differ: {sorted(k for k in {*other, *signature} if other.get(k) != signature.get(k))}")
        if df.columns != table.columns:
            raise ValueError(f"columns of {first_name} and {name} differ")
    return tagged_union({n: df for n, (_, df) in parts.items()}, tag)


def both_differences(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(side, keys): keys that only one side has."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return a.exceptAll(b).withColumn("side", F.lit("left")).union(b.exceptAll(a).withColumn("side", F.lit("right")))


def field_changes(left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(field, n, changed, appeared, vanished, median, p90, most): numeric fields over the keys that both sides have."""
    a = left.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(list(keys), list(columns), "field", "a")
    b = right.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(list(keys), list(columns), "field", "b")
    d = F.abs(F.col("a") - F.col("b"))
    moved = F.when(d > 0, d)
    return a.join(b, [*keys, "field"]).groupBy("field").agg(
        F.count("*").alias("n"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("changed"),
        F.count_if(F.col("a").isNull() & F.col("b").isNotNull()).alias("appeared"),
        F.count_if(F.col("a").isNotNull() & F.col("b").isNull()).alias("vanished"),
        F.median(moved).alias("median"), F.percentile(moved, 0.9).alias("p90"), F.max(moved).alias("most"))


def table_difference(expected: DataFrame, actual: DataFrame, exact: Sequence[str], close: Sequence[str], atol: float = 1e-8,
                     rtol: float = 1e-7) -> DataFrame:
    """Rows in which two tables differ: keys of one side only, repeated keys, values beyond the tolerance."""
    def numbered(df: DataFrame, side: str) -> DataFrame:
        return df.groupBy(*exact).agg(F.count("*").alias(f"n_{side}"), *[F.sort_array(F.collect_list(c)).alias(f"{c}_{side}") for c in close])

    a, b = numbered(expected, "a"), numbered(actual, "b")
    same = F.lit(True)
    for c in exact:
        same &= a[c].eqNullSafe(b[c])
    joined = a.join(b, same, "full_outer").select(*[F.coalesce(a[c], b[c]).alias(c) for c in exact], *[
        x for df in (a, b) for x in df.columns if x not in exact])
    differs = ~F.col("n_a").eqNullSafe(F.col("n_b"))
    for c in close:
        pairs = F.arrays_zip(F.col(f"{c}_a").alias("x"), F.col(f"{c}_b").alias("y"))
        differs |= F.exists(pairs, lambda p: ~F.coalesce(F.abs(p["x"] - p["y"]) <= atol + rtol * F.abs(p["y"]), F.lit(False)))
    return joined.where(differs)


def expand_counts(df: DataFrame, keys: Sequence[str], rate: str, n: str) -> DataFrame:
    """One row per trial: round(rate * n) successes, the others failures."""
    hits = F.least(F.greatest(F.rint(F.col(rate) * F.col(n)), F.lit(0.0)), F.col(n)).cast("long")
    rows = df.where(F.col(n) > 0).select(*keys, hits.alias("__h"), F.explode(F.sequence(F.lit(1), F.col(n).cast("int"))).alias("trial"))
    return rows.select(*keys, "trial", (F.col("trial") <= F.col("__h")).cast("int").alias("outcome"))
