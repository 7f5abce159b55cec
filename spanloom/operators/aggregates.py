"""Grouped statistics: window features, robust statistics, error tables, cross tables, bins."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def slope(y: Column | str, x: Column | str) -> Column:
    """Least-squares slope, null below two points."""
    return F.when(F.count(F.when(F.col(str(x)).isNotNull() & F.col(str(y)).isNotNull(), 1)) >= 2, F.regr_slope(y, x))


def behaviour_features(windows: DataFrame, keys: Sequence[str], time: str, rt: str, error: str, omission: str) -> DataFrame:
    """The feature block of each window: counts, RT mean, median, sd, MAD, CV and slope, accuracy, errors, omissions.

    `windows` has one row per event and a row with a null time for a window without any: its
    trial count is 0 and all else null.
    """
    n = F.count(time)
    some = lambda c: F.when(n > 0, c)
    # a window's times are few, so median and MAD come from one list and the join runs once
    f = windows.groupBy(*keys).agg(
        n.alias("trial_count"), F.avg(rt).alias("rt_mean"), F.sort_array(F.collect_list(rt)).alias("__rt"),
        F.stddev_samp(rt).alias("rt_sd"), (F.stddev_samp(rt) / F.nullif(F.avg(rt), F.lit(0.0))).alias("rt_cv"), slope(rt, time).alias("rt_slope"),
        some(1 - F.avg(error)).alias("accuracy"), some(F.sum(error)).alias("error_count"), some(F.avg(error)).alias("error_rate"),
        some(F.sum(omission)).alias("omission_count"), some(F.avg(omission)).alias("omission_rate"))
    f = f.withColumn("rt_median", array_median(F.col("__rt")))
    f = f.withColumn("rt_mad", array_median(F.transform("__rt", lambda x: F.abs(x - F.col("rt_median")))))
    return f.select(*keys, "trial_count", "rt_mean", "rt_median", "rt_sd", "rt_mad", "rt_cv", "rt_slope", "accuracy", "error_count", "error_rate", "omission_count", "omission_rate")


def describe(df: DataFrame, by: Sequence[str], value: str, person: str) -> DataFrame:
    """n, distinct persons, mean, sd and median of few and large groups; null keys are a group."""
    sums = df.groupBy(*by).agg(F.count("*").alias("n"), F.countDistinct(person).alias("n_people"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    return with_percentiles(sums, df, by, value, {"median": 0.5})


def with_total(df: DataFrame, by: str, aggregates: Sequence[Column], label: str = "all") -> DataFrame:
    """Aggregates by a key and over all rows, the total under `label`."""
    sets = df.groupingSets([[F.col(by)], []], F.col(by)).agg(F.grouping(by).alias("__total"), *aggregates)
    return sets.withColumn(by, F.when(F.col("__total") == 1, label).otherwise(F.col(by))).drop("__total")


def mad(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by, median, mad): median and median absolute deviation of each group."""
    center = df.groupBy(*by).agg(F.median(value).alias("median"))
    return df.join(center, list(by)).groupBy(*by).agg(
        F.first("median").alias("median"), F.median(F.abs(F.col(value) - F.col("median"))).alias("mad"))


def robust_z(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """`df` with robust_z: (x - median) / (1.4826 MAD) within the group, null where the MAD is 0."""
    return df.join(mad(df, by, value), list(by)).withColumn(
        "robust_z", (F.col(value) - F.col("median")) / (1.4826 * F.nullif("mad", F.lit(0.0)))).drop("median", "mad")


def crosstab_shares(df: DataFrame, row: str, column: str, values: Sequence) -> DataFrame:
    """Shares of the values within each row, 0 for values that don't occur."""
    wide = df.groupBy(row).pivot(column, list(values)).count().na.fill(0)
    total = sum((F.col(f"`{v}`") for v in values), F.lit(0))
    return wide.select(row, *[(F.col(f"`{v}`") / total).alias(f"share_{v}") for v in values])


#: Equal widths that the values of a group are cut into to find the rows near a percentile.
WIDTHS = 1 << 14


def percentiles(df: DataFrame, by: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """(by, percentiles): exact interpolated percentiles of few and large groups, an array in the order of `shares`; groups without a value have no row.

    Rows are counted in equal widths between a group's ends; only the rows of the widths that hold the wanted ranks are then
    counted by value, so no task gathers a group's values. Null keys are a group.
    """
    rows = df.select(*by, F.col(value).cast("double").alias("__v")).where("__v is not null")
    ends = rows.groupBy(*by).agg(F.min("__v").alias("__low"), F.max("__v").alias("__high"), F.count("*").alias("__all"))
    keys = [F.col(c).alias(f"__k{k}") for k, c in enumerate(by)]

    def beside(left: DataFrame, right: DataFrame, *extra: Column) -> DataFrame:
        same = [F.col(c).eqNullSafe(F.col(f"__k{k}")) for k, c in enumerate(by)]
        return left.join(F.broadcast(right), functools.reduce(lambda x, y: x & y, [*same, *extra])).drop(*[f"__k{k}" for k in range(len(by))])

    part = (F.col("__v") - F.col("__low")) / F.nullif(F.col("__high") - F.col("__low"), F.lit(0.0)) * WIDTHS
    width = F.least(F.floor(F.nanvl(F.coalesce(part, F.lit(0.0)), F.lit(0.0))), F.lit(WIDTHS - 1))
    cut = beside(rows, ends.select(*keys, "__low", "__high")).select(*by, "__v", width.alias("__w"))
    places = ends.select(*by, F.posexplode(F.array(*[(F.col("__all") - 1) * F.lit(float(p)) for p in shares])).alias("__p", "__at"))
    places = places.withColumns({"__first": F.floor("__at"), "__second": F.ceil("__at")})

    def reached(rank: str) -> Column:
        return (F.col(rank) >= F.col("__before")) & (F.col(rank) < F.col("__before") + F.col("__n"))

    counts = cut.groupBy(*by, "__w").agg(F.count("*").alias("__n"))
    counts = counts.withColumn("__before", F.sum("__n").over(Window.partitionBy(*by).orderBy("__w")) - F.col("__n"))
    wanted = beside(counts, places.select(*keys, "__first", "__second"), reached("__first") | reached("__second")).select(*by, "__w", "__before").distinct()
    near = beside(cut, wanted.select(*keys, F.col("__w").alias("__x"), "__before"), F.col("__w") == F.col("__x")).groupBy(*by, "__w", "__before", "__v").agg(F.count("*").alias("__n"))
    ahead = F.sum("__n").over(Window.partitionBy(*by, "__w").orderBy("__v")) - F.col("__n")
    near = near.withColumn("__before", F.col("__before") + ahead)
    found = beside(near, places.select(*keys, "__p", "__at", "__first", "__second"), reached("__first") | reached("__second"))
    first, second = F.max(F.when(reached("__first"), F.col("__v"))), F.max(F.when(reached("__second"), F.col("__v")))
    share = F.col("__at") - F.col("__first")
    one = found.groupBy(*by, "__p", "__at", "__first").agg(first.alias("__f"), second.alias("__s"))
    one = one.select(*by, "__p", F.when(F.col("__f") == F.col("__s"), F.col("__f")).otherwise((1 - share) * F.col("__f") + share * F.col("__s")).alias("__v"))
    return one.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("__p", "__v"))).getField("__v").alias("percentiles"))


def with_percentiles(grouped: DataFrame, df: DataFrame, by: Sequence[str], value: str, names: dict[str, float]) -> DataFrame:
    """`grouped`, one row for each group of `df`, with percentiles of a value under `names`."""
    found = percentiles(df, by, value, list(names.values())).select(*[F.col(c).alias(f"__k{k}") for k, c in enumerate(by)], "percentiles")
    same = functools.reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__k{k}")) for k, c in enumerate(by)])
    return grouped.join(F.broadcast(found), same, "left").select(*grouped.columns, *[F.col("percentiles")[k].alias(n) for k, n in enumerate(names)])


def error_metrics(df: DataFrame, by: Sequence[str], estimate: str, reference: str) -> DataFrame:
    """(by, n, MAE, median AE, bias, RMSE, P90 and largest AE, within 5, 10 and 20, Pearson, coverage), for few and large groups."""
    e = F.col(estimate) - F.col(reference)
    ae = F.abs(e)
    sums = df.groupBy(*by).agg(F.count(e).alias("n"), F.avg(ae).alias("mae"), F.avg(e).alias("bias"),
            F.sqrt(F.avg(e * e)).alias("rmse"), F.max(ae).alias("max_ae"),
            F.count_if(ae <= 5).alias("within_5"), F.count_if(ae <= 10).alias("within_10"), F.count_if(ae <= 20).alias("within_20"),
            F.corr(estimate, reference).alias("pearson"), (F.count(e) / F.count("*")).alias("coverage"))
    sums = with_percentiles(sums, df.withColumn("__ae", ae), by, "__ae", {"median_ae": 0.5, "p90_ae": 0.9})
    return sums.select(*by, "n", "mae", "median_ae", "bias", "rmse", "p90_ae", "max_ae", "within_5", "within_10", "within_20", "pearson", "coverage")


def paired_delta(df: DataFrame, by: Sequence[str], first: str, second: str, reference: str, tolerance: float = 1e-9) -> DataFrame:
    """Mean and median of |second - ref| - |first - ref|, and how often the second is better, tied, worse, for few and large groups."""
    delta = F.abs(F.col(second) - F.col(reference)) - F.abs(F.col(first) - F.col(reference))
    rows = df.withColumn("__d", delta).where("__d is not null")
    sums = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg("__d").alias("mean_delta"),
        F.count_if(F.col("__d") < -tolerance).alias("better"), F.count_if(F.abs("__d") <= tolerance).alias("tied"),
        F.count_if(F.col("__d") > tolerance).alias("worse"))
    found = with_percentiles(sums, rows, by, "__d", {"median_delta": 0.5})
    return found.select(*by, "n", "mean_delta", "median_delta", "better", "tied", "worse")


def bias_shares(df: DataFrame, by: str, error: str) -> DataFrame:
    """Additive parts of the pooled bias: each class's sum of errors over the number of all rows."""
    grouped = df.groupBy(by).agg(F.count(error).alias("n"), F.sum(error).alias("total"))
    every = Window.partitionBy()
    part = F.col("total") / F.sum("n").over(every)
    return grouped.select(by, "n", part.alias("contribution"), (F.col("total") / F.nullif(F.sum("total").over(every), F.lit(0.0))).alias("share"))


def near_far(df: DataFrame, by: Sequence[str], distance: str, error: str, edge: float) -> DataFrame:
    far = F.col(distance) >= edge
    return df.groupBy(*by).agg(F.avg(F.when(~far, F.col(error))).alias("near"), F.avg(F.when(far, F.col(error))).alias("far")).withColumn(
        "contrast", F.col("far") - F.col("near"))


def flag_counts(df: DataFrame, column: str, separator: str = "|") -> DataFrame:
    """(flag, n) over a delimited list; empty entries don't count."""
    return df.select(F.explode(F.split(column, "\\" + separator)).alias("flag")).where("flag <> ''").groupBy("flag").agg(F.count("*").alias("n"))


def calibration(df: DataFrame, score: str, label: str, bins: int = 10) -> DataFrame:
    """(bin, n, mean_score, rate) for bins of equal width over 0 to 1, right-closed, the empty ones too."""
    spark = df.sparkSession
    edges = [i / bins for i in range(1, bins)]
    index = sum((F.when(F.col(score) > e, 1).otherwise(0) for e in edges), F.lit(0))
    stats = df.where(F.col(score).isNotNull()).groupBy(index.alias("bin")).agg(
        F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.avg(label).alias("rate"))
    return spark.range(bins).select(F.col("id").cast("int").alias("bin")).join(stats, "bin", "left").na.fill(0, ["n"])


def equal_width(df: DataFrame, value: str, bins: int) -> DataFrame:
    """`df` with bin: equal width over the range of the values, right-closed, the least in bin 0."""
    span = df.agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    width = (F.col("__hi") - F.col("__lo")) / bins
    index = F.greatest(F.ceil((F.col(value) - F.col("__lo")) / F.nullif(width, F.lit(0.0))) - 1, F.lit(0))
    return df.crossJoin(F.broadcast(span)).withColumn("bin", F.coalesce(index, F.lit(0)).cast("int")).drop("__lo", "__hi")


def masked_counts(df: DataFrame, masks: dict[str, Column], value: str) -> DataFrame:
    """(mask, n, mean) for masks that may overlap, in one pass."""
    hit = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in masks.items()]))
    return df.select(value, F.explode(hit).alias("mask")).groupBy("mask").agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def mode_stability(df: DataFrame, by: Sequence[str], order: str, value: str) -> DataFrame:
    """(by, mode, persistence, n_values): the most frequent value, first seen on ties, its share, and the distinct values."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return counts.groupBy(*by).agg(
        F.max_by(value, F.struct("n", -F.col("first"))).alias("mode"), (F.max("n") / F.sum("n")).alias("persistence"),
        F.count("*").alias("n_values"))


def frame_weighted_mean(chunks: DataFrame, by: Sequence[str], mean: str, n: str) -> DataFrame:
    """Mean over all frames from the means of chunks."""
    return chunks.groupBy(*by).agg((F.sum(F.col(mean) * F.col(n)) / F.sum(n)).alias("mean"), F.sum(n).alias("n"))


def long_form(df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str = "arm", value: str = "value") -> DataFrame:
    return df.unpivot(list(keys), list(columns), name, value)


def dense_grid(df: DataFrame, rows: str, columns: str, aggregates: Sequence[Column]) -> DataFrame:
    """Aggregates for every pair of the values of two columns, those without rows too. Both are dimensions of few values."""
    grid = df.select(rows).distinct().crossJoin(F.broadcast(df.select(columns).distinct()))
    return grid.join(df.groupBy(rows, columns).agg(*aggregates), [rows, columns], "left")


def acceptance(row: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """`row` with the names of the rules that fail, and whether none does."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]))
    return row.withColumn("failed", failed).withColumn("accepted", F.size("failed") == 0)


def gap_distribution(df: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """Quantiles of the differences between neighbours of each key."""
    gaps = df.select(*by, (F.col(order) - F.lag(order).over(Window.partitionBy(*by).orderBy(order))).alias("gap"))
    q = F.percentile("gap", F.array(*map(F.lit, (0.1, 0.5, 0.9, 0.95))))
    return gaps.where("gap is not null").groupBy(*by).agg(
        F.count("*").alias("n"), F.min("gap").alias("least"), q.alias("q"), F.max("gap").alias("most")).select(
        *by, "n", "least", *[F.col("q")[i].alias(f"p{p}") for i, p in enumerate((10, 50, 90, 95))], "most")


def value_counts(df: DataFrame, value: str) -> DataFrame:
    """(value, n, share) of each value, null too; the share of all rows to eight digits."""
    counts = df.groupBy(value).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 8))    # over grouped rows


def class_counts(df: DataFrame, by: Sequence[str], label: str, error: str) -> DataFrame:
    """(by, n, mae, classes): mean of an error, and the counts of the classes as JSON, by name."""
    parts = df.groupBy(*by, label).agg(F.count("*").alias("n"), F.count(error).alias("m"), F.sum(error).alias("s"))
    entries = F.array_sort(F.collect_list(F.struct(F.col(label).alias("key"), F.col("n").alias("value"))))
    return parts.groupBy(*by).agg(F.sum("n").alias("n"), (F.sum("s") / F.sum("m")).alias("mae"), F.to_json(F.map_from_entries(entries)).alias("classes"))


def array_median(values: Column) -> Column:
    """Median of an array without nulls, null if it is empty."""
    n = F.size(values)
    s = F.array_sort(values)
    return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)
