"""Beats of a signal: median cycle templates, sliding similarity, the best path of beats, aligned interval series."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _kinds(df: DataFrame, columns: Sequence[str]) -> str:
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in columns)


def standard(x: Column, w) -> Column:
    """Values less their mean over their population deviation; a constant stretch is 0."""
    spread = F.stddev_pop(x).over(w)
    return F.when(spread > 0, (x - F.avg(x).over(w)) / spread).otherwise(F.lit(0.0))


def cycle_templates(samples: DataFrame, peaks: DataFrame, by: Sequence[str], index: str, value: str, reach: int = 10, least: int = 5) -> DataFrame:
    """(by, half, mean, deviation, template): the median cycle of each key, from the samples around its peaks.

    `samples` has whole numbers without holes as `index`, `peaks` those of the peaks. A cycle is the standardised samples
    up to `half` on both sides of a peak, half the median interval but `reach` at least; cut ones don't count. `mean` is the rounded median
    interval, `deviation` the population deviation of intervals. Keys with fewer than `least` peaks or whole cycles have no row.
    """
    w = Window.partitionBy(*by).orderBy(index)
    span = samples.groupBy(*by).agg(F.min(index).alias("__lo"), F.max(index).alias("__hi"))
    inner = peaks.select(*by, F.col(index).alias("__p")).join(span, list(by)).where(F.col("__p").between(F.col("__lo") + 1, F.col("__hi")))
    steps = inner.withColumn("__d", F.col("__p") - F.lag("__p").over(Window.partitionBy(*by).orderBy("__p")))
    rhythm = steps.groupBy(*by).agg(F.count("*").alias("__n"), F.rint(F.median("__d")).cast("int").alias("mean"), F.stddev_pop("__d").alias("deviation"))
    rhythm = rhythm.where(F.col("__n") >= least).withColumn("half", F.greatest(F.lit(reach), F.floor(F.col("mean") / 2).cast("int"))).drop("__n")
    # a sample stands in the cycle of every peak within half of it
    whole = inner.join(rhythm, list(by)).where((F.col("__p") - F.col("half") >= F.col("__lo")) & (F.col("__p") + F.col("half") <= F.col("__hi")))
    cells = whole.select(*by, "__p", "half", "mean", "deviation", F.explode(F.sequence(-F.col("half"), F.col("half"))).alias("offset"))
    cells = cells.withColumn(index, (F.col("__p") + F.col("offset")).cast(samples.schema[index].dataType)).join(samples.select(*by, index, value), [*by, index])
    z = cells.withColumn("__z", standard(F.col(value), Window.partitionBy(*by, "__p")))
    medians = z.groupBy(*by, "half", "mean", "deviation", "offset").agg(F.median("__z").alias("__m"), F.count("*").alias("__n")).where(F.col("__n") >= least)
    return medians.groupBy(*by, "half", "mean", "deviation").agg(F.transform(F.sort_array(F.collect_list(F.struct("offset", "__m"))), lambda c: c["__m"]).alias("template"))


def template_similarity(samples: DataFrame, templates: DataFrame, by: Sequence[str], index: str, value: str, longest: int = 401) -> DataFrame:
    """`samples` with similarity: the correlation of the stretch around each sample with its key's template, null where it would be cut.

    A sample gets the values around it from one window of the key's order, of `longest` samples at most; no pair of samples and
    offsets is ever a row.
    """
    w = Window.partitionBy(*by).orderBy(index)
    reach = longest // 2
    near = F.collect_list(value).over(w.rowsBetween(-reach, reach))
    before = F.least(F.row_number().over(w) - 1, F.lit(reach))
    rows = samples.select("*", near.alias("__x"), before.alias("__b")).join(templates.select(*by, "half", "template"), list(by))
    size = 2 * F.col("half") + 1
    cut = (F.col("__b") < F.col("half")) | (F.size("__x") < F.col("__b") + F.col("half") + 1)
    x = F.slice("__x", F.col("__b") - F.col("half") + 1, size)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v)
    rows = rows.withColumn("__x", F.when(~cut, x)).withColumn("__m", total("__x") / size).withColumn("__t", total("template") / size)
    dx, dt = F.transform("__x", lambda v: v - F.col("__m")), F.transform("template", lambda v: v - F.col("__t"))
    product = total(F.zip_with(dx, dt, lambda a, b: a * b))
    scale = F.sqrt(total(F.transform(dx, lambda v: v * v)) * total(F.transform(dt, lambda v: v * v)))
    return rows.withColumn("similarity", F.when(F.col("__x").isNotNull(), F.when(scale > 1e-12, product / scale).otherwise(F.lit(0.0)))).drop("__x", "__b", "__m", "__t", "half", "template")


def best_paths(similarity: np.ndarray, mean: np.ndarray, deviation: np.ndarray, shortest: int, longest: int) -> list[list[int]]:
    """Paths of beats of several series at once, rows of one matrix; what isn't a number is no beat.

    A step in time is one max-plus product for all series: the values a beat's predecessors have reached, less the penalties of the
    intervals to them, and the greatest of each row.
    """
    count, n = similarity.shape
    spread = np.maximum(deviation, 2.0)
    low, high = np.maximum(shortest, np.rint(mean - 3 * spread)).astype(int), np.minimum(longest, np.rint(mean + 3 * spread)).astype(int)
    lags = np.arange(longest, 0, -1)
    penalty = np.where((lags >= low[:, None]) & (lags <= high[:, None]), 0.25 * ((lags - mean[:, None]) / spread[:, None]) ** 2, np.inf)
    times = np.arange(n)
    beat = np.isfinite(similarity) & (times >= np.maximum(1, low)[:, None])
    reached = np.full((count, longest + n), -np.inf)      # columns before time 0 are never reached
    source = np.full((count, n), -1)
    rows = np.arange(count)
    for t in times:
        chains = reached[:, t:t + longest] - penalty
        best = chains.argmax(axis=1)
        chain = chains[rows, best]
        linked = np.isfinite(chain)
        reached[:, longest + t] = np.where(beat[:, t], similarity[:, t] + np.where(linked, chain, 0.0), -np.inf)
        source[:, t] = np.where(beat[:, t] & linked, t - lags[best], -1)
    out = []
    for values, back in zip(reached[:, longest:], source):
        path = [int(values.argmax())] if np.isfinite(values).any() else []
        while path and back[path[-1]] >= 0:
            path.append(int(back[path[-1]]))
        out.append(path[::-1])
    return out


def beat_paths(samples: DataFrame, rhythm: DataFrame, by: Sequence[str], index: str, similarity: str, shortest: int = 30, longest: int = 200, batch: int = 32) -> DataFrame:
    """(by, index, interval): the beats of each key with the greatest sum of similarities, less a quarter of the squared deviations of
    their intervals from the key's mean, in units of its deviation (two samples at least).

    Intervals keep within three deviations of the mean and within `shortest` and `longest`; no beat is earlier than the least interval; a beat that can follow
    another one does. `rhythm` has mean and deviation of each key. A series is a recording's window; its samples become one array, and a task folds
    `batch` arrays at once.
    """
    series = samples.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col(index).alias("i"), F.col(similarity).cast("double").alias("s")))).alias("__s"))
    ready = series.select(*by, F.transform("__s", lambda c: c["i"]).alias("__i"), F.transform("__s", lambda c: c["s"]).alias("__s")).join(rhythm.select(*by, "mean", "deviation"), list(by))
    ready = ready.where("mean is not null and deviation is not null")

    def paths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            rows = rows.assign(__n=rows["__s"].map(len)).sort_values("__n")
            for low in range(0, len(rows), batch):
                part = rows.iloc[low:low + batch]
                table = np.full((len(part), part["__n"].max()), np.nan)
                for line, values in zip(table, part["__s"]):
                    line[:len(values)] = np.array(values, float)
                found = best_paths(table, part["mean"].to_numpy(float), part["deviation"].to_numpy(float), shortest, longest)
                yield part[list(by)].assign(__beats=[[int(at[k]) for k in path] for at, path in zip(part["__i"], found)])

    beats = ready.mapInPandas(paths, f"{_kinds(samples, by)}, __beats array<long>")
    placed = beats.select(*by, F.posexplode("__beats").alias("__k", index), "__beats")
    return placed.select(*by, index, F.when(F.col("__k") > 0, F.col(index) - F.get("__beats", F.col("__k") - 1)).alias("interval"))


def interval_costs(a: np.ndarray, b: np.ndarray, most: float, gap: float) -> tuple[int, float, float]:
    """(pairs, sum of their differences, cost) of the cheapest alignment in order of two series.

    Cells on one anti-diagonal don't depend on each other, so each is one vector operation; a cell carries what its best way
    has paired, so no table is kept and nothing is traced back. Of equal ways a pair comes first, then an interval of `a` left out.
    """
    n, m = len(a), len(b)
    places = np.arange(n + 1)
    # by the number of intervals of `a` used, on the two diagonals before: cost, pairs, sum
    older, newer = np.full((3, n + 1), np.inf), np.full((3, n + 1), np.inf)
    newer[:, 0] = 0.0
    for diagonal in range(1, n + m + 1):
        j = diagonal - places
        inside = (j >= 0) & (j <= m)
        both = inside & (places > 0) & (j > 0)
        difference = np.full(n + 1, np.inf)
        difference[both] = np.abs(a[places[both] - 1] - b[j[both] - 1])
        shifted_older, shifted = np.roll(older, 1, axis=1), np.roll(newer, 1, axis=1)
        shifted_older[:, 0] = shifted[:, 0] = np.inf
        ways = np.stack([shifted_older, shifted, newer])
        added = np.zeros_like(ways)
        added[0] = np.where(difference <= most, difference, 2 * gap + 1), np.ones(n + 1), np.where(np.isfinite(difference), difference, 0.0)
        added[1:, 0] = gap
        ways = ways + added
        best = ways[:, 0].argmin(axis=0)
        older, newer = newer, np.where(inside, np.take_along_axis(ways, best[None, None, :], axis=0)[0], np.inf)
    cost, pairs, total = newer[:, n]
    return int(pairs), float(total), float(cost)


def interval_alignment(reference: DataFrame, estimate: DataFrame, by: Sequence[str], order: str, value: str, most: float, gap: float) -> DataFrame:
    """(by, n_pairs, n_reference, n_estimate, mae) of the alignment of the interval series of each key.

    A pair costs its difference and may differ by `most`; an interval left out costs `gap`. Each series becomes one array,
    a task holds those of one batch of keys.
    """
    def listed(df: DataFrame, name: str) -> DataFrame:
        rows = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).cast("double").alias("v")))).alias(name))
        return rows.select(*by, F.transform(name, lambda c: c["v"]).alias(name))

    @F.pandas_udf("pairs long, total double")
    def align(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        found = [interval_costs(np.asarray(x, float), np.asarray(y, float), most, gap)[:2] for x, y in zip(a, b)]
        return pd.DataFrame(found, columns=["pairs", "total"])

    none = F.array().cast("array<double>")
    both = listed(reference, "__a").join(listed(estimate, "__b"), list(by), "full").withColumns({"__a": F.coalesce("__a", none), "__b": F.coalesce("__b", none)})
    out = both.withColumn("__r", align("__a", "__b"))
    return out.select(*by, F.col("__r.pairs").alias("n_pairs"), F.size("__a").cast("long").alias("n_reference"), F.size("__b").cast("long").alias("n_estimate"),
                      (F.col("__r.total") / F.nullif(F.col("__r.pairs"), F.lit(0))).alias("mae"))
