"""Audit operators: response curves, exported models, coverage, one-to-one matching, tests of paired samples."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators.joins import interval_pieces, matched_pieces, nearest_pairs
from spanloom.operators.windows import average_rank


def response_curve(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, event: Column) -> DataFrame:
    """(phase, n, mean, se): values one row before, at, and one row after the rows that are events."""
    w = Window.partitionBy(*by).orderBy(*order)
    rows = df.withColumn("__e", event).select(F.lag(value).over(w).alias("previous"), F.col(value).alias("event"), F.lead(value).over(w).alias("post"), "__e").where("__e")
    long = rows.unpivot(["__e"], ["previous", "event", "post"], "phase", "value")
    return long.groupBy("phase").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), (F.stddev_samp("value") / F.sqrt(F.count("value"))).alias("se"))


def apply_model(df: DataFrame, features: Sequence[str], model: DataFrame) -> DataFrame:
    """`df` with score: a one-row model (mean, scale, coef: arrays; intercept) over standardised features, null if one is missing."""
    x = F.array(*[F.col(c).cast("double") for c in features])
    z = F.zip_with(F.zip_with(x, "mean", lambda a, m: a - m), "scale", lambda a, s: a / s)
    dot = F.aggregate(F.zip_with(z, "coef", lambda a, c: a * c), F.lit(0.0), lambda acc, v: acc + v)
    t = F.least(F.greatest(dot + F.col("intercept"), F.lit(-60.0)), F.lit(60.0))
    return df.crossJoin(F.broadcast(model)).withColumn("score", 1 / (1 + F.exp(-t))).drop("mean", "scale", "coef", "intercept")


def inside_fraction(points: DataFrame, intervals: DataFrame, by: Sequence[str], time: str, start: str, end: str, span: int = 86_400_000) -> DataFrame:
    """(by, n, inside, fraction): how many points lie in some interval, both ends closed.

    Overlapping intervals of a key are merged first, so a point meets one at most; the join is by key and bucket of time.
    """
    w = Window.partitionBy(*by).orderBy(start, end)
    reached = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = intervals.where(F.col(start) <= F.col(end)).select(*by, start, end, F.when(F.col(start) <= reached, 0).otherwise(1).alias("__new"))
    whole = marked.withColumn("__part", F.sum("__new").over(w)).groupBy(*by, "__part").agg(F.min(start).alias(start), F.max(end).alias(end))
    cut = interval_pieces(whole, start, end, span).select(*by, "__bucket", start, end)
    # a bucket may hold several intervals of a key, and a point in it lies in one of them at most
    spans = cut.groupBy(*by, "__bucket").agg(F.collect_list(F.struct(F.col(start).alias("a"), F.col(end).alias("b"))).alias("__spans"))
    rows = points.withColumn("__bucket", F.floor(F.col(time) / span)).join(spans, [*by, "__bucket"], "left")
    hit = F.coalesce(F.exists("__spans", lambda s: F.col(time).between(s["a"], s["b"])), F.lit(False))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(hit).alias("inside"), (F.count_if(hit) / F.count("*")).alias("fraction"))


def label_coverage(df: DataFrame, by: Sequence[str], half: str, label: str) -> DataFrame:
    """(by, covered): whether every label of the second half stands in the first."""
    sets = df.groupBy(*by).agg(F.collect_set(F.when(F.col(half) == "first", F.col(label))).alias("a"), F.collect_set(F.when(F.col(half) == "second", F.col(label))).alias("b"))
    return sets.select(*by, F.size("a").alias("n_first"), F.size("b").alias("n_second"), (F.size(F.array_except("b", "a")) == 0).alias("covered"))


def paired_tests(df: DataFrame, by: Sequence[str], delta: str) -> DataFrame:
    """(by, n, positive, cohen_d, wilcoxon_z, sign_p): tests of paired differences; zero differences don't count.

    wilcoxon_z is the normal approximation of the signed-rank sum, sign_p the two-sided normal
    p-value of the sign test with continuity correction.
    """
    rows = df.where(F.col(delta) != 0).select(*by, F.col(delta).alias("d"), F.abs(delta).alias("m"))
    ranked = rows.withColumn("r", average_rank(by, "m"))
    n = F.count("*").cast("double")
    g = ranked.groupBy(*by).agg(n.alias("n"), F.count_if(F.col("d") > 0).alias("positive"), (F.avg("d") / F.nullif(F.stddev_samp("d"), F.lit(0.0))).alias("cohen_d"),
                                ((F.sum(F.when(F.col("d") > 0, F.col("r")).otherwise(0.0)) - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24)).alias("wilcoxon_z"))

    z = F.greatest(F.abs(F.col("positive") - F.col("n") / 2) - 0.5, F.lit(0.0)) / F.sqrt(F.col("n") / 4)
    return g.withColumn("sign_p", two_sided_p(z)).withColumn("n", F.col("n").cast("long"))


# The polynomial of Abramowitz and Stegun 7.1.26 for the error function, right to 1.5e-7.
ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def two_sided_p(z: Column) -> Column:
    """Two-sided normal p-value of a z, by a polynomial."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    poly = F.lit(0.0)
    for a in reversed(ERF):
        poly = (poly + a) * t
    return poly * F.exp(-x * x)


def student_p(t: Column, freedom: Column, steps: int = 2000) -> Column:
    """Two-sided p-value of Student's t for any positive degrees of freedom.

    With tan(a) = |t| / sqrt(freedom) it is the share that angles beyond a have of the integral of cos(x)^(freedom - 1) over a right angle,
    so no gamma function is needed. Simpson's rule over x = (pi / 2) (1 - u^2), which is smooth at the far end, in `steps` steps; beyond 5,000 degrees of
    freedom t counts as normal. For one row of each group: it is no row-wise function of large tables.
    """
    edge = F.sqrt(1 - 2 / math.pi * F.atan(F.abs(t) / F.sqrt(freedom)))

    def integral(top: Column) -> Column:
        def value(i: Column) -> Column:
            u = top * i / steps
            weight = F.when((i == 0) | (i == steps), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
            return weight * u * F.pow(F.sin(math.pi / 2 * u * u), freedom - 1)

        return top / steps * F.aggregate(F.sequence(F.lit(0), F.lit(steps)), F.lit(0.0), lambda acc, i: acc + value(i))

    return F.when(freedom > 5000, two_sided_p(t)).when(freedom > 0, integral(edge) / integral(F.lit(1.0)))


def chi2_p(x: Column, freedom: int) -> Column:
    """Chance of a chi-square of `freedom` degrees over x: the finite sum for even degrees, that after a normal term for odd ones."""
    h = F.greatest(x, F.lit(0.0)) / 2
    if freedom % 2:
        term, out = F.sqrt(h) * 2 / math.sqrt(math.pi), two_sided_p(F.sqrt(2 * h))
        for k in range((freedom - 1) // 2):
            out, term = out + F.exp(-h) * term, term * h / (k + 1.5)
        return out
    term, out = F.lit(1.0), F.lit(0.0)
    for k in range(freedom // 2):
        out, term = out + term, term * h / (k + 1)
    return F.exp(-h) * out


def two_samples(df: DataFrame, by: Sequence[str], group: Column, value: str) -> DataFrame:
    """(by, n1, n2, t, freedom, t_p, mann_whitney_z, mann_whitney_p): Welch's t and the rank sum of the rows in the group against the others.

    Rows are first counted by value, so ranks come from running counts over the distinct values of a key.
    """
    rows = df.where(F.col(value).isNotNull()).select(*by, group.alias("__g"), F.col(value).cast("double").alias("__v"))
    cells = rows.groupBy(*by, "__v").agg(F.count_if("__g").cast("double").alias("__a"), F.count_if(~F.col("__g")).cast("double").alias("__b"))
    n = F.col("__a") + F.col("__b")
    rank = F.sum(n).over(Window.partitionBy(*by).orderBy("__v")) - (n - 1) / 2
    v, a, b = F.col("__v"), F.col("__a"), F.col("__b")
    s = cells.withColumn("__r", rank).groupBy(*by).agg(*[F.sum(e).alias(k) for k, e in {
        "__n1": a, "__n2": b, "__s1": a * v, "__s2": b * v, "__w": a * F.col("__r")}.items()])
    mean = s.select(*by, *["__n1", "__n2", "__w"], (F.col("__s1") / F.nullif("__n1", F.lit(0.0))).alias("__m1"), (F.col("__s2") / F.nullif("__n2", F.lit(0.0))).alias("__m2"))
    spread = cells.join(mean, list(by)).groupBy(*by, "__n1", "__n2", "__w", "__m1", "__m2").agg(
        F.sum(a * (v - F.col("__m1")) * (v - F.col("__m1"))).alias("__q1"), F.sum(b * (v - F.col("__m2")) * (v - F.col("__m2"))).alias("__q2"))
    n1, n2 = F.col("__n1"), F.col("__n2")
    e1, e2 = (F.col(q) / F.nullif(k - 1, F.lit(0.0)) / k for q, k in (("__q1", n1), ("__q2", n2)))
    t = (F.col("__m1") - F.col("__m2")) / F.nullif(F.sqrt(e1 + e2), F.lit(0.0))
    freedom = (e1 + e2) * (e1 + e2) / F.nullif(e1 * e1 / (n1 - 1) + e2 * e2 / (n2 - 1), F.lit(0.0))
    z = (F.col("__w") - n1 * (n1 + 1) / 2 - n1 * n2 / 2) / F.nullif(F.sqrt(n1 * n2 * (n1 + n2 + 1) / 12), F.lit(0.0))
    out = spread.select(*by, n1.cast("long").alias("n1"), n2.cast("long").alias("n2"), t.alias("t"), freedom.alias("freedom"), z.alias("mann_whitney_z"))
    return out.select(*by, "n1", "n2", "t", "freedom", student_p(F.col("t"), F.col("freedom")).alias("t_p"), "mann_whitney_z", two_sided_p(F.col("mann_whitney_z")).alias("mann_whitney_p"))


def friedman(df: DataFrame, block: str, arm: str, value: str, arms: int) -> DataFrame:
    """(n, chi2, p): Friedman's statistic over the blocks that have all arms, and its chance."""
    cells = df.groupBy(block, arm).agg(F.avg(value).alias("__v"))
    whole = cells.groupBy(block).agg(F.count("__v").alias("__n")).where(F.col("__n") == arms).select(block)
    ranked = cells.join(whole, block).withColumn("__r", average_rank([block], "__v"))
    sums = ranked.groupBy(arm).agg(F.sum("__r").alias("__s"), F.count("*").alias("__n"))
    n = F.max("__n")
    return sums.agg(n.alias("n"), (12 / (n * arms * (arms + 1)) * F.sum(F.col("__s") * F.col("__s")) - 3 * n * (arms + 1)).alias("chi2")).withColumn("p", chi2_p(F.col("chi2"), arms - 1))


def effect(beta: Column, se: Column) -> tuple[Column, Column, Column]:
    """Odds ratio and its 95 % interval."""
    return F.exp(beta), F.exp(beta - 1.96 * se), F.exp(beta + 1.96 * se)


def resampled(df: DataFrame, by: Sequence[str], time: str, value: str, step: int) -> DataFrame:
    """(by, grid, value): linear interpolation at the multiples of `step` between the first and the last sample.

    Times are integers, one sample each. Every segment between neighbours gives its own grid
    points, so a long series is interpolated wherever its rows lie.
    """
    w = Window.partitionBy(*by).orderBy(time)
    seg = df.select(*by, F.col(time).alias("a"), F.col(value).alias("x"), F.lead(time).over(w).alias("b"), F.lead(value).over(w).alias("y"))
    first = F.ceil(F.col("a") / step) * step
    inner = seg.where("b is not null and b > a").withColumn("first", first).where("first < b")
    last = (F.ceil(F.col("b") / step) - 1) * step
    grid = inner.select(*by, "a", "b", "x", "y", F.explode(F.sequence(F.col("first"), last, F.lit(step).cast("bigint"))).alias("grid"))
    inside = grid.select(*by, "grid", (F.col("x") + (F.col("y") - F.col("x")) * (F.col("grid") - F.col("a")) / (F.col("b") - F.col("a"))).alias("value"))
    ends = seg.where((F.col("b").isNull()) & (F.pmod(F.col("a"), F.lit(step)) == 0)).select(*by, F.col("a").alias("grid"), F.col("x").alias("value"))
    return inside.union(ends)


def greedy_global_match(left: DataFrame, right: DataFrame, by: Sequence[str], time: str, tolerance: int) -> DataFrame:
    """(by, a, b): one-to-one pairs, the nearest of all first, ties by the earlier times; equal times of a side are one.

    The two series are cut where neighbours lie further apart than the tolerance; pieces are matched by themselves.
    """
    found = matched_pieces(left, right, by, time, tolerance, nearest_pairs)
    return found.select(*by, F.col("reference_time").alias("a"), F.col("estimate_time").alias("b"))


def version_diff(old: DataFrame, new: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """(field, changed, to_null, from_null, pairs, median, p90, most): how two versions with the same keys differ by field.

    Both sides become one long table of (key, field, value) that is grouped once by key and field,
    so neither version is joined to the other; the absolute differences are of rows known in both.
    """
    def long(df: DataFrame, side: str) -> DataFrame:
        wide = df.select(*keys, *[F.col(f).cast("double").alias(f) for f in fields])
        return wide.unpivot(list(keys), list(fields), "field", "value").withColumn("__side", F.lit(side))

    both = long(old, "old").union(long(new, "new")).groupBy(*keys, "field").agg(
        F.max(F.when(F.col("__side") == "old", F.col("value"))).alias("a"), F.max(F.when(F.col("__side") == "new", F.col("value"))).alias("b"))
    d = F.abs(F.col("b") - F.col("a"))
    return both.groupBy("field").agg(
        F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("changed"), F.count_if(F.col("a").isNotNull() & F.col("b").isNull()).alias("to_null"),
        F.count_if(F.col("a").isNull() & F.col("b").isNotNull()).alias("from_null"), F.count(d).alias("pairs"), F.median(d).alias("median"),
        F.percentile(d, F.lit(0.9)).alias("p90"), F.max(d).alias("most"))


def artifact_windows(df: DataFrame, by: Sequence[str], window: Column, value: str, share: float = 0.9, least: int = 10) -> DataFrame:
    """(by, window, n, mean, artifact): windows of at least `least` values, flagged if their mean is over the key's percentile."""
    limit = df.groupBy(*by).agg(F.percentile(value, F.lit(share)).alias("__limit"))
    means = df.groupBy(*by, window.alias("window")).agg(F.count(value).alias("n"), F.avg(value).alias("mean")).where(F.col("n") >= least)
    return means.join(limit, list(by)).withColumn("artifact", F.col("mean") > F.col("__limit")).drop("__limit")


def harmonic_fold(value: Column, anchor: Column, low: float, high: float, share: float = 0.2) -> tuple[Column, Column]:
    """The half or the double of a rate if it lies in [low, high] and within a share of the anchor, half first; and whether it was folded."""
    def fits(v: Column) -> Column:
        return F.coalesce(v.between(low, high) & (F.abs(v - anchor) <= share * anchor), F.lit(False))

    half, double = value / 2, value * 2
    return F.when(fits(half), half).when(fits(double), double).otherwise(value), fits(half) | fits(double)


def neighbour_coherence(samples: DataFrame, by: Sequence[str], time: str, cell: str, value: str, radius: int = 2) -> DataFrame:
    """(by, cell, coherence): the greatest absolute correlation of a cell's steps with those of a cell within `radius`.

    The steps of a cell meet those of its neighbours at the same key and time, 2 * radius for
    each; a cell without a neighbour, or with constant steps, has 0.
    """
    steps = samples.select(*by, time, cell, (F.col(value) - F.lag(value).over(Window.partitionBy(*by, cell).orderBy(time))).alias("x"))
    moved = steps.select(*by, time, F.explode(F.array(*[F.col(cell) + i for i in range(-radius, radius + 1) if i])).alias(cell), F.col("x").alias("y"),
                         F.col(cell).alias("__other"))
    paired = steps.where("x is not null").join(moved.where("y is not null"), [*by, time, cell])
    r = paired.groupBy(*by, cell, "__other").agg(F.corr("x", "y").alias("r"))
    best = r.groupBy(*by, cell).agg(F.max(F.abs(F.nanvl("r", F.lit(0.0)))).alias("coherence"))
    return samples.select(*by, cell).distinct().join(best, [*by, cell], "left").na.fill(0.0, ["coherence"])


def preferred_path(paths: DataFrame, by: Sequence[str], path: str, preferred: str) -> DataFrame:
    """(by, path): one path of each key, without `preferred` in it before with, then of the least depth, then the first by name."""
    order = F.struct(F.col(path).contains(preferred), F.size(F.split(path, "/")), F.col(path))
    return paths.groupBy(*by).agg(F.min_by(path, order).alias("path"))
