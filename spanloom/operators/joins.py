"""Joins by time windows, nearest time, intervals, position and key sets."""

from __future__ import annotations

import functools
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lookback_join(probes: DataFrame, events: DataFrame, by: Sequence[str], onset: str, time: str, width: int | str,
                  span: int, how: str = "left", closed: bool = False) -> DataFrame:
    """Each probe with the events of [onset - width, onset), or up to and with the onset if `closed`.

    `width` is a number or a column of the probes, `span` a bound on it: both sides are cut into
    buckets of `span`. An event stands in its own bucket and the next, so a probe meets in one bucket all that
    its window can hold, and a subject with a long history is
    spread over as many tasks as it has buckets. Times are integers. The columns of the two sides
    but `by` differ; a left join keeps probes without events.
    """
    start = F.col(onset) - (F.lit(width) if isinstance(width, int) else F.col(width))
    bucket = lambda c: F.floor(F.col(c) / span)
    extra = [c for c in events.columns if c not in by]
    left = probes.withColumn("__bucket", bucket(onset))
    right = events.select(*[F.col(c).alias(f"__r_{c}") for c in by], *extra, F.explode(F.array(bucket(time), bucket(time) + 1)).alias("__r_bucket"))
    inside = (F.col(time) >= start) & ((F.col(time) <= F.col(onset)) if closed else (F.col(time) < F.col(onset)))
    same = functools.reduce(lambda x, y: x & y, [F.col(c) == F.col(f"__r_{c}") for c in by], F.col("__bucket") == F.col("__r_bucket"))
    return left.join(right, same & inside, how).select(*probes.columns, *extra)


def nearest(left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str, right_time: str, value: str,
            tolerance: int | None = None) -> DataFrame:
    """`left` with the value of the nearest row of `right` in time: nearest_time, nearest_value, distance.

    Ties go to the earlier row; equal times of the right side to the smallest value. Beyond the
    tolerance the value is null and the distance stays. One union and one window per direction,
    so the plan is a sort by key, never a product.
    """
    tagged = left.select(*by, F.col(left_time).alias("__t"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__row"),
                         F.lit(None).cast(right.schema[right_time].dataType).alias("__rt"),
                         F.lit(None).cast(right.schema[value].dataType).alias("__rv"))
    points = right.groupBy(*by, right_time).agg(F.min(value).alias(value))
    other = points.select(*by, F.col(right_time).alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast(
        tagged.schema["__row"].dataType).alias("__row"), F.col(right_time).alias("__rt"), F.col(value).alias("__rv"))
    pair = F.when(F.col("__rt").isNotNull(), F.struct(F.col("__rt").alias("t"), F.col("__rv").alias("v")))
    order = Window.partitionBy(*by).orderBy("__t", "__side")
    back = F.last(pair, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(pair, ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    found = tagged.union(other).select("*", back.alias("__b"), ahead.alias("__a")).where("__side = 1")
    db, da = F.col("__t") - F.col("__b.t"), F.col("__a.t") - F.col("__t")
    best = F.when(F.col("__b").isNotNull() & (F.col("__a").isNull() | (db <= da)), F.col("__b")).otherwise(F.col("__a"))
    out = found.select("__row.*", best.alias("__n"), F.col("__t").alias("__t"))
    distance = F.abs(F.col("__t") - F.col("__n.t"))
    within = F.lit(True) if tolerance is None else distance <= tolerance
    return out.select(*left.columns, F.when(within, F.col("__n.t")).alias("nearest_time"),
                      F.when(within, F.col("__n.v")).alias("nearest_value"), distance.alias("distance"))


def interval_pieces(intervals: DataFrame, start: str, end: str, span: int) -> DataFrame:
    """`intervals` once for each bucket of `span` that they reach, numbered in __bucket."""
    bucket = lambda c: F.floor(F.col(c) / span)
    return intervals.where(F.col(start) <= F.col(end)).withColumn("__bucket", F.explode(F.sequence(bucket(start), bucket(end))))


def interval_lookup(points: DataFrame, intervals: DataFrame, by: Sequence[str], time: str, start: str, end: str, label: str,
                    key: Sequence[str], default: str | None = None, closed: bool = True, span: int = 86_400_000) -> DataFrame:
    """`points` with the label of the first interval that holds them, else the default.

    First is by start, then end, then label. `key` names the columns that tell the points apart. Both sides are cut
    into buckets of `span`, so the points of one subject meet its intervals in many tasks.
    """
    inside = (F.col(time) >= F.col(start)) & ((F.col(time) <= F.col(end)) if closed else (F.col(time) < F.col(end)))
    pieces = interval_pieces(intervals.select(*by, start, end, label), start, end, span)
    pieces = pieces.select(*[F.col(c).alias(f"__r_{c}") for c in by], start, end, label, F.col("__bucket").alias("__r_bucket"))
    same = functools.reduce(lambda x, y: x & y, [F.col(c) == F.col(f"__r_{c}") for c in by], F.col("__bucket") == F.col("__r_bucket"))
    hits = points.withColumn("__bucket", F.floor(F.col(time) / span)).join(pieces, same & inside, "left")
    others = [c for c in points.columns if c not in key]
    first = hits.groupBy(*key).agg(*[F.first(c).alias(c) for c in others], F.min_by(label, F.struct(start, end, label)).alias("label"))
    return first.select(*points.columns, F.coalesce("label", F.lit(default)).alias("label"))


def pair_markers(markers: DataFrame, by: Sequence[str], time: str, kind: str, start: str, stop: str) -> DataFrame:
    """(by, start, end): each start marker with the next stop after it, null if there is none."""
    order = Window.partitionBy(*by).orderBy(time).rangeBetween(1, Window.unboundedFollowing)
    end = F.min(F.when(F.col(kind) == stop, F.col(time))).over(order)
    return markers.where(F.col(kind).isin(start, stop)).select(*by, kind, F.col(time).alias("start"), end.alias("end")).where(
        F.col(kind) == start).drop(kind)


def zip_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_order: Sequence[str], right_order: Sequence[str]) -> DataFrame:
    """Rows of equal position within the key, as many as the shorter side has."""
    number = lambda order: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return left.withColumn("position", number(left_order)).join(right.withColumn("position", number(right_order)), [*by, "position"])


def rounded_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_value: str, right_value: str, digits: int = 1,
                 how: str = "inner") -> DataFrame:
    """Equi join on the key and on both values rounded half to even."""
    a = left.withColumn("rounded", F.bround(left_value, digits))
    return a.join(right.withColumn("rounded", F.bround(right_value, digits)), [*by, "rounded"], how)


def same_keys_join(first: DataFrame, others: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Inner join of tables that must have the same set of keys; fails on a key that one side lacks."""
    out = first.withColumn("__has0", F.lit(True))
    for i, other in enumerate(others, 1):
        out = out.join(other.withColumn(f"__has{i}", F.lit(True)), list(keys), "full_outer")
    flags = [f"__has{i}" for i in range(len(others) + 1)]
    lacking = F.raise_error(F.concat(F.lit("a side lacks key "), F.to_json(F.struct(*keys)))).cast("boolean")
    whole = F.forall(F.array(*[F.col(c).isNotNull() for c in flags]), lambda x: x)
    return out.where(F.when(whole, F.lit(True)).otherwise(lacking)).drop(*flags)


def fold_roles(rows: DataFrame, group: str) -> DataFrame:
    """Every row in every leave-one-group-out fold, TEST in its own group's fold and TRAIN elsewhere.

    The folds are as many as the groups; the product is the result asked for, and it is built from
    the small list of groups.
    """
    folds = rows.select(F.col(group).alias("held_out")).distinct().withColumn(
        "fold_id", F.format_string("LOSO_%03d", F.dense_rank().over(Window.orderBy("held_out"))))
    roles = F.when(F.col(group) == F.col("held_out"), "TEST").otherwise("TRAIN")
    return rows.crossJoin(F.broadcast(folds)).withColumn("role", roles)


def pairs_in_order(reference: np.ndarray, estimate: np.ndarray, tolerance: float) -> list[tuple[int, int]]:
    """Pairs of two sorted sequences: each reference in turn takes the first estimate within the tolerance that none before it took."""
    first, end = np.searchsorted(estimate, reference - tolerance, "left"), np.searchsorted(estimate, reference + tolerance, "right")
    free, out = 0, []
    for i in np.flatnonzero(first < end).tolist():
        at = max(free, int(first[i]))
        if at < end[i]:
            out.append((i, at))
            free = at + 1
    return out


def pieces(reference: DataFrame, estimate: DataFrame, by: Sequence[str], time: str, tolerance: float) -> DataFrame:
    """(by, t, ref, piece): both series of each key, cut where neighbours lie further apart than the tolerance.

    No match reaches over such a cut, so pieces are matched by themselves and a long series is many groups.
    """
    both = reference.select(*by, F.col(time).alias("t"), F.lit(True).alias("ref")).union(estimate.select(*by, F.col(time).alias("t"), F.lit(False).alias("ref")))
    w = Window.partitionBy(*by).orderBy("t")
    cuts = both.where("t is not null").withColumn("__cut", F.when(F.col("t") - F.lag("t").over(w) > tolerance, 1).otherwise(0))
    return cuts.withColumn("piece", F.sum("__cut").over(w.rangeBetween(Window.unboundedPreceding, 0))).drop("__cut")


def matched_pieces(reference: DataFrame, estimate: DataFrame, by: Sequence[str], time: str, tolerance: float, rule) -> DataFrame:
    """(by, reference_time, estimate_time): the pairs that `rule` finds in each piece of two series."""
    kinds = {f.name: f.dataType.simpleString() for f in reference.schema}
    keys = ", ".join(f"{c} {kinds[c]}" for c in by)
    schema = f"{keys}, reference_time {kinds[time]}, estimate_time {kinds[time]}"

    def match(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        t = rows["t"].to_numpy()
        x, y = (np.sort(t[rows["ref"].to_numpy() == side]) for side in (True, False))
        return pd.DataFrame([(*key[:-1], x[i], y[j]) for i, j in rule(x, y, tolerance)], columns=[*by, "reference_time", "estimate_time"])

    found = pieces(reference, estimate, by, time, tolerance)
    both = found.groupBy(*by, "piece").agg(F.min("ref").alias("__a"), F.max("ref").alias("__b")).where("__a <> __b").select(*by, "piece")
    return found.join(both, [*by, "piece"]).groupBy(*by, "piece").applyInPandas(lambda key, rows: match(key, rows), schema)


def monotone_match(reference: DataFrame, estimate: DataFrame, by: Sequence[str], time: str, tolerance: float) -> DataFrame:
    """(by, reference_time, estimate_time): matches of two time series of each key, in order and one to one."""
    return matched_pieces(reference, estimate, by, time, tolerance, pairs_in_order)


def nearest_of(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Index of the nearest of the sorted `y` for each of `x`, the earlier of two as near."""
    right = np.clip(np.searchsorted(y, x), 1, max(1, len(y) - 1))
    return np.where(x - y[right - 1] <= y[np.minimum(right, len(y) - 1)] - x, right - 1, np.minimum(right, len(y) - 1))


def nearest_pairs(reference: np.ndarray, estimate: np.ndarray, tolerance: float) -> list[tuple[int, int]]:
    """One-to-one pairs of the distinct values of two sorted sequences, the nearest of all first, ties by the earlier times.

    In rounds: values that are each other's nearest are paired and leave, as nothing nearer can come for either; those without a partner
    within the tolerance leave too. A round pairs at least the two that are nearest of all.
    """
    x, at = np.unique(reference, return_index=True)
    y, to = np.unique(estimate, return_index=True)
    out = []
    while len(x) and len(y):
        there, back = nearest_of(x, y), nearest_of(y, x)
        i = np.flatnonzero(back[there] == np.arange(len(x)))
        i = i[np.abs(y[there[i]] - x[i]) <= tolerance]
        if not len(i):
            break
        j = there[i]
        out += zip(at[i].tolist(), to[j].tolist())
        x, at, y, to = np.delete(x, i), np.delete(at, i), np.delete(y, j), np.delete(to, j)
    return sorted(out)


def clock_fit(pairs: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """(by, n, slope, intercept) of y over x; null below two points."""
    n = F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1))
    return pairs.groupBy(*by).agg(n.alias("n"), F.when(n >= 2, F.regr_slope(y, x)).alias("slope"),
                                  F.when(n >= 2, F.regr_intercept(y, x)).alias("intercept"))



def first_known(*columns: str) -> Column:
    """Identity from several joined sources: the first that knows it."""
    return F.coalesce(*columns)


def through_clock(df: DataFrame, pairs: DataFrame, by: Sequence[str], x: str, y: str, out: str) -> DataFrame:
    """`df` with `out`: its x on the clock that the pairs of its key fit; null without a fit. Keys of clocks are unique."""
    fit = clock_fit(pairs, by, x, y).select(*by, "slope", "intercept")
    return df.join(fit, list(by), "left").withColumn(out, F.col("slope") * F.col(x) + F.col("intercept")).drop("slope", "intercept")


def suffixed_join(left: DataFrame, right: DataFrame, by: Sequence[str], suffix: str) -> DataFrame:
    """Left join on exact keys; columns of the right side that both have take the suffix, so both stay for audits."""
    renamed = right.select(*[F.col(c) if c in by or c not in left.columns else F.col(c).alias(c + suffix) for c in right.columns])
    return left.join(renamed, list(by), "left")


def lookup(left: DataFrame, right: DataFrame, by: Sequence[str], defaults: dict[str, str]) -> DataFrame:
    """Left join on a composite key; columns without a match take their default."""
    return left.join(right, list(by), "left").na.fill(defaults) if defaults else left.join(right, list(by), "left")


def arms_side_by_side(long: DataFrame, keys: Sequence[str], arm: str, value: str, arms: Sequence[str]) -> DataFrame:
    """(keys, one column for each arm) for the keys that all arms have: a conditional pivot in place of a self-join."""
    wide = long.groupBy(*keys).agg(*[F.max(F.when(F.col(arm) == a, F.col(value))).alias(a) for a in arms])
    return wide.where(functools.reduce(lambda x, y: x & y, [F.col(a).isNotNull() for a in arms]))


def fold_sizes(rows: DataFrame, group: str) -> DataFrame:
    """(fold_id, held_out, n_train, n_test) of leave-one-group-out folds, from the counts of the groups."""
    counts = rows.groupBy(F.col(group).alias("held_out")).agg(F.count("*").alias("n_test"))
    every = Window.partitionBy()    # over grouped rows
    return counts.select(F.format_string("LOSO_%03d", F.dense_rank().over(Window.orderBy("held_out"))).alias("fold_id"), "held_out",
                         (F.sum("n_test").over(every) - F.col("n_test")).alias("n_train"), "n_test")
