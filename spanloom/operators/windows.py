"""Ordered and partitioned analytics: ordinals, ranks, runs, folds, multiple-testing steps."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators.aggregates import percentiles


def position_share(by: Sequence[str], order: Sequence[str]) -> Column:
    """Zero-based position over the last position of the group; 0 for a single row."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return F.coalesce((rank - 1) / F.nullif(n - 1, F.lit(0)), F.lit(0.0))


def group_weight(by: Sequence[str]) -> Column:
    return 1.0 / F.count(F.lit(1)).over(Window.partitionBy(*by))


def average_rank(by: Sequence[str], value: str) -> Column:
    """Rank from 1 with ties sharing their mean rank."""
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (
        F.count(F.lit(1)).over(Window.partitionBy(*by, value)) - 1) / 2


def spearman(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = rows.select(*by, average_rank(by, x).alias("__x"), average_rank(by, y).alias("__y"))
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), F.corr("__x", "__y").alias("rho"))


def spearman_by_values(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """As `spearman`, for few and large groups: ranks come from counts of the distinct values, so no window holds the rows of a group."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).alias("__x"), F.col(y).alias("__y"))

    def ranks(column: str) -> DataFrame:
        steps = rows.groupBy(*by, column).agg(F.count("*").alias("n"))
        below = F.sum("n").over(Window.partitionBy(*by).orderBy(column)) - F.col("n")
        return steps.select(*by, column, (below + (F.col("n") + 1) / 2).alias(f"{column}r"))

    return rows.join(ranks("__x"), [*by, "__x"]).join(ranks("__y"), [*by, "__y"]).groupBy(*by).agg(F.count("*").alias("n"), F.corr("__xr", "__yr").alias("rho"))


def z_scored(df: DataFrame, by: Sequence[str], value: str, out: str, sample: bool = False, epsilon: float = 1e-9) -> DataFrame:
    """`df` with the z-score of a value, for few and large groups: statistics by map-side combine, joined back."""
    sd = F.stddev_samp(value) if sample else F.stddev_pop(value) + epsilon
    stats = df.groupBy(*by).agg(F.avg(value).alias("__m"), sd.alias("__s"))
    return df.join(stats, list(by)).withColumn(out, (F.col(value) - F.col("__m")) / F.col("__s")).drop("__m", "__s")


def sorted_index(df: DataFrame, coarse: Column, order: Sequence[str], name: str) -> DataFrame:
    """`df` with its position, from 0, in the order of all rows, which `coarse` must not contradict.

    Rows are numbered within each value of `coarse`; only the counts of its values are summed up in one task.
    """
    marked = df.withColumn("__coarse", coarse)
    counts = marked.groupBy("__coarse").agg(F.count("*").alias("__n"))
    before = counts.select("__coarse", (F.sum("__n").over(Window.orderBy("__coarse")) - F.col("__n")).alias("__before"))
    within = F.row_number().over(Window.partitionBy("__coarse").orderBy(*order)) - 1
    return marked.join(before, "__coarse").withColumn(name, F.col("__before") + within).drop("__coarse", "__before")


def head_of_each(df: DataFrame, by: Sequence[str], order: Sequence[str], k: int) -> DataFrame:
    """The first k rows of each key in order. Spark keeps k rows a key on each side of the shuffle."""
    return top_k(df, by, [F.col(c) for c in order], k).drop("rank")


def runs(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """(by, value, run, length): maximal runs of one value in order."""
    here, among = Window.partitionBy(*by).orderBy(*order), Window.partitionBy(*by, value).orderBy(*order)
    island = df.select(*by, value, (F.row_number().over(here) - F.row_number().over(among)).alias("run"))
    return island.groupBy(*by, value, "run").agg(F.count("*").alias("length"))


def longest_run(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    return runs(df, by, order, value).groupBy(*by).agg(F.max("length").alias("longest"))


def switches(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """(by, n, switches, rate): how often the value changes from one row to the next."""
    last = F.lag(value).over(Window.partitionBy(*by).orderBy(*order))
    changed = df.select(*by, (F.col(value) != last).alias("__c"), last.isNotNull().alias("__s"))
    return changed.groupBy(*by).agg(F.count("*").alias("n"), F.count_if("__c").alias("switches"),
                                    (F.count_if("__c") / F.nullif(F.count_if("__s"), F.lit(0))).alias("rate"))


def isolated(df: DataFrame, by: Sequence[str], order: str, gap: float) -> DataFrame:
    """Rows at least `gap` from both neighbours; a side without neighbour is far enough."""
    w = Window.partitionBy(*by).orderBy(order)
    far = lambda c: F.coalesce(c >= gap, F.lit(True))
    marked = df.withColumn("__ok", far(F.col(order) - F.lag(order).over(w)) & far(F.lead(order).over(w) - F.col(order)))
    return marked.where("__ok").drop("__ok")


def z_score(by: Sequence[str], value: str, sample: bool = False, epsilon: float = 1e-9) -> Column:
    w = Window.partitionBy(*by)
    sd = F.stddev_samp(value) if sample else F.stddev_pop(value)
    return (F.col(value) - F.avg(value).over(w)) / (sd.over(w) + (0.0 if sample else epsilon))


def half(by: Sequence[str], order: Sequence[str]) -> Column:
    """first for the first max(1, n // 2) rows of a group, then second."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return F.when(rank <= F.greatest(F.lit(1), F.floor(n / 2)), "first").otherwise("second")


def equal_parts(df: DataFrame, by: Sequence[str], order: Sequence[str], parts: int = 4) -> DataFrame:
    """`df` with part 0 to parts-1 of n // parts rows each; the rows left over go."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    part = F.floor((rank - 1) / F.nullif(F.floor(n / parts), F.lit(0)))
    return df.withColumn("part", part.cast("int")).where(F.col("part") < parts)


def first_row(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= k)


def best_and_margin(df: DataFrame, by: Sequence[str], value: str, label: str) -> DataFrame:
    """(by, best, margin): label of the largest value, and its lead over the runner-up."""
    top = top_k(df, by, [F.desc(value), F.col(label)], 2)
    return top.groupBy(*by).agg(F.max(F.when(F.col("rank") == 1, F.col(label))).alias("best"),
                                (F.max(F.when(F.col("rank") == 1, F.col(value))) - F.max(F.when(F.col("rank") == 2, F.col(value)))).alias("margin"))


def benjamini_hochberg(df: DataFrame, by: Sequence[str], p: str, tie: str) -> DataFrame:
    """`df` with q: adjusted p-values within the group, ordered by p, then `tie`."""
    w = Window.partitionBy(*by).orderBy(F.asc_nulls_last(p), tie)
    raw = F.col(p) * F.count(F.lit(1)).over(Window.partitionBy(*by)) / F.row_number().over(w)
    marked = df.withColumn("__raw", raw)
    # Spark walks all later rows anew for each row of a frame up to the last one; the reverse order's frame runs on
    suffix = Window.partitionBy(*by).orderBy(F.desc_nulls_first(p), F.desc(tie)).rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("q", F.least(F.min("__raw").over(suffix), F.lit(1.0))).drop("__raw")


def holm(df: DataFrame, by: Sequence[str], p: str, tie: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(p, tie)
    raw = F.col(p) * (F.count(F.lit(1)).over(Window.partitionBy(*by)) - F.row_number().over(w) + 1)
    marked = df.withColumn("__raw", raw)
    prefix = w.rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("holm", F.least(F.max("__raw").over(prefix), F.lit(1.0))).drop("__raw")


def moving_mean(by: Sequence[str], order: Sequence[str], value: str, width: int = 5) -> Column:
    """Mean over a centred window of constant width; what lies outside counts as 0."""
    reach = width // 2
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(-reach, reach)
    return F.sum(value).over(w) / width


def gated_anchor(df: DataFrame, by: Sequence[str], order: str, value: str, confidence: str, keep: float = 0.8,
                 least: float = 0.12) -> DataFrame:
    """(by, order, anchor): an anchor carried through each group in order.

    The first finite value sets it; later finite values move it to keep * anchor + (1 - keep) *
    value if their confidence reaches `least`. The state starts anew with each group.
    """
    def step(anchor: float | None, row: tuple) -> tuple[float | None, float | None]:
        v, c = row
        if v is not None and v == v:
            anchor = v if anchor is None else anchor * keep + v * (1 - keep) if c is not None and c >= least else anchor
        return anchor, anchor

    rows = df.select(*by, order, F.col(value).cast("double").alias("__v"), F.col(confidence).cast("double").alias("__c"))
    return ordered_fold(rows, by, [order], ["__v", "__c"], None, step, "anchor double").select(*by, order, "anchor")


def ordered_fold(df: DataFrame, by: Sequence[str], order: Sequence[str], columns: Sequence[str], start, step, result: str) -> DataFrame:
    """(by, order, result): a value carried from row to row of each key in order: `step(state, values)` gives the next state and the row's result.

    Rows are sorted within partitions by Spark and walked batch by batch, so a key's rows are never held together. The
    state starts anew with each key; columns that aren't numbers come as they are, missing numbers as None.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join([*[f"{c} {kinds[c]}" for c in (*by, *order)], result])
    name = result.split()[0]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, start
        for batch in batches:
            keys = list(zip(*[batch[c].tolist() for c in by]))
            cells = batch[list(columns)].astype(object)
            values = zip(*[cells[c].where(cells[c].notna(), None).tolist() for c in columns])
            out = []
            for key, row in zip(keys, values):
                if key != last:
                    last, state = key, start
                state, found = step(state, row)
                out.append(found)
            yield batch[[*by, *order]].assign(**{name: pd.Series(out, index=batch.index, dtype=object)})

    rows = df.select(*by, *order, *columns).repartition(*by).sortWithinPartitions(*by, *order)
    return rows.mapInPandas(walk, schema)


def jackknife_correlation(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """(by, low, high): range of the correlation as each row in turn is left out, from total sums."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    w = Window.partitionBy(*by)
    left = {"n": F.count("x").over(w) - 1}
    for name, e in {"sx": F.col("x"), "sy": F.col("y"), "sxx": F.col("x") * F.col("x"), "syy": F.col("y") * F.col("y"), "sxy": F.col("x") * F.col("y")}.items():
        left[name] = F.sum(e).over(w) - e
    s = rows.select(*by, *[c.alias(n) for n, c in left.items()])
    r = (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / F.nullif(
        F.sqrt(F.greatest(F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx"), F.lit(0.0)))
        * F.sqrt(F.greatest(F.col("n") * F.col("syy") - F.col("sy") * F.col("sy"), F.lit(0.0))), F.lit(0.0))
    return s.groupBy(*by).agg(F.min(r).alias("low"), F.max(r).alias("high"))


def inside_fences(df: DataFrame, by: Sequence[str], value: str, reach: float = 1.5) -> DataFrame:
    """Rows within reach * IQR of the quartiles of their group, for few and large groups."""
    q = percentiles(df, by, value, (0.25, 0.75)).withColumnRenamed("percentiles", "__q")
    lo, hi = F.col("__q")[0], F.col("__q")[1]
    return df.join(q, list(by)).where(F.col(value).between(lo - reach * (hi - lo), hi + reach * (hi - lo))).drop("__q")


def jump_mask(by: Sequence[str], order: Sequence[str], value: str, share: float = 0.2) -> tuple[Column, Column]:
    """Whether a row jumps from the one before, or the next jumps from it, by over a share of the earlier value. Any step from 0 is a jump."""
    w = Window.partitionBy(*by).orderBy(*order)

    def jumps(earlier: Column, later: Column) -> Column:
        return F.when(earlier == 0, later != 0).otherwise(F.abs(later - earlier) / earlier > share)

    here, ahead = jumps(F.lag(value).over(w), F.col(value)), jumps(F.col(value), F.lead(value).over(w))
    return F.coalesce(here, F.lit(False)), F.coalesce(ahead, F.lit(False))


def gap_sessions(df: DataFrame, by: Sequence[str], time: str, gap: float) -> DataFrame:
    """`df` with session: a number from 1 that grows where the gap to the row before is `gap` or more."""
    w = Window.partitionBy(*by).orderBy(time)
    marked = df.withColumn("__new", F.when(F.col(time) - F.lag(time).over(w) >= gap, 1).otherwise(0))
    return marked.withColumn("session", 1 + F.sum("__new").over(w.rangeBetween(Window.unboundedPreceding, 0))).drop("__new")
