"""Windows before probes and other joins in time. Sign-ups are probes, all other events are trials."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.functions import expressions as X
from spanloom.operators import aggregates, joins
from spanloom.plans.registry import EVENTS_SQL, HOUR, events, q6, query, r6

WIDTHS = (6, 24, 72)


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).where("event_type = 'signup'").select(F.col("event_id").alias("probe_id"), "user_id", F.col("ms").alias("onset"))


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).where("event_type <> 'signup'")
    return e.select("user_id", "ms", F.when(F.col("event_type").isin("click", "purchase"), F.col("value")).alias("rt"),
                    (F.col("event_type") == "error").cast("int").alias("error"), (F.col("event_type") == "view").cast("int").alias("omission"))


PROBES_SQL = f"""{EVENTS_SQL},
pr AS (SELECT event_id AS probe_id, user_id, ms AS onset FROM ev WHERE event_type = 'signup'),
tr AS (SELECT user_id, ms, CASE WHEN event_type IN ('click', 'purchase') THEN value END AS rt,
  CAST(event_type = 'error' AS INT) AS error, CAST(event_type = 'view' AS INT) AS omission FROM ev WHERE event_type <> 'signup'),
wd AS (SELECT unnest([6, 24, 72]) AS width_h)"""


@query(f"""WITH {PROBES_SQL},
w AS (SELECT probe_id, width_h, onset, ms, rt, error, omission FROM pr CROSS JOIN wd
  LEFT JOIN tr ON tr.user_id = pr.user_id AND ms >= onset - width_h * {HOUR} AND ms < onset),
m AS (SELECT probe_id, width_h, median(rt) AS md FROM w GROUP BY 1, 2)
SELECT w.probe_id, w.width_h, count(ms) AS trial_count, {q6('avg(rt)')} AS rt_mean, {q6('max(md)')} AS rt_median,
 {q6('stddev_samp(rt)')} AS rt_sd, {q6('median(abs(rt - md))')} AS rt_mad, {q6('stddev_samp(rt) / nullif(avg(rt), 0)')} AS rt_cv,
 CASE WHEN count(rt) >= 2 THEN {q6(f'regr_slope(rt, (ms - onset) / {HOUR}.0)')} END AS rt_slope,
 {q6('1 - avg(error)')} AS accuracy, CAST(sum(error) AS BIGINT) AS error_count, {q6('avg(error)')} AS error_rate,
 CAST(sum(omission) AS BIGINT) AS omission_count, {q6('avg(omission)')} AS omission_rate
FROM w JOIN m ON m.probe_id = w.probe_id AND m.width_h = w.width_h GROUP BY 1, 2""")
def preevent_window_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    # one join with the widest window; a row counts in each width that holds it
    w = joins.lookback_join(probes(spark, sf_dir), trials(spark, sf_dir), ["user_id"], "onset", "ms", max(WIDTHS) * HOUR, max(WIDTHS) * HOUR)
    w = w.withColumn("width_h", F.explode(F.array(*map(F.lit, WIDTHS))))
    inside = F.col("onset") - F.col("ms") <= F.col("width_h").cast("long") * HOUR
    w = w.select("probe_id", "width_h", F.when(inside, (F.col("ms") - F.col("onset")) / HOUR).alias("at"), *[F.when(inside, F.col(c)).alias(c) for c in ("rt", "error", "omission")])
    f = aggregates.behaviour_features(w, ["probe_id", "width_h"], "at", "rt", "error", "omission")
    counts = ("trial_count", "error_count", "omission_count")
    return f.select("probe_id", "width_h", *[F.col(c) if c in counts else r6(c).alias(c) for c in f.columns[2:]])


@query(f"""WITH {PROBES_SQL},
w AS (SELECT probe_id, width_h, count(ms) AS n, avg(error) AS er, median(rt) AS md FROM pr CROSS JOIN wd
  LEFT JOIN tr ON tr.user_id = pr.user_id AND ms >= onset - width_h * {HOUR} AND ms < onset GROUP BY 1, 2)
SELECT probe_id, {', '.join(f"max(n) FILTER (width_h = {h}) AS n_{h}, {q6(f'max(er) FILTER (width_h = {h})')} AS error_{h}, {q6(f'max(md) FILTER (width_h = {h})')} AS rt_{h}" for h in WIDTHS)}
FROM w GROUP BY 1""")
def preevent_window_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    # one join with the widest window; the narrower ones are conditions on the distance
    w = joins.lookback_join(probes(spark, sf_dir), trials(spark, sf_dir), ["user_id"], "onset", "ms", max(WIDTHS) * HOUR, max(WIDTHS) * HOUR)
    back = F.col("onset") - F.col("ms")
    inside = {h: back <= h * HOUR for h in WIDTHS}
    return w.groupBy("probe_id").agg(*[x for h, ok in inside.items() for x in (
        F.count(F.when(ok, 1)).alias(f"n_{h}"), r6(F.avg(F.when(ok, F.col("error")))).alias(f"error_{h}"),
        r6(F.median(F.when(ok, F.col("rt")))).alias(f"rt_{h}"))])


NEAREST = """WITH {ev},
a AS (SELECT event_id, user_id, ms FROM ev WHERE event_type = 'purchase'),
b AS (SELECT user_id, ms AS vms, min(value) AS v FROM ev WHERE event_type = 'view' GROUP BY 1, 2),
c AS (SELECT event_id, ms, vms, v, row_number() OVER (PARTITION BY event_id ORDER BY abs(ms - vms), vms) AS rn FROM a LEFT JOIN b USING (user_id))
SELECT event_id, {pick} FROM c WHERE rn = 1"""


def _nearest(spark: SparkSession, sf_dir: str, tolerance: int | None) -> DataFrame:
    e = events(spark, sf_dir)
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "ms")
    right = e.where("event_type = 'view'").select("user_id", F.col("ms").alias("vms"), "value")
    out = joins.nearest(left, right, ["user_id"], "ms", "vms", "value", tolerance)
    return out.select("event_id", F.col("nearest_time").alias("vms"), r6("nearest_value").alias("v"), "distance")


@query(NEAREST.format(ev=EVENTS_SQL, pick=f"vms, {q6('v')} AS v, abs(ms - vms) AS distance"))
def asof_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir, None)


@query(NEAREST.format(ev=EVENTS_SQL, pick=f"CASE WHEN abs(ms - vms) <= {HOUR} THEN vms END AS vms, "
                      f"CASE WHEN abs(ms - vms) <= {HOUR} THEN {q6('v')} END AS v, abs(ms - vms) AS distance"))
def asof_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir, HOUR)


PHASES_SQL = f"""{EVENTS_SQL},
iv AS (SELECT user_id, event_type AS label, min(ms) AS lo, max(ms) AS hi FROM ev WHERE event_type IN ('error', 'signup') GROUP BY 1, 2)"""


@query(f"""WITH {PHASES_SQL},
h AS (SELECT event_id, label, row_number() OVER (PARTITION BY event_id ORDER BY lo, hi, label) AS rn FROM ev JOIN iv USING (user_id)
  WHERE event_type = 'click' AND ms BETWEEN lo AND hi)
SELECT ev.event_id, coalesce(label, 'outside') AS label FROM ev LEFT JOIN h ON h.event_id = ev.event_id AND rn = 1 WHERE event_type = 'click'""")
def interval_point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    phases = e.where(F.col("event_type").isin("error", "signup")).groupBy("user_id", F.col("event_type").alias("phase")).agg(
        F.min("ms").alias("lo"), F.max("ms").alias("hi"))
    points = e.where("event_type = 'click'").select("event_id", "user_id", "ms")
    return joins.interval_lookup(points, phases, ["user_id"], "ms", "lo", "hi", "phase", ["event_id"], "outside", span=24 * HOUR).select("event_id", "label")


@query(f"""WITH {EVENTS_SQL}
SELECT s.event_id, s.user_id, s.ms AS start_ms, min(e.ms) AS end_ms FROM ev s
LEFT JOIN ev e ON e.user_id = s.user_id AND e.event_type = 'purchase' AND e.ms > s.ms WHERE s.event_type = 'signup' GROUP BY 1, 2, 3""")
def marker_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).where("event_type IN ('signup', 'purchase')")
    order = Window.partitionBy("user_id").orderBy("ms").rangeBetween(1, Window.unboundedFollowing)
    end = F.min(F.when(F.col("event_type") == "purchase", F.col("ms"))).over(order)
    return e.select("event_id", "user_id", "event_type", F.col("ms").alias("start_ms"), end.alias("end_ms")).where(
        "event_type = 'signup'").drop("event_type")


@query(f"""WITH {EVENTS_SQL},
a AS (SELECT user_id, ms, row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id) AS position FROM ev WHERE event_type = 'click'),
b AS (SELECT user_id, ms AS other, row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id) AS position FROM ev WHERE event_type = 'view')
SELECT user_id, CAST(position AS INT) AS position, other - ms AS gap FROM a JOIN b USING (user_id, position)""")
def positional_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    a = e.where("event_type = 'click'").select("user_id", "ms", F.col("event_id").alias("i"))
    b = e.where("event_type = 'view'").select("user_id", F.col("ms").alias("other"), F.col("event_id").alias("j"))
    z = joins.zip_join(a, b, ["user_id"], ["ms", "i"], ["other", "j"])
    return z.select("user_id", "position", (F.col("other") - F.col("ms")).alias("gap"))


@query("""SELECT a.c_custkey, b.s_suppkey, round_even(a.c_acctbal / 100, 0) AS rounded FROM customer a JOIN supplier b
ON a.c_nationkey = b.s_nationkey AND round_even(a.c_acctbal / 100, 0) = round_even(b.s_acctbal / 100, 0)""")
def rounded_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanloom.plans.registry import read

    a = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), (F.col("c_acctbal") / 100).alias("x"))
    b = read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), (F.col("s_acctbal") / 100).alias("y"))
    return joins.rounded_join(a, b, ["nation"], "x", "y", 0).select("c_custkey", "s_suppkey", "rounded")


@query(f"""WITH {PROBES_SQL}
SELECT probe_id, count(ms) AS n, sha256(coalesce(string_agg(CAST(ms AS VARCHAR), ',' ORDER BY ms), '')) AS digest
FROM pr LEFT JOIN tr ON tr.user_id = pr.user_id AND ms >= onset - {24 * HOUR} AND ms < onset GROUP BY 1""")
def digest_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = joins.lookback_join(probes(spark, sf_dir), trials(spark, sf_dir), ["user_id"], "onset", "ms", 24 * HOUR, 24 * HOUR)
    return w.groupBy("probe_id").agg(F.count("ms").alias("n"), F.collect_list("ms").alias("m")).select(
        "probe_id", "n", X.membership_digest(F.col("m")).alias("digest"))


@query(f"""WITH {PROBES_SQL}
SELECT probe_id, count(ms) AS n FROM pr LEFT JOIN tr ON tr.user_id = pr.user_id AND ms >= onset - {24 * HOUR} AND ms <= onset GROUP BY 1""")
def legacy_closed_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = joins.lookback_join(probes(spark, sf_dir), trials(spark, sf_dir), ["user_id"], "onset", "ms", 24 * HOUR, 24 * HOUR, closed=True)
    return w.groupBy("probe_id").agg(F.count("ms").alias("n"))


@query(f"""WITH {EVENTS_SQL},
p AS (SELECT user_id, ms / {HOUR}.0 AS x, row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id) AS y FROM ev)
SELECT user_id, count(*) AS n, CASE WHEN count(*) >= 2 THEN {q6('regr_slope(y, x - 473000)')} END AS slope FROM p GROUP BY 1""")
def clock_fit_regr(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    order = Window.partitionBy("user_id").orderBy("ms", "event_id")
    pairs = e.select("user_id", (F.col("ms") / HOUR - 473000).alias("x"), F.row_number().over(order).alias("y"))
    return joins.clock_fit(pairs, ["user_id"], "x", "y").select("user_id", "n", r6("slope").alias("slope"))


@query(f"""WITH {EVENTS_SQL},
w AS (SELECT *, CAST(floor(ms / {HOUR}.0) AS BIGINT) AS win, ms - {HOUR} * CAST(floor(ms / {HOUR}.0) AS BIGINT) AS inside FROM ev)
SELECT event_id, win, inside BETWEEN 300000 AND {HOUR - 300000} AS core,
 lag(win) OVER (PARTITION BY user_id ORDER BY ms, event_id) AS last_win, lead(win) OVER (PARTITION BY user_id ORDER BY ms, event_id) AS next_win FROM w""")
def window_core_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    win = F.floor(F.col("ms") / HOUR)
    e = events(spark, sf_dir).withColumn("win", win).withColumn("inside", F.col("ms") - HOUR * F.col("win"))
    order = Window.partitionBy("user_id").orderBy("ms", "event_id")
    return e.select("event_id", "win", F.col("inside").between(300000, HOUR - 300000).alias("core"),
                    F.lag("win").over(order).alias("last_win"), F.lead("win").over(order).alias("next_win"))


@query(f"""WITH {EVENTS_SQL},
g AS (SELECT user_id, ms, ms - lag(ms) OVER (PARTITION BY user_id ORDER BY ms) AS gap FROM ev),
pr AS (SELECT event_id, user_id, ms AS onset FROM ev WHERE event_type = 'signup')
SELECT event_id, count(gap) FILTER (gap > {HOUR}) AS n_1h, count(gap) FILTER (gap > {6 * HOUR}) AS n_6h, coalesce(max(gap), 0) AS longest,
 CAST(coalesce(sum(gap), 0) AS BIGINT) AS total FROM pr LEFT JOIN g ON g.user_id = pr.user_id AND ms >= onset - {72 * HOUR} AND ms < onset AND gap IS NOT NULL GROUP BY 1""")
def gap_burden(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    g = e.select("user_id", "ms", (F.col("ms") - F.lag("ms").over(Window.partitionBy("user_id").orderBy("ms"))).alias("gap")).where("gap is not null")
    p = e.where("event_type = 'signup'").select("event_id", "user_id", F.col("ms").alias("onset"))
    w = joins.lookback_join(p, g, ["user_id"], "onset", "ms", 72 * HOUR, 72 * HOUR)
    return w.groupBy("event_id").agg(F.count_if(F.col("gap") > HOUR).alias("n_1h"), F.count_if(F.col("gap") > 6 * HOUR).alias("n_6h"),
                                     F.coalesce(F.max("gap"), F.lit(0)).alias("longest"), F.coalesce(F.sum("gap"), F.lit(0)).alias("total"))


@query(f"""WITH RECURSIVE {EVENTS_SQL}, a AS (SELECT user_id, ms, row_number() OVER (PARTITION BY user_id ORDER BY ms) AS i FROM ev WHERE event_type = 'click'),
b AS (SELECT user_id, ms, row_number() OVER (PARTITION BY user_id ORDER BY ms) AS j FROM ev WHERE event_type = 'view'),
w AS (SELECT DISTINCT user_id, CAST(1 AS BIGINT) AS i, CAST(1 AS BIGINT) AS j, CAST(NULL AS BIGINT) AS gap FROM ev
 UNION ALL SELECT w.user_id, CASE WHEN abs(b.ms - a.ms) <= {HOUR} OR b.ms - a.ms > 0 THEN w.i + 1 ELSE w.i END, CASE WHEN abs(b.ms - a.ms) <= {HOUR} OR b.ms - a.ms < 0 THEN w.j + 1 ELSE w.j END,
  CASE WHEN abs(b.ms - a.ms) <= {HOUR} THEN abs(b.ms - a.ms) END FROM w JOIN a ON a.user_id = w.user_id AND a.i = w.i JOIN b ON b.user_id = w.user_id AND b.j = w.j),
m AS (SELECT user_id, count(gap) AS n, avg(gap) / 1000 AS mae FROM w GROUP BY 1),
c AS (SELECT user_id, count(*) FILTER (event_type = 'click') AS r, count(*) FILTER (event_type = 'view') AS e FROM ev GROUP BY 1)
SELECT user_id, n, {q6('mae')} AS mae, {q6('n / CAST(nullif(e, 0) AS DOUBLE)')} AS precision, {q6('n / CAST(nullif(r, 0) AS DOUBLE)')} AS recall, {q6('2 * n / CAST(nullif(e + r, 0) AS DOUBLE)')} AS f1 FROM m JOIN c USING (user_id)""")
def monotone_match_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of clicks and views within an hour, in order and one to one, with precision, recall and F1 by user."""
    e = events(spark, sf_dir).select("user_id", "event_type", (F.col("ms") / 1000).alias("t"))
    a, b = e.where("event_type = 'click'"), e.where("event_type = 'view'")
    pairs = joins.monotone_match(a, b, ["user_id"], "t", 3600.0)
    n = e.groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("n_ref"), F.count_if(F.col("event_type") == "view").alias("n_est"))
    m = pairs.groupBy("user_id").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("estimate_time") - F.col("reference_time"))).alias("mae"))
    j = n.join(m, "user_id", "left").na.fill(0, ["n"])
    return j.select("user_id", "n", r6("mae").alias("mae"), r6(F.col("n") / F.nullif("n_est", F.lit(0))).alias("precision"),
                    r6(F.col("n") / F.nullif("n_ref", F.lit(0))).alias("recall"), r6(2 * F.col("n") / F.nullif(F.col("n_est") + F.col("n_ref"), F.lit(0))).alias("f1"))


LAGS = [-6, -3, 0, 3, 6]


@query(f"""WITH RECURSIVE {EVENTS_SQL}, a AS (SELECT user_id, ms, row_number() OVER (PARTITION BY user_id ORDER BY ms) AS i FROM ev WHERE event_type = 'click'),
b AS (SELECT user_id, ms, row_number() OVER (PARTITION BY user_id ORDER BY ms) AS j FROM ev WHERE event_type = 'view'), l AS (SELECT unnest({LAGS}) * {HOUR} AS lag),
w AS (SELECT DISTINCT user_id, lag, CAST(1 AS BIGINT) AS i, CAST(1 AS BIGINT) AS j, false AS hit FROM ev, l
 UNION ALL SELECT w.user_id, w.lag, CASE WHEN abs(b.ms - lag - a.ms) <= {HOUR} OR b.ms - lag - a.ms > 0 THEN w.i + 1 ELSE w.i END, CASE WHEN abs(b.ms - lag - a.ms) <= {HOUR} OR b.ms - lag - a.ms < 0 THEN w.j + 1 ELSE w.j END,
  abs(b.ms - lag - a.ms) <= {HOUR} FROM w JOIN a ON a.user_id = w.user_id AND a.i = w.i JOIN b ON b.user_id = w.user_id AND b.j = w.j)
SELECT user_id, CAST(lag AS BIGINT) AS lag, count(*) FILTER (hit) AS n FROM w GROUP BY 1, 2 HAVING count(*) FILTER (hit) > 0""")
def lag_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of clicks and views within an hour, in order and one to one, as the views are moved by some hours."""
    from spanloom.operators.signal import lag_sweep as sweep

    e = events(spark, sf_dir).select("user_id", "event_type", "ms")
    a, b = (e.where(F.col("event_type") == kind).select("user_id", "ms") for kind in ("click", "view"))
    return sweep(a, b, ["user_id"], "ms", HOUR, [k * HOUR for k in LAGS]).select("user_id", F.col("lag").cast("long").alias("lag"), "n")
