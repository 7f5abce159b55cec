"""Window kernels over the driver's tables: events of a user are a series, its values samples."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.functions import expressions as X
from spanloom.operators import audits, joins, rhythm
from spanloom.operators import signal as S
from spanloom.plans.registry import EVENTS_SQL, HOUR, events, q6, query, r6, read

ORDER = "OVER (PARTITION BY user_id ORDER BY ms, event_id)"
TURN = 2 * math.pi


@query(f"""WITH {EVENTS_SQL}, p AS (SELECT event_id, user_id, ms, value - {TURN} * floor(value / {TURN}) AS phi FROM ev),
d AS (SELECT *, phi - lag(phi) {ORDER} AS d FROM p), w AS (SELECT *, coalesce(d - {TURN} * floor((d + {math.pi}) / {TURN}), 0) AS step FROM d)
SELECT event_id, {q6(f'(first_value(phi) {ORDER} + sum(step) OVER (PARTITION BY user_id ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING)) * {5.0 / (4 * math.pi)}')} AS displacement FROM w""")
def phase_displacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = events(spark, sf_dir).select("event_id", "user_id", "ms", (F.col("value") - TURN * F.floor(F.col("value") / TURN)).alias("phi"))
    return S.displacement(p, ["user_id"], ["ms", "event_id"], "phi", 5.0).select("event_id", r6("displacement").alias("displacement"))


@query(f"""WITH {EVENTS_SQL}, x AS (SELECT event_id, user_id, value, ms / {HOUR}.0 - 473000 AS t FROM ev), f AS (SELECT user_id, regr_slope(value, t) AS s, regr_intercept(value, t) AS i FROM x GROUP BY 1 HAVING count(*) > 2)
SELECT event_id, {q6('value - (s * t + i)')} AS detrended FROM x JOIN f USING (user_id)""")
def detrended(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select("event_id", "user_id", "value", (F.col("ms") / HOUR - 473000).alias("t"))
    many = e.groupBy("user_id").agg(F.count("*").alias("n")).where("n > 2").select("user_id")
    return S.detrended(e.join(many, "user_id"), ["user_id"], "t", "value").select("event_id", r6("detrended").alias("detrended"))


@query(f"""WITH {EVENTS_SQL} SELECT event_id, CASE WHEN stddev_pop(value) OVER (PARTITION BY user_id ORDER BY ms, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) >= 20 THEN {q6('value')} END AS gated FROM ev""")
def signal_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("at", F.struct("ms", "event_id"))
    return e.select("event_id", r6(S.gated_std(["user_id"], "at", "value", 4, 20)).alias("gated"))


@query(f"""SELECT l_orderkey, l_linenumber, {q6('l_quantity - avg(l_quantity) OVER (PARTITION BY l_orderkey)')} AS re, {q6('l_discount - avg(l_discount) OVER (PARTITION BY l_orderkey)')} AS im FROM lineitem""")
def mean_subtracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("re"), F.col("l_discount").cast("double").alias("im"))
    return S.mean_subtracted(c, ["l_orderkey"]).select("l_orderkey", "l_linenumber", r6("re").alias("re"), r6("im").alias("im"))


@query("""WITH c AS (SELECT l_orderkey AS k, CAST(l_quantity AS INT) AS bin, l_linenumber AS channel, l_extendedprice AS snr, 1 - l_discount AS stability FROM lineitem WHERE CAST(l_quantity AS INT) * CAST(0.05 AS DOUBLE) + CAST(0.1 AS DOUBLE) BETWEEN CAST(0.3 AS DOUBLE) AND CAST(1.5 AS DOUBLE)),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY snr * stability DESC, bin, channel) AS rn FROM c) SELECT k, bin, channel FROM r WHERE rn = 1""")
def gated_best_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_quantity").cast("int").alias("bin"), F.col("l_linenumber").alias("channel"),
                                               F.col("l_extendedprice").alias("snr"), (1 - F.col("l_discount")).alias("stability"))
    return S.best_bin(c.where(S.bin_distance(F.col("bin"), 0.05, 0.1).between(0.3, 1.5)), ["k"], "snr", "stability")


@query(f"""WITH {EVENTS_SQL}, p AS (SELECT *, lag(value) {ORDER} AS a, lead(value) {ORDER} AS b FROM ev) SELECT event_id FROM p WHERE value > a AND value >= b AND value >= 50""")
def local_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("at", F.struct("ms", "event_id"))
    return S.local_peaks(e, ["user_id"], "at", "value", 50).select("event_id")


IBI = f"""WITH {EVENTS_SQL}, i AS (SELECT user_id, (ms - lag(ms) OVER (PARTITION BY user_id ORDER BY ms)) / {HOUR}.0 AS ibi FROM ev),
k AS (SELECT user_id, ibi, greatest(round_even(ibi / 20, 0), 1) AS k FROM i WHERE ibi BETWEEN 60 / 60.0 AND 60 / 0.5),
s AS (SELECT user_id, CASE WHEN k BETWEEN 2 AND 3 AND abs(ibi / k - 20) <= 0.22 * 20 THEN ibi / k ELSE ibi END AS ibi FROM k),
m AS (SELECT user_id, median(ibi) AS m FROM s GROUP BY 1 HAVING count(*) >= 3), d AS (SELECT user_id, m, median(abs(ibi - m)) AS mad FROM s JOIN m USING (user_id) GROUP BY 1, 2),
c AS (SELECT user_id, ibi FROM s JOIN d USING (user_id) WHERE abs(ibi - m) <= greatest(0.1, 3.5 * 1.4826 * mad, 0.2 * m)),
q AS (SELECT user_id, median(ibi) AS mid, count(*) AS n FROM c GROUP BY 1 HAVING count(*) >= 3), v AS (SELECT user_id, mid, n, median(abs(ibi - mid)) AS dev FROM c JOIN q USING (user_id) GROUP BY 1, 2, 3)
SELECT user_id, n, {q6('60 / mid')} AS bpm, {q6('least(greatest(least(1.0, n / 10.0) * exp(-5 * 1.4826 * dev / greatest(mid, 1e-6)), 0), 1)')} AS quality FROM v"""


@query(IBI)
def repaired_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    # hours stand for seconds: a reference rate of three, from a half to sixty
    e = events(spark, sf_dir).select("user_id", (F.col("ms") / HOUR).alias("t"))
    return S.repaired_rate(e, ["user_id"], "t", F.lit(3.0), 0.5, 60).select("user_id", "n", r6("bpm").alias("bpm"), r6("quality").alias("quality"))


CANDIDATES = """c AS (SELECT l_orderkey AS k, l_quantity * 3 AS bpm, l_extendedprice AS power, CASE WHEN l_orderkey % 3 <> 0 THEN CAST(60 + l_orderkey % 40 AS DOUBLE) END AS time, CASE WHEN l_orderkey % 5 <> 0 THEN 72.0 END AS previous FROM lineitem)"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_orderkey")
    return read(spark, sf_dir, "lineitem").select(k.alias("k"), (F.col("l_quantity") * 3).cast("double").alias("bpm"), F.col("l_extendedprice").alias("power"),
                                                  F.when(k % 3 != 0, (60 + k % 40).cast("double")).alias("time"), F.when(k % 5 != 0, 72.0).alias("previous"))


@query(f"""WITH {CANDIDATES}, s AS (SELECT *, power / greatest(max(power) OVER (PARTITION BY k), 1e-12) AS share FROM c),
r AS (SELECT k, bpm, share, row_number() OVER (PARTITION BY k ORDER BY ln(greatest(share, 1e-8)) - coalesce(0.035 * abs(bpm - time), 0) - coalesce(0.025 * abs(bpm - previous), 0) DESC, bpm) AS rn FROM s)
SELECT k, {q6('bpm')} AS rate, {q6('share')} AS relative_power FROM r WHERE rn = 1""")
def anchored_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = S.anchored_candidate(_candidates(spark, sf_dir), ["k"], "bpm", "power", {"time": 0.035, "previous": 0.025})
    return b.select("k", r6("rate").alias("rate"), r6("relative_power").alias("relative_power"))


@query(f"""WITH {EVENTS_SQL}, x AS (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN value END AS t, CASE WHEN event_id % 5 <> 0 THEN value + event_id % 30 - 12 END AS f, (event_id % 10) / 10.0 AS tq, (event_id % 8) / 8.0 AS fq,
 CASE WHEN event_id % 3 <> 0 THEN 60.0 END AS a FROM ev), g AS (SELECT *, abs(t - f) AS gap, coalesce(a, t) AS aa, t IS NOT NULL AND f IS NOT NULL AS both_known FROM x),
h AS (SELECT *, coalesce(both_known AND gap > 10, false) AS warned, abs(t - aa) <= abs(f - aa) AS nearer FROM g)
SELECT event_id, warned, {q6('CASE WHEN warned THEN CASE WHEN nearer THEN t ELSE f END WHEN both_known THEN (greatest(tq, 0.05) * t + greatest(fq, 0.05) * f) / (greatest(tq, 0.05) + greatest(fq, 0.05)) ELSE coalesce(t, f) END')} AS rate,
 {q6('least(greatest(CASE WHEN warned THEN 0.1 * exp(-gap / 12) * CASE WHEN nearer THEN tq ELSE fq END WHEN both_known THEN exp(-gap / 12) * sqrt(tq * fq) WHEN t IS NOT NULL THEN 0.45 * tq WHEN f IS NOT NULL THEN 0.35 * fq ELSE 0 END, 0), 1)')} AS confidence FROM h""")
def fused_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, v = F.col("event_id"), F.col("value")
    t, f = F.when(i % 7 != 0, v), F.when(i % 5 != 0, v + i % 30 - 12)
    rate, sure, warned = S.fused_rate(t, f, i % 10 / 10, i % 8 / 8, F.when(i % 3 != 0, 60.0))
    return events(spark, sf_dir).select("event_id", warned.alias("warned"), r6(rate).alias("rate"), r6(sure).alias("confidence"))


LIMIT = "least(greatest((0.2 + 0.3 * c) * {x} + (1 - (0.2 + 0.3 * c)) * {p}, {p} - 7), {p} + 7)"


@query(f"""WITH RECURSIVE {EVENTS_SQL}, o AS (SELECT user_id, event_id, value AS v, (event_id % 10) / 10.0 AS c, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM ev WHERE value IS NOT NULL),
s AS (SELECT user_id, count(*) FILTER (c >= 0.12) AS sure FROM o GROUP BY 1), k AS (SELECT o.*, CASE WHEN sure < 2 OR c >= 0.12 THEN v END AS known FROM o JOIN s USING (user_id)),
b AS (SELECT *, last_value(CASE WHEN known IS NOT NULL THEN i END IGNORE NULLS) OVER w AS i0, last_value(known IGNORE NULLS) OVER w AS v0, first_value(CASE WHEN known IS NOT NULL THEN i END IGNORE NULLS) OVER u AS i1, first_value(known IGNORE NULLS) OVER u AS v1 FROM k
 WINDOW w AS (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING), u AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
g AS (SELECT user_id, event_id, c, i, n, CASE WHEN known IS NOT NULL THEN known WHEN i0 IS NULL THEN v1 WHEN i1 IS NULL THEN v0 ELSE v0 + (v1 - v0) / (i1 - i0) * (i - i0) END AS x FROM b),
f AS (SELECT user_id, event_id, c, i, n, CASE WHEN n < 3 THEN x ELSE list_sort([coalesce(lag(x) OVER (PARTITION BY user_id ORDER BY i), 0), x, coalesce(lead(x) OVER (PARTITION BY user_id ORDER BY i), 0)])[2] END AS x FROM g),
a AS (SELECT user_id, event_id, c, i, n, x AS y FROM f WHERE i = 1 UNION ALL SELECT f.user_id, f.event_id, f.c, f.i, f.n, {LIMIT.format(x='f.x', p='a.y').replace('* c', '* f.c')} FROM a JOIN f ON f.user_id = a.user_id AND f.i = a.i + 1),
z AS (SELECT user_id, event_id, c, i, y AS s FROM a WHERE i = n UNION ALL SELECT a.user_id, a.event_id, a.c, a.i, {LIMIT.format(x='a.y', p='z.s').replace('* c', '* a.c')} FROM z JOIN a ON a.user_id = z.user_id AND a.i = z.i - 1)
SELECT event_id, {q6('s')} AS smoothed FROM z""")
def smoothed_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).where("value is not null").select("user_id", "event_id", "value", (F.col("event_id") % 10 / 10).alias("c"))
    return S.smoothed_track(e, ["user_id"], "event_id", "value", "c").select("event_id", r6("smoothed").alias("smoothed"))


@query("""WITH RECURSIVE c AS (SELECT l_suppkey AS k, l_orderkey AS t, l_linenumber AS channel, CAST(l_quantity AS INT) AS bin, max(l_extendedprice) / 1000 AS score FROM lineitem GROUP BY 1, 2, 3, 4),
s AS (SELECT k, t, row_number() OVER (PARTITION BY k ORDER BY t) AS i FROM (SELECT DISTINCT k, t FROM c)),
g AS (SELECT k, t, channel, bin, row_number() OVER (PARTITION BY k, t ORDER BY score DESC, channel, bin) AS rn FROM c),
w AS (SELECT s.k, s.t, s.i, g.channel, g.bin, 'start' AS rule FROM s JOIN g ON g.k = s.k AND g.t = s.t AND rn = 1 WHERE i = 1
 UNION ALL SELECT k, t, i, p.channel, p.bin, p.rule FROM (SELECT w.k, s.t, s.i, (SELECT {'channel': channel, 'bin': bin, 'rule': 'near'} FROM c WHERE c.k = s.k AND c.t = s.t AND abs(c.bin - w.bin) <= 5
   ORDER BY ln(1 + greatest(score, 0)) - 0.2 * abs(c.bin - w.bin) - 0.5 * CAST(c.channel <> w.channel AS INT) DESC, c.channel, c.bin LIMIT 1) AS near, {'channel': g.channel, 'bin': g.bin, 'rule': 'fallback'} AS far
   FROM w JOIN s ON s.k = w.k AND s.i = w.i + 1 JOIN g ON g.k = s.k AND g.t = s.t AND g.rn = 1), LATERAL (SELECT coalesce(near, far) AS p))
SELECT k, t, channel, bin, rule FROM w""")
def local_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("k"), F.col("l_orderkey").alias("t"), F.col("l_linenumber").alias("channel"), F.col("l_quantity").cast("int").alias("bin")).agg(
        (F.max("l_extendedprice") / 1000).alias("score"))
    return S.local_choices(c, ["k"], "t", "score", 5)


@query(f"""WITH {EVENTS_SQL}, o AS (SELECT user_id, value, row_number() {ORDER} AS i, count(value) OVER (PARTITION BY user_id) AS n, 0.2 * stddev_pop(value) OVER (PARTITION BY user_id) AS r FROM ev WHERE value IS NOT NULL),
x AS (SELECT a.user_id, a.i, a.n, a.r, a.value AS x0, b.value AS x1, c.value AS x2 FROM o a JOIN o b ON b.user_id = a.user_id AND b.i = a.i + 1 LEFT JOIN o c ON c.user_id = a.user_id AND c.i = a.i + 2 WHERE a.r > 0 AND a.n > 3),
p AS (SELECT a.user_id, a.n, abs(a.x2 - b.x2) <= a.r AS longer, b.i AS j FROM x a JOIN x b ON a.user_id = b.user_id AND a.i < b.i AND abs(a.x0 - b.x0) <= a.r AND abs(a.x1 - b.x1) <= a.r WHERE b.i <= a.n - 2),
s AS (SELECT user_id, n, count(*) AS b, count(*) FILTER (longer AND j <= n - 3) AS a FROM p GROUP BY 1, 2)
SELECT user_id, n, {q6('-ln((a / ((n - 3) * (n - 4) / 2.0)) / (b / ((n - 2) * (n - 3) / 2.0)))')} AS sampen FROM s WHERE a > 0 AND b > 0""")
def sample_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sample_entropy(events(spark, sf_dir), ["user_id"], ["ms", "event_id"], "value").select("user_id", "n", r6("sampen").alias("sampen"))


@query(f"""WITH {EVENTS_SQL}, t AS (SELECT user_id, ms, avg(value) AS x, avg(event_id % 97) AS y FROM ev GROUP BY 1, 2), d AS (SELECT *, ms - lag(ms) OVER (PARTITION BY user_id ORDER BY ms) AS d FROM t),
m AS (SELECT user_id, median(d) AS m FROM d WHERE d > 0 GROUP BY 1), s AS (SELECT user_id, x, y, 1 + sum(CASE WHEN d > 3 * m THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ms) AS segment FROM d JOIN m USING (user_id)),
g AS (SELECT user_id, segment, count(*) AS n, corr(x, y) AS r FROM s GROUP BY 1, 2 HAVING count(*) >= 4)
SELECT user_id, count(*) AS segments, {q6('sum(n * abs(r)) FILTER (isfinite(r)) / sum(n) FILTER (isfinite(r))')} AS coherence FROM g GROUP BY 1""")
def segment_coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = events(spark, sf_dir).groupBy("user_id", "ms").agg(F.avg("value").alias("x"), F.avg(F.col("event_id") % 97).alias("y"))
    g = S.gap_segments(t, ["user_id"], "ms", 3, 4).groupBy("user_id", "segment").agg(F.count("*").alias("n"), F.corr("x", "y").alias("r"))
    known = F.col("r").isNotNull() & ~F.isnan("r")
    return g.groupBy("user_id").agg(F.count("*").alias("segments"), r6(F.sum(F.when(known, F.col("n") * F.abs("r"))) / F.sum(F.when(known, F.col("n")))).alias("coherence"))


WIDE, EVERY = 48 * HOUR, 24 * HOUR


@query(f"""WITH {EVENTS_SQL}, b AS (SELECT user_id, min(ms) AS lo, max(ms) AS hi FROM ev GROUP BY 1), c AS (SELECT user_id, lo, hi, unnest(range(lo, hi + 1, {EVERY})) AS center FROM b),
w AS (SELECT user_id, center, greatest(least(center - {WIDE // 2}, hi + 1 - {WIDE}), lo) AS start_ms FROM c)
SELECT w.user_id, center, start_ms, count(*) AS n, {q6('avg(value)')} AS mean FROM w JOIN ev ON ev.user_id = w.user_id AND ms >= start_ms AND ms < start_ms + {WIDE} GROUP BY 1, 2, 3""")
def centred_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = S.centred_windows(events(spark, sf_dir), ["user_id"], "ms", WIDE, EVERY)
    return w.groupBy("user_id", "center", F.col("start").alias("start_ms")).agg(F.count("*").alias("n"), r6(F.avg("value")).alias("mean"))


@query(f"""WITH {EVENTS_SQL}, s AS (SELECT user_id, value, unnest([ms // {12 * HOUR} * {12 * HOUR}, ms // {12 * HOUR} * {12 * HOUR} - {12 * HOUR}]) AS start_ms FROM ev),
m AS (SELECT user_id, CAST(start_ms AS BIGINT) AS start_ms, avg(value) AS v FROM s GROUP BY 1, 2)
SELECT user_id, start_ms, {q6('1 / (1 + exp(-(0.8 * (v - 50) / 30 + 0.1)))')} AS score, CASE WHEN 1 / (1 + exp(-(0.8 * (v - 50) / 30 + 0.1))) >= 0.65 THEN 'positive' WHEN 1 / (1 + exp(-(0.8 * (v - 50) / 30 + 0.1))) <= 0.35 THEN 'negative' ELSE 'indeterminate' END AS decision FROM m""")
def window_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("user_id", "value", F.col("ts").cast("timestamp").alias("ts"))
    m = e.groupBy("user_id", F.window("ts", "24 hours", "12 hours").alias("w")).agg(F.avg("value").alias("v"))
    model = spark.createDataFrame([([50.0], [30.0], [0.8], 0.1)], "mean array<double>, scale array<double>, coef array<double>, intercept double")
    s = audits.apply_model(m.where("v is not null"), ["v"], model)
    # rows without a value have no score but a decision
    s = s.select("user_id", F.unix_millis("w.start").alias("start_ms"), r6("score").alias("score"), X.decision(F.col("score")).alias("decision"))
    none = m.where("v is null").select("user_id", F.unix_millis("w.start").alias("start_ms"), F.lit(None).cast("double").alias("score"), F.lit("indeterminate").alias("decision"))
    return s.union(none)


@query(f"""WITH {EVENTS_SQL}, b AS (SELECT user_id, min(ms) + {HOUR} AS lo, max(ms) - {HOUR} AS hi FROM ev GROUP BY 1),
w AS (SELECT user_id, unnest(range(lo, hi - {24 * HOUR} + 1, {12 * HOUR})) AS start_ms FROM b WHERE lo + {24 * HOUR} <= hi)
SELECT w.user_id, start_ms, count(*) AS n FROM w JOIN ev ON ev.user_id = w.user_id AND ms >= start_ms AND ms < start_ms + {24 * HOUR} GROUP BY 1, 2""")
def guarded_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanloom.functions.registered import register

    # the registered function makes the windows of each block, from its own start and inside its guards
    register(spark)
    blocks = events(spark, sf_dir).groupBy("user_id").agg(F.min("ms").alias("lo"), F.max("ms").alias("hi"))
    made = blocks.select("user_id", F.expr(f"block_windows(lo, hi, {HOUR}L, {24 * HOUR}L, {12 * HOUR}L)").alias("starts")).select("user_id", F.explode("starts").alias("start_ms"))
    probes = made.select("user_id", "start_ms", (F.col("start_ms") + 24 * HOUR).alias("end_ms"))
    w = joins.lookback_join(probes, events(spark, sf_dir).select("user_id", "ms"), ["user_id"], "end_ms", "ms", 24 * HOUR, 24 * HOUR, how="inner")
    return w.groupBy("user_id", "start_ms").agg(F.count("*").alias("n"))


@query(f"""WITH {EVENTS_SQL}, i AS (SELECT user_id, ms - lag(ms) OVER (PARTITION BY user_id ORDER BY ms) AS d FROM ev)
SELECT user_id, {q6('median(d)')} AS median, {q6('quantile_cont(d, 0.05)')} AS p5, {q6('quantile_cont(d, 0.95)')} AS p95, {q6(f'{HOUR}.0 / nullif(median(d), 0)')} AS per_hour FROM i WHERE d IS NOT NULL GROUP BY 1""")
def interval_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = events(spark, sf_dir).select("user_id", (F.col("ms") - F.lag("ms").over(Window.partitionBy("user_id").orderBy("ms"))).alias("d")).where("d is not null")
    q = d.groupBy("user_id").agg(F.percentile("d", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95))).alias("q"))
    return q.select("user_id", r6(F.col("q")[1]).alias("median"), r6(F.col("q")[0]).alias("p5"), r6(F.col("q")[2]).alias("p95"), r6(HOUR / F.nullif(F.col("q")[1], F.lit(0.0))).alias("per_hour"))


@query(f"""WITH {EVENTS_SQL}, w AS (SELECT user_id, ms // {24 * HOUR} AS day, avg(value) AS v, stddev_samp(value) AS sd, count(*) AS n, max(ms) - min(ms) AS span FROM ev GROUP BY 1, 2)
SELECT user_id, day, {q6('CASE WHEN v < 45 AND v * 2 <= 95 THEN v * 2 ELSE v END')} AS rate, coalesce(v < 45 AND v * 2 <= 95, false) AS doubled,
 CASE WHEN n < 2 THEN 'too_few' WHEN v / nullif(sd, 0) < 1 THEN 'weak' WHEN span < {2 * HOUR} THEN 'static' WHEN v IS NULL THEN 'missing' ELSE 'usable' END AS verdict FROM w""")
def window_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a day's mean is summed in order, so that one of exactly 45 doesn't hang on the order that a shuffle brings
    e = events(spark, sf_dir).withColumn("day", F.expr(f"ms div {24 * HOUR}"))
    whole = Window.partitionBy("user_id", "day").orderBy("ms", "event_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = e.withColumn("v", F.avg("value").over(whole)).groupBy("user_id", "day").agg(
        F.first("v").alias("v"), F.stddev_samp("value").alias("sd"), F.count("*").alias("n"), (F.max("ms") - F.min("ms")).alias("span"))
    v = F.col("v")
    low = (v < 45) & (v * 2 <= 95)
    rules = [(F.col("n") < 2, "too_few"), (v / F.nullif("sd", F.lit(0.0)) < 1, "weak"), (F.col("span") < 2 * HOUR, "static"), (v.isNull(), "missing")]
    return w.select("user_id", "day", r6(F.when(low, v * 2).otherwise(v)).alias("rate"), F.coalesce(low, F.lit(False)).alias("doubled"), X.first_match(rules, "usable").alias("verdict"))


def _normal_p(z: str) -> str:
    x = f"(abs({z}) / {math.sqrt(2)})"
    poly = "0.0"
    for a in reversed(audits.ERF):
        poly = f"({poly} + {a}) * (1 / (1 + 0.3275911 * {x}))"
    return f"({poly}) * exp(-{x} * {x})"


def _simpson(top: str) -> str:
    return f"{top} / 2000 * list_sum(list_transform(range(0, 2001), lambda i: CASE WHEN i = 0 OR i = 2000 THEN 1.0 WHEN i % 2 = 1 THEN 4.0 ELSE 2.0 END::DOUBLE * ({top} * i / 2000) * pow(sin({math.pi / 2} * ({top} * i / 2000) * ({top} * i / 2000)), freedom - 1)))"


@query(f"""WITH d AS (SELECT o_orderpriority AS g, o_orderstatus = 'F' AS one, o_totalprice AS v FROM orders), r AS (SELECT *, rank() OVER (PARTITION BY g ORDER BY v) + (count(*) OVER (PARTITION BY g, v) - 1) / 2.0 AS r FROM d),
s AS (SELECT g, CAST(count(*) FILTER (one) AS DOUBLE) AS n1, CAST(count(*) FILTER (NOT one) AS DOUBLE) AS n2, avg(v) FILTER (one) - avg(v) FILTER (NOT one) AS d, var_samp(v) FILTER (one) AS v1, var_samp(v) FILTER (NOT one) AS v2, sum(r) FILTER (one) AS w FROM r GROUP BY 1),
x AS (SELECT *, d / nullif(sqrt(v1 / n1 + v2 / n2), 0) AS t, pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)) AS freedom, (w - n1 * (n1 + 1) / 2 - n1 * n2 / 2) / nullif(sqrt(n1 * n2 * (n1 + n2 + 1) / 12), 0) AS z FROM s),
y AS (SELECT *, sqrt(1 - {2 / math.pi} * atan(abs(t) / sqrt(freedom))) AS edge, 1.0::DOUBLE AS whole FROM x)
SELECT g, CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, {q6('t')} AS t, round(freedom, 3) AS freedom, {q6(f"CASE WHEN freedom > 5000 THEN {_normal_p('t')} ELSE ({_simpson('edge')}) / ({_simpson('whole')}) END")} AS t_p, {q6('z')} AS mann_whitney_z, {q6(_normal_p('z'))} AS mann_whitney_p FROM y""")
def two_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("g"), "o_orderstatus", F.col("o_totalprice").alias("v"))
    t = audits.two_samples(d, ["g"], F.col("o_orderstatus") == "F", "v")
    return t.select("g", "n1", "n2", F.round("freedom", 3).alias("freedom"), *[r6(c).alias(c) for c in ("t", "t_p", "mann_whitney_z", "mann_whitney_p")])


@query(f"""WITH c AS (SELECT user_id, event_type, avg(value) AS v FROM events GROUP BY 1, 2), w AS (SELECT user_id FROM c WHERE v IS NOT NULL GROUP BY 1 HAVING count(*) = 5),
r AS (SELECT event_type, rank() OVER (PARTITION BY user_id ORDER BY v) + (count(*) OVER (PARTITION BY user_id, v) - 1) / 2.0 AS r FROM c JOIN w USING (user_id)), s AS (SELECT sum(r) AS s, count(*) AS n FROM r GROUP BY event_type),
x AS (SELECT max(n) AS n, 12.0 / (max(n) * 5 * 6) * sum(s * s) - 3 * max(n) * 6 AS chi2 FROM s)
SELECT n, {q6('chi2')} AS chi2, {q6('exp(-chi2 / 2) * (1 + chi2 / 2)')} AS p FROM x""")
def friedman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.friedman(events(spark, sf_dir), "user_id", "event_type", "value", 5).select("n", r6("chi2").alias("chi2"), r6("p").alias("p"))


HALF = f"""{EVENTS_SQL}, o AS (SELECT event_id, user_id, value AS x, CAST(event_type IN ('click', 'purchase') AS INT) AS y, row_number() {ORDER} <= greatest(1, count(*) OVER (PARTITION BY user_id) // 2) AS f FROM ev),
s AS (SELECT user_id, count(*) AS n, count(*) FILTER (y = 1) AS p, avg(x) AS m, stddev_pop(x) AS s, avg(x) FILTER (y = 1) AS m1, avg(x) FILTER (y = 0) AS m0, sum(x * x) AS xx FROM o WHERE f AND x IS NOT NULL GROUP BY 1),
v AS (SELECT *, (xx - p * m1 * m1 - (n - p) * m0 * m0) / n AS inside FROM s),
md AS (SELECT *, n >= 6 AND p > 0 AND p < n AND s > 0 AND inside > 1e-9 AS fit FROM v),
mo AS (SELECT user_id, n, p AS positive, CASE WHEN fit THEN m END AS mean, CASE WHEN fit THEN s END AS scale, CASE WHEN fit THEN (m1 - m0) * s / inside END AS coef, CASE WHEN fit THEN (m1 - m0) / inside * (m - (m1 + m0) / 2) END AS intercept,
 CASE WHEN fit THEN 'fitted' ELSE 'indeterminate' END AS status FROM md)"""


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", "user_id", "ms", F.col("value").alias("x"), F.col("event_type").isin("click", "purchase").cast("int").alias("y"))


@query(f"WITH {HALF} SELECT user_id, n, positive, {q6('mean')} AS mean, {q6('scale')} AS scale, {q6('coef')} AS coef, {q6('intercept')} AS intercept, status FROM mo")
def half_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = S.half_calibrated(_labelled(spark, sf_dir), ["user_id"], ["ms", "event_id"], "y", "x")
    return m.select("user_id", "n", "positive", *[r6(c).alias(c) for c in ("mean", "scale", "coef", "intercept")], "status")


@query(f"WITH {HALF} SELECT event_id, {q6('1 / (1 + exp(-least(greatest(coef * (x - mean) / scale + intercept, -60), 60)))')} AS score, status FROM o JOIN mo USING (user_id) WHERE NOT f")
def second_half_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = S.second_half_scores(_labelled(spark, sf_dir), ["user_id"], ["ms", "event_id"], "y", "x")
    return s.select("event_id", r6("score").alias("score"), "status")


ALIGN_WAYS = """CASE WHEN d - i < 0 OR d - i > len(b) THEN NULL WHEN i = 0 THEN {'c': d * 4.0::DOUBLE, 'n': 0, 's': 0.0::DOUBLE} WHEN d = i THEN {'c': i * 4.0::DOUBLE, 'n': 0, 's': 0.0::DOUBLE}
 WHEN p2[i].c + CASE WHEN abs(a[i] - b[d - i]) <= 6 THEN abs(a[i] - b[d - i]) ELSE 9 END <= least(p1[i].c, p1[i + 1].c) + 4
 THEN {'c': p2[i].c + CASE WHEN abs(a[i] - b[d - i]) <= 6 THEN abs(a[i] - b[d - i]) ELSE 9 END, 'n': p2[i].n + 1, 's': p2[i].s + abs(a[i] - b[d - i])}
 WHEN p1[i].c <= p1[i + 1].c THEN {'c': p1[i].c + 4, 'n': p1[i].n, 's': p1[i].s} ELSE {'c': p1[i + 1].c + 4, 'n': p1[i + 1].n, 's': p1[i + 1].s} END"""


@query(f"""WITH RECURSIVE {EVENTS_SQL}, i AS (SELECT user_id, event_type, event_id, (ms - lag(ms) OVER (PARTITION BY user_id, event_type ORDER BY ms, event_id)) / {HOUR}.0::DOUBLE AS ibi FROM ev WHERE event_type IN ('click', 'view')),
l AS (SELECT user_id, coalesce(list(ibi ORDER BY event_id) FILTER (event_type = 'click'), []::DOUBLE[]) AS a, coalesce(list(ibi ORDER BY event_id) FILTER (event_type = 'view'), []::DOUBLE[]) AS b FROM i WHERE ibi IS NOT NULL GROUP BY 1),
w AS (SELECT user_id, a, b, 1 AS d, CAST(NULL AS STRUCT(c DOUBLE, n INT, s DOUBLE)[]) AS p2, list_transform(range(0, len(a) + 1), lambda i: CASE WHEN i = 0 THEN {{'c': 0.0::DOUBLE, 'n': 0, 's': 0.0::DOUBLE}} END) AS p1 FROM l
 UNION ALL SELECT user_id, a, b, d + 1, p1, list_transform(range(0, len(a) + 1), lambda i: {ALIGN_WAYS}) FROM w WHERE d <= len(a) + len(b))
SELECT user_id, CAST(p1[len(a) + 1].n AS BIGINT) AS n_pairs, len(a) AS n_reference, len(b) AS n_estimate, {q6('p1[len(a) + 1].s / nullif(p1[len(a) + 1].n, 0)')} AS mae FROM w WHERE d = len(a) + len(b) + 1""")
def interval_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of clicks and of views of a user, aligned in order with a penalty for those left out."""
    order = Window.partitionBy("user_id", "event_type").orderBy("ms", "event_id")
    i = events(spark, sf_dir).where("event_type in ('click', 'view')").select("user_id", "event_type", "event_id", ((F.col("ms") - F.lag("ms").over(order)) / HOUR).alias("ibi")).where("ibi is not null")
    a, b = (i.where(F.col("event_type") == k) for k in ("click", "view"))
    out = rhythm.interval_alignment(a, b, ["user_id"], "event_id", "ibi", 6.0, 4.0)
    return out.select("user_id", "n_pairs", "n_reference", "n_estimate", r6("mae").alias("mae"))


SAMPLES = f"""{EVENTS_SQL}, x AS (SELECT user_id, CAST(row_number() {ORDER} AS INT) AS i, value AS v FROM ev WHERE value IS NOT NULL),
pk AS (SELECT user_id, i FROM (SELECT *, lag(v) OVER (PARTITION BY user_id ORDER BY i) AS b, lead(v) OVER (PARTITION BY user_id ORDER BY i) AS a FROM x) WHERE v > b AND v >= a),
sp AS (SELECT user_id, min(i) AS lo, max(i) AS hi FROM x GROUP BY 1), ip AS (SELECT pk.user_id, pk.i AS p, lo, hi, pk.i - lag(pk.i) OVER (PARTITION BY pk.user_id ORDER BY pk.i) AS d FROM pk JOIN sp USING (user_id) WHERE pk.i BETWEEN lo + 1 AND hi),
rh AS (SELECT user_id, CAST(round_even(median(d), 0) AS INT) AS mean, stddev_pop(d) AS deviation, greatest(4, CAST(round_even(median(d), 0) AS INT) // 2) AS half FROM ip GROUP BY 1 HAVING count(*) >= 5),
cy AS (SELECT ip.user_id, p, half, i - p AS o, CASE WHEN stddev_pop(v) OVER c > 0 THEN (v - avg(v) OVER c) / stddev_pop(v) OVER c ELSE 0 END AS z FROM ip JOIN rh USING (user_id) JOIN x ON x.user_id = ip.user_id AND x.i BETWEEN p - half AND p + half
 WHERE p - half >= lo AND p + half <= hi WINDOW c AS (PARTITION BY ip.user_id, p)),
tm AS (SELECT user_id, half, o, median(z) AS m FROM cy GROUP BY 1, 2, 3 HAVING count(*) >= 5),
sm AS (SELECT x.user_id, x.i, corr(y.v, m) AS r, count(*) AS n, any_value(half) AS half FROM x JOIN tm ON tm.user_id = x.user_id JOIN x y ON y.user_id = x.user_id AND y.i = x.i + o GROUP BY 1, 2),
sy AS (SELECT x.user_id, x.i, CASE WHEN n = 2 * half + 1 THEN CASE WHEN isfinite(r) THEN r ELSE 0 END END AS s FROM x JOIN sm USING (user_id, i))"""


def _samples(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Values of each user in order, numbered, and the numbers of local peaks."""
    order = Window.partitionBy("user_id").orderBy("ms", "event_id")
    x = events(spark, sf_dir).where("value is not null").select("user_id", F.row_number().over(order).alias("i"), F.col("value").alias("v"))
    return x, S.local_peaks(x, ["user_id"], "i", "v").select("user_id", "i")


@query(f"WITH {SAMPLES} SELECT user_id, i, {q6('s')} AS similarity FROM sy")
def template_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much the values around each event look like the median cycle around the user's peaks."""
    x, peaks = _samples(spark, sf_dir)
    t = rhythm.cycle_templates(x, peaks, ["user_id"], "i", "v", 4)
    return rhythm.template_similarity(x, t, ["user_id"], "i", "v", 101).select("user_id", "i", r6("similarity").alias("similarity"))


@query(f"""WITH RECURSIVE {SAMPLES}, r AS (SELECT user_id, mean, greatest(deviation, 2) AS sd, greatest(3, CAST(round_even(mean - 3 * greatest(deviation, 2), 0) AS INT)) AS lo, least(20, CAST(round_even(mean + 3 * greatest(deviation, 2), 0) AS INT)) AS hi FROM rh WHERE deviation IS NOT NULL),
l AS (SELECT user_id, any_value(mean) AS mean, any_value(sd) AS sd, any_value(lo) AS lo, any_value(hi) AS hi, list(s ORDER BY i) AS s FROM sy JOIN r USING (user_id) GROUP BY 1),
w AS (SELECT *, 0 AS t, []::STRUCT(c DOUBLE, n INT)[] AS best FROM l UNION ALL SELECT user_id, mean, sd, lo, hi, s, t + 1, list_append(best, CASE WHEN s[t + 1] IS NULL OR t < greatest(1, lo) THEN NULL ELSE (SELECT {{'c': s[t + 1] + coalesce(max(q.c), 0), 'n': 1 + coalesce(arg_min(q.n, (-q.c, q.k)), 0)}}
  FROM (SELECT unnest(list_transform(list_filter(range(greatest(0, t - hi), t - lo + 1), lambda k: best[k + 1] IS NOT NULL), lambda k: {{'c': best[k + 1].c - 0.25 * pow((t - k - mean) / sd, 2), 'n': best[k + 1].n, 'k': k}})) AS q)) END) FROM w WHERE t < len(s)),
f AS (SELECT user_id, unnest(list_filter(best, lambda b: b IS NOT NULL)) AS b FROM w WHERE t = len(s))
SELECT user_id, CAST(arg_max(b.n, b.c) AS BIGINT) AS beats FROM f GROUP BY 1""")
def beat_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of beats on the best path through each user's similarities."""
    x, peaks = _samples(spark, sf_dir)
    t = rhythm.cycle_templates(x, peaks, ["user_id"], "i", "v", 4)
    like = rhythm.template_similarity(x, t, ["user_id"], "i", "v", 101)
    return rhythm.beat_paths(like, t, ["user_id"], "i", "similarity", 3, 20).groupBy("user_id").agg(F.count("*").alias("beats"))
