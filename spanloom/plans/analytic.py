"""Ordered analytics over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.operators import windows as W
from spanloom.plans.registry import EVENTS_SQL, HOUR, events, q6, query, r6, read

ORDER = "OVER (PARTITION BY user_id ORDER BY ms, event_id)"


@query(f"""WITH {EVENTS_SQL} SELECT event_id, CAST(row_number() {ORDER} AS INT) AS ordinal,
 {q6(f'coalesce((row_number() {ORDER} - 1) / nullif(CAST(count(*) OVER (PARTITION BY user_id) - 1 AS DOUBLE), 0), 0)')} AS position,
 {q6('1.0 / count(*) OVER (PARTITION BY user_id)')} AS weight FROM ev""")
def ordinal_position_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ms", "event_id")
    return events(spark, sf_dir).select("event_id", F.row_number().over(order).alias("ordinal"),
                                        r6(W.position_share(["user_id"], ["ms", "event_id"])).alias("position"), r6(W.group_weight(["user_id"])).alias("weight"))


@query(f"""WITH {EVENTS_SQL}, r AS (SELECT user_id, rank() OVER (PARTITION BY user_id ORDER BY value) + (count(*) OVER (PARTITION BY user_id, value) - 1) / 2.0 AS a,
 rank() OVER (PARTITION BY user_id ORDER BY ms) + (count(*) OVER (PARTITION BY user_id, ms) - 1) / 2.0 AS b FROM ev WHERE value IS NOT NULL)
SELECT user_id, count(*) AS n, CASE WHEN count(*) > 2 THEN {q6('corr(a, b)')} END AS rho FROM r GROUP BY 1""")
def avg_rank_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.spearman(events(spark, sf_dir), ["user_id"], "value", "ms").select("user_id", "n", F.when(F.col("n") > 2, r6("rho")).alias("rho"))


@query(f"""WITH {EVENTS_SQL}, i AS (SELECT user_id, event_type, row_number() {ORDER} - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ms, event_id) AS run FROM ev),
l AS (SELECT user_id, event_type, run, count(*) AS n FROM i GROUP BY 1, 2, 3) SELECT user_id, max(n) AS longest FROM l GROUP BY 1""")
def longest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.longest_run(events(spark, sf_dir), ["user_id"], ["ms", "event_id"], "event_type")


@query(f"""WITH {EVENTS_SQL}, c AS (SELECT user_id, event_type <> lag(event_type) {ORDER} AS c FROM ev)
SELECT user_id, count(*) AS n, count(*) FILTER (c) AS switches, {q6('count(*) FILTER (c) / CAST(nullif(count(c), 0) AS DOUBLE)')} AS rate FROM c GROUP BY 1""")
def switch_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.switches(events(spark, sf_dir), ["user_id"], ["ms", "event_id"], "event_type").select("user_id", "n", "switches", r6("rate").alias("rate"))


@query(f"""WITH {EVENTS_SQL}, g AS (SELECT event_id, ms - lag(ms) OVER (PARTITION BY user_id ORDER BY ms) AS a, lead(ms) OVER (PARTITION BY user_id ORDER BY ms) - ms AS b FROM ev WHERE event_type = 'error')
SELECT event_id FROM g WHERE coalesce(a >= {24 * HOUR}, true) AND coalesce(b >= {24 * HOUR}, true)""")
def isolated_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.isolated(events(spark, sf_dir).where("event_type = 'error'"), ["user_id"], "ms", 24 * HOUR).select("event_id")


@query(f"""SELECT event_id, {q6('(value - avg(value) OVER (PARTITION BY user_id)) / (stddev_pop(value) OVER (PARTITION BY user_id) + 1e-9)')} AS z_pop,
 CASE WHEN count(*) OVER (PARTITION BY event_type) > 1 THEN {q6('(value - avg(value) OVER (PARTITION BY event_type)) / stddev_samp(value) OVER (PARTITION BY event_type)')} END AS z_samp FROM events""")
def z_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = W.z_scored(events(spark, sf_dir), ["event_type"], "value", "z_samp", sample=True)
    return e.select("event_id", r6(W.z_score(["user_id"], "value")).alias("z_pop"), r6("z_samp").alias("z_samp"))


@query(f"""WITH {EVENTS_SQL}, r AS (SELECT user_id, value, row_number() {ORDER} AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM ev)
SELECT user_id, CASE WHEN rn <= greatest(1, n // 2) THEN 'first' ELSE 'second' END AS half, count(*) AS n, {q6('avg(value)')} AS mean FROM r GROUP BY 1, 2""")
def half_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("half", W.half(["user_id"], ["ms", "event_id"]))
    return e.groupBy("user_id", "half").agg(F.count("*").alias("n"), r6(F.avg("value")).alias("mean"))


@query(f"""WITH {EVENTS_SQL}, r AS (SELECT user_id, value, row_number() {ORDER} AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM ev)
SELECT user_id, CAST((rn - 1) // (n // 4) AS INT) AS part, count(*) AS n, {q6('avg(value)')} AS mean FROM r WHERE n >= 4 AND (rn - 1) // (n // 4) < 4 GROUP BY 1, 2""")
def segment_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = W.equal_parts(events(spark, sf_dir), ["user_id"], ["ms", "event_id"])
    return e.groupBy("user_id", "part").agg(F.count("*").alias("n"), r6(F.avg("value")).alias("mean"))


@query(f"""WITH {EVENTS_SQL}, r AS (SELECT user_id, event_id, value, CAST(row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS INT) AS rank FROM ev)
SELECT user_id, event_id, rank FROM r WHERE rank <= 3""")
def topk_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.top_k(events(spark, sf_dir), ["user_id"], [F.desc("value"), F.col("event_id")], 3).select("user_id", "event_id", "rank")


@query("""WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) AS rn FROM orders)
SELECT o_custkey, o_orderkey FROM r WHERE rn = 1""")
def argmax_tuple(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderpriority", -F.col("o_totalprice"), "o_orderkey")).alias("o_orderkey"))


@query(f"""WITH r AS (SELECT l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS rn FROM lineitem)
SELECT l_orderkey, max(l_linenumber) FILTER (rn = 1) AS best, {q6('max(l_extendedprice) FILTER (rn = 1) - max(l_extendedprice) FILTER (rn = 2)')} AS margin FROM r WHERE rn <= 2 GROUP BY 1""")
def best_runner_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = W.best_and_margin(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), ["l_orderkey"], "l_extendedprice", "l_linenumber")
    return b.select("l_orderkey", "best", r6("margin").alias("margin"))


@query(f"""WITH {EVENTS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ms, event_id) AS rn FROM ev) SELECT event_id, user_id, event_type FROM r WHERE rn = 1""")
def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.first_row(events(spark, sf_dir), ["user_id", "event_type"], ["ms", "event_id"]).select("event_id", "user_id", "event_type")


P_SQL = "pv AS (SELECT user_id, event_type, min(value) / (1 + max(value)) AS p FROM events GROUP BY 1, 2)"


def _p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("user_id", "event_type").agg((F.min("value") / (1 + F.max("value"))).alias("p"))


@query(f"""WITH {P_SQL}, r AS (SELECT *, p * count(*) OVER (PARTITION BY event_type) / row_number() OVER (PARTITION BY event_type ORDER BY p, user_id) AS raw FROM pv)
SELECT user_id, event_type, {q6('least(min(raw) OVER (PARTITION BY event_type ORDER BY p, user_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1)')} AS q FROM r""")
def bh_fdr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.benjamini_hochberg(_p_values(spark, sf_dir), ["event_type"], "p", "user_id").select("user_id", "event_type", r6("q").alias("q"))


@query(f"""WITH {P_SQL}, r AS (SELECT *, p * (count(*) OVER (PARTITION BY user_id) - row_number() OVER (PARTITION BY user_id ORDER BY p, event_type) + 1) AS raw FROM pv)
SELECT user_id, event_type, {q6('least(max(raw) OVER (PARTITION BY user_id ORDER BY p, event_type ROWS UNBOUNDED PRECEDING), 1)')} AS holm FROM r""")
def holm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.holm(_p_values(spark, sf_dir), ["user_id"], "p", "event_type").select("user_id", "event_type", r6("holm").alias("holm"))


@query(f"""WITH {EVENTS_SQL} SELECT event_id, {q6('sum(value) OVER (PARTITION BY user_id ORDER BY ms, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5')} AS m FROM ev""")
def moving_mean_zero_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", r6(W.moving_mean(["user_id"], ["ms", "event_id"], "value")).alias("m"))


ANCHOR_SQL = f"""WITH RECURSIVE {EVENTS_SQL}, o AS (SELECT user_id, event_id, value AS v, (event_id % 100) / 100.0 AS c, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM ev),
f AS (SELECT user_id, event_id, rn, v AS anchor FROM o WHERE rn = 1 UNION ALL
 SELECT o.user_id, o.event_id, o.rn, CASE WHEN f.anchor IS NULL THEN o.v WHEN o.v IS NOT NULL AND o.c >= 0.12 THEN f.anchor * 0.8 + o.v * (1 - 0.8) ELSE f.anchor END
 FROM f JOIN o ON o.user_id = f.user_id AND o.rn = f.rn + 1)
SELECT user_id, event_id, {q6('anchor')} AS anchor FROM f"""


@query(ANCHOR_SQL)
def ewma_gated_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("c", (F.col("event_id") % 100) / 100)
    return W.gated_anchor(e, ["user_id"], "event_id", "value", "c").select("user_id", "event_id", r6("anchor").alias("anchor"))


@query(ANCHOR_SQL)
def anchor_table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The anchors of `ewma_gated_anchor` by the registered table function."""
    from spanloom.functions.registered import register

    register(spark)
    rows = events(spark, sf_dir).select(F.col("user_id").alias("session"), F.col("event_id").alias("step"), "value", (F.col("event_id") % 100 / 100).alias("confidence"))
    found = spark.sql("SELECT session, step, anchor FROM gated_anchor(TABLE({rows}))", rows=rows)
    return found.select(F.col("session").alias("user_id"), F.col("step").alias("event_id"), r6("anchor").alias("anchor"))



@query(f"""WITH x AS (SELECT user_id, value AS x, CAST(event_id % 97 AS DOUBLE) AS y FROM events WHERE value IS NOT NULL),
s AS (SELECT user_id, count(*) OVER w - 1 AS n, sum(x) OVER w - x AS sx, sum(y) OVER w - y AS sy, sum(x * x) OVER w - x * x AS sxx, sum(y * y) OVER w - y * y AS syy, sum(x * y) OVER w - x * y AS sxy FROM x WINDOW w AS (PARTITION BY user_id))
SELECT user_id, {q6('min((n * sxy - sx * sy) / (sqrt(n * sxx - sx * sx) * sqrt(n * syy - sy * sy)))')} AS low,
 {q6('max((n * sxy - sx * sy) / (sqrt(n * sxx - sx * sx) * sqrt(n * syy - sy * sy)))')} AS high FROM s WHERE n > 8 GROUP BY 1""")
def jackknife_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).where("value is not null").withColumn("y", (F.col("event_id") % 97).cast("double"))
    many = e.groupBy("user_id").agg(F.count("*").alias("n")).where("n > 9").select("user_id")
    return W.jackknife_correlation(e.join(many, "user_id"), ["user_id"], "value", "y").select("user_id", r6("low").alias("low"), r6("high").alias("high"))


@query("""WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events GROUP BY 1)
SELECT event_id FROM events JOIN q USING (event_type) WHERE value BETWEEN a - 0.1 * (b - a) AND b + 0.1 * (b - a)""")
def iqr_outlier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.inside_fences(events(spark, sf_dir), ["event_type"], "value", 0.1).select("event_id")


@query(f"""WITH {EVENTS_SQL}, g AS (SELECT event_id, user_id, ms, value, lag(value) {ORDER} AS p, lead(value) {ORDER} AS n FROM ev)
SELECT event_id, coalesce(abs(value - p) / p > 0.2, false) AS jumps, coalesce(abs(n - value) / value > 0.2, false) AS next_jumps FROM g WHERE value > 0""")
def jump_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    here, ahead = W.jump_mask(["user_id"], ["ms", "event_id"], "value")
    return events(spark, sf_dir).select("event_id", "value", here.alias("jumps"), ahead.alias("next_jumps")).where("value > 0").drop("value")


@query(f"""WITH {EVENTS_SQL}, g AS (SELECT user_id, ms, CASE WHEN ms - lag(ms) OVER (PARTITION BY user_id ORDER BY ms) >= {6 * HOUR} THEN 1 ELSE 0 END AS b FROM ev),
s AS (SELECT user_id, ms, 1 + sum(b) OVER (PARTITION BY user_id ORDER BY ms RANGE UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, min(ms) AS start_ms, max(ms) AS end_ms FROM s GROUP BY 1, 2""")
def session_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = W.gap_sessions(events(spark, sf_dir), ["user_id"], "ms", 6 * HOUR)
    return s.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("ms").alias("start_ms"), F.max("ms").alias("end_ms"))


@query(f"""WITH {EVENTS_SQL} SELECT event_type, CAST(ms // {HOUR} AS BIGINT) * {HOUR} AS start_ms, count(*) AS n, {q6('avg(value)')} AS mean FROM ev GROUP BY 1, 2""")
def tumbling_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_type", "value", F.col("ts").cast("timestamp").alias("ts"))
    g = e.groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), r6(F.avg("value")).alias("mean"))
    return g.select("event_type", F.unix_millis("w.start").alias("start_ms"), "n", "mean")


@query(f"""WITH {EVENTS_SQL}, s AS (SELECT event_type, value, unnest([CAST(ms // {HOUR} AS BIGINT) * {HOUR}, CAST(ms // {HOUR} AS BIGINT) * {HOUR} - {HOUR}]) AS start_ms FROM ev)
SELECT event_type, start_ms, count(*) AS n, {q6('avg(value)')} AS mean FROM s GROUP BY 1, 2""")
def sliding_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_type", "value", F.col("ts").cast("timestamp").alias("ts"))
    g = e.groupBy("event_type", F.window("ts", "2 hours", "1 hour").alias("w")).agg(F.count("*").alias("n"), r6(F.avg("value")).alias("mean"))
    return g.select("event_type", F.unix_millis("w.start").alias("start_ms"), "n", "mean")


@query(f"""WITH {EVENTS_SQL}, f AS (SELECT user_id, ibi, ibi - lag(ibi) OVER (PARTITION BY user_id ORDER BY ms, event_id) AS d FROM (SELECT user_id, ms, event_id, (ms - lag(ms) {ORDER}) / 1000.0 AS ibi FROM ev))
SELECT user_id, count(ibi) AS n, {q6('sqrt(avg(d * d))')} AS rmssd, CASE WHEN count(ibi) > 1 THEN {q6('stddev_samp(ibi)')} END AS sdnn FROM f GROUP BY 1""")
def rmssd_sdnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ms", "event_id")
    e = events(spark, sf_dir).select("user_id", "ms", "event_id", ((F.col("ms") - F.lag("ms").over(order)) / 1000).alias("ibi"))
    e = e.withColumn("d", F.col("ibi") - F.lag("ibi").over(order))
    return e.groupBy("user_id").agg(F.count("ibi").alias("n"), r6(F.sqrt(F.avg(F.col("d") * F.col("d")))).alias("rmssd"), r6(F.stddev_samp("ibi")).alias("sdnn"))


@query("""WITH r AS (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS last_role, lead(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS next_chars FROM conversations)
SELECT conv_id, turn, role, last_role, next_chars FROM r""")
def turn_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("conv_id").orderBy("turn")
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.lag("role").over(order).alias("last_role"),
                                                       F.lead(F.char_length("text").cast("long")).over(order).alias("next_chars"))
