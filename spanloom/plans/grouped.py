"""Grouped statistics over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import expressions as X
from spanloom.operators import aggregates as A
from spanloom.plans.registry import EVENTS_SQL, HOUR, events, q6, query, r6, read


def estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two estimates of a reference: l_extendedprice and the discounted price against quantity times retail price, in hundreds."""
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_quantity", "l_extendedprice", "l_discount")
    p = read(spark, sf_dir, "part").select("p_partkey", "p_retailprice", "p_size")
    j = li.join(p, F.col("l_partkey") == F.col("p_partkey"))
    return j.select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_suppkey", "p_size",
                    (F.col("l_extendedprice") / 1000).alias("fused"), (F.col("l_extendedprice") * (1 - F.col("l_discount")) / 1000).alias("time"),
                    (F.col("l_quantity") * F.col("p_retailprice") / 1000).alias("ref"))


EST = """es AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity, l_suppkey, p_size, l_extendedprice / 1000 AS fused,
 l_extendedprice * (1 - l_discount) / 1000 AS time, l_quantity * p_retailprice / 1000 AS ref FROM lineitem JOIN part ON l_partkey = p_partkey)"""

BAND = "CASE WHEN l_quantity >= 0 AND l_quantity < 10 THEN 'low' WHEN l_quantity >= 10 AND l_quantity < 30 THEN 'mid' WHEN l_quantity >= 30 AND l_quantity <= 50 THEN 'high' END"
BANDS = [(0, 10, "low"), (10, 30, "mid"), (30, 50, "high")]


@query(f"""SELECT c_mktsegment AS segment, count(*) AS n, count(DISTINCT c_nationkey) AS n_people, {q6('avg(c_acctbal)')} AS mean,
 {q6('stddev_samp(c_acctbal)')} AS sd, {q6('median(c_acctbal)')} AS median FROM customer GROUP BY 1""")
def group_descriptives(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = A.describe(read(spark, sf_dir, "customer").withColumnRenamed("c_mktsegment", "segment"), ["segment"], "c_acctbal", "c_nationkey")
    return d.select("segment", "n", "n_people", *[r6(c).alias(c) for c in ("mean", "sd", "median")])


@query(f"""SELECT coalesce(event_type, 'all') AS event_type, count(*) AS n, {q6('avg(value)')} AS mean, {q6('stddev_samp(value)')} AS sd
FROM events GROUP BY GROUPING SETS ((event_type), ())""")
def coverage_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return A.with_total(e, "event_type", [F.count("*").alias("n"), r6(F.avg("value")).alias("mean"), r6(F.stddev_samp("value")).alias("sd")])


@query(f"""WITH m AS (SELECT user_id, median(value) AS md FROM events GROUP BY 1)
SELECT e.user_id, {q6('max(md)')} AS median, {q6('median(abs(value - md))')} AS mad FROM events e JOIN m USING (user_id) GROUP BY 1""")
def mad_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.mad(events(spark, sf_dir), ["user_id"], "value").select("user_id", r6("median").alias("median"), r6("mad").alias("mad"))


@query(f"""WITH m AS (SELECT user_id, median(value) AS md FROM events GROUP BY 1),
d AS (SELECT user_id, md, median(abs(value - md)) AS mad FROM events JOIN m USING (user_id) GROUP BY 1, 2)
SELECT event_id, {q6('(value - md) / (1.4826 * nullif(mad, 0))')} AS z FROM events JOIN d USING (user_id)""")
def robust_z_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.robust_z(events(spark, sf_dir), ["user_id"], "value").select("event_id", r6("robust_z").alias("z"))


TYPES = ("click", "error", "purchase", "signup", "view")


@query(f"""SELECT user_id, {', '.join(f"{q6(f'''count(*) FILTER (event_type = '{t}') / CAST(count(*) AS DOUBLE)''')} AS share_{t}" for t in TYPES)}
FROM events GROUP BY 1""")
def crosstab_row_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = A.crosstab_shares(events(spark, sf_dir), "user_id", "event_type", TYPES)
    return t.select("user_id", *[r6(c).alias(c) for c in t.columns[1:]])


@query(f"""WITH {EST} SELECT {BAND} AS band, count(*) AS n, {q6('avg(abs(fused - ref))')} AS mae, {q6('median(abs(fused - ref))')} AS median_ae,
 {q6('avg(fused - ref)')} AS bias, {q6('sqrt(avg((fused - ref) * (fused - ref)))')} AS rmse, {q6('quantile_cont(abs(fused - ref), 0.9)')} AS p90_ae,
 {q6('max(abs(fused - ref))')} AS max_ae, count(*) FILTER (abs(fused - ref) <= 5) AS within_5, count(*) FILTER (abs(fused - ref) <= 10) AS within_10,
 count(*) FILTER (abs(fused - ref) <= 20) AS within_20, {q6('corr(fused, ref)')} AS pearson, {q6('1.0')} AS coverage FROM es GROUP BY 1""")
def band_error_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = estimates(spark, sf_dir).withColumn("band", X.band(F.col("l_quantity"), BANDS, closed_last=True))
    m = A.error_metrics(e, ["band"], "fused", "ref")
    whole = ("band", "n", "within_5", "within_10", "within_20")
    return m.select(*[F.col(c) if c in whole else r6(c).alias(c) for c in m.columns])


@query(f"""WITH {EST}, d AS (SELECT l_returnflag, abs(time - ref) - abs(fused - ref) AS delta FROM es)
SELECT l_returnflag, count(*) AS n, {q6('avg(delta)')} AS mean_delta, {q6('median(delta)')} AS median_delta, count(*) FILTER (delta < -1e-9) AS better,
 count(*) FILTER (abs(delta) <= 1e-9) AS tied, count(*) FILTER (delta > 1e-9) AS worse FROM d GROUP BY 1""")
def paired_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = A.paired_delta(estimates(spark, sf_dir), ["l_returnflag"], "fused", "time", "ref")
    return d.select("l_returnflag", "n", r6("mean_delta").alias("mean_delta"), r6("median_delta").alias("median_delta"), "better", "tied", "worse")


@query(f"""WITH {EST}, g AS (SELECT l_returnflag, count(*) AS n, sum(time - ref) AS total FROM es GROUP BY 1)
SELECT l_returnflag, n, {q6('total / sum(n) OVER ()')} AS contribution, {q6('total / sum(total) OVER ()')} AS share FROM g""")
def bias_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = A.bias_shares(estimates(spark, sf_dir).withColumn("e", F.col("time") - F.col("ref")), "l_returnflag", "e")
    return b.select("l_returnflag", "n", r6("contribution").alias("contribution"), r6("share").alias("share"))


@query(f"""WITH {EST}, g AS (SELECT l_suppkey, avg(time - ref) FILTER (p_size < 25) AS near, avg(time - ref) FILTER (p_size >= 25) AS far FROM es GROUP BY 1)
SELECT l_suppkey, {q6('near')} AS near, {q6('far')} AS far, {q6('far - near')} AS contrast FROM g""")
def near_far_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = estimates(spark, sf_dir).withColumn("e", F.col("time") - F.col("ref"))
    return A.near_far(e, ["l_suppkey"], "p_size", "e", 25).select("l_suppkey", *[r6(c).alias(c) for c in ("near", "far", "contrast")])


@query(f"""WITH m AS (SELECT unnest(list_filter([CASE WHEN value > 50 THEN 'high' END, CASE WHEN event_type = 'view' THEN 'view' END,
 CASE WHEN user_id % 2 = 0 THEN 'even' END], lambda x: x IS NOT NULL)) AS mask, value FROM events)
SELECT mask, count(*) AS n, {q6('avg(value)')} AS mean FROM m GROUP BY 1""")
def coverage_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    masks = {"high": F.col("value") > 50, "view": F.col("event_type") == "view", "even": F.col("user_id") % 2 == 0}
    return A.masked_counts(events(spark, sf_dir), masks, "value").select("mask", "n", r6("mean").alias("mean"))


@query(f"""WITH s AS (SELECT CASE WHEN value IS NULL THEN NULL ELSE value / (SELECT max(value) FROM events) END AS score,
 CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS y FROM events),
b AS (SELECT {' + '.join(f'CASE WHEN score > {i / 10} THEN 1 ELSE 0 END' for i in range(1, 10))} AS bin, score, y FROM s WHERE score IS NOT NULL)
SELECT CAST(i AS INT) AS bin, count(score) AS n, {q6('avg(score)')} AS mean_score, {q6('avg(y)')} AS rate FROM range(10) t(i) LEFT JOIN b ON b.bin = i GROUP BY 1""")
def calibration_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    top = e.agg(F.max("value").alias("top"))
    s = e.crossJoin(F.broadcast(top)).select((F.col("value") / F.col("top")).alias("score"), (F.col("event_type") == "purchase").cast("int").alias("y"))
    return A.calibration(s, "score", "y").select("bin", "n", r6("mean_score").alias("mean_score"), r6("rate").alias("rate"))


@query("""WITH x AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
b AS (SELECT CAST(greatest(ceil((o_totalprice - lo) / ((hi - lo) / 10)) - 1, 0) AS INT) AS bin FROM orders, x)
SELECT bin, count(*) AS n FROM b GROUP BY 1""")
def equal_width_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.equal_width(read(spark, sf_dir, "orders").select("o_totalprice"), "o_totalprice", 10).groupBy("bin").agg(F.count("*").alias("n"))


@query(f"""SELECT event_type, {', '.join(f"{q6(f'quantile_cont(value, {q})')} AS q{int(q * 100)}" for q in (0.25, 0.5, 0.75))} FROM events GROUP BY 1""")
def quantile_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    q = A.with_percentiles(e.select("event_type").distinct(), e, ["event_type"], "value", {f"q{p}": p / 100 for p in (25, 50, 75)})
    return q.select("event_type", *[r6(f"q{p}").alias(f"q{p}") for p in (25, 50, 75)])


@query(f"""WITH {EVENTS_SQL}, g AS (SELECT user_id, ms - lag(ms) OVER (PARTITION BY user_id ORDER BY ms) AS gap FROM ev)
SELECT user_id, count(gap) AS n, CAST(min(gap) AS BIGINT) AS least, {', '.join(f"{q6(f'quantile_cont(gap, {p / 100})')} AS p{p}" for p in (10, 50, 90, 95))},
 max(gap) AS most FROM g WHERE gap IS NOT NULL GROUP BY 1""")
def gap_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = A.gap_distribution(events(spark, sf_dir), ["user_id"], "ms")
    return g.select("user_id", "n", "least", *[r6(c).alias(c) for c in ("p10", "p50", "p90", "p95")], "most")


@query(f"""WITH {EVENTS_SQL}, c AS (SELECT user_id, event_type, count(*) AS n, min(ms) AS f FROM ev GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f, event_type DESC) AS rn FROM c)
SELECT user_id, max(event_type) FILTER (rn = 1) AS mode, {q6('max(n) / CAST(sum(n) AS DOUBLE)')} AS persistence, count(*) AS n_values FROM r GROUP BY 1""")
def mode_persistence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.mode_stability(events(spark, sf_dir), ["user_id"], "ms", "event_type").select("user_id", "mode", r6("persistence").alias("persistence"), "n_values")


@query(f"""WITH {EST}, l AS (SELECT l_returnflag, 'fused' AS arm, fused AS v, ref FROM es UNION ALL SELECT l_returnflag, 'time', time, ref FROM es)
SELECT l_returnflag, arm, count(*) AS n, {q6('avg(v - ref)')} AS bias, {q6('avg(abs(v - ref))')} AS mae FROM l GROUP BY 1, 2""")
def multi_arm_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = A.long_form(estimates(spark, sf_dir).select("l_returnflag", "ref", "fused", "time"), ["l_returnflag", "ref"], ["fused", "time"])
    e = F.col("value") - F.col("ref")
    return long.groupBy("l_returnflag", "arm").agg(F.count("*").alias("n"), r6(F.avg(e)).alias("bias"), r6(F.avg(F.abs(e))).alias("mae"))


@query(f"""WITH g AS (SELECT * FROM (SELECT DISTINCT o_orderpriority FROM orders), (SELECT DISTINCT o_orderstatus FROM orders))
SELECT g.o_orderpriority, g.o_orderstatus, count(o_orderkey) AS n, {q6('avg(o_totalprice)')} AS mean FROM g LEFT JOIN orders o
ON o.o_orderpriority = g.o_orderpriority AND o.o_orderstatus = g.o_orderstatus AND o_totalprice > 200000 GROUP BY 1, 2""")
def dense_cross_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select("o_orderpriority", "o_orderstatus", "o_totalprice")
    price = F.when(F.col("o_totalprice") > 200000, F.col("o_totalprice"))
    d = A.dense_grid(o, "o_orderpriority", "o_orderstatus", [F.count(price).alias("n"), r6(F.avg(price)).alias("mean")])
    return d.na.fill(0, ["n"])


@query(f"""WITH c AS (SELECT l_returnflag, l_orderkey % 7 AS chunk, avg(l_quantity) AS m, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT l_returnflag, {q6('sum(m * n) / sum(n)')} AS mean, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1""")
def frame_weighted_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "lineitem").groupBy("l_returnflag", (F.col("l_orderkey") % 7).alias("chunk")).agg(F.avg("l_quantity").alias("m"), F.count("*").alias("n"))
    return A.frame_weighted_mean(c, ["l_returnflag"], "m", "n").select("l_returnflag", r6("mean").alias("mean"), "n")


@query(f"""WITH {EST}, f AS (SELECT unnest(list_filter([CASE WHEN l_quantity > 40 THEN 'large' END, CASE WHEN fused > 50 THEN 'dear' END,
 CASE WHEN p_size < 5 THEN 'small' END], lambda x: x IS NOT NULL)) AS flag FROM es) SELECT flag, count(*) AS n FROM f GROUP BY 1""")
def flag_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = estimates(spark, sf_dir)
    f = e.select(F.array_join(X.flags([(F.col("l_quantity") > 40, "large"), (F.col("fused") > 50, "dear"), (F.col("p_size") < 5, "small")]), "|").alias("flags"))
    return A.flag_counts(f, "flags")


@query(f"""WITH {EST}, m AS (SELECT avg(abs(time - ref)) AS mae, avg(time - ref) AS bias, max(abs(time - ref)) AS worst FROM es),
f AS (SELECT *, list_filter([CASE WHEN NOT mae < 5 THEN 'mae' END, CASE WHEN NOT abs(bias) < 1 THEN 'bias' END, CASE WHEN NOT worst < 1 THEN 'worst' END], lambda x: x IS NOT NULL) AS failed FROM m)
SELECT {q6('mae')} AS mae, {q6('bias')} AS bias, {q6('worst')} AS worst, array_to_string(failed, ',') AS failed, len(failed) = 0 AS accepted FROM f""")
def acceptance_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("time") - F.col("ref")
    m = estimates(spark, sf_dir).agg(F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias"), F.max(F.abs(e)).alias("worst"))
    v = A.acceptance(m, {"mae": F.col("mae") < 5, "bias": F.abs("bias") < 1, "worst": F.col("worst") < 1})
    return v.select(r6("mae").alias("mae"), r6("bias").alias("bias"), r6("worst").alias("worst"), F.array_join("failed", ",").alias("failed"), "accepted")


@query(f"""SELECT event_type, count(*) AS n, {q6('sum(value) / count(*)')} AS pooled, count(*) FILTER (value IS NULL) AS missing,
 {q6('count(*) FILTER (value > 50) / CAST(count(*) AS DOUBLE)')} AS high_rate FROM events GROUP BY 1""")
def trial_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("event_type").agg(
        F.count("*").alias("n"), r6(F.sum("value") / F.count("*")).alias("pooled"), F.count_if(F.col("value").isNull()).alias("missing"),
        r6(F.count_if(F.col("value") > 50) / F.count("*")).alias("high_rate"))


@query(f"""WITH s AS (SELECT avg(fused - ref) AS bias, stddev_samp(fused - ref) AS sd, avg(abs(fused - ref)) AS mae FROM ({'SELECT l_extendedprice / 1000 AS fused, l_quantity * p_retailprice / 1000 AS ref FROM lineitem JOIN part ON l_partkey = p_partkey'}))
SELECT {q6('bias')} AS bias, {q6('sd')} AS sd, {q6('bias - 1.96 * sd')} AS low, {q6('bias + 1.96 * sd')} AS high, {q6('mae')} AS mae FROM s""")
def bland_altman(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("fused") - F.col("ref")
    s = estimates(spark, sf_dir).agg(F.avg(e).alias("bias"), F.stddev_samp(e).alias("sd"), F.avg(F.abs(e)).alias("mae"))
    return s.select(r6("bias").alias("bias"), r6("sd").alias("sd"), r6(F.col("bias") - 1.96 * F.col("sd")).alias("low"),
                    r6(F.col("bias") + 1.96 * F.col("sd")).alias("high"), r6("mae").alias("mae"))


@query(f"""WITH {EVENTS_SQL}, c AS (SELECT user_id, CAST(floor(ms / {24 * HOUR}.0) AS BIGINT) AS day, min(ms) AS a, max(ms) AS b, count(*) AS n FROM ev GROUP BY 1, 2)
SELECT user_id, day, n, {q6(f'least(greatest((b - a) / {24 * HOUR}.0, 0), 1)')} AS coverage,
 CASE WHEN (b - a) / {24 * HOUR}.0 >= 0.5 THEN 'COMPLETE' WHEN n > 1 THEN 'PARTIAL' ELSE 'SEVERELY_INCOMPLETE' END AS class FROM c""")
def coverage_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = 24 * HOUR
    c = events(spark, sf_dir).groupBy("user_id", F.floor(F.col("ms") / day).alias("day")).agg(F.min("ms").alias("a"), F.max("ms").alias("b"), F.count("*").alias("n"))
    share = (F.col("b") - F.col("a")) / day
    return c.select("user_id", "day", "n", r6(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))).alias("coverage"),
                    X.first_match([(share >= 0.5, "COMPLETE"), (F.col("n") > 1, "PARTIAL")], "SEVERELY_INCOMPLETE").alias("class"))
