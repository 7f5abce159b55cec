"""Audit queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.operators import audits as A
from spanloom.operators import joins, windows
from spanloom.plans.registry import EVENTS_SQL, HOUR, events, q6, query, r6, read

ORDER = "OVER (PARTITION BY user_id ORDER BY ms, event_id)"


@query(f"""WITH {EVENTS_SQL}, r AS (SELECT lag(value) {ORDER} AS previous, value AS event, lead(value) {ORDER} AS post, event_type FROM ev),
l AS (SELECT unnest(['previous', 'event', 'post']) AS phase, unnest([previous, event, post]) AS v FROM r WHERE event_type = 'error')
SELECT phase, count(v) AS n, {q6('avg(v)')} AS mean, {q6('stddev_samp(v) / sqrt(count(v))')} AS se FROM l GROUP BY 1""")
def response_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = A.response_curve(events(spark, sf_dir), ["user_id"], ["ms", "event_id"], "value", F.col("event_type") == "error")
    return c.select("phase", "n", r6("mean").alias("mean"), r6("se").alias("se"))


@query(f"""SELECT c_custkey, {q6('1 / (1 + exp(-least(greatest(0.8 * (c_acctbal - 4500) / 3000 - 0.3 * (c_nationkey - 12) / 7 + 0.1, -60), 60)))')} AS score FROM customer""")
def model_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = spark.createDataFrame([([4500.0, 12.0], [3000.0, 7.0], [0.8, -0.3], 0.1)], "mean array<double>, scale array<double>, coef array<double>, intercept double")
    return A.apply_model(read(spark, sf_dir, "customer"), ["c_acctbal", "c_nationkey"], model).select("c_custkey", r6("score").alias("score"))


@query(f"""SELECT n_regionkey AS region, n_nationkey AS nation, count(c_custkey) AS n, count(DISTINCT c_mktsegment) AS segments,
 count(*) FILTER (c_acctbal > 0) AS positive, count(*) FILTER (c_custkey IS NULL) AS missing FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal < 1000 GROUP BY 1, 2""")
def coverage_by_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("region"), F.col("n_nationkey").alias("nation"))
    c = read(spark, sf_dir, "customer").where("c_acctbal < 1000").select(F.col("c_nationkey").alias("nation"), "c_custkey", "c_mktsegment", "c_acctbal")
    return n.join(c, "nation", "left").groupBy("region", "nation").agg(
        F.count("c_custkey").alias("n"), F.countDistinct("c_mktsegment").alias("segments"), F.count_if(F.col("c_acctbal") > 0).alias("positive"),
        F.count_if(F.col("c_custkey").isNull()).alias("missing"))


@query(f"""WITH {EVENTS_SQL}, iv AS (SELECT user_id, ms AS lo, ms + {6 * HOUR} AS hi FROM ev WHERE event_type = 'signup'),
p AS (SELECT event_id, user_id, EXISTS (SELECT 1 FROM iv WHERE iv.user_id = ev.user_id AND ev.ms BETWEEN lo AND hi) AS hit FROM ev WHERE event_type = 'click')
SELECT user_id, count(*) AS n, count(*) FILTER (hit) AS inside, {q6('count(*) FILTER (hit) / CAST(count(*) AS DOUBLE)')} AS fraction FROM p GROUP BY 1""")
def interval_coverage_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    iv = e.where("event_type = 'signup'").select("user_id", F.col("ms").alias("lo"), (F.col("ms") + 6 * HOUR).alias("hi"))
    f = A.inside_fraction(e.where("event_type = 'click'").select("user_id", "ms"), iv, ["user_id"], "ms", "lo", "hi")
    return f.select("user_id", "n", "inside", r6("fraction").alias("fraction"))


@query(f"""WITH {EVENTS_SQL}, r AS (SELECT user_id, event_type, row_number() {ORDER} AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM ev),
h AS (SELECT user_id, event_type, rn <= greatest(1, n // 2) AS f FROM r),
s AS (SELECT user_id, count(DISTINCT event_type) FILTER (f) AS n_first, count(DISTINCT event_type) FILTER (NOT f) AS n_second, count(DISTINCT event_type) AS n_all FROM h GROUP BY 1)
SELECT user_id, CAST(n_first AS INT) AS n_first, CAST(n_second AS INT) AS n_second, n_first = n_all AS covered FROM s""")
def label_coverage_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("half", windows.half(["user_id"], ["ms", "event_id"]))
    return A.label_coverage(e, ["user_id"], "half", "event_type")


@query(f"""WITH d AS (SELECT o_orderpriority AS g, round(o_totalprice - 150000, 0) AS d FROM orders), m AS (SELECT g, d, abs(d) AS m FROM d WHERE d <> 0),
r AS (SELECT g, d, rank() OVER (PARTITION BY g ORDER BY m) + (count(*) OVER (PARTITION BY g, m) - 1) / 2.0 AS r FROM m),
s AS (SELECT g, CAST(count(*) AS DOUBLE) AS n, count(*) FILTER (d > 0) AS positive, avg(d) / nullif(stddev_samp(d), 0) AS cohen_d, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w FROM r GROUP BY 1)
SELECT g, CAST(n AS BIGINT) AS n, positive, {q6('cohen_d')} AS cohen_d, {q6('(w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24)')} AS wilcoxon_z,
 {q6('t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * exp(-x * x)')} AS sign_p
 FROM (SELECT *, greatest(abs(positive - n / 2) - 0.5, 0) / sqrt(n / 4) / sqrt(2.0) AS x, 1 / (1 + 0.3275911 * x) AS t FROM s)""")
def paired_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("g"), F.round(F.col("o_totalprice") - 150000, 0).alias("d"))
    t = A.paired_tests(d, ["g"], "d")
    return t.select("g", "n", "positive", r6("cohen_d").alias("cohen_d"), r6("wilcoxon_z").alias("wilcoxon_z"), r6("sign_p").alias("sign_p"))


@query(f"""WITH {EVENTS_SQL}, s AS (SELECT user_id, ms, min(value) AS v FROM ev GROUP BY 1, 2),
g AS (SELECT user_id, ms AS a, v AS x, lead(ms) OVER (PARTITION BY user_id ORDER BY ms) AS b, lead(v) OVER (PARTITION BY user_id ORDER BY ms) AS y FROM s),
e AS (SELECT user_id, a, b, x, y, unnest(range(CAST(ceil(a / {24.0 * HOUR}) AS BIGINT), CAST(ceil(b / {24.0 * HOUR}) AS BIGINT))) * {24 * HOUR} AS grid FROM g WHERE b IS NOT NULL)
SELECT user_id, CAST(grid AS BIGINT) AS grid, {q6('x + (y - x) * (grid - a) / (b - a)')} AS value FROM e
UNION ALL SELECT user_id, a, {q6('x')} FROM g WHERE b IS NULL AND a % {24 * HOUR} = 0""")
def resample_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = events(spark, sf_dir).groupBy("user_id", "ms").agg(F.min("value").alias("v"))
    return A.resampled(s, ["user_id"], "ms", "v", 24 * HOUR).select("user_id", "grid", r6("value").alias("value"))


@query(f"""WITH {EVENTS_SQL}, s AS (SELECT event_id, value, event_type, user_id % 3 <> 0 AS eligible FROM ev),
m AS (SELECT unnest(list_filter(['S0', CASE WHEN eligible THEN 'S1' END, CASE WHEN eligible AND value > 20 THEN 'S2' END], lambda x: x IS NOT NULL)) AS selection, event_type, value FROM s)
SELECT selection, event_type, count(*) AS n, {q6('avg(abs(value - 50))')} AS mae FROM m GROUP BY 1, 2""")
def selection_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = F.col("user_id") % 3 != 0
    masks = F.array_compact(F.array(F.lit("S0"), F.when(ok, "S1"), F.when(ok & (F.col("value") > 20), "S2")))
    m = events(spark, sf_dir).select("event_type", "value", F.explode(masks).alias("selection"))
    return m.groupBy("selection", "event_type").agg(F.count("*").alias("n"), r6(F.avg(F.abs(F.col("value") - 50))).alias("mae"))


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, abs(l_quantity - 25) AS d, row_number() OVER (PARTITION BY l_orderkey ORDER BY abs(l_quantity - 25), l_linenumber) AS rn FROM lineitem)
SELECT l_orderkey, l_linenumber AS nearest, d, CASE WHEN d <= 1 THEN 'exact' WHEN d <= 5 THEN 'nearby' ELSE 'far' END AS truth FROM c WHERE rn = 1""")
def nearest_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.abs(F.col("l_quantity") - 25)
    g = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min_by("l_linenumber", F.struct(d, "l_linenumber")).alias("nearest"), F.min(d).alias("d"))
    return g.withColumn("truth", F.when(F.col("d") <= 1, "exact").when(F.col("d") <= 5, "nearby").otherwise("far"))


@query("SELECT n_nationkey, count(DISTINCT c_custkey) AS n_customers, count(DISTINCT s_suppkey) AS n_suppliers FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
def same_keys_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation").select("n_nationkey")

    def counted(name: str, key: str, out: str) -> DataFrame:
        t = read(spark, sf_dir, name).groupBy(F.col(key).alias("n_nationkey")).agg(F.count("*").alias(out))
        return n.join(t, "n_nationkey", "left").na.fill(0, [out])

    return joins.same_keys_join(n, [counted("customer", "c_nationkey", "n_customers"), counted("supplier", "s_nationkey", "n_suppliers")], ["n_nationkey"])


@query(f"""WITH RECURSIVE {EVENTS_SQL}, a AS (SELECT DISTINCT user_id, ms FROM ev WHERE event_type = 'click'), b AS (SELECT DISTINCT user_id, ms FROM ev WHERE event_type = 'view'),
p AS (SELECT a.user_id, a.ms AS a, b.ms AS b, row_number() OVER (PARTITION BY a.user_id ORDER BY abs(a.ms - b.ms), a.ms, b.ms) AS k FROM a JOIN b ON a.user_id = b.user_id AND abs(a.ms - b.ms) <= {3 * HOUR}),
w AS (SELECT user_id, k, a, b, true AS free, [a] AS used_a, [b] AS used_b FROM p WHERE k = 1
 UNION ALL SELECT p.user_id, p.k, p.a, p.b, NOT list_contains(used_a, p.a) AND NOT list_contains(used_b, p.b),
  CASE WHEN list_contains(used_a, p.a) OR list_contains(used_b, p.b) THEN used_a ELSE list_append(used_a, p.a) END,
  CASE WHEN list_contains(used_a, p.a) OR list_contains(used_b, p.b) THEN used_b ELSE list_append(used_b, p.b) END FROM w JOIN p ON p.user_id = w.user_id AND p.k = w.k + 1)
SELECT user_id, a, b FROM w WHERE free""")
def greedy_global_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks and views of a user paired one to one within three hours, nearest first."""
    e = events(spark, sf_dir)
    return A.greedy_global_match(e.where("event_type = 'click'"), e.where("event_type = 'view'"), ["user_id"], "ms", 3 * HOUR)


@query(f"""WITH o AS (SELECT o_orderkey, unnest(['price', 'customer']) AS field,
 unnest([CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice END, CAST(o_custkey AS DOUBLE)]) AS a,
 unnest([CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 2.5 ELSE o_totalprice END, CASE WHEN o_orderkey % 13 <> 0 THEN CAST(o_custkey AS DOUBLE) END]) AS b FROM orders)
SELECT field, count(*) FILTER (a IS DISTINCT FROM b) AS changed, count(*) FILTER (a IS NOT NULL AND b IS NULL) AS to_null, count(*) FILTER (a IS NULL AND b IS NOT NULL) AS from_null,
 count(abs(b - a)) AS pairs, {q6('median(abs(b - a))')} AS median, {q6('quantile_cont(abs(b - a), 0.9)')} AS p90, {q6('max(abs(b - a))')} AS most FROM o GROUP BY 1""")
def version_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"), F.col("o_custkey").alias("customer"))
    key = F.col("o_orderkey")
    old = o.withColumn("price", F.when(key % 11 != 0, F.col("price")))
    new = o.withColumns({"price": F.when(key % 7 == 0, F.col("price") + 2.5).otherwise(F.col("price")), "customer": F.when(key % 13 != 0, F.col("customer"))})
    d = A.version_diff(old, new, ["o_orderkey"], ["price", "customer"])
    return d.select("field", "changed", "to_null", "from_null", "pairs", *[r6(c).alias(c) for c in ("median", "p90", "most")])


@query(f"""WITH {EVENTS_SQL}, t AS (SELECT event_type, quantile_cont(value, 0.9) AS lim FROM ev GROUP BY 1),
w AS (SELECT event_type, CAST(floor(ms / {6.0 * HOUR}) AS BIGINT) AS win, count(value) AS n, avg(value) AS mean FROM ev GROUP BY 1, 2)
SELECT event_type, win AS "window", n, {q6('mean')} AS mean, mean > lim AS artifact FROM w JOIN t USING (event_type) WHERE n >= 3""")
def artifact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = A.artifact_windows(events(spark, sf_dir), ["event_type"], F.floor(F.col("ms") / (6 * HOUR)), "value", 0.9, 3)
    return a.select("event_type", "window", "n", r6("mean").alias("mean"), "artifact")


@query(f"""WITH {EVENTS_SQL}, a AS (SELECT event_id, value AS v, avg(value) OVER (PARTITION BY user_id) AS m FROM ev)
SELECT event_id, CASE WHEN v / 2 BETWEEN 10 AND 200 AND abs(v / 2 - m) <= 0.2 * m THEN {q6('v / 2')} WHEN v * 2 BETWEEN 10 AND 200 AND abs(v * 2 - m) <= 0.2 * m THEN {q6('v * 2')}
 ELSE {q6('v')} END AS rate, coalesce(v / 2 BETWEEN 10 AND 200 AND abs(v / 2 - m) <= 0.2 * m OR v * 2 BETWEEN 10 AND 200 AND abs(v * 2 - m) <= 0.2 * m, false) AS folded FROM a""")
def harmonic_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    # summed in the order of ids: at the very edge of the share the last bit of the mean decides, whatever order a shuffle brings
    whole = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    a = events(spark, sf_dir).select("event_id", F.col("value").alias("v"), F.avg("value").over(whole).alias("m"))
    rate, folded = A.harmonic_fold(F.col("v"), F.col("m"), 10, 200)
    return a.select("event_id", r6(rate).alias("rate"), folded.alias("folded"))


@query(f"""WITH {EVENTS_SQL}, s AS (SELECT user_id % 12 AS cell, ms // {6 * HOUR} AS t, avg(value) AS v FROM ev GROUP BY 1, 2),
d AS (SELECT cell, t, v - lag(v) OVER (PARTITION BY cell ORDER BY t) AS x FROM s),
r AS (SELECT a.cell, b.cell AS other, corr(a.x, b.x) AS r FROM d a JOIN d b ON a.t = b.t AND a.cell <> b.cell AND abs(a.cell - b.cell) <= 2 GROUP BY 1, 2)
SELECT c.cell, {q6('coalesce(max(CASE WHEN isnan(r) THEN 0 ELSE abs(r) END), 0)')} AS coherence FROM (SELECT DISTINCT cell FROM s) c LEFT JOIN r USING (cell) GROUP BY 1""")
def neighbour_coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = events(spark, sf_dir).groupBy((F.col("user_id") % 12).alias("cell"), F.expr(f"ms div {6 * HOUR}").alias("t")).agg(F.avg("value").alias("v"))
    return A.neighbour_coherence(s, [], "t", "cell", "v").select("cell", r6("coherence").alias("coherence"))


@query("""WITH p AS (SELECT split_part(url, '/', 3) AS host, url FROM pages),
r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY contains(url, 'index'), len(string_split(url, '/')), url) AS rn FROM p)
SELECT host, url AS path FROM r WHERE rn = 1""")
def preferred_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "pages").select(F.split_part("url", F.lit("/"), F.lit(3)).alias("host"), "url")
    return A.preferred_path(p, ["host"], "url", "index")
