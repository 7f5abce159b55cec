"""Scalar rules, filters, lookups and small tables over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.functions import expressions as X
from spanloom.operators import aggregates as A
from spanloom.operators import contracts, joins, windows
from spanloom.plans.registry import EVENTS_SQL, HOUR, events, q6, query, r6, read

ORDER = "OVER (PARTITION BY user_id ORDER BY ms, event_id)"


@query("""WITH t AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'abc' WHEN 1 THEN '' WHEN 2 THEN '12' WHEN 3 THEN '-7.5' ELSE ' 3 ' END AS raw,
 CASE c_custkey % 4 WHEN 0 THEN 'Yes' WHEN 1 THEN ' false' WHEN 2 THEN '1' END AS flag, CASE c_custkey % 4 WHEN 0 THEN '1.0' WHEN 1 THEN 'no' WHEN 2 THEN 'TRUE' END AS loose,
 CASE c_custkey % 4 WHEN 0 THEN 'block-1' WHEN 1 THEN 'B02' WHEN 2 THEN ' b10' ELSE 'rest' END AS block FROM customer)
SELECT c_custkey, TRY_CAST(trim(raw) AS DOUBLE) AS number, CASE WHEN c_custkey % 5 = 2 THEN 12 END AS whole, CASE lower(trim(flag)) WHEN 'yes' THEN true WHEN '1' THEN true WHEN 'false' THEN false END AS strict,
 coalesce(lower(trim(loose)) IN ('true', '1', '1.0', 'yes'), false) AS lenient,
 CASE WHEN regexp_matches(lower(trim(block)), '^(?:block[-_ ]?|b)?0*\\d+$') THEN 'b' || regexp_extract(lower(trim(block)), '^(?:block[-_ ]?|b)?0*(\\d+)$', 1) END AS block FROM t""")
def coerced_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    def cases(n: int, values: list) -> F.Column:
        return F.element_at(F.array(*map(F.lit, values)), (F.col("c_custkey") % n + 1).cast("int"))

    c = read(spark, sf_dir, "customer").select(
        "c_custkey", cases(5, ["abc", "", "12", "-7.5", " 3 "]).alias("raw"), F.when(F.col("c_custkey") % 5 == 2, "12").alias("integer"),
        cases(4, ["Yes", " false", "1", None]).alias("flag"), cases(4, ["1.0", "no", "TRUE", None]).alias("loose"), cases(4, ["block-1", "B02", " b10", "rest"]).alias("block"))
    return c.select("c_custkey", X.number("raw").alias("number"), X.strict_number("integer", "int").alias("whole"), X.strict_flag("flag").alias("strict"),
                    X.lenient_flag("loose").alias("lenient"), X.block_name("block").alias("block"))


@query(f"""WITH t AS (SELECT event_id, value * 10 AS rt, CAST(event_id % 7 = 0 AS INT) AS no_go, CAST(event_type <> 'view' AS INT) AS response,
 CASE event_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 END AS correct FROM events)
SELECT event_id, {q6("CASE WHEN no_go = 0 AND response = 1 AND rt >= 150 THEN rt END")} AS rt, CAST(coalesce(correct = 0, false) AS INT) AS strict,
 CAST(coalesce(correct, 0) <> 1 AS INT) AS lenient, CAST(correct <> 1 AS INT) AS target, CAST(correct = 1 AS INT) AS inverse FROM t""")
def trial_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    t = events(spark, sf_dir).select("event_id", (F.col("value") * 10).alias("rt"), (i % 7 == 0).cast("int").alias("no_go"), (F.col("event_type") != "view").cast("int").alias("response"),
                                     F.when(i % 3 == 0, 0).when(i % 3 == 1, 1).alias("correct"))
    return t.select("event_id", r6(X.valid_rt("no_go", "response", "rt")).alias("rt"), X.error_strict("correct").alias("strict"), X.error_lenient("correct").alias("lenient"),
                    (F.col("correct") != 1).cast("int").alias("target"), (F.col("correct") == 1).cast("int").alias("inverse"))


@query(f"""WITH {EVENTS_SQL}, s AS (SELECT *, min(ms) OVER (PARTITION BY user_id) AS lo, max(ms) OVER (PARTITION BY user_id) AS hi FROM ev)
SELECT event_id, lo, hi, ms - lo AS elapsed, {q6('least(greatest((ms - lo) / CAST(nullif(hi - lo, 0) AS DOUBLE), 0), 1)')} AS progress FROM s""")
def relative_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id")
    e = events(spark, sf_dir).select("event_id", "ms", F.min("ms").over(w).alias("lo"), F.max("ms").over(w).alias("hi"))
    share = F.when(F.col("hi") > F.col("lo"), X.clipped_share(F.col("ms"), F.col("lo"), F.col("hi")))
    return e.select("event_id", "lo", "hi", (F.col("ms") - F.col("lo")).alias("elapsed"), r6(share).alias("progress"))


@query(f"""SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN {q6('ln(c_acctbal)')} END AS log_balance, {q6('ln(1 + abs(c_acctbal))')} AS log1p_balance,
 {q6('10 * log10(1 + abs(c_acctbal))')} AS db, CAST(sign(c_acctbal) AS INT) AS sign, {q6('sqrt(c_acctbal * c_acctbal + c_nationkey * c_nationkey)')} AS hypot FROM customer""")
def guarded_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("c_acctbal")
    return read(spark, sf_dir, "customer").select("c_custkey", r6(X.guarded_log(b)).alias("log_balance"), r6(F.log1p(F.abs(b))).alias("log1p_balance"),
                                                  r6(10 * F.log10(1 + F.abs(b))).alias("db"), F.signum(b).cast("int").alias("sign"), r6(F.hypot(b, F.col("c_nationkey"))).alias("hypot"))


@query("""WITH t AS (SELECT event_id, value AS v, CAST(60 + event_id % 40 AS DOUBLE) AS ref, CAST(12 + event_id % 9 AS DOUBLE) AS breath FROM events)
SELECT event_id, array_to_string(list_filter([CASE WHEN abs(v - breath * 2) <= 5 OR abs(v - breath * 3) <= 5 THEN 'breath' END, CASE WHEN abs(v - ref * 2) <= 5 THEN 'double' END,
 CASE WHEN abs(v - ref / 2) <= 5 THEN 'half' END], lambda x: x IS NOT NULL), '|') AS relation FROM t""")
def harmonic_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    flags = X.harmonic_flags((60 + i % 40).cast("double"), F.col("value"), (12 + i % 9).cast("double"))
    return events(spark, sf_dir).select("event_id", F.array_join(flags, "|").alias("relation"))


@query("""WITH t AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN CAST('nan' AS DOUBLE) WHEN 2 THEN CAST('inf' AS DOUBLE) ELSE o_totalprice END AS a, CAST(o_custkey AS DOUBLE) AS b FROM orders)
SELECT o_orderkey, coalesce(isfinite(a), false) AND coalesce(isfinite(b), false) AS finite FROM t""")
def finite_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 6
    a = F.when(k == 0, None).when(k == 1, float("nan")).when(k == 2, float("inf")).otherwise(F.col("o_totalprice"))
    return read(spark, sf_dir, "orders").select("o_orderkey", a.alias("a"), F.col("o_custkey").cast("double").alias("b")).select("o_orderkey", X.all_finite(["a", "b"]).alias("finite"))


@query("""SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_totalprice > 200000 THEN 'dear' END, CASE WHEN o_orderstatus = 'O' THEN 'open' END, CASE WHEN o_orderpriority LIKE '1%' THEN 'urgent' END], lambda x: x IS NOT NULL), '|') AS flags,
 array_to_string(list_filter([CASE WHEN o_orderpriority LIKE '1%' THEN 'priority' END, CASE WHEN o_orderstatus = 'O' AND NOT o_orderpriority LIKE '1%' THEN 'priority' END, CASE WHEN o_totalprice > 200000 THEN 'amount' END], lambda x: x IS NOT NULL), '|') AS reasons,
 NOT (o_totalprice > 200000 OR o_orderstatus = 'O' OR o_orderpriority LIKE '1%') AS usable FROM orders""")
def quality_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    dear, is_open, urgent = F.col("o_totalprice") > 200000, F.col("o_orderstatus") == "O", F.col("o_orderpriority").like("1%")
    found = X.flags([(urgent, "urgent"), (is_open, "open"), (dear, "dear")])
    why = X.reasons([(urgent, "priority"), (is_open, "priority"), (dear, "amount")])
    return read(spark, sf_dir, "orders").select("o_orderkey", F.array_join(found, "|").alias("flags"), F.array_join(why, "|").alias("reasons"), (F.size(found) == 0).alias("usable"))


@query(f"""WITH {EVENTS_SQL}, s AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'signup') AS probes, max(ms) - min(ms) AS span FROM ev GROUP BY 1)
SELECT user_id, CASE WHEN probes = 0 THEN 'U' WHEN errors * 10 <= n THEN 'A' WHEN errors * 4 <= n THEN 'B' ELSE 'C' END AS attribution,
 CASE WHEN probes = 0 THEN 3 WHEN errors * 10 <= n AND span >= {24 * HOUR} THEN 1 WHEN errors * 4 <= n THEN 2 ELSE 3 END AS tier,
 CASE WHEN span < {24 * HOUR} THEN 'short' WHEN errors * 4 > n THEN 'errors' WHEN probes = 0 THEN 'no_probe' ELSE 'none' END AS failure FROM s""")
def session_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    s = events(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(kind == "error").alias("errors"), F.count_if(kind == "signup").alias("probes"),
                                                     (F.max("ms") - F.min("ms")).alias("span"))
    few, some, none = F.col("errors") * 10 <= F.col("n"), F.col("errors") * 4 <= F.col("n"), F.col("probes") == 0
    day = F.col("span") >= 24 * HOUR
    return s.select("user_id", X.first_match([(none, "U"), (few, "A"), (some, "B")], "C").alias("attribution"),
                    F.when(none, 3).when(few & day, 1).when(some, 2).otherwise(3).alias("tier"), X.first_match([(~day, "short"), (~some, "errors"), (none, "no_probe")], "none").alias("failure"))


@query("""SELECT source, count(*) AS n, count(*) FILTER (coalesce(contains(text, 'license'), false)) AS with_word, count(*) FILTER (coalesce(regexp_matches(text, '[0-9]{3}-[0-9]{4}'), false)) AS with_number
FROM documents GROUP BY 1""")
def text_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return read(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_if(X.has_text(t, "license")).alias("with_word"),
                                                                  F.count_if(X.has_pattern(t, "[0-9]{3}-[0-9]{4}")).alias("with_number"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal END AS balance, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS segment, CASE WHEN c_custkey % 3 <> 0 THEN 1 ELSE 0 END AS available,
 CASE WHEN c_custkey % 3 <> 0 THEN c_nationkey / 24.0 ELSE 0.0 END AS quality FROM customer""")
def modality_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"), F.lit(1).alias("available"), (F.col("c_nationkey") / 24).alias("quality"))
    return X.masked(c, F.col("c_custkey") % 3 == 0, ["balance", "segment"], ["available", "quality"])


@query(f"""WITH {EVENTS_SQL}, o AS (SELECT event_id, row_number() {ORDER} AS i FROM ev) SELECT event_id, {q6('(i - 1) / 9.0')} AS fraction FROM o WHERE i <= 10""")
def fixed_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ms", "event_id")
    o = events(spark, sf_dir).select("event_id", F.row_number().over(order).alias("i")).where("i <= 10")
    return o.select("event_id", r6((F.col("i") - 1) / 9).alias("fraction"))


@query(f"""SELECT o_orderkey, CAST(DATE '1899-12-30' + CAST(o_custkey % 40000 AS INT) AS VARCHAR) AS serial, CAST(make_date(2000 + CAST(o_orderkey % 20 AS INT), 1 + CAST(o_orderkey % 12 AS INT), 1 + CAST(o_orderkey % 28 AS INT)) AS VARCHAR) AS made,
 CAST(epoch_ms(CAST(o_orderkey AS BIGINT) * {HOUR}) AS VARCHAR) AS stamp FROM orders""")
def date_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    part = lambda n: (k % n).cast("int")
    return read(spark, sf_dir, "orders").select("o_orderkey", X.serial_date(F.col("o_custkey") % 40000).cast("string").alias("serial"),
                                                F.make_date(2000 + part(20), 1 + part(12), 1 + part(28)).cast("string").alias("made"),
                                                F.timestamp_millis(k.cast("long") * HOUR).cast("string").alias("stamp"))


@query("""WITH v AS (SELECT CASE WHEN event_type <> 'view' THEN event_type END AS kind FROM events)
SELECT kind, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 8) AS share FROM v GROUP BY 1""")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select(F.when(F.col("event_type") != "view", F.col("event_type")).alias("kind"))
    return A.value_counts(e, "kind")


@query(f"""WITH c AS (SELECT l_returnflag, CASE WHEN l_discount <= 0.03 THEN 'le3' WHEN l_discount <= 0.06 THEN 'le6' ELSE 'gt6' END AS class, count(*) AS n, sum(abs(l_quantity - 25)) AS s FROM lineitem GROUP BY 1, 2)
SELECT l_returnflag, CAST(sum(n) AS BIGINT) AS n, {q6('sum(s) / sum(n)')} AS mae, '{{' || string_agg('"' || class || '":' || n, ',' ORDER BY class) || '}}' AS classes FROM c GROUP BY 1""")
def group_errors_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("l_discount")
    li = read(spark, sf_dir, "lineitem").select("l_returnflag", F.abs(F.col("l_quantity") - 25).alias("e"), X.first_match([(d <= 0.03, "le3"), (d <= 0.06, "le6")], "gt6").alias("class"))
    return A.class_counts(li, ["l_returnflag"], "class", "e").select("l_returnflag", "n", r6("mae").alias("mae"), "classes")


@query(f"""WITH e AS (SELECT l_returnflag AS g, l_extendedprice AS x, l_quantity * p_retailprice AS y FROM lineitem JOIN part ON l_partkey = p_partkey),
r AS (SELECT g, rank() OVER (PARTITION BY g ORDER BY x) + (count(*) OVER (PARTITION BY g, x) - 1) / 2.0 AS a, rank() OVER (PARTITION BY g ORDER BY y) + (count(*) OVER (PARTITION BY g, y) - 1) / 2.0 AS b FROM e)
SELECT g, count(*) AS n, {q6('corr(a, b)')} AS rho FROM r GROUP BY 1""")
def error_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_returnflag").alias("g"), F.col("l_extendedprice").alias("x"), "l_quantity")
    e = li.join(read(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey")).withColumn("y", F.col("l_quantity") * F.col("p_retailprice"))
    return windows.spearman_by_values(e, ["g"], "x", "y").select("g", "n", r6("rho").alias("rho"))


@query(f"""WITH {EVENTS_SQL}, g AS (SELECT (ms - lag(ms) OVER (PARTITION BY user_id ORDER BY ms)) / {HOUR}.0 AS h FROM ev)
SELECT CAST(floor(h) AS BIGINT) AS hours, count(*) AS n, count(*) FILTER (abs(h - round_even(h, 0)) <= 0.1) AS near_period FROM g WHERE h IS NOT NULL GROUP BY 1""")
def gap_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = (F.col("ms") - F.lag("ms").over(Window.partitionBy("user_id").orderBy("ms"))) / HOUR
    g = events(spark, sf_dir).select(h.alias("h")).where("h is not null")
    return g.groupBy(F.floor("h").alias("hours")).agg(F.count("*").alias("n"), F.count_if(F.abs(F.col("h") - F.rint("h")) <= 0.1).alias("near_period"))


@query(f"""SELECT lang, sum(CAST(n_chars > 1000 AS INT)) / CAST(count(*) AS DOUBLE) AS long_rate, {q6('sum(n_chars) / CAST(count(*) AS DOUBLE)')} AS pooled FROM documents WHERE n_chars IS NOT NULL GROUP BY 1""")
def pooled_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    # rates of sources are pooled by their counts, not averaged
    part = read(spark, sf_dir, "documents").where("n_chars is not null").groupBy("lang", "source").agg(
        F.count("*").alias("n"), F.count_if(F.col("n_chars") > 1000).alias("long"), F.sum("n_chars").alias("chars"))
    return part.groupBy("lang").agg((F.sum("long") / F.sum("n")).alias("long_rate"), r6(F.sum("chars") / F.sum("n")).alias("pooled"))


@query("SELECT count(*) AS n_rows, count(DISTINCT n_regionkey) AS n_regions, count(DISTINCT n_nationkey) AS n_nations FROM nation")
def asserted_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation").agg(F.count("*").alias("n_rows"), F.countDistinct("n_regionkey").alias("n_regions"), F.countDistinct("n_nationkey").alias("n_nations"))
    return contracts.expected(n, {"n_rows": 25, "n_regions": 5, "n_nations": 25})


@query("""WITH a AS (SELECT c_custkey, 'b' || (c_custkey % 7) AS block, row_number() OVER (PARTITION BY c_custkey % 7 ORDER BY c_custkey) AS i FROM customer),
b AS (SELECT s_suppkey, 'block-0' || (s_suppkey % 7) AS raw, row_number() OVER (PARTITION BY s_suppkey % 7 ORDER BY s_suppkey) AS i FROM supplier)
SELECT c_custkey, s_suppkey, block, CAST(a.i AS INT) AS ordinal FROM a JOIN b ON block = 'b' || CAST(replace(raw, 'block-', '') AS INT) AND a.i = b.i""")
def derived_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("b"), F.col("c_custkey") % 7).alias("block"))
    b = read(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("block-0"), F.col("s_suppkey") % 7).alias("raw"))
    a = a.withColumn("ordinal", F.row_number().over(Window.partitionBy("block").orderBy("c_custkey")))
    b = b.select("s_suppkey", X.block_name("raw").alias("block")).withColumn("ordinal", F.row_number().over(Window.partitionBy("block").orderBy("s_suppkey")))
    return a.join(b, ["block", "ordinal"]).select("c_custkey", "s_suppkey", "block", "ordinal")


@query(f"""WITH {EVENTS_SQL}, a AS (SELECT user_id, ms, min(event_id) AS event_id FROM ev WHERE event_type = 'click' GROUP BY 1, 2), b AS (SELECT user_id, ms - ms % 1000 AS ms, min(event_id) AS event_id FROM ev GROUP BY 1, 2)
SELECT a.user_id, a.ms, a.event_id, b.event_id AS event_id_sensor, a.event_id - b.event_id AS id_gap FROM a LEFT JOIN b ON a.user_id = b.user_id AND a.ms = b.ms""")
def exact_time_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    a = e.where("event_type = 'click'").groupBy("user_id", "ms").agg(F.min("event_id").alias("event_id"))
    b = e.groupBy("user_id", (F.col("ms") - F.col("ms") % 1000).alias("ms")).agg(F.min("event_id").alias("event_id"))
    return joins.suffixed_join(a, b, ["user_id", "ms"], "_sensor").withColumn("id_gap", F.col("event_id") - F.col("event_id_sensor"))


@query("""SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'b' WHEN 'MACHINERY' THEN 'm' END AS code, coalesce(s_name, 'unavailable') AS status
FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey AND s_nationkey = c_nationkey""")
def lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = spark.createDataFrame([("BUILDING", "b"), ("MACHINERY", "m")], "c_mktsegment string, code string")
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_nationkey").alias("c_nationkey"), F.col("s_name").alias("status"))
    mapped = c.join(F.broadcast(codes), "c_mktsegment", "left")    # a dictionary written above, of two rows
    return joins.lookup(mapped, s, ["c_custkey", "c_nationkey"], {"status": "unavailable"}).select("c_custkey", "code", "status")


@query(f"""WITH {EVENTS_SQL}, iv AS (SELECT user_id, event_type AS label, min(ms) AS lo, max(ms) AS hi FROM ev WHERE event_type IN ('error', 'signup') GROUP BY 1, 2),
w AS (SELECT event_id, user_id, ms + {HOUR // 2} AS mid FROM ev WHERE event_type = 'click'),
h AS (SELECT event_id, label, row_number() OVER (PARTITION BY event_id ORDER BY lo, hi, label) AS rn FROM w JOIN iv USING (user_id) WHERE mid >= lo AND mid < hi)
SELECT w.event_id, label FROM w LEFT JOIN h ON h.event_id = w.event_id AND rn = 1""")
def midpoint_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    phases = e.where(F.col("event_type").isin("error", "signup")).groupBy("user_id", F.col("event_type").alias("phase")).agg(F.min("ms").alias("lo"), F.max("ms").alias("hi"))
    w = e.where("event_type = 'click'").select("event_id", "user_id", (F.col("ms") + HOUR // 2).alias("mid"))
    return joins.interval_lookup(w, phases, ["user_id"], "mid", "lo", "hi", "phase", ["event_id"], closed=False, span=24 * HOUR).select("event_id", "label")


@query(f"""WITH p AS (SELECT o_orderkey, o_orderpriority, unnest(['base', 'fusion']) AS arm, unnest([abs(o_totalprice - 150000), abs(o_totalprice * CAST(0.9 AS DOUBLE) - 150000)]) AS e FROM orders)
SELECT a.o_orderpriority, count(*) AS n, {q6('avg(b.e - a.e)')} AS delta, count(*) FILTER (b.e < a.e) AS better FROM p a JOIN p b ON a.o_orderkey = b.o_orderkey
WHERE a.arm = 'base' AND b.arm = 'fusion' GROUP BY 1""")
def arms_on_one_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("o_totalprice")
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.abs(price - 150000).alias("base"), F.abs(price * 0.9 - 150000).alias("fusion"))
    long = A.long_form(o, ["o_orderkey", "o_orderpriority"], ["base", "fusion"], value="e")
    wide = joins.arms_side_by_side(long, ["o_orderkey", "o_orderpriority"], "arm", "e", ["base", "fusion"])
    return wide.groupBy("o_orderpriority").agg(F.count("*").alias("n"), r6(F.avg(F.col("fusion") - F.col("base"))).alias("delta"), F.count_if(F.col("fusion") < F.col("base")).alias("better"))


@query(f"""WITH {EVENTS_SQL}, p AS (SELECT user_id, CAST(ms AS DOUBLE) / {HOUR} - 473000 AS x, row_number() {ORDER} * 2.5 + user_id AS y FROM ev),
c AS (SELECT user_id, regr_slope(y, x) AS s, regr_intercept(y, x) AS i FROM p GROUP BY 1 HAVING count(*) >= 2)
SELECT event_id, {q6(f'i + s * (CAST(ms AS DOUBLE) / {HOUR} - 473000)')} AS sample FROM ev LEFT JOIN c USING (user_id) WHERE event_type = 'signup'""")
def clock_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("x", F.col("ms").cast("double") / HOUR - 473000)
    y = F.row_number().over(Window.partitionBy("user_id").orderBy("ms", "event_id")) * 2.5 + F.col("user_id")
    out = joins.through_clock(e.where("event_type = 'signup'").select("event_id", "user_id", "x"), e.select("user_id", "x", y.alias("y")), ["user_id"], "x", "y", "sample")
    return out.select("event_id", r6("sample").alias("sample"))


@query(f"""WITH {EVENTS_SQL} SELECT event_id, row_number() OVER (ORDER BY ms, event_id) - 1 AS position FROM ev""")
def sorted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select("event_id", "ms")
    return windows.sorted_index(e, F.expr(f"ms div {6 * HOUR}"), ["ms", "event_id"], "position").select("event_id", "position")


@query(f"""WITH {EVENTS_SQL}, r AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ms, event_id) AS rn FROM ev) SELECT event_type, event_id FROM r WHERE rn <= 3""")
def fixed_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.head_of_each(events(spark, sf_dir).select("event_type", "event_id", "ms"), ["event_type"], ["ms", "event_id"], 3).select("event_type", "event_id")


@query(f"""WITH {EVENTS_SQL}, l AS (SELECT max(ms) - {240 * HOUR} AS stop FROM ev), s AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'signup') AS probes, count(*) FILTER (event_type = 'error') AS errors FROM ev, l WHERE ms < stop GROUP BY 1)
SELECT user_id, n, CASE WHEN user_id % 50 = 7 THEN 'excluded' WHEN user_id % 50 = 8 THEN 'review' WHEN probes = 0 THEN 'no_probe' WHEN errors > n / 2 THEN 'errors' ELSE 'included' END AS status FROM s""")
def session_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    turn = F.col("user_id") % 50
    denied = e.where(turn.isin(7, 8)).select("user_id", F.when(turn == 7, "excluded").otherwise("review").alias("listed")).distinct()
    stop = e.agg((F.max("ms") - 240 * HOUR).alias("stop"))    # one row
    kept = e.crossJoin(F.broadcast(stop)).where("ms < stop")
    s = kept.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "signup").alias("probes"), F.count_if(F.col("event_type") == "error").alias("errors"))
    s = joins.lookup(s, denied, ["user_id"], {})
    status = F.when(F.col("listed").isNotNull(), F.col("listed")).when(F.col("probes") == 0, "no_probe").when(F.col("errors") > F.col("n") / 2, "errors").otherwise("included")
    return s.select("user_id", "n", status.alias("status"))


@query(f"""WITH {EVENTS_SQL}, o AS (SELECT user_id, max(ms) AS onset FROM ev WHERE event_type = 'purchase' GROUP BY 1),
w AS (SELECT user_id, event_type AS feature, min(ms - onset) AS start_ms, max(ms - onset) AS end_ms FROM ev JOIN o USING (user_id) WHERE event_type <> 'purchase' GROUP BY 1, 2)
SELECT user_id, feature, start_ms, end_ms, end_ms > 0 OR start_ms >= end_ms AS leaks FROM w""")
def temporal_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The span of each kind of a user's events about the last purchase, as a feature's window: whether it reads past that."""
    e = events(spark, sf_dir)
    onset = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.max("ms").alias("onset"))
    t = F.col("ms") - F.col("onset")
    spans = e.where("event_type <> 'purchase'").join(onset, "user_id").groupBy("user_id", F.col("event_type").alias("feature")).agg(F.min(t).alias("start_ms"), F.max(t).alias("end_ms"))
    return contracts.temporal_leaks(spans, "start_ms", "end_ms")


@query(f"""WITH d AS (SELECT source, doc_id, quality AS y FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL),
f AS (SELECT *, dense_rank() OVER (ORDER BY source) % 5 AS fold FROM d), g AS (SELECT fold, count(*) AS n, count(DISTINCT y) AS classes FROM f GROUP BY 1)
SELECT "check", CAST(n AS BIGINT) AS n FROM (SELECT 'group_in_two_folds' AS "check", (SELECT count(*) FROM (SELECT source FROM f GROUP BY 1 HAVING count(DISTINCT fold) > 1)) AS n
UNION ALL SELECT 'row_in_two_folds', (SELECT count(*) FROM (SELECT doc_id FROM f GROUP BY 1 HAVING count(*) > 1)) UNION ALL SELECT 'row_without_fold', (SELECT count(*) FROM f WHERE fold IS NULL)
UNION ALL SELECT 'row_without_group', (SELECT count(*) FROM f WHERE source IS NULL) UNION ALL SELECT 'fold_of_one_class', (SELECT count(*) FROM g WHERE classes < 2)
UNION ALL SELECT 'fold_missing', 5 - (SELECT count(DISTINCT fold) FROM f WHERE fold BETWEEN 0 AND 4))""")
def fold_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanloom.operators.metrics import fold_checks as checks

    labels = read(spark, sf_dir, "labels").where("quality is not null").select("doc_id", F.col("quality").alias("y"))
    d = read(spark, sf_dir, "documents").select("doc_id", "source").join(labels, "doc_id")
    sources = d.select("source").distinct().select("source", (F.dense_rank().over(Window.orderBy("source")) % 5).alias("fold"))
    rows = d.withColumn("s", F.col("source")).join(sources.withColumnRenamed("source", "t"), F.col("s").eqNullSafe(F.col("t")), "left")
    return checks(rows.select("doc_id", "source", "y", "fold"), "doc_id", "source", "fold", "y", 5)



@query("""WITH b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END AS first_name, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey + 1 END AS second_name, o_orderkey % 100 AS i FROM orders)
SELECT o_orderkey, coalesce(first_name, second_name) AS subject, printf('probe-%02d', CAST(i AS INT)) AS probe_id, coalesce(first_name, second_name) IS NULL AS refused FROM b""")
def canonical_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    b = read(spark, sf_dir, "orders").select("o_orderkey", F.when(k % 3 == 0, c).alias("first_name"), F.when(k % 2 == 0, c + 1).alias("second_name"), (k % 100).cast("int").alias("i"))
    subject = joins.first_known("first_name", "second_name")
    return b.select("o_orderkey", subject.alias("subject"), F.format_string("probe-%02d", "i").alias("probe_id"), subject.isNull().alias("refused"))


@query(f"""WITH {EVENTS_SQL}, g AS (SELECT user_id, (ms - lag(ms) OVER (PARTITION BY user_id ORDER BY ms)) / {HOUR}.0 AS ibi, ms FROM ev), f AS (SELECT *, lag(ibi) OVER (PARTITION BY user_id ORDER BY ms) AS p FROM g),
v AS (SELECT user_id, ibi, ibi BETWEEN 0.3 AND 40 AND coalesce(abs(ibi - p) / nullif(p, 0) <= 2, true) AS ok FROM f WHERE ibi IS NOT NULL)
SELECT user_id, count(*) AS n, count(*) FILTER (ok) AS n_valid, count(*) FILTER (ok) >= 0.8 * count(*) AS eligible FROM v GROUP BY 1""")
def reference_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ms")
    g = events(spark, sf_dir).select("user_id", "ms", ((F.col("ms") - F.lag("ms").over(w)) / HOUR).alias("ibi"))
    f = g.withColumn("p", F.lag("ibi").over(w)).where("ibi is not null")
    steady = F.coalesce(F.abs(F.col("ibi") - F.col("p")) / F.nullif("p", F.lit(0.0)) <= 2, F.lit(True))
    ok = F.col("ibi").between(0.3, 40) & steady
    return f.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(ok).alias("n_valid"), (F.count_if(ok) >= 0.8 * F.count("*")).alias("eligible"))


@query(f"""WITH {EVENTS_SQL}, s AS (SELECT user_id, max(ms) AS stop FROM ev WHERE event_type = 'purchase' GROUP BY 1)
SELECT ev.user_id, count(*) AS n, max(ms) AS last_ms FROM ev JOIN s USING (user_id) WHERE ms <= stop GROUP BY 1""")
def truncated_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    stops = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.max("ms").alias("stop"))
    return e.join(stops, "user_id").where("ms <= stop").groupBy("user_id").agg(F.count("*").alias("n"), F.max("ms").alias("last_ms"))


@query(f"""WITH n AS (SELECT DISTINCT lower(regexp_replace(p_type, '[^A-Za-z]+', '_', 'g')) || '_' || m AS name FROM part, (SELECT unnest(['hr', 'rmssd', 'count', 'label', 'share']) AS m))
SELECT name, regexp_matches(lower(name), '{X.FORBIDDEN.pattern}') AS forbidden FROM n""")
def predictor_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of features of every type of part in five measures: which of them a predictor may not have."""
    measures = F.array(*map(F.lit, ("hr", "rmssd", "count", "label", "share")))
    kind = F.lower(F.regexp_replace("p_type", "[^A-Za-z]+", "_"))
    names = read(spark, sf_dir, "part").select(F.explode(F.transform(measures, lambda m: F.concat_ws("_", kind, m))).alias("name")).distinct()
    return names.withColumn("forbidden", F.lower("name").rlike(X.FORBIDDEN.pattern))
