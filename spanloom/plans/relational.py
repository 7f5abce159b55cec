"""Keyed joins, set operations, projections and classifications over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.functions import expressions as X
from spanloom.operators import contracts, joins, sets
from spanloom.plans.registry import EVENTS_SQL, HOUR, events, q6, query, r6, read


@query("SELECT o_orderkey, c_custkey, c_nationkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def keyed_left_join_validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.lit(True).alias("known"))
    j = contracts.validated_join(o, c, ["c_custkey"], validate="many_to_one")
    return j.select("o_orderkey", F.when(F.col("known"), F.col("c_custkey")).alias("c_custkey"), "c_nationkey")


@query("""SELECT c_custkey, coalesce(n_name, s_name, 'unknown') AS identity FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey <= 2
LEFT JOIN supplier ON s_suppkey = c_custkey""")
def coalesce_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = read(spark, sf_dir, "nation").where("n_regionkey <= 2").select("n_nationkey", "n_name")
    s = read(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    j = c.join(n, c["c_nationkey"] == n["n_nationkey"], "left").join(s, c["c_custkey"] == s["s_suppkey"], "left")
    return j.select("c_custkey", joins.first_known("n_name", "s_name", F.lit("unknown")).alias("identity"))


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def semi_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = read(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return read(spark, sf_dir, "orders").join(allowed, "o_custkey", "left_semi").select("o_orderkey")


@query("""SELECT o_custkey, count(*) AS n FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 5000) GROUP BY 1""")
def anti_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = read(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return read(spark, sf_dir, "orders").join(allowed, "o_custkey", "left_anti").groupBy("o_custkey").agg(F.count("*").alias("n"))


@query("""WITH f AS (SELECT held_out, printf('LOSO_%03d', CAST(dense_rank() OVER (ORDER BY held_out) AS INT)) AS fold_id
 FROM (SELECT DISTINCT s_nationkey AS held_out FROM supplier))
SELECT s_suppkey, fold_id, CASE WHEN s_nationkey = held_out THEN 'TEST' ELSE 'TRAIN' END AS role FROM supplier, f""")
def fold_cross_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.fold_roles(read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), "s_nationkey").select("s_suppkey", "fold_id", "role")


@query("""WITH k AS (SELECT 'customer' AS source, c_nationkey AS nation, c_acctbal AS balance FROM customer UNION ALL SELECT 'supplier', s_nationkey, s_acctbal FROM supplier)
SELECT source, nation, count(*) AS n, round(sum(balance), 2) + 0.0 AS total FROM k GROUP BY 1, 2""")
def union_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    s = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    u = sets.tagged_union({"customer": c, "supplier": s})
    return u.groupBy("source", "nation").agg(F.count("*").alias("n"), (F.round(F.sum("balance"), 2) + F.lit(0.0)).alias("total"))


BUYERS = {"left": "SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority LIKE '1%'", "right": "SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'"}


def _buyers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = read(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "k")
    return o.where("o_orderpriority LIKE '1%'").select("k"), o.where("o_orderstatus = 'F'").select("k")


@query(f"""SELECT k, 'left' AS side FROM ({BUYERS['left']} EXCEPT {BUYERS['right']}) UNION ALL SELECT k, 'right' AS side FROM ({BUYERS['right']} EXCEPT {BUYERS['left']})""")
def except_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.both_differences(*_buyers(spark, sf_dir), ["k"])


@query(f"{BUYERS['left']} INTERSECT {BUYERS['right']}")
def intersect_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _buyers(spark, sf_dir)
    return a.intersect(b)


@query(f"""WITH a AS (SELECT s_suppkey AS k, s_acctbal AS balance, CAST(s_nationkey AS DOUBLE) AS nation FROM supplier),
b AS (SELECT c_custkey AS k, c_acctbal AS balance, CAST(c_nationkey AS DOUBLE) AS nation FROM customer),
l AS (SELECT 'balance' AS field, a.balance AS x, b.balance AS y FROM a JOIN b USING (k) UNION ALL SELECT 'nation', a.nation, b.nation FROM a JOIN b USING (k))
SELECT field, count(*) AS n, count(*) FILTER (x IS DISTINCT FROM y) AS changed, {q6('median(abs(x - y)) FILTER (x <> y)')} AS median, {q6('max(abs(x - y)) FILTER (x <> y)')} AS most FROM l GROUP BY 1""")
def key_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nation"))
    b = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("balance"), F.col("c_nationkey").alias("nation"))
    return sets.field_changes(a, b, ["k"], ["balance", "nation"]).select("field", "n", "changed", r6("median").alias("median"), r6("most").alias("most"))


@query("SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.duplicates(read(spark, sf_dir, "orders"), ["o_custkey", "o_orderpriority"])


@query("""WITH r AS (SELECT s_suppkey, CAST(s_suppkey % 7 AS BIGINT) AS n, (s_suppkey % 10) / 10.0 AS rate FROM supplier),
t AS (SELECT s_suppkey, n, rate, unnest(range(1, n + 1)) AS trial FROM r)
SELECT s_suppkey, CAST(trial AS INT) AS trial, CAST(trial <= round_even(rate * n, 0) AS INT) AS outcome FROM t""")
def expand_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = read(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % 7).alias("n"), ((F.col("s_suppkey") % 10) / 10).alias("rate"))
    return sets.expand_counts(r, ["s_suppkey"], "rate", "n")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'UNRESOLVED' WHEN o_totalprice < 1000 THEN 'QC_FAIL' WHEN o_orderstatus = 'O' THEN 'OBSERVATION_MISSING'
 WHEN o_totalprice IS NOT NULL THEN 'OBSERVED' ELSE 'STRUCTURAL_MISSING' END AS state FROM orders""")
def state_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [(F.col("o_orderstatus") == "P", "UNRESOLVED"), (F.col("o_totalprice") < 1000, "QC_FAIL"),
             (F.col("o_orderstatus") == "O", "OBSERVATION_MISSING"), (F.col("o_totalprice").isNotNull(), "OBSERVED")]
    return read(spark, sf_dir, "orders").select("o_orderkey", X.first_match(rules, "STRUCTURAL_MISSING").alias("state"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query(f"""SELECT vec_id, {q6('list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))')} AS energy, {q6('CAST(list_max(embedding) AS DOUBLE)')} AS peak, len(embedding) AS n FROM embeddings""")
def embedding_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    d = F.transform("embedding", lambda x: x.cast("double"))
    return e.select("vec_id", r6(F.aggregate(d, F.lit(0.0), lambda a, x: a + x * x)).alias("energy"), r6(F.array_max(d)).alias("peak"), F.size("embedding").cast("long").alias("n"))


@query(f"""WITH {EVENTS_SQL}, w AS (SELECT user_id, CAST(floor(ms / {24 * HOUR}.0) AS BIGINT) AS day, min(ms) AS a, max(ms) AS b, count(*) AS n FROM ev GROUP BY 1, 2)
SELECT user_id, day, n, (b - a) >= greatest(0.8 * {12 * HOUR}, {7 * HOUR}) AS usable FROM w""")
def partial_window_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = events(spark, sf_dir).groupBy("user_id", F.floor(F.col("ms") / (24 * HOUR)).alias("day")).agg(F.min("ms").alias("a"), F.max("ms").alias("b"), F.count("*").alias("n"))
    return w.select("user_id", "day", "n", ((F.col("b") - F.col("a")) >= max(0.8 * 12 * HOUR, 7 * HOUR)).alias("usable"))


@query("""SELECT c_custkey, CASE WHEN length(CAST(c_custkey AS VARCHAR)) >= 3 THEN CAST(c_custkey AS VARCHAR) ELSE lpad(CAST(c_custkey AS VARCHAR), 3, '0') END AS code,
 CASE WHEN c_acctbal >= 6500 THEN 'positive' WHEN c_acctbal <= 3500 THEN 'negative' ELSE 'indeterminate' END AS decision,
 CAST(least(greatest(round_even(c_acctbal / 10000 * 20, 0), 0), 20) AS BIGINT) AS rebuilt FROM customer""")
def projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = F.col("c_acctbal") / 10000
    return read(spark, sf_dir, "customer").select("c_custkey", X.padded_id("c_custkey").alias("code"), X.decision(share).alias("decision"),
                                                  X.rebuilt_count(share, F.lit(20)).alias("rebuilt"))


@query("""SELECT c_custkey, CASE WHEN e <= 5 THEN 'le5' WHEN e <= 10 THEN 'le10' WHEN e <= 20 THEN 'le20' ELSE 'gt20' END AS severity,
 CASE WHEN abs(t - s) > 10 THEN t ELSE f END AS switched FROM (SELECT c_custkey, abs(c_acctbal) / 300 AS e, CAST(c_custkey % 31 AS DOUBLE) AS t, CAST(c_custkey % 17 AS DOUBLE) AS s, CAST(c_custkey % 23 AS DOUBLE) AS f FROM customer)""")
def severity_and_switch(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    t, s, f = ((F.col("c_custkey") % n).cast("double") for n in (31, 17, 23))
    return c.select("c_custkey", X.severity(F.abs("c_acctbal") / 300).alias("severity"), X.switched_estimate(f, t, s).alias("switched"))


@query("""SELECT 'null:o_custkey' AS "check", count(*) FILTER (o_custkey IS NULL) AS n FROM orders UNION ALL
SELECT 'enum:o_orderstatus', count(*) FILTER (o_orderstatus NOT IN ('O', 'F')) FROM orders UNION ALL
SELECT 'range:o_totalprice', count(*) FILTER (NOT o_totalprice BETWEEN 1000 AND 300000) FROM orders""")
def contract_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.violations(read(spark, sf_dir, "orders"), ["o_custkey"], {"o_orderstatus": ["O", "F"]}, {"o_totalprice": (1000, 300000)})


@query("""WITH a AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), f AS (SELECT c_custkey, n, c_acctbal > 0 AS ok FROM customer JOIN a ON o_custkey = c_custkey WHERE c_acctbal > 0 AND n >= 5)
SELECT count(*) AS n_rows, CAST(sum(n) AS BIGINT) AS n_orders FROM f""")
def cohort_freeze(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n")).where("n >= 5")
    c = read(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey")
    return c.join(a, "c_custkey").agg(F.count("*").alias("n_rows"), F.sum("n").alias("n_orders"))


@query(f"""WITH {EVENTS_SQL}, r AS (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ms, event_id) AS last FROM ev)
SELECT last, event_type, count(*) AS n FROM r WHERE last IS NOT NULL GROUP BY 1, 2""")
def transition_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ms", "event_id")
    r = events(spark, sf_dir).select("event_type", F.lag("event_type").over(order).alias("last")).where("last is not null")
    return r.groupBy("last", "event_type").agg(F.count("*").alias("n"))
