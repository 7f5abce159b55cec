"""Scores of predictions over documents and labels, folds and bootstrap."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators import metrics as M
from spanloom.plans.registry import events, q6, query, r6, read

SCORED = """sc AS (SELECT source, doc_id, quality AS y, least(1.0, n_chars / 5000.0) AS p FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    labels = read(spark, sf_dir, "labels").select("doc_id", "quality").where("quality is not null")
    return d.join(labels, "doc_id").select("source", "lang", "doc_id", "n_chars", F.col("quality").alias("y"), F.least(F.lit(1.0), F.col("n_chars") / 5000).alias("p"))


@query(f"""WITH {SCORED}, r AS (SELECT source, y, rank() OVER (PARTITION BY source ORDER BY p) + (count(*) OVER (PARTITION BY source, p) - 1) / 2.0 AS r FROM sc)
SELECT source, count(*) AS n, {q6('(sum(y * r) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y) * (count(*) - sum(y)), 0)')} AS auc FROM r GROUP BY 1""")
def roc_auc_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.roc_auc(scored(spark, sf_dir), ["source"], "y", "p").select("source", "n", r6("auc").alias("auc"))


@query(f"""WITH {SCORED}, s AS (SELECT source, p, sum(y) AS pos, count(*) AS n FROM sc GROUP BY 1, 2),
c AS (SELECT source, pos / nullif(CAST(sum(pos) OVER (PARTITION BY source) AS DOUBLE), 0) * sum(pos) OVER (PARTITION BY source ORDER BY p DESC) / sum(n) OVER (PARTITION BY source ORDER BY p DESC) AS part FROM s)
SELECT source, {q6('sum(part)')} AS ap FROM c GROUP BY 1""")
def average_precision_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.average_precision(scored(spark, sf_dir), ["source"], "y", "p").select("source", r6("ap").alias("ap"))


@query(f"""WITH {SCORED}, c AS (SELECT source, CAST(count(*) FILTER (y = 1 AND p >= 0.5) AS DOUBLE) AS tp, CAST(count(*) FILTER (y = 0 AND p >= 0.5) AS DOUBLE) AS fp,
 CAST(count(*) FILTER (y = 1 AND p < 0.5) AS DOUBLE) AS fn, CAST(count(*) FILTER (y = 0 AND p < 0.5) AS DOUBLE) AS tn, avg((p - y) * (p - y)) AS brier,
 avg(-(y * ln(least(greatest(p, 1e-15), 1 - 1e-15)) + (1 - y) * ln(1 - least(greatest(p, 1e-15), 1 - 1e-15)))) AS log_loss FROM sc GROUP BY 1)
SELECT source, {q6('tp / nullif(tp + fn, 0)')} AS sensitivity, {q6('tn / nullif(tn + fp, 0)')} AS specificity, {q6('2 * tp / nullif(2 * tp + fp + fn, 0)')} AS f1,
 {q6('(tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0)')} AS mcc, {q6('brier')} AS brier, {q6('log_loss')} AS log_loss FROM c""")
def confusion_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = M.confusion_suite(scored(spark, sf_dir), ["source"], "y", "p")
    return c.select("source", *[r6(x).alias(x) for x in ("sensitivity", "specificity", "f1", "mcc", "brier", "log_loss")])


@query(f"""WITH {SCORED}, f AS (SELECT source AS held_out, printf('LOSO_%03d', CAST(dense_rank() OVER (ORDER BY source) AS INT)) AS fold_id FROM (SELECT DISTINCT source FROM sc))
SELECT fold_id, held_out, count(*) FILTER (source <> held_out) AS n_train, count(*) FILTER (source = held_out) AS n_test FROM sc, f GROUP BY 1, 2""")
def loso_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanloom.operators.joins import fold_sizes

    return fold_sizes(scored(spark, sf_dir), "source")


@query(f"""WITH {SCORED}, g AS (SELECT source, count(*) AS n, avg(y) AS rate FROM sc GROUP BY 1),
o AS (SELECT source, row_number() OVER (ORDER BY n DESC, rate DESC, source) - 1 AS pos FROM g)
SELECT source, CAST(CASE WHEN (pos // 5) % 2 = 0 THEN pos % 5 ELSE 4 - pos % 5 END AS INT) AS fold FROM o""")
def group_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.group_folds(scored(spark, sf_dir), "source", "y")


def weights_sql(key: str, source: str, replicates: int, seed: int) -> str:
    cases = " + ".join(f"CASE WHEN u >= {p} THEN 1 ELSE 0 END" for p in M.POISSON)
    return f"""u AS (SELECT {key}, rep, CAST('0x' || substr(md5('{seed}-' || rep || '-' || {key}), 1, 12) AS BIGINT) / 281474976710656.0 AS u FROM (SELECT DISTINCT {key} FROM {source}), range({replicates}) t(rep)),
wt AS (SELECT * FROM (SELECT {key}, rep, {cases} AS weight FROM u) WHERE weight > 0)"""


@query(f"""WITH {weights_sql('user_id', 'events', 500, 20260826)}, s AS (SELECT user_id, sum(value) AS s, count(value) AS n FROM events GROUP BY 1),
r AS (SELECT rep, sum(s * weight) / sum(n * weight) AS m FROM s JOIN wt USING (user_id) GROUP BY 1)
SELECT (SELECT {q6('sum(s) / sum(n)')} FROM s) AS mean, {q6('quantile_cont(m, 0.025)')} AS low, {q6('quantile_cont(m, 0.975)')} AS high FROM r""")
def cluster_bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean event value with a bootstrap over users."""
    b = M.bootstrap_interval(events(spark, sf_dir), "user_id", "value", 500)
    return b.select(*[r6(c).alias(c) for c in b.columns])


@query(f"""WITH {SCORED}, {weights_sql('source', 'sc', 100, 20260824)}, z AS (SELECT -1 AS rep, 1 AS weight, y, doc_id % 100 / 100.0 AS a, p AS b FROM sc UNION ALL
 SELECT rep, weight, y, doc_id % 100 / 100.0, p FROM sc JOIN wt USING (source)),
l AS (SELECT rep, 'a' AS arm, a AS score, sum(y * weight) AS p, sum((1 - y) * weight) AS q FROM z GROUP BY 1, 2, 3 UNION ALL SELECT rep, 'b', b, sum(y * weight), sum((1 - y) * weight) FROM z GROUP BY 1, 2, 3),
c AS (SELECT *, sum(q) OVER (PARTITION BY rep, arm ORDER BY score) - q / 2.0 AS below FROM l),
x AS (SELECT rep, arm, sum(p * below) / nullif(CAST(sum(p) AS DOUBLE) * sum(q), 0) AS auc FROM c GROUP BY 1, 2), d AS (SELECT rep, max(auc) FILTER (arm = 'b') - max(auc) FILTER (arm = 'a') AS d FROM x GROUP BY 1)
SELECT {q6('max(d) FILTER (rep = -1)')} AS delta, {q6('quantile_cont(d, 0.025) FILTER (rep >= 0)')} AS low, {q6('quantile_cont(d, 0.975) FILTER (rep >= 0)')} AS high FROM d""")
def paired_bootstrap_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difference of the AUCs of two scores with a paired bootstrap over sources."""
    s = scored(spark, sf_dir).withColumn("other", F.col("doc_id") % 100 / 100)
    b = M.paired_bootstrap_auc(s, "source", "y", "other", "p", 100)
    return b.select(*[r6(c).alias(c) for c in b.columns])


@query()
def folded_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold scores of a ridge logistic regression, folds disjoint by source, and their AUC by fold."""
    s = scored(spark, sf_dir).withColumn("log_chars", F.log1p("n_chars")).withColumn("english", (F.col("lang") == "en").cast("double"))
    own = s.groupBy("source").agg((1 / F.count("*")).alias("weight"))      # every source weighs the same
    rows = s.join(M.group_folds(s, "source", "y"), "source").join(own, "source").select("doc_id", "fold", "y", "log_chars", "english", "weight")
    oof = M.out_of_fold_scores(rows, "fold", ["doc_id"], ["log_chars", "english"], "y", "weight", indicators=True)
    return M.roc_auc(oof, ["fold"], "y", "score").select("fold", "n", r6("auc").alias("auc"))


@query(f"""WITH {weights_sql('user_id', 'events', 60, 20260826)}, e AS (SELECT user_id, value AS x, CAST(event_id % 97 AS BIGINT) AS y FROM events WHERE value IS NOT NULL),
z AS (SELECT -1 AS rep, 1 AS weight, x, y FROM e UNION ALL SELECT rep, weight, x, y FROM e JOIN wt USING (user_id)),
a AS (SELECT rep, x, sum(weight) AS n FROM z GROUP BY 1, 2), b AS (SELECT rep, y, sum(weight) AS n FROM z GROUP BY 1, 2),
ra AS (SELECT rep, x, sum(n) OVER (PARTITION BY rep ORDER BY x) - n + (n + 1) / 2.0 AS r FROM a), rb AS (SELECT rep, y, sum(n) OVER (PARTITION BY rep ORDER BY y) - n + (n + 1) / 2.0 AS r FROM b),
s AS (SELECT z.rep, CAST(sum(weight) AS DOUBLE) AS n, sum(weight * ra.r) AS a, sum(weight * rb.r) AS b, sum(weight * ra.r * ra.r) AS aa, sum(weight * rb.r * rb.r) AS bb, sum(weight * ra.r * rb.r) AS ab
 FROM z JOIN ra ON ra.rep = z.rep AND ra.x = z.x JOIN rb ON rb.rep = z.rep AND rb.y = z.y GROUP BY 1),
r AS (SELECT rep, (n * ab - a * b) / nullif(sqrt((n * aa - a * a) * (n * bb - b * b)), 0) AS rho FROM s)
SELECT {q6('max(rho) FILTER (rep = -1)')} AS rho, {q6('quantile_cont(rho, 0.025) FILTER (rep >= 0)')} AS low, {q6('quantile_cont(rho, 0.975) FILTER (rep >= 0)')} AS high FROM r""")
def bootstrap_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select("user_id", F.col("value").alias("x"), (F.col("event_id") % 97).alias("y"))
    b = M.bootstrap_spearman(e, "user_id", "x", "y", 60)
    return b.select(*[r6(c).alias(c) for c in b.columns])


@query(f"""WITH c AS (SELECT l_returnflag AS g, CAST(count(*) FILTER (l_quantity > 25 AND l_discount > 0.05) + 0.5 AS DOUBLE) AS a, CAST(count(*) FILTER (l_quantity > 25 AND l_discount <= 0.05) + 0.5 AS DOUBLE) AS b,
 CAST(count(*) FILTER (l_quantity <= 25 AND l_discount > 0.05) + 0.5 AS DOUBLE) AS c, CAST(count(*) FILTER (l_quantity <= 25 AND l_discount <= 0.05) + 0.5 AS DOUBLE) AS d FROM lineitem GROUP BY 1),
e AS (SELECT g, ln(a * d / (b * c)) AS beta, sqrt(1 / a + 1 / b + 1 / c + 1 / d) AS se FROM c)
SELECT g, {q6('exp(beta)')} AS odds, {q6('exp(beta - 1.96 * se)')} AS low, {q6('exp(beta + 1.96 * se)')} AS high, {q6('100 * (exp(beta) - 1)')} AS percent FROM e""")
def effect_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanloom.operators.audits import effect

    large, dear = F.col("l_quantity") > 25, F.col("l_discount") > 0.05
    cells = read(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("g")).agg(*[(F.count_if(rule) + F.lit(0.5).cast("double")).alias(n) for n, rule in (
        ("a", large & dear), ("b", large & ~dear), ("c", ~large & dear), ("d", ~large & ~dear))])
    a, b, c, d = (F.col(x) for x in "abcd")
    odds, low, high = effect(F.log(a * d / (b * c)), F.sqrt(1 / a + 1 / b + 1 / c + 1 / d))
    return cells.select("g", r6(odds).alias("odds"), r6(low).alias("low"), r6(high).alias("high"), r6(100 * (odds - 1)).alias("percent"))


@query(f"""WITH {SCORED}, g AS (SELECT source, count(*) AS n, count(DISTINCT y) AS classes, avg(p) AS p FROM sc GROUP BY 1),
r AS (SELECT *, list_filter([CASE WHEN n < 10 THEN 'few_rows' END, CASE WHEN classes < 2 THEN 'one_class' END, CASE WHEN p > 0.9 THEN 'long_texts' END], lambda x: x IS NOT NULL) AS why FROM g)
SELECT source, len(why) = 0 AS ready, array_to_string(why, '|') AS reasons FROM r""")
def readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanloom.functions.expressions import reasons

    g = scored(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("y").alias("classes"), F.avg("p").alias("p"))
    why = reasons([(F.col("n") < 10, "few_rows"), (F.col("classes") < 2, "one_class"), (F.col("p") > 0.9, "long_texts")])
    return g.select("source", (F.size(why) == 0).alias("ready"), F.array_join(why, "|").alias("reasons"))


@query(f"""WITH {SCORED}, g AS (SELECT source, count(*) AS n, avg(y) AS rate FROM sc GROUP BY 1), o AS (SELECT source, row_number() OVER (ORDER BY n DESC, rate DESC, source) - 1 AS pos FROM g),
f AS (SELECT source, CASE WHEN (pos // 5) % 2 = 0 THEN pos % 5 ELSE 4 - pos % 5 END AS fold FROM o), r AS (SELECT fold, y FROM sc JOIN f USING (source)), t AS (SELECT fold, count(*) AS n, sum(y) AS s FROM r GROUP BY 1)
SELECT CAST(fold AS INT) AS fold, n, {q6('((SELECT sum(s) FROM t) - s) / CAST((SELECT sum(n) FROM t) - n AS DOUBLE)')} AS prior FROM t""")
def folded_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir)
    rows = s.join(M.group_folds(s, "source", "y"), "source")
    return M.fold_priors(rows, "fold", "y").select("fold", "n", r6("prior").alias("prior"))


@query()
def folded_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold scores of a random forest on the folds of `folded_logistic`, and their AUC by fold."""
    s = scored(spark, sf_dir).withColumn("log_chars", F.log1p("n_chars")).withColumn("english", (F.col("lang") == "en").cast("double"))
    rows = s.join(M.group_folds(s, "source", "y"), "source").select("doc_id", "fold", "y", "log_chars", "english").na.fill(0.0, ["english"])
    oof = M.out_of_fold_trees(rows, "fold", ["doc_id"], ["log_chars", "english"], "y")
    return M.roc_auc(oof, ["fold"], "y", "score").select("fold", "n", r6("auc").alias("auc"))


@query()
def left_out_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of a logistic regression that leaves one language out at a time; a language of one class keeps its scores and has no AUC."""
    s = scored(spark, sf_dir).where("lang is not null").withColumn("log_chars", F.log1p("n_chars"))
    oof = M.out_of_fold_scores(s, "lang", ["doc_id"], ["log_chars"], "y")
    brier = oof.groupBy("lang").agg(r6(F.avg((F.col("score") - F.col("y")) * (F.col("score") - F.col("y")))).alias("brier"))
    return M.roc_auc(oof, ["lang"], "y", "score").join(brier, "lang").select("lang", "n", r6("auc").alias("auc"), "brier")
