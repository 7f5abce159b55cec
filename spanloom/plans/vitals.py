"""Choices between candidate rates over the driver's tables: lines of an order as spectra or windows, values of a user in order as samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators import spectral as P
from spanloom.operators import vitals as V
from spanloom.plans.registry import EVENTS_SQL, events, q6, query, r6, read
from spanloom.plans.spectral import SAMPLES_SQL, samples


@query(f"""WITH s AS (SELECT l_orderkey AS k, 0.1 + l_linenumber * 0.05::DOUBLE AS hz, sum(l_extendedprice) AS p FROM lineitem GROUP BY l_orderkey, l_linenumber), t AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 <> 0 THEN 0.1 + (o_orderkey % 31) * 0.0101::DOUBLE END AS t FROM orders),
a AS (SELECT *, lag(p) OVER w AS b, lead(p) OVER w AS c, max(p) OVER (PARTITION BY k) AS top, max(p) OVER (PARTITION BY k) / greatest(median(p) OVER (PARTITION BY k), 1e-12) AS snr FROM s WINDOW w AS (PARTITION BY k ORDER BY hz)),
u AS (SELECT k, count(*) FILTER (p > b AND p > c) AS n, min(hz) FILTER (p = top) AS first, any_value(snr) AS snr FROM a GROUP BY k),
c AS (SELECT a.k, hz, p, t FROM a JOIN u USING (k) LEFT JOIN t USING (k) WHERE (p > b AND p > c) OR (n = 0 AND hz = first)),
m AS (SELECT k, arg_max(hz, (p, hz)) AS top_hz, max(p) AS tp, arg_max(hz, (p, hz)) FILTER (abs(hz - t) <= 0.08) AS near, any_value(t) AS t FROM c GROUP BY k),
h AS (SELECT k, arg_min(struct_pack(hz := s.hz, p := s.p), (abs(s.hz - top_hz / 2), s.hz)) AS h FROM m JOIN s USING (k) GROUP BY k),
r AS (SELECT *, coalesce(top_hz >= 0.22 AND abs(h.hz - top_hz / 2) <= 0.04 AND h.p >= 0.35 * tp, false) AS halved FROM m JOIN h USING (k) JOIN u USING (k))
SELECT k, {q6('CASE WHEN near IS NOT NULL THEN near WHEN halved THEN h.hz ELSE top_hz END')} AS hz, CASE WHEN near IS NOT NULL THEN 'time' WHEN halved THEN 'half' ELSE 'top' END AS reason, {q6('top_hz')} AS top_hz, {q6('t')} AS time_hz, {q6('snr')} AS snr FROM r""")
def breath_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rate of each order's lines as a spectrum, held against one made of its key."""
    sums = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k"), "l_linenumber").agg(F.sum("l_extendedprice").alias("power"))
    lines = sums.select("k", (0.1 + F.col("l_linenumber") * 0.05).alias("hz"), "power")
    k = F.col("o_orderkey")
    times = read(spark, sf_dir, "orders").select(k.alias("k"), F.when(k % 3 != 0, 0.1 + (k % 31) * 0.0101).alias("time_hz"))
    return V.breath_rates(lines, times, ["k"]).select("k", r6("hz").alias("hz"), "reason", *[r6(c).alias(c) for c in ("top_hz", "time_hz", "snr")])


@query()
def breath_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The better way to read a breath rate from each user's values, two samples a second."""
    found = V.breath_choice(samples(spark, sf_dir), ["user_id"], "i", "v", 2.0)
    return found.select("user_id", "branch", "reason", "n_peaks", *[F.round(c, 4).alias(c) for c in ("hz", "time_hz", "roughness", "snr", "score")])


RATES_SQL = """w AS (SELECT l_orderkey AS k, CASE WHEN l_suppkey % 7 <> 0 THEN 60 + CAST(l_quantity AS DOUBLE) * 0.37::DOUBLE END AS c,
 CASE WHEN l_suppkey % 4 <> 0 THEN 60 + CAST(l_quantity AS DOUBLE) * 0.37::DOUBLE + (l_suppkey % 21 - 10) * 1.01::DOUBLE END AS t FROM lineitem),
g AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 11 <> 0 THEN CAST(60 + o_orderkey % 40 AS DOUBLE) END AS f, CASE WHEN o_orderkey % 13 <> 0 THEN CAST(62 + o_orderkey % 17 AS DOUBLE) END AS g FROM orders)"""


@query(f"""WITH RECURSIVE {RATES_SQL}, v AS (SELECT k, c, t, CASE WHEN abs(c - t) <= 8 THEN 'fused' WHEN t IS NOT NULL THEN 'time' ELSE 'corrected' END AS kind, CASE WHEN abs(c - t) <= 8 THEN 0.5 * (c + t) ELSE coalesce(t, c) END AS v FROM w),
o AS (SELECT k, t, kind, v, row_number() OVER (PARTITION BY k ORDER BY v, kind, t) - 1 AS i FROM v WHERE v IS NOT NULL), l AS (SELECT k, list(v ORDER BY i) AS l FROM o GROUP BY k),
z AS (SELECT k, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS s FROM l UNION ALL
 SELECT z.k, z.i + 1, CASE WHEN abs(l[z.i + 2] - (l[CAST(floor((s + z.i) / 2) AS BIGINT) + 1] + l[CAST(ceil((s + z.i) / 2) AS BIGINT) + 1]) / 2) <= 6 THEN s ELSE z.i + 1 END FROM z JOIN l ON l.k = z.k WHERE z.i + 1 < len(l)),
q AS (SELECT k, s, count(*) AS n, median(v) AS center, median(t) AS tm, coalesce(stddev_samp(v), 0) AS d, 1.5 * count(*) FILTER (kind = 'fused') + 0.4 * count(*) FILTER (kind = 'time') AS wt FROM o JOIN z USING (k, i) GROUP BY k, s),
b AS (SELECT q.k, count(*) AS clusters, arg_max(struct_pack(n := n, center := center, tm := tm), (3.0 * n + wt - 0.6 * d - 0.15 * coalesce(abs(center - g), 0), -s)) AS b FROM q JOIN g ON g.k = q.k GROUP BY q.k),
m AS (SELECT k, stddev_samp(c) AS sp, count(c) AS nc, median(c) AS mc, count(t) AS nt, median(t) AS mt, count(*) FILTER (kind = 'fused') AS nf, median(v) FILTER (kind = 'fused') AS mf FROM v GROUP BY k),
a AS (SELECT g.k, f, g, m.* EXCLUDE (k), b, clusters, coalesce(abs(f - g) > 3, false) AS apart FROM g LEFT JOIN m ON m.k = g.k LEFT JOIN b ON b.k = g.k),
r AS (SELECT *, CASE WHEN b.n >= 3 AND (f IS NULL OR g IS NULL OR apart OR coalesce(sp > 8, false)) THEN 'cluster' WHEN apart AND nf >= 3 THEN 'fused' WHEN apart AND nt >= 3 THEN 'time' WHEN apart AND nc >= 3 THEN 'corrected'
 WHEN abs(f - g) <= 3 AND sp > 10 AND nf >= 3 THEN 'fused_varied' ELSE 'frequency' END AS source FROM a)
SELECT k, {q6("CASE source WHEN 'cluster' THEN b.center WHEN 'fused' THEN mf WHEN 'fused_varied' THEN mf WHEN 'time' THEN mt WHEN 'corrected' THEN mc ELSE f END")} AS rate,
 {q6("CASE WHEN source = 'cluster' THEN coalesce(b.tm, g) WHEN source = 'fused_varied' THEN mt ELSE g END")} AS time_rate, source, CASE WHEN source = 'cluster' AND b.tm IS NOT NULL THEN 'cluster' WHEN source = 'fused_varied' THEN 'time_varied' ELSE 'peaks' END AS time_source,
 coalesce(clusters, 0) AS clusters, coalesce(b.n, 0) AS best_count, {q6('b.center')} AS best_center FROM r""")
def rate_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rate of each order from two made of its key and those of its lines as windows, of which three are many."""
    own, s, k = 60 + F.col("l_quantity").cast("double") * 0.37, F.col("l_suppkey"), F.col("o_orderkey")
    windows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.when(s % 7 != 0, own).alias("c"), F.when(s % 4 != 0, own + (s % 21 - 10) * 1.01).alias("t"))
    rates = read(spark, sf_dir, "orders").select(k.alias("k"), F.when(k % 11 != 0, (60 + k % 40).cast("double")).alias("f"), F.when(k % 13 != 0, (62 + k % 17).cast("double")).alias("g"))
    out = V.rate_consensus(rates, windows, ["k"], "f", "g", "c", "t", least=3)
    return out.select("k", "source", "time_source", "clusters", "best_count", *[r6(c).alias(c) for c in ("rate", "time_rate", "best_center")])


def _lost(name: str) -> str:
    cost, most = V.COURSE_COSTS[name]
    return f"coalesce({cost} * CASE WHEN {name} > {most} THEN {most} ELSE {name} END, 0)"


@query(f"""WITH {EVENTS_SQL}, w AS (SELECT user_id, event_type, value, lag(value) OVER o AS b FROM ev WHERE value IS NOT NULL WINDOW o AS (PARTITION BY user_id, event_type ORDER BY ms, event_id)),
c AS (SELECT user_id, event_type, avg(value) AS frequency, median(value) AS "time", count(*) AS peaks, stddev_samp(value) AS raw_std, stddev_samp(value) FILTER (value < 100) AS corrected_std, stddev_samp(value) FILTER (value > 5) AS time_std,
 count(*) FILTER (value > 200) AS locked, count(*) FILTER (value >= 100) AS changed, stddev_pop(value) AS course_std, max(abs(value - b)) AS course_jump, avg(abs(value - b)) AS course_agreement, stddev_pop(value - b) AS beat_std, median(abs(value - b)) AS beat_jump,
 100.0 * count(*) FILTER (abs(value - b) > 10) / nullif(count(b), 0) AS beat_jump_share, 1.0 * count(*) FILTER (value < 60) / count(*) AS usable, 1.0 * count(*) FILTER (value BETWEEN 5 AND 40) / count(*) AS confidence FROM w GROUP BY 1, 2),
s AS (SELECT user_id, event_type, CASE WHEN usable >= 0.5 THEN 40.0 - 1.8 * least(abs(frequency - "time"), 30) - 0.5 * least(coalesce(raw_std, 999), 40) - 0.4 * least(coalesce(corrected_std, raw_std, 999), 40) - 0.2 * least(coalesce(time_std, 999), 40) - 1.5 * locked - 0.4 * changed
 + least(peaks / 100.0, 8) - CASE WHEN abs(frequency - "time") > 10 THEN 20 ELSE 0 END - {' - '.join(map(_lost, V.COURSE_COSTS))} + 5 * confidence - 30 * (1 - usable) ELSE -1000000 END AS score FROM c)
SELECT user_id, arg_min(event_type, (-score, event_type)) AS event_type, {q6('max(score)')} AS score FROM s GROUP BY 1""")
def heart_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of each user's event types, their values as windows and course of a candidate."""
    keys = ["user_id", "event_type"]
    b = F.lag("value").over(P.Window.partitionBy(*keys).orderBy("ms", "event_id"))
    rows = events(spark, sf_dir).where("value is not null").select(*keys, "value", b.alias("b"))
    v, step = F.col("value"), F.abs(F.col("value") - F.col("b"))
    part = lambda rule: F.count(F.when(rule, 1)) / F.count("*")
    usable = part(v < 60)
    candidates = rows.groupBy(*keys).agg(F.avg(v).alias("frequency"), F.median(v).alias("time"), F.count("*").alias("peaks"), F.stddev_pop(v).alias("course_std"), F.max(step).alias("course_jump"), F.avg(step).alias("course_agreement"),
                                         F.stddev_pop(v - F.col("b")).alias("beat_std"), F.median(step).alias("beat_jump"), (100.0 * F.count(F.when(step > 10, 1)) / F.nullif(F.count("b"), F.lit(0))).alias("beat_jump_share"),
                                         usable.alias("usable"), part(v.between(5, 40)).alias("confidence"), (usable >= 0.5).alias("passed"))
    windows = rows.select(*keys, v.alias("raw"), F.when(v < 100, v).alias("corrected"), F.when(v > 5, v).alias("timed"), (v > 200).alias("locked"), (v >= 100).alias("changed"))
    return V.heart_choice(candidates, windows, ["user_id"], "event_type").select("user_id", "event_type", r6("score").alias("score"))


@query(f"""WITH RECURSIVE {SAMPLES_SQL}, l AS (SELECT user_id, list(v ORDER BY i) AS l, count(*) AS n, 3.0 + user_id % 5 AS p FROM x GROUP BY 1),
c AS (SELECT user_id, CAST(0 AS BIGINT) AS pos, CAST(NULL AS BIGINT) AS i FROM l UNION ALL SELECT user_id, b + 1, b + 1 FROM (
 SELECT c.user_id, lo + list_position(l[lo + 1:hi], list_max(l[lo + 1:hi])) - 1 AS b FROM c JOIN l ON l.user_id = c.user_id, LATERAL (SELECT CAST(floor(pos + 0.75 * p) AS BIGINT) AS lo, least(CAST(floor(pos + 1.35 * p) AS BIGINT), n) AS hi) WHERE lo < n AND hi > lo))
SELECT user_id, CAST(i AS INT) AS i FROM c WHERE i IS NOT NULL""")
def beat_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beats of each user's values by a period of three to seven samples."""
    rows = P.window_arrays(samples(spark, sf_dir), ["user_id"], "i", "v")
    beats = V.beat_chain(F.col("__v"), 3.0 + (F.col("user_id") % 5))
    return rows.select("user_id", F.explode(beats).alias("b")).select("user_id", (F.col("b") + 1).alias("i"))


@query()
def narrowband_beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beats of each user's values near the strongest line from 0.6 to 1.2 Hz, four samples a second."""
    x = samples(spark, sf_dir)
    lines = V.band_lines(x, ["user_id"], "i", "v", 4.0, 0.6, 1.2)
    best = lines.groupBy("user_id").agg(F.max_by("hz", F.struct("power", "hz")).alias("hz"))
    return V.narrowband_beats(x, best, ["user_id"], "i", "v", "hz", 4.0).select("user_id", "i", F.round("filtered", 4).alias("filtered"))


@query()
def respiration_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's values as a respiration belt, four samples a second."""
    q = V.respiration_qa(samples(spark, sf_dir), ["user_id"], "i", "v", 4.0)
    return q.select("user_id", "n_raw", "n_rejected", "n_kept", "usable", "loose", "note", *[F.round(c, 4).alias(c) for c in ("valid_ratio", "rate", "amplitude")])
