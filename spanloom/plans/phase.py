"""Vectors of a label as frames of complex cells: the target cell and the features of each window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators import phase as P
from spanloom.plans.registry import q6, query, r6, read

BY = ["label", "part"]


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame each vector, ten milliseconds an id, of 16 bins and two channels; a window is a label's part of 4,096 ids."""
    v = read(spark, sf_dir, "embeddings").select(F.coalesce("label", F.lit(-1)).alias("label"), F.expr("vec_id div 4096").alias("part"), (F.col("vec_id") * 10).alias("t"), "embedding")
    cells = v.select(*BY, "t", "embedding", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("c"))
    value = lambda k: F.get("embedding", 2 * F.col("c") + k).cast("double")
    return cells.select(*BY, "t", F.floor(F.col("c") / 2).alias("bin"), (F.col("c") % 2).alias("channel"), value(0).alias("re"), value(1).alias("im")).where("re is not null and im is not null and not isnan(re) and not isnan(im)")


def _best(name: str, by: str, source: str) -> str:
    """SQL of the best cell of each window of `source`."""
    return f"""{name}1 AS (SELECT {by}, channel, bin, avg(a * a) AS p, sqrt(greatest(regr_syy(ph, i) - coalesce(regr_sxy(ph, i) * regr_sxy(ph, i) / nullif(regr_sxx(ph, i), 0), 0), 0) / count(*)) AS d, stddev_pop(a) / (avg(a) + 1e-12) AS c FROM {source} WHERE bin BETWEEN 2 AND 13 GROUP BY ALL),
{name}2 AS (SELECT *, p / (median(p) OVER (PARTITION BY {by}) + 1e-12) AS ratio, row_number() OVER (PARTITION BY {by}, channel ORDER BY p DESC, bin DESC) AS r FROM {name}1),
{name}3 AS (SELECT {by}, channel, bin, ratio, ln(1 + d) + 0.18 * ln(1 + ratio) - 0.35 * least(c, 3) AS score FROM {name}2 WHERE r <= 6),
{name} AS (SELECT *, score - coalesce(lead(score) OVER w, score) AS margin, row_number() OVER w AS r FROM {name}3 WINDOW w AS (PARTITION BY {by} ORDER BY score DESC, bin DESC, channel DESC) QUALIFY r = 1)"""


@query(f"""WITH v AS (SELECT coalesce(label, -1) AS label, vec_id // 4096 AS part, vec_id * 10 AS t, embedding AS e, unnest(range(0, 32)) AS c FROM embeddings),
f AS (SELECT label, part, t, c // 2 AS bin, CAST(c % 2 AS INT) AS channel, e[2 * c + 1]::DOUBLE AS re, e[2 * c + 2]::DOUBLE AS im FROM v WHERE e[2 * c + 1] IS NOT NULL AND e[2 * c + 2] IS NOT NULL AND NOT isnan(e[2 * c + 1]) AND NOT isnan(e[2 * c + 2])),
g AS (SELECT *, sqrt(re * re + im * im) AS a, atan2(im, re) AS ang, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY label, part, channel, bin) AS n, atan2(im, re) - lag(atan2(im, re)) OVER w AS s FROM f WINDOW w AS (PARTITION BY label, part, channel, bin ORDER BY t)),
x AS (SELECT label, part, channel, bin, a, i, n, first(ang) OVER w + sum(coalesce(s - 2 * pi() * floor((s + pi()) / (2 * pi())), 0)) OVER w AS ph FROM g WINDOW w AS (PARTITION BY label, part, channel, bin ORDER BY t ROWS UNBOUNDED PRECEDING)),
{_best('b', 'label, part', 'x')}, y AS (SELECT *, CASE WHEN 2 * n // 3 <= i THEN 2 WHEN n // 3 <= i THEN 1 ELSE 0 END AS k FROM x), z AS (SELECT * FROM y WHERE n // 3 >= 10 AND i < k * n // 3 + n // 3),
{_best('s', 'label, part, k', 'z')}, st AS (SELECT s.label, s.part, avg(abs(s.bin - b.bin)) AS stability FROM s JOIN b USING (label, part) GROUP BY 1, 2)
SELECT label, part, channel, bin, {q6('score')} AS score, {q6('ratio')} AS ratio, {q6('margin')} AS margin, {q6('stability')} AS stability FROM b LEFT JOIN st USING (label, part)""")
def target_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cell of each label's frames that moves most steadily."""
    t = P.target_cells(frames(spark, sf_dir), BY, "t", "bin", "channel", 2, 13, 6, 10)
    return t.select(*BY, "channel", "bin", *[r6(c).alias(c) for c in ("score", "ratio", "margin", "stability")])


@query()
def phase_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of each label's target cell."""
    rows = P.phase_rows(frames(spark, sf_dir), BY, "t", "bin", "channel", 2, 13, 6, 10)
    keys = {*BY, "channel", "bin", "harmonics", "frames"}
    return rows.select(*[c if c in keys else F.round(c, 6).alias(c) for c in rows.columns])
