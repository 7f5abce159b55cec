"""Models of repeated measures over the driver's tables; the SQL takes the same steps, written out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators import metrics as M
from spanloom.operators import models
from spanloom.plans.evaluation import scored
from spanloom.plans.registry import q6, query, r6, read


def pairs(n: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(n) for j in range(i, n)]


def inverted(source: str, name: str, n: int, carried: str) -> str:
    """CTEs name_0 ... name_n: Gauss-Jordan on the symmetric a_i_j of `source`; i_i_j is the inverse, x_i the solution for u_i."""
    cell = lambda i, j: f"a_{min(i, j)}_{max(i, j)}"
    first = [f"{cell(i, j)} AS c_{i}_{j}" for i in range(n) for j in range(n)]
    first += [f"{float(i == k)}::DOUBLE AS i_{i}_{k}" for i in range(n) for k in range(n)] + [f"u_{i} AS x_{i}" for i in range(n)]
    out = [f"{name}_0 AS (SELECT {carried}, {', '.join(first)} FROM {source})"]
    for p in range(n):
        step = []
        for i in range(n):
            for prefix, columns in (("c_", range(n)), ("i_", range(n)), ("x_", (None,))):
                for j in columns:
                    own, pivot = (f"{prefix}{r}" + ("" if j is None else f"_{j}") for r in (i, p))
                    step.append((f"{own} / c_{p}_{p}" if i == p else f"{own} - c_{i}_{p} * {pivot} / c_{p}_{p}") + f" AS {own}")
        out.append(f"{name}_{p + 1} AS (SELECT {carried}, {', '.join(step)} FROM {name}_{p})")
    return ",\n".join(out)


def robust(n: int, k: int) -> str:
    """Entry k, k of inverse * meat * inverse."""
    return " + ".join(f"i_{k}_{i} * m_{min(i, j)}_{max(i, j)} * i_{j}_{k}" for i in range(n) for j in range(n))


def term_rows(source: str, names: list[str], variance: list[str], more: str = "") -> str:
    return " UNION ALL ".join(f"SELECT '{t}' AS term, {q6(f'b_{k}')} AS estimate, {q6(f'sqrt({variance[k]})')} AS se, {q6(f'b_{k} / sqrt({variance[k]})')} AS z, CAST(rows AS BIGINT) AS n, clusters{more} FROM {source}"
                              for k, t in enumerate(names))


def terms(df: DataFrame, *more: str) -> DataFrame:
    return df.select("term", *[r6(c).alias(c) for c in ("estimate", "se", "z")], "n", "clusters", *[r6(c).alias(c) for c in more])


# -- estimating equations ---------------------------------------------------------------------------

GEE_NAMES = [models.INTERCEPT, "hour", "purchase"]
GEE_ROWS = "e AS (SELECT user_id AS g, CAST(value > 50 AS DOUBLE) AS y, value AS v, 1.0::DOUBLE AS x_0, hour(ts) / 24.0::DOUBLE AS x_1, CAST(event_type = 'purchase' AS DOUBLE) AS x_2 FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL)"


def gee_sql(outcome: str, logit: bool, exchangeable: bool, steps: int) -> str:
    n = len(GEE_NAMES)
    eta = " + ".join(f"b_{i} * x_{i}" for i in range(n))
    ctes = [GEE_ROWS, "p0 AS (SELECT " + ", ".join(f"0.0::DOUBLE AS b_{i}" for i in range(n)) + ", 0.0::DOUBLE AS r)"]
    keep = ", ".join([*[f"b_{i}" for i in range(n)], "r"])
    for t in range(steps):
        mean = f"1 / (1 + exp(-({eta})))" if logit else eta
        ctes.append(f"w{t} AS (SELECT *, {'sqrt(m * (1 - m))' if logit else '1.0::DOUBLE'} AS s FROM (SELECT e.*, p.*, {mean} AS m FROM e, p{t} p))")
        sums = [f"sum(s * x_{i}) AS z_{i}" for i in range(n)] + [f"sum(x_{i} * ({outcome} - m)) AS ze_{i}" for i in range(n)] + [f"sum(s * s * x_{i} * x_{j}) AS zz_{i}_{j}" for i, j in pairs(n)]
        ctes.append(f"s{t} AS (SELECT {keep}, g, CAST(count(*) AS DOUBLE) AS n, sum(({outcome} - m) / s) AS e, sum(({outcome} - m) * ({outcome} - m) / (s * s)) AS ee, {', '.join(sums)} FROM w{t} GROUP BY ALL)")
        ctes.append(f"u{t} AS (SELECT *, " + ", ".join(f"(ze_{i} - r / (1 + (n - 1) * r) * z_{i} * e) / (1 - r) AS v_{i}" for i in range(n)) + f" FROM s{t})")
        totals = [f"sum(v_{i}) AS u_{i}" for i in range(n)] + [f"sum((zz_{i}_{j} - r / (1 + (n - 1) * r) * z_{i} * z_{j}) / (1 - r)) AS a_{i}_{j}" for i, j in pairs(n)] + [f"sum(v_{i} * v_{j}) AS m_{i}_{j}" for i, j in pairs(n)]
        ctes.append(f"g{t} AS (SELECT {keep}, count(*) AS clusters, sum(n) AS rows, sum(ee) AS ee, sum((e * e - ee) / 2) AS crossed, sum(n * (n - 1) / 2) AS n_pairs, {', '.join(totals)} FROM u{t} GROUP BY ALL)")
        carried = f"{keep}, clusters, rows, ee, crossed, n_pairs, " + ", ".join(f"m_{i}_{j}" for i, j in pairs(n))
        ctes.append(inverted(f"g{t}", f"h{t}", n, carried))
        ctes.append(f"p{t + 1} AS (SELECT " + ", ".join(f"b_{i} + x_{i} AS b_{i}" for i in range(n)) + f", {f'crossed / (ee / (rows - {n})) / (n_pairs - {n})' if exchangeable else '0.0'} AS r FROM h{t}_{n})")
    return "WITH " + ",\n".join(ctes) + "\n" + term_rows(f"h{steps - 1}_{n}", GEE_NAMES, [robust(n, k) for k in range(n)], f", {q6('r')} AS correlation")


def gee_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select("user_id", F.col("value").alias("v"), (F.col("value") > 50).cast("double").alias("high"), (F.hour("ts") / 24).alias("hour"), (F.col("event_type") == "purchase").cast("double").alias("purchase"))


@query(gee_sql("y", True, True, 12))
def gee_binomial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chance of a high value by hour and type, users as clusters, exchangeable working correlation."""
    return terms(models.gee(gee_rows(spark, sf_dir), "user_id", GEE_NAMES[1:], "high"), "correlation")


@query(gee_sql("v", False, True, 8))
def gee_gaussian(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean value by hour and type, users as clusters, exchangeable working correlation."""
    return terms(models.gee(gee_rows(spark, sf_dir), "user_id", GEE_NAMES[1:], "v", "gaussian"), "correlation")


# -- ordered and multinomial logits -----------------------------------------------------------------


def newton_sql(rows: str, start: list[str], prepare: str, score: list[str], second: dict[tuple[int, int], str], names: list[str], steps: int) -> str:
    """Full Newton steps; `prepare` is a SELECT list over the rows and b_i, layer by layer, `second` the negated second derivatives."""
    n = len(names)
    keep = ", ".join(f"b_{i}" for i in range(n))
    ctes = [rows, "p0 AS (SELECT " + ", ".join(f"({v})::DOUBLE AS b_{i}" for i, v in enumerate(start)) + ")"]
    for t in range(steps):
        layer = f"(SELECT e.*, p.* FROM e, p{t} p)"
        for columns in prepare.split(";"):
            layer = f"(SELECT *, {columns} FROM {layer})"
        ctes.append(f"s{t} AS (SELECT {keep}, g, count(*) AS n, " + ", ".join([*[f"sum({s}) AS v_{i}" for i, s in enumerate(score)], *[f"sum({second[i, j]}) AS w_{i}_{j}" for i, j in pairs(n)]]) + f" FROM {layer} GROUP BY ALL)")
        ctes.append(f"g{t} AS (SELECT {keep}, count(*) AS clusters, CAST(sum(n) AS DOUBLE) AS rows, " + ", ".join([*[f"sum(v_{i}) AS u_{i}" for i in range(n)], *[f"sum(w_{i}_{j}) AS a_{i}_{j}" for i, j in pairs(n)],
                                                                                                                *[f"sum(v_{i} * v_{j}) AS m_{i}_{j}" for i, j in pairs(n)]]) + f" FROM s{t} GROUP BY ALL)")
        ctes.append(inverted(f"g{t}", f"h{t}", n, f"{keep}, clusters, rows, " + ", ".join(f"m_{i}_{j}" for i, j in pairs(n))))
        ctes.append(f"p{t + 1} AS (SELECT " + ", ".join(f"b_{i} + x_{i} AS b_{i}" for i in range(n)) + f" FROM h{t}_{n})")
    adjusted = [f"({robust(n, k)}) * clusters / (clusters - 1.0) * (rows - 1) / (rows - {n})" for k in range(n)]
    return "WITH " + ",\n".join(ctes) + "\n" + term_rows(f"h{steps - 1}_{n}", names, adjusted)


ORDERED_NAMES = ["hour", "threshold_1", "threshold_2"]
ORDERED_UPPER = ["-x", "(k = 0)::INT", "(k = 1)::INT"]
ORDERED_LOWER = ["-x", "(k = 1)::INT", "(k = 2)::INT"]
ORDERED_SQL = newton_sql(
    "e AS (SELECT user_id AS g, CAST(least(2, floor(value / 40)) AS INT) AS k, hour(ts) / 24.0::DOUBLE AS x FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL)",
    ["0", *[f"(SELECT ln(avg((k < {t})::INT) / (1 - avg((k < {t})::INT))) FROM e)" for t in (1, 2)]],
    "CASE k WHEN 0 THEN 1 / (1 + exp(-(b_1 - b_0 * x))) WHEN 1 THEN 1 / (1 + exp(-(b_2 - b_0 * x))) ELSE 1.0 END AS hi, CASE k WHEN 0 THEN 0.0 WHEN 1 THEN 1 / (1 + exp(-(b_1 - b_0 * x))) ELSE 1 / (1 + exp(-(b_2 - b_0 * x))) END AS lo;"
    "hi * (1 - hi) / (hi - lo) AS gh, -lo * (1 - lo) / (hi - lo) AS gl;gh * (1 - 2 * hi) - gh * gh AS hh, gl * (1 - 2 * lo) - gl * gl AS ll, -gh * gl AS hl",
    [f"gh * {u} + gl * {v}" for u, v in zip(ORDERED_UPPER, ORDERED_LOWER)],
    {(i, j): f"-(hh * {ORDERED_UPPER[i]} * {ORDERED_UPPER[j]} + ll * {ORDERED_LOWER[i]} * {ORDERED_LOWER[j]} + hl * ({ORDERED_UPPER[i]} * {ORDERED_LOWER[j]} + {ORDERED_LOWER[i]} * {ORDERED_UPPER[j]}))" for i, j in pairs(3)},
    ORDERED_NAMES, 10)


@query(ORDERED_SQL)
def ordered_logit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three levels of an event's value by hour, users as clusters."""
    e = read(spark, sf_dir, "events").select("user_id", F.least(F.lit(2), F.floor(F.col("value") / 40)).alias("level"), (F.hour("ts") / 24).alias("hour"))
    return terms(models.ordered_logit(e, "user_id", ["hour"], "level"))


FLAGS_SQL = newton_sql(
    "e AS (SELECT l_suppkey AS g, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS k, l_quantity / 50.0 AS x FROM lineitem)",
    ["0"] * 4, "exp(b_0 + b_1 * x) AS o1, exp(b_2 + b_3 * x) AS o2;o1 / (1 + o1 + o2) AS q1, o2 / (1 + o1 + o2) AS q2",
    ["(k = 1)::INT - q1", "((k = 1)::INT - q1) * x", "(k = 2)::INT - q2", "((k = 2)::INT - q2) * x"],
    {(i, j): f"q{i // 2 + 1} * ({int(i // 2 == j // 2)} - q{j // 2 + 1}) * {'x' if i % 2 else '1'} * {'x' if j % 2 else '1'}" for i, j in pairs(4)},
    ["1|intercept", "1|quantity", "2|intercept", "2|quantity"], 10)


@query(f"SELECT CAST(split_part(term, '|', 1) AS DOUBLE) AS level, split_part(term, '|', 2) AS term, * EXCLUDE (term) FROM ({FLAGS_SQL})")
def multinomial_logit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return flags by quantity, suppliers as clusters."""
    flag = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    rows = read(spark, sf_dir, "lineitem").select("l_suppkey", flag.alias("flag"), (F.col("l_quantity") / 50).alias("quantity"))
    return models.multinomial_logit(rows, "l_suppkey", ["quantity"], "flag").select("level", "term", *[r6(c).alias(c) for c in ("estimate", "se", "z")], "n", "clusters")


# -- random intercepts --------------------------------------------------------------------------------


def intercepts_sql() -> str:
    """Halves the interval of log q over the clusters' sums, held as one list."""
    total = lambda e: f"list_sum(list_transform(c, lambda s: {e}))"
    weigh, fall = "(q / (1 + s.n * q))", "(1 / ((1 + s.n * q) * (1 + s.n * q)))"
    cells = {name: total(f"s.{sq} - {weigh} * s.{a} * s.{b}") for name, sq, a, b in (("a00", "n", "n", "n"), ("a01", "x", "n", "x"), ("a11", "xx", "x", "x"), ("r0", "y", "n", "y"), ("r1", "xy", "x", "y"), ("yy", "yy", "y", "y"))}
    falls = {f"d{name}": total(f"{fall} * s.{a} * s.{b}") for name, a, b in (("a00", "n", "n"), ("a01", "n", "x"), ("a11", "x", "x"), ("r0", "n", "y"), ("r1", "x", "y"), ("yy", "y", "y"))}
    sums = ", ".join(f"{e} AS {k}" for k, e in {**cells, **falls, "trace": total("s.n / (1 + s.n * q)"), "rows": total("s.n")}.items())
    solved = "(a11 * r0 - a01 * r1) / (a00 * a11 - a01 * a01) AS b_0, (a00 * r1 - a01 * r0) / (a00 * a11 - a01 * a01) AS b_1"
    slope = "rows * (dyy - 2 * (b_0 * dr0 + b_1 * dr1) + b_0 * b_0 * da00 + 2 * b_0 * b_1 * da01 + b_1 * b_1 * da11) / (yy - b_0 * r0 - b_1 * r1) - trace"
    at = lambda source: f"(SELECT *, {slope} AS slope FROM (SELECT *, {solved} FROM (SELECT *, {sums} FROM {source})))"
    return f"""WITH RECURSIVE own AS (SELECT o_custkey AS g, CAST(count(*) AS DOUBLE) AS n, sum(x) AS x, sum(y) AS y, sum(x * x) AS xx, sum(x * y) AS xy, sum(y * y) AS yy
  FROM (SELECT o_custkey, month(o_orderdate) / 12.0::DOUBLE AS x, ln(o_totalprice) + (o_custkey % 7) / 10.0 AS y FROM orders WHERE o_totalprice > 0) GROUP BY 1),
every AS (SELECT list({{'n': n, 'x': x, 'y': y, 'xx': xx, 'xy': xy, 'yy': yy}} ORDER BY g) AS c, count(*) AS clusters FROM own),
start AS (SELECT slope > 0 AS up FROM {at('(SELECT c, 0.0::DOUBLE AS q FROM every)')}),
halves AS (SELECT 0 AS step, ln(1e-8) AS low, ln(1e8) AS high UNION ALL
  SELECT step + 1, CASE WHEN slope > 0 THEN (low + high) / 2 ELSE low END, CASE WHEN slope > 0 THEN high ELSE (low + high) / 2 END
  FROM {at('(SELECT h.*, e.c, exp((low + high) / 2) AS q FROM halves h, every e WHERE step < 60)')}),
best AS (SELECT *, (yy - b_0 * r0 - b_1 * r1) / rows AS variance FROM {at("(SELECT e.*, CASE WHEN (SELECT up FROM start) THEN (SELECT exp((low + high) / 2) FROM halves WHERE step = 60) ELSE 0.0 END AS q FROM every e)")})
{term_rows('best', ['intercept', 'month'], ['variance * a11 / (a00 * a11 - a01 * a01)', 'variance * a00 / (a00 * a11 - a01 * a01)'], f", {q6('q * variance')} AS cluster_variance, {q6('variance')} AS residual_variance")}"""


@query(intercepts_sql())
def random_intercepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log price of an order, raised by a customer's own level, by month, with a random intercept for each customer."""
    o = read(spark, sf_dir, "orders").where("o_totalprice > 0").select("o_custkey", (F.month("o_orderdate") / 12).alias("month"), (F.log("o_totalprice") + F.col("o_custkey") % 7 / 10).alias("y"))
    return terms(models.random_intercepts(o, "o_custkey", ["month"], "y"), "cluster_variance", "residual_variance")


# -- gated fusion ----------------------------------------------------------------------------------------

EXPERTS, QUALITIES = ["long", "english", "prior"], ["p_long", "p_known"]
GATE = [0.5, 1.0, -0.25, -0.5, 0.75, 0.25, 0.0, -1.0, 0.5]


def experts(df: DataFrame) -> DataFrame:
    return df.withColumns({"long": F.log1p("n_chars") - 6.5, "english": F.when(F.col("lang") == "en", 0.4).otherwise(-0.4), "prior": F.lit(1.5), "p_long": F.least(F.lit(1.0), F.col("n_chars") / 5000),
                           "p_known": F.col("lang").isNotNull().cast("double")})


def gate_sql() -> str:
    design = ["1.0", "least(1.0, greatest(0.0, p_long))", "least(1.0, greatest(0.0, p_known))"]
    scores = [" + ".join(f"({GATE[m * 3 + k]}) * {design[k]}" for k in range(3)) for m in range(3)]
    shares = [f"exp({s})" for s in scores]
    every = " + ".join(shares)
    return f"""WITH x AS (SELECT source, quality AS y, ln(1 + n_chars) - 6.5 AS long, CASE WHEN lang = 'en' THEN 0.4 ELSE -0.4 END AS english, 1.5 AS prior, least(1.0, n_chars / 5000.0) AS p_long,
  CAST(lang IS NOT NULL AS DOUBLE) AS p_known FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL),
w AS (SELECT *, {', '.join(f'{s} / ({every}) AS w_{n}' for n, s in zip(EXPERTS, shares))} FROM x),
s AS (SELECT *, 1 / (1 + exp(-({' + '.join(f'w_{n} * {n}' for n in EXPERTS)}))) AS score FROM w)
SELECT source, count(*) AS n, {', '.join(f'{q6(f"avg(w_{n})")} AS w_{n}' for n in EXPERTS)}, {q6('avg(-(y * ln(score) + (1 - y) * ln(1 - score)))')} AS log_loss FROM s GROUP BY 1"""


@query(gate_sql())
def gate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean weights of three experts and the fused log loss by source, for a given gate."""
    s = models.gate_scores(experts(scored(spark, sf_dir)), EXPERTS, QUALITIES, GATE)
    loss = -(F.col("y") * F.log("score") + (1 - F.col("y")) * F.log(1 - F.col("score")))
    return s.groupBy("source").agg(F.count("*").alias("n"), *[r6(F.avg(f"w_{n}")).alias(f"w_{n}") for n in EXPERTS], r6(F.avg(loss)).alias("log_loss"))


@query()
def gated_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log loss of the gate fitted on all other folds, beside that of each expert, by fold disjoint by source."""
    s = scored(spark, sf_dir)
    rows = experts(s.join(M.group_folds(s, "source", "y"), "source"))
    out = models.gated_fusion(rows, "fold", EXPERTS, QUALITIES, "y", ["doc_id", *EXPERTS])

    def loss(p):
        return -F.avg(F.col("y") * F.log(p) + (1 - F.col("y")) * F.log(1 - p))

    return out.groupBy("fold").agg(F.count("*").alias("n"), r6(loss(F.col("score"))).alias("gate_loss"), *[r6(loss(1 / (1 + F.exp(-F.col(n))))).alias(f"{n}_loss") for n in EXPERTS])
