"""Models of repeated measures: estimating equations, ordered and multinomial logits, random intercepts, gated fusion.

Every step of a fit is one aggregation: rows to sums of their cluster, where an estimator needs them, and clusters to
one row of sums. Rows stay where they are; the driver holds coefficients and matrices of (terms x terms). A cluster of any size
is summed map-side. Inputs are kept between steps (`persist`), which a lost executor only costs time.
"""

from __future__ import annotations

import contextlib
import functools
import math
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INTERCEPT = "intercept"
TERMS = "term string, estimate double, se double, z double, p double, low double, high double, n long, clusters long"


@contextlib.contextmanager
def kept(df: DataFrame) -> Iterator[DataFrame]:
    df = df.persist()
    try:
        yield df
    finally:
        df.unpersist()


def total(columns: Sequence[Column]) -> Column:
    return functools.reduce(Column.__add__, columns)


def complete(df: DataFrame, label: str, features: Sequence[str], *others: str) -> DataFrame:
    """Rows whose label, features and `others` are all there and finite, as doubles: y, x0, x1, ... beside `others`."""
    numbers = [F.col(label).cast("double").alias("y"), *[F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(features)]]
    rows = df.select(*[F.col(c) for c in others], *numbers)
    there = [F.col(c).isNotNull() for c in others]
    finite = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in ["y", *[f"x{k}" for k in range(len(features))]]]
    return rows.where(functools.reduce(Column.__and__, [*there, *finite]))


def normal_p(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def term_table(df: DataFrame, names: Sequence[str], estimates: np.ndarray, cov: np.ndarray, n: int, clusters: int) -> DataFrame:
    """One row for each term: estimate, robust error, normal test and 95 % interval. Terms are few."""
    rows = []
    for name, b, v in zip(names, estimates.tolist(), np.diag(cov).tolist()):
        se = math.sqrt(max(v, 0.0))
        z = b / se if se else None
        rows.append((name, b, se, z, None if z is None else normal_p(z), b - 1.96 * se, b + 1.96 * se, n, clusters))
    return df.sparkSession.createDataFrame(rows, TERMS)


def solve(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """The solution, of least norm where terms depend on each other."""
    return np.linalg.lstsq(matrix, vector, rcond=None)[0]


def sandwich(bread: np.ndarray, meat: np.ndarray) -> np.ndarray:
    inverse = np.linalg.pinv(bread)
    return inverse @ meat @ inverse.T


def squares(names: Sequence[str]) -> list[tuple[int, int]]:
    return [(i, j) for i in range(len(names)) for j in range(i, len(names))]


def symmetric(values: dict, prefix: str, size: int) -> np.ndarray:
    out = np.zeros((size, size))
    for i in range(size):
        for j in range(i, size):
            out[i, j] = out[j, i] = values[f"{prefix}_{i}_{j}"] or 0.0
    return out


def vector(values: dict, prefix: str, size: int) -> np.ndarray:
    return np.array([values[f"{prefix}_{i}"] or 0.0 for i in range(size)])


# -- estimating equations ------------------------------------------------------------------------


def gee_fit(df: DataFrame, cluster: str, features: Sequence[str], label: str, family: str = "binomial", working: str = "exchangeable", weight: str | None = None,
            steps: int = 60, tolerance: float = 1e-10) -> dict:
    """Generalised estimating equations with the cluster sandwich.

    Logit link for "binomial", identity for "gaussian"; working correlation "exchangeable" or "independence"; `weight`
    is one number for a cluster (its mean counts). With A the variances and R the working correlation, the sums of a
    cluster's sqrt(A) x and (y - mu) / sqrt(A) and of their products give its share of D'V^-1 D and D'V^-1 (y - mu), as R^-1 of n rows is
    (I - c J) / (1 - r), c = r / (1 + (n - 1) r). A step takes these with the last r and finds the next.
    """
    names = [INTERCEPT, *features]
    d = len(names)
    rows = complete(df.withColumn("__w", F.lit(1.0) if weight is None else F.col(weight).cast("double")), label, features, cluster, "__w")
    x = [F.lit(1.0), *[F.col(f"x{k}") for k in range(len(features))]]
    b, r = np.zeros(d), 0.0
    found: dict = {}
    with kept(rows) as rows:
        for _ in range(steps):
            eta = total([F.lit(float(v)) * c for v, c in zip(b, x)])
            mean = 1 / (1 + F.exp(-eta)) if family == "binomial" else eta
            spread = F.sqrt(F.col("__m") * (1 - F.col("__m"))) if family == "binomial" else F.lit(1.0)
            at = rows.withColumn("__m", mean).withColumn("__s", spread).withColumn("__e", (F.col("y") - F.col("__m")) / F.col("__s"))
            z = [F.col("__s") * c for c in x]
            e = F.col("__e")
            sums = at.groupBy(cluster).agg(
                F.count("*").cast("double").alias("n"), F.avg("__w").alias("w"), F.sum(e).alias("e"), F.sum(e * e).alias("ee"),
                *[F.sum(z[i]).alias(f"z_{i}") for i in range(d)], *[F.sum(z[i] * e).alias(f"ze_{i}") for i in range(d)],
                *[F.sum(z[i] * z[j]).alias(f"zz_{i}_{j}") for i, j in squares(names)])
            n, w = F.col("n"), F.col("w")
            c = F.lit(r) / (1 + (n - 1) * F.lit(r))
            scores = [w * (F.col(f"ze_{i}") - c * F.col(f"z_{i}") * F.col("e")) / (1 - r) for i in range(d)]
            shares = sums.select(
                "n", "w", "e", "ee", *[s.alias(f"u_{i}") for i, s in enumerate(scores)],
                *[(w * (F.col(f"zz_{i}_{j}") - c * F.col(f"z_{i}") * F.col(f"z_{j}")) / (1 - r)).alias(f"b_{i}_{j}") for i, j in squares(names)])
            found = shares.agg(
                F.count("*").alias("clusters"), F.sum(n).alias("rows"), F.sum(w * n).alias("weights"), F.sum(w * F.col("ee")).alias("ee"),
                F.sum(w * (F.col("e") * F.col("e") - F.col("ee")) / 2).alias("cross"), F.sum(n * (n - 1) / 2).alias("pairs"), F.sum(w * n * (n - 1) / 2).alias("pair_weights"),
                *[F.sum(f"u_{i}").alias(f"u_{i}") for i in range(d)], *[F.sum(f"b_{i}_{j}").alias(f"b_{i}_{j}") for i, j in squares(names)],
                *[F.sum(F.col(f"u_{i}") * F.col(f"u_{j}")).alias(f"m_{i}_{j}") for i, j in squares(names)]).first().asDict()
            if not found["rows"]:
                raise ValueError("no row has a label and all features")
            bread = symmetric(found, "b", d)
            change = solve(bread, vector(found, "u", d))
            scale = found["ee"] / (found["weights"] * (found["rows"] - d) / found["rows"]) if found["rows"] > d else 0.0
            before, r = r, 0.0
            if working == "exchangeable" and found["pairs"] > d and scale > 0:
                r = found["cross"] / scale / (found["pair_weights"] * (found["pairs"] - d) / found["pairs"])
            if max(np.abs(change).max(), abs(r - before)) < tolerance:
                break
            b = b + change
    cov = sandwich(bread, symmetric(found, "m", d))
    return {"names": names, "estimates": b, "cov": cov, "n": int(found["rows"]), "clusters": found["clusters"], "correlation": before, "scale": scale, "score": vector(found, "u", d)}


def gee(df: DataFrame, cluster: str, features: Sequence[str], label: str, family: str = "binomial", working: str = "exchangeable", weight: str | None = None) -> DataFrame:
    """(term, estimate, se, z, p, low, high, n, clusters, correlation) of `gee_fit`; rows without label, feature or cluster are left out."""
    f = gee_fit(df, cluster, features, label, family, working, weight)
    return term_table(df, f["names"], f["estimates"], f["cov"], f["n"], f["clusters"]).withColumn("correlation", F.lit(f["correlation"]))


# -- likelihoods by Newton steps with a cluster sandwich -----------------------------------------


def newton(rows: DataFrame, cluster: str, names: Sequence[str], start: np.ndarray, parts: Callable[[np.ndarray, DataFrame], tuple[DataFrame, list[Column], dict[tuple[int, int], Column], Column]],
           steps: int = 60, tolerance: float = 1e-10) -> dict:
    """Greatest likelihood by Newton steps, halved where the likelihood falls, and the sandwich of the clusters' scores.

    `parts` gives, at coefficients, the rows with what its columns need, the score of each coefficient, the second
    derivatives of each pair and the log likelihood. A step is one aggregation by cluster and one over clusters.
    """
    d = len(names)

    def sums(b: np.ndarray) -> dict:
        at, score, second, likelihood = parts(b, rows)
        own = at.groupBy(cluster).agg(F.count("*").alias("n"), F.sum(likelihood).alias("l"), *[F.sum(s).alias(f"u_{i}") for i, s in enumerate(score)],
                                      *[F.sum(second[i, j]).alias(f"b_{i}_{j}") for i, j in squares(names)])
        return own.agg(F.count("*").alias("clusters"), F.sum("n").alias("rows"), F.sum("l").alias("l"), *[F.sum(f"u_{i}").alias(f"u_{i}") for i in range(d)],
                       *[F.sum(f"b_{i}_{j}").alias(f"b_{i}_{j}") for i, j in squares(names)],
                       *[F.sum(F.col(f"u_{i}") * F.col(f"u_{j}")).alias(f"m_{i}_{j}") for i, j in squares(names)]).first().asDict()

    b = np.array(start, float)
    found = sums(b)
    if not found["rows"]:
        raise ValueError("no row has a label and all features")
    for _ in range(steps):
        change = solve(-symmetric(found, "b", d), vector(found, "u", d))
        if np.abs(change).max() < tolerance:
            break
        after = sums(b + change)
        while not (after["l"] is not None and after["l"] >= found["l"] - 1e-9 * abs(found["l"])) and np.abs(change).max() > tolerance:
            change = change / 2
            after = sums(b + change)
        b, found = b + change, after
    bread = -symmetric(found, "b", d)
    g, n = found["clusters"], found["rows"]
    adjust = g / (g - 1) * (n - 1) / (n - d) if g > 1 and n > d else 1.0
    return {"names": list(names), "estimates": b, "cov": sandwich(bread, symmetric(found, "m", d)) * adjust, "n": n, "clusters": g, "likelihood": found["l"], "score": vector(found, "u", d)}


def levels_of(rows: DataFrame, limit: int = 100) -> list[tuple[float, int]]:
    """The levels of an ordered or nominal label with their counts; they are to be few."""
    found = sorted((r["y"], r["n"]) for r in rows.groupBy("y").agg(F.count("*").alias("n")).limit(limit + 1).collect())
    if not 2 <= len(found) <= limit:
        raise ValueError(f"a label needs from 2 to {limit} levels")
    return found


def ordered_logit(df: DataFrame, cluster: str, features: Sequence[str], label: str) -> DataFrame:
    """Cumulative logit of an ordered label: (term, estimate, se, ...), slopes first, then a threshold under each level but the first.

    P(y <= k) is the logistic of threshold k less the slopes; errors are the clusters' sandwich with the usual
    small-sample factor. Labels may be any numbers; their order counts.
    """
    rows = complete(df, label, features, cluster)
    with kept(rows) as rows:
        levels = levels_of(rows)
        d, k = len(features), len(levels)
        below = np.cumsum([n for _, n in levels])[:-1] / sum(n for _, n in levels)
        rank = functools.reduce(lambda c, t: c.when(F.col("y") == t[1][0], t[0]), enumerate(levels), F.when(F.lit(False), 0))
        ranked = rows.withColumn("k", rank)
        names = [*features, *[f"threshold_{level:g}" for level, _ in levels[1:]]]

        def parts(b: np.ndarray, rows: DataFrame):
            slope = total([F.lit(0.0), *[F.lit(float(v)) * F.col(f"x{i}") for i, v in enumerate(b[:d])]])
            bound = F.array(F.lit(-1e3), *[F.lit(float(v)) for v in b[d:]], F.lit(1e3))
            logistic = lambda c: 1 / (1 + F.exp(-c))
            at = rows.withColumn("__h", logistic(F.get(bound, F.col("k") + 1) - slope)).withColumn("__l", logistic(F.get(bound, F.col("k")) - slope))
            at = at.withColumn("__d", F.col("__h") - F.col("__l"))
            h, low, share = F.col("__h"), F.col("__l"), F.col("__d")
            fh, fl = h * (1 - h), low * (1 - low)
            gh, gl = fh / share, -fl / share
            hh, ll, hl = fh * (1 - 2 * h) / share - gh * gh, -fl * (1 - 2 * low) / share - gl * gl, -gh * gl
            upper = [*[-F.col(f"x{i}") for i in range(d)], *[(F.col("k") == t).cast("double") for t in range(k - 1)]]
            lower = [*[-F.col(f"x{i}") for i in range(d)], *[(F.col("k") == t + 1).cast("double") for t in range(k - 1)]]
            score = [gh * u + gl * v for u, v in zip(upper, lower)]
            second = {(i, j): hh * upper[i] * upper[j] + ll * lower[i] * lower[j] + hl * (upper[i] * lower[j] + lower[i] * upper[j]) for i, j in squares(names)}
            return at, score, second, F.when(share > 0, F.log(share))

        f = newton(ranked, cluster, names, np.concatenate([np.zeros(d), np.log(below / (1 - below))]), parts)
    return term_table(df, f["names"], f["estimates"], f["cov"], f["n"], f["clusters"])


def multinomial_logit(df: DataFrame, cluster: str, features: Sequence[str], label: str) -> DataFrame:
    """Logits of every level of a label against its least: (level, term, estimate, se, ...), errors the clusters' sandwich."""
    rows = complete(df, label, features, cluster)
    with kept(rows) as rows:
        levels = levels_of(rows)
        terms = [INTERCEPT, *features]
        d, k = len(terms), len(levels) - 1
        cells = [(c, t) for c in range(k) for t in range(d)]
        names = [f"{levels[c + 1][0]:g}|{terms[t]}" for c, t in cells]
        x = [F.lit(1.0), *[F.col(f"x{i}") for i in range(len(features))]]

        def parts(b: np.ndarray, rows: DataFrame):
            logits = [total([F.lit(float(b[c * d + t])) * x[t] for t in range(d)]) for c in range(k)]
            at = rows.withColumn("__g", F.greatest(F.lit(0.0), *logits, F.lit(0.0))).withColumns({f"__o{c}": o for c, o in enumerate(logits)})
            at = at.withColumn("__t", F.exp(-F.col("__g")) + total([F.exp(F.col(f"__o{c}") - F.col("__g")) for c in range(k)]))
            at = at.withColumns({f"__p{c}": F.exp(F.col(f"__o{c}") - F.col("__g")) / F.col("__t") for c in range(k)})
            own = [(F.col("y") == levels[c + 1][0]).cast("double") for c in range(k)]
            score = [(own[c] - F.col(f"__p{c}")) * x[t] for c, t in cells]
            second = {(i, j): -F.col(f"__p{cells[i][0]}") * (float(cells[i][0] == cells[j][0]) - F.col(f"__p{cells[j][0]}")) * x[cells[i][1]] * x[cells[j][1]] for i, j in squares(names)}
            chosen = total([F.lit(0.0), *[own[c] * F.col(f"__o{c}") for c in range(k)]])
            return at, score, second, chosen - F.col("__g") - F.log(F.col("__t"))

        f = newton(rows, cluster, names, np.zeros(k * d), parts)
    out = term_table(df, f["names"], f["estimates"], f["cov"], f["n"], f["clusters"])
    return out.select(F.split("term", r"\|")[0].cast("double").alias("level"), F.split("term", r"\|")[1].alias("term"), *out.columns[1:])


# -- random intercepts -----------------------------------------------------------------------------


def random_intercepts(df: DataFrame, cluster: str, features: Sequence[str], label: str, steps: int = 100, tolerance: float = 1e-9) -> DataFrame:
    """Linear model with a random intercept for each cluster, by maximum likelihood: (term, estimate, se, ..., cluster_variance, residual_variance).

    Rows become one row of sums for each cluster, once. The ratio q of both variances is the root of the profile likelihood's
    slope, found by false position in log q over those sums, one aggregation a step; given q, coefficients and residual variance
    are weighted sums. If the slope is negative from the start, q is 0.
    """
    names = [INTERCEPT, *features]
    d = len(names)
    x = [F.lit(1.0), *[F.col(f"x{k}") for k in range(len(features))]]
    y = F.col("y")
    own = complete(df, label, features, cluster).groupBy(cluster).agg(
        F.count("*").cast("double").alias("n"), F.sum(y).alias("y"), F.sum(y * y).alias("yy"), *[F.sum(x[i]).alias(f"x_{i}") for i in range(d)],
        *[F.sum(x[i] * y).alias(f"xy_{i}") for i in range(d)], *[F.sum(x[i] * x[j]).alias(f"xx_{i}_{j}") for i, j in squares(names)])
    with kept(own) as own:
        def at(q: float) -> dict:
            """Coefficients, residual sum and slope of the profile likelihood in q."""
            n = F.col("n")
            c, e = F.lit(q) / (1 + n * F.lit(q)), 1 / ((1 + n * F.lit(q)) * (1 + n * F.lit(q)))
            cells = {"yy": F.col("yy") - c * F.col("y") * F.col("y"), "dyy": e * F.col("y") * F.col("y"), "trace": n / (1 + n * F.lit(q)), "rows": n, "clusters": F.lit(1)}
            for i in range(d):
                cells[f"xy_{i}"] = F.col(f"xy_{i}") - c * F.col(f"x_{i}") * F.col("y")
                cells[f"dxy_{i}"] = e * F.col(f"x_{i}") * F.col("y")
            for i, j in squares(names):
                cells[f"xx_{i}_{j}"] = F.col(f"xx_{i}_{j}") - c * F.col(f"x_{i}") * F.col(f"x_{j}")
                cells[f"dxx_{i}_{j}"] = e * F.col(f"x_{i}") * F.col(f"x_{j}")
            s = own.agg(*[F.sum(v).alias(k) for k, v in cells.items()]).first().asDict()
            if not s["rows"]:
                raise ValueError("no row has a label and all features")
            a, xy = symmetric(s, "xx", d), vector(s, "xy", d)
            b = solve(a, xy)
            rss = s["yy"] - b @ xy
            fall = s["dyy"] - 2 * b @ vector(s, "dxy", d) + b @ symmetric(s, "dxx", d) @ b      # how fast the residual sum falls with q
            return {"a": a, "b": b, "rss": rss, "rows": int(s["rows"]), "clusters": s["clusters"], "slope": s["rows"] * fall / rss - s["trace"]}

        best, q = at(0.0), 0.0
        if best["slope"] > 0:
            # false position on log q between ends of both signs; an end that stays counts half
            low, high = math.log(1e-8), math.log(1e8)
            first, last, side = at(math.exp(low))["slope"], at(math.exp(high))["slope"], 0
            first, last = first * math.exp(low), last * math.exp(high)
            for _ in range(steps):
                guess = (low * last - high * first) / (last - first) if first > 0 > last else (low + high) / 2
                q = math.exp(guess)
                best = at(q)
                slope = best["slope"] * q
                if abs(slope) < tolerance or high - low < tolerance:
                    break
                if slope > 0:
                    low, first = guess, slope
                    last = last / 2 if side > 0 else last
                    side = 1
                else:
                    high, last = guess, slope
                    first = first / 2 if side < 0 else first
                    side = -1
    variance = best["rss"] / best["rows"]
    out = term_table(df, names, best["b"], np.linalg.pinv(best["a"]) * variance, best["rows"], best["clusters"])
    return out.withColumns({"cluster_variance": F.lit(q * variance), "residual_variance": F.lit(variance)})


# -- gated fusion ------------------------------------------------------------------------------------


def gate_weights(experts: int, qualities: Sequence[str], parameters: Sequence[float]) -> list[Column]:
    """Softmax weights of the experts, whose scores are linear in a constant and the qualities (clipped to 0..1, null is 0)."""
    width = len(qualities) + 1
    design = [F.lit(1.0), *[F.least(F.greatest(F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(0.0)), F.lit(1.0)) for c in qualities]]
    scores = [total([F.lit(float(parameters[m * width + k])) * design[k] for k in range(width)]) for m in range(experts)]
    top = F.greatest(*scores) if experts > 1 else scores[0]
    shares = [F.exp(s - top) for s in scores]
    return [s / total(shares) for s in shares]


def gate_scores(df: DataFrame, experts: Sequence[str], qualities: Sequence[str], parameters: Sequence[float]) -> DataFrame:
    """`df` with the weight of each expert (w_<name>) and the fused probability (score), null where an expert is."""
    weights = gate_weights(len(experts), qualities, parameters)
    fused = total([w * F.col(c) for w, c in zip(weights, experts)])
    return df.withColumns({**{f"w_{c}": w for w, c in zip(weights, experts)}, "score": F.when(fused.isNotNull(), 1 / (1 + F.exp(-F.least(F.greatest(fused, F.lit(-40.0)), F.lit(40.0)))))})


def gate_loss(df: DataFrame, experts: Sequence[str], qualities: Sequence[str], label: str, parameters: Sequence[float], ridge: float = 1e-3) -> tuple[float, np.ndarray]:
    """Mean log loss of the gate with its ridge, and the gradient in the parameters: one aggregation.

    The slope of the loss in an expert's score is (p - y) times its weight times how far its logit stands above the fused one.
    """
    width = len(qualities) + 1
    design = [F.lit(1.0), *[F.least(F.greatest(F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(0.0)), F.lit(1.0)) for c in qualities]]
    at = gate_scores(df, experts, qualities, parameters)
    fused = total([F.col(f"w_{c}") * F.col(c) for c in experts])
    q = F.least(F.greatest(F.col("score"), F.lit(1e-15)), F.lit(1 - 1e-15))
    y = F.col(label).cast("double")
    loss = -(y * F.log(q) + (1 - y) * F.log(1 - q))
    slopes = [(F.col("score") - y) * F.col(f"w_{c}") * (F.col(c) - fused) for c in experts]
    row = at.agg(F.avg(loss).alias("l"), *[F.avg(s * design[k]).alias(f"g_{m * width + k}") for m, s in enumerate(slopes) for k in range(width)]).first()
    if row["l"] is None:
        raise ValueError("no row has a label and all experts")
    p = np.asarray(parameters, float)
    return row["l"] + ridge * float(p @ p), np.array(row[1:], float) + 2 * ridge * p


def lbfgs(f: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, memory: int = 8, steps: int = 100, tolerance: float = 1e-5) -> np.ndarray:
    """A minimum of a smooth function given with its gradient; the last `memory` moves stand for the curvature."""
    x, (value, slope) = np.array(start, float), f(start)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        if np.abs(slope).max() < tolerance:
            break
        way, parts = slope.copy(), []
        for s, g in reversed(moves):
            parts.append((s @ way) / (s @ g))
            way -= parts[-1] * g
        if moves:
            s, g = moves[-1]
            way *= (s @ g) / (g @ g)
        for (s, g), part in zip(moves, reversed(parts)):
            way += s * (part - (g @ way) / (s @ g))
        size, fall = 1.0 if moves else min(1.0, 1.0 / np.abs(slope).sum()), slope @ way
        new, (after, turned) = x - size * way, f(x - size * way)
        while after > value - 1e-4 * size * fall and size > 1e-12:
            size /= 2
            new, (after, turned) = x - size * way, f(x - size * way)
        if after >= value:
            break
        if (new - x) @ (turned - slope) > 1e-14:
            moves = [*moves[1 - memory:], (new - x, turned - slope)]
        x, value, slope = new, after, turned
    return x


def gated_fusion(df: DataFrame, fold: str, experts: Sequence[str], qualities: Sequence[str], label: str, keys: Sequence[str], ridge: float = 1e-3) -> DataFrame:
    """(keys, fold, label, w_<expert>..., score): every row scored by the gate fitted on all other folds.

    Experts are columns of logits; a row without label, or without all of them, trains nothing, and one without all of them has no score.
    Folds are a parameter of few values.
    """
    there = functools.reduce(Column.__and__, [F.col(c).isNotNull() & ~F.isnan(c) for c in experts])
    with kept(df.select(*dict.fromkeys([fold, label, *experts, *qualities]))) as rows:
        folds = [r[0] for r in rows.select(fold).distinct().collect()]

        def fitted(name: object) -> list[float]:
            train = rows.where(~F.col(fold).eqNullSafe(F.lit(name)) & there & F.col(label).isNotNull())
            return lbfgs(lambda p: gate_loss(train, experts, qualities, label, p, ridge), np.zeros(len(experts) * (len(qualities) + 1))).tolist()

        with ThreadPoolExecutor(max(1, min(8, len(folds)))) as pool:     # jobs of one session side by side
            gates = list(pool.map(fitted, folds))
    parts = [gate_scores(df.where(F.col(fold).eqNullSafe(F.lit(name))), experts, qualities, g) for name, g in zip(folds, gates)]
    return functools.reduce(DataFrame.union, parts).select(*keys, fold, label, *[f"w_{c}" for c in experts], "score")
