"""Models of repeated measures against NumPy fits of the same definitions, written for whole arrays."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.operators import metrics, models

RNG = np.random.default_rng(7)
SIZES = [1, 2, 3, 5, 8, 13, 40, 4, 6, 9, 7, 30]
G = np.repeat(np.arange(len(SIZES)), SIZES)
X = np.column_stack([RNG.normal(size=len(G)), RNG.integers(0, 2, len(G)).astype(float)])
OWN = RNG.normal(size=len(SIZES))[G]
LINEAR = 0.4 + 0.8 * X[:, 0] - 0.5 * X[:, 1] + OWN
CHANCE = 1 / (1 + np.exp(-LINEAR))
BINARY = (RNG.random(len(G)) < CHANCE).astype(float)
NUMBER = LINEAR + RNG.normal(size=len(G)) * 0.7
LEVEL = np.digitize(LINEAR + RNG.logistic(size=len(G)), [-1.0, 0.5, 1.5]) * 2 + 1
KIND = RNG.integers(0, 3, len(G)) * (LINEAR > 0) + (LINEAR < -1)


@pytest.fixture(scope="module")
def data(spark):
    rows = [(int(g), float(a), float(b), float(y), float(v), int(k), int(m), float(1 + g % 3)) for g, (a, b), y, v, k, m in zip(G, X, BINARY, NUMBER, LEVEL, KIND)]
    rows += [(0, None, 1.0, 1.0, 1.0, 1, 1, 1.0), (None, 1.0, 1.0, 1.0, 1.0, 1, 1, 1.0), (1, float("nan"), 0.0, 1.0, 1.0, 3, 0, 2.0), (2, 1.0, 0.0, None, None, None, None, 3.0)]
    return spark.createDataFrame(rows, "g long, a double, b double, y double, v double, level int, kind int, w double").repartition(3).cache()


def by_term(df):
    return {r["term"]: r for r in df.collect()}


def plain_gee(y, x, g, family, exchangeable, weights=None):
    """Estimating equations with full working covariance matrices."""
    x = np.column_stack([np.ones(len(y)), x])
    b, r = np.zeros(x.shape[1]), 0.0
    clusters = [np.flatnonzero(g == c) for c in np.unique(g)]
    weights = np.ones(len(y)) if weights is None else weights
    for _ in range(200):
        bread, score, meat = 0, 0, 0
        for at in clusters:
            eta = x[at] @ b
            mu = 1 / (1 + np.exp(-eta)) if family == "binomial" else eta
            a = mu * (1 - mu) if family == "binomial" else np.ones(len(at))
            v = np.sqrt(np.outer(a, a)) * ((1 - r) * np.eye(len(at)) + r)
            d = a[:, None] * x[at]
            u = weights[at[0]] * d.T @ np.linalg.solve(v, y[at] - mu)
            bread, score, meat = bread + weights[at[0]] * d.T @ np.linalg.solve(v, d), score + u, meat + np.outer(u, u)
        b = b + np.linalg.solve(bread, score)
        eta = x @ b
        mu = 1 / (1 + np.exp(-eta)) if family == "binomial" else eta
        e = (y - mu) / np.sqrt(mu * (1 - mu) if family == "binomial" else 1)
        n, d = len(y), x.shape[1]
        if exchangeable:
            w = [weights[at[0]] for at in clusters]
            scale = sum(k * (e[at] ** 2).sum() for k, at in zip(w, clusters)) / (sum(k * len(at) for k, at in zip(w, clusters)) * (n - d) / n)
            pairs = [len(at) * (len(at) - 1) / 2 for at in clusters]
            r = sum(k * (e[at].sum() ** 2 - (e[at] ** 2).sum()) / 2 for k, at in zip(w, clusters)) / scale / (sum(k * p for k, p in zip(w, pairs)) * (sum(pairs) - d) / sum(pairs))
    inverse = np.linalg.inv(bread)
    return b, np.sqrt(np.diag(inverse @ meat @ inverse)), r


@pytest.mark.parametrize("family, column, y", [("binomial", "y", BINARY), ("gaussian", "v", NUMBER)])
@pytest.mark.parametrize("working, weight", [("exchangeable", None), ("independence", None), ("exchangeable", "w")])
def test_gee_equals_full_matrices(data, family, column, y, working, weight):
    got = by_term(models.gee(data, "g", ["a", "b"], column, family, working, weight))
    b, se, r = plain_gee(y, X, G, family, working == "exchangeable", None if weight is None else 1.0 + G % 3)
    assert list(got) == ["intercept", "a", "b"]
    np.testing.assert_allclose([t["estimate"] for t in got.values()], b, atol=1e-7)
    np.testing.assert_allclose([t["se"] for t in got.values()], se, atol=1e-7)
    one = got["a"]
    assert one["n"] == len(G) and one["clusters"] == len(SIZES) and abs(one["correlation"] - r) < 1e-7
    assert abs(one["p"] - math.erfc(abs(one["estimate"] / one["se"]) / math.sqrt(2))) < 1e-12 and abs(one["high"] - one["low"] - 3.92 * one["se"]) < 1e-9


def numeric_fit(log_likelihood, start, score_by_row, g):
    """Newton steps with derivatives by differences of given scores, and the clusters' sandwich."""
    b = np.array(start, float)
    for _ in range(60):
        u = score_by_row(b)
        h = np.column_stack([(score_by_row(b + d).sum(0) - score_by_row(b - d).sum(0)) / 2e-5 for d in np.eye(len(b)) * 1e-5])
        step = np.linalg.solve(-h, u.sum(0))
        while log_likelihood(b + step) < log_likelihood(b) - 1e-12:
            step /= 2
        b = b + step
    u = score_by_row(b)
    own = np.array([u[g == c].sum(0) for c in np.unique(g)])
    n, k, m = len(u), len(b), len(own)
    inverse = np.linalg.inv(-h)
    return b, np.sqrt(np.diag(inverse @ (own.T @ own) @ inverse) * m / (m - 1) * (n - 1) / (n - k))


def test_ordered_logit_equals_differences(data):
    levels = np.unique(LEVEL)
    k = np.searchsorted(levels, LEVEL)

    def rows(b):
        bounds = np.concatenate([[-np.inf], b[2:], [np.inf]])
        f = lambda z: 1 / (1 + np.exp(-z))
        return np.log(f(bounds[k + 1] - X @ b[:2]) - f(bounds[k] - X @ b[:2]))

    def score(b):
        return np.column_stack([(rows(b + d) - rows(b - d)) / 2e-4 for d in np.eye(len(b)) * 1e-4])

    b, se = numeric_fit(lambda b: rows(b).sum() if (np.diff(b[2:]) > 0).all() else -np.inf, [0, 0, -1, 0, 1], score, G)
    got = by_term(models.ordered_logit(data, "g", ["a", "b"], "level"))
    assert list(got) == ["a", "b", "threshold_3", "threshold_5", "threshold_7"] and got["a"]["n"] == len(G)
    np.testing.assert_allclose([t["estimate"] for t in got.values()], b, atol=1e-5)
    np.testing.assert_allclose([t["se"] for t in got.values()], se, atol=1e-4)


def test_multinomial_logit_equals_plain_scores(data):
    x = np.column_stack([np.ones(len(G)), X])
    own = np.column_stack([KIND == 1, KIND == 2]).astype(float)

    def chances(b):
        o = np.exp(x @ b.reshape(2, 3).T)
        return o / (1 + o.sum(1, keepdims=True))

    def score(b):
        return ((own - chances(b))[:, :, None] * x[:, None, :]).reshape(len(x), 6)

    def likelihood(b):
        p = chances(b)
        return (own * np.log(p)).sum() + (np.log(1 - p.sum(1)) * (1 - own.sum(1))).sum()

    b, se = numeric_fit(likelihood, np.zeros(6), score, G)
    got = models.multinomial_logit(data, "g", ["a", "b"], "kind").collect()
    assert [(r["level"], r["term"]) for r in got] == [(c, t) for c in (1.0, 2.0) for t in ("intercept", "a", "b")]
    np.testing.assert_allclose([r["estimate"] for r in got], b, atol=1e-6)
    np.testing.assert_allclose([r["se"] for r in got], se, atol=1e-4)


def test_random_intercepts_equal_whole_covariance(data):
    x = np.column_stack([np.ones(len(G)), X])
    same = (G[:, None] == G[None, :]).astype(float)

    def fitted(q):
        v = np.eye(len(G)) + q * same
        a = x.T @ np.linalg.solve(v, x)
        b = np.linalg.solve(a, x.T @ np.linalg.solve(v, NUMBER))
        e = NUMBER - x @ b
        s = e @ np.linalg.solve(v, e) / len(G)
        return -len(G) / 2 * np.log(s) - np.linalg.slogdet(v)[1] / 2, b, s, np.linalg.inv(a) * s

    grid = np.exp(np.linspace(-4, 4, 81))
    q = max(grid, key=lambda q: fitted(q)[0])
    width = 0.1
    for _ in range(40):
        q = max((q * math.exp(t * width) for t in (-1, -0.5, 0, 0.5, 1)), key=lambda q: fitted(q)[0])
        width /= 1.6
    _, b, s, cov = fitted(q)
    got = by_term(models.random_intercepts(data, "g", ["a", "b"], "v"))
    np.testing.assert_allclose([t["estimate"] for t in got.values()], b, atol=1e-5)
    np.testing.assert_allclose([t["se"] for t in got.values()], np.sqrt(np.diag(cov)), atol=1e-5)
    assert abs(got["a"]["residual_variance"] - s) < 1e-5 and abs(got["a"]["cluster_variance"] / (q * s) - 1) < 1e-3


def test_no_variance_between_clusters(spark):
    rows = [(k % 5, float(k), float(2 * k + (-1) ** (k // 5))) for k in range(40)]
    got = by_term(models.random_intercepts(spark.createDataFrame(rows, "g long, a double, v double"), "g", ["a"], "v"))
    assert got["a"]["cluster_variance"] == 0.0 and abs(got["a"]["estimate"] - np.polyfit([r[1] for r in rows], [r[2] for r in rows], 1)[0]) < 1e-9


def test_models_of_nothing(data):
    none = data.limit(0)
    for fit in (lambda: models.gee(none, "g", ["a"], "y"), lambda: models.ordered_logit(none, "g", ["a"], "level"), lambda: models.multinomial_logit(none, "g", ["a"], "kind"),
                lambda: models.random_intercepts(none, "g", ["a"], "v")):
        with pytest.raises(ValueError):
            fit()


# -- gate ---------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def views(spark):
    """Three experts, each right where its quality is high."""
    n = 900
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, n)
    quality = rng.random((n, 2))
    first, second = ((2 * y - 1) * 2.5 * (quality[:, k] > 0.5) + rng.normal(size=n) * np.where(quality[:, k] > 0.5, 0.5, 2.0) for k in (0, 1))
    rows = [(k, k % 3, int(y[k]), float(first[k]), float(second[k]), 0.1, float(quality[k, 0]), float(quality[k, 1])) for k in range(n)]
    return spark.createDataFrame(rows, "id long, fold int, y int, one double, two double, prior double, q1 double, q2 double").repartition(3).cache()


def test_gradient_of_gate_equals_differences(views):
    at = np.array([0.3, -1.0, 0.5, 0.2, 0.9, -0.4, 0.0, 0.1, 0.7])
    args = (views, ["one", "two", "prior"], ["q1", "q2"], "y")
    loss, slope = models.gate_loss(*args, at)
    assert loss > 0
    for k in range(9):
        step = np.eye(9)[k] * 1e-5
        assert abs((models.gate_loss(*args, at + step)[0] - models.gate_loss(*args, at - step)[0]) / 2e-5 - slope[k]) < 1e-7


def test_gate_beats_every_expert_on_left_out_folds(views):
    out = models.gated_fusion(views, "fold", ["one", "two", "prior"], ["q1", "q2"], "y", ["id", "one", "two", "prior"]).toPandas()

    def loss(p):
        return float(-(out.y * np.log(p) + (1 - out.y) * np.log(1 - p)).mean())

    best = min(loss(1 / (1 + np.exp(-out[c]))) for c in ("one", "two", "prior"))
    assert len(out) == 900 and loss(out.score) < 0.8 * best
    np.testing.assert_allclose(out[["w_one", "w_two", "w_prior"]].sum(axis=1), 1)


def test_gate_without_qualities_or_experts(views):
    some = views.withColumn("q1", F.lit(None).cast("double")).withColumn("one", F.when(F.col("id") > 5, F.col("one")))
    out = models.gate_scores(some, ["one", "two"], ["q1"], [0.0, 5.0, 0.0, -5.0]).orderBy("id").collect()
    assert all(r["score"] is None for r in out[:6]) and all(abs(r["w_one"] - 0.5) < 1e-12 and r["score"] is not None for r in out[6:])


def test_lbfgs_finds_the_bottom_of_a_valley():
    def valley(x):
        a, b = x
        return (1 - a) ** 2 + 100 * (b - a * a) ** 2, np.array([-2 * (1 - a) - 400 * a * (b - a * a), 200 * (b - a * a)])

    np.testing.assert_allclose(models.lbfgs(valley, np.array([-1.2, 1.0]), steps=300, tolerance=1e-9), [1, 1], atol=1e-6)


# -- folds ----------------------------------------------------------------------------------------------


def plain_fold_scores(x, y, w, fold):
    """Ridge logistic regression by Newton steps on all other folds: medians for missing values, indicators, standardised, balanced classes."""
    out = np.zeros(len(y))
    for f in np.unique(fold):
        train = fold != f
        gone = np.isnan(x).astype(float)
        full = np.column_stack([np.where(np.isnan(x), np.nanmedian(x[train], axis=0), x), gone])
        spread = full[train].std(axis=0)
        z = np.column_stack([(full - full[train].mean(axis=0)) / np.where(spread == 0, 1, spread), np.ones(len(y))])
        rate = y[train].mean()
        v = w * np.where(y == 1, 0.5 / rate, 0.5 / (1 - rate))
        penalty = np.diag([1.0] * full.shape[1] + [1e-9])
        b = np.zeros(z.shape[1])
        for _ in range(50):
            p = 1 / (1 + np.exp(-z[train] @ b))
            h = (z[train] * (v[train] * p * (1 - p))[:, None]).T @ z[train] + penalty
            b = b + np.linalg.solve(h, z[train].T @ (v[train] * (y[train] - p)) - penalty @ b)
        out[~train] = 1 / (1 + np.exp(-z[~train] @ b))
    return out


def test_scores_out_of_fold_equal_whole_fits(spark):
    rng = np.random.default_rng(5)
    n = 90
    x = rng.normal(size=(n, 2))
    y = (rng.random(n) < 1 / (1 + np.exp(-x[:, 0]))).astype(int)
    x[rng.random(n) < 0.2, 0] = np.nan
    w, fold = 1.0 + np.arange(n) % 4, np.arange(n) % 3
    rows = [(k, int(fold[k]), int(y[k]), None if np.isnan(x[k, 0]) else float(x[k, 0]), float(x[k, 1]), float(w[k])) for k in range(n)]
    d = spark.createDataFrame(rows, "id long, fold int, y int, a double, b double, w double").repartition(3)
    got = {r.id: r.score for r in metrics.out_of_fold_scores(d, "fold", ["id"], ["a", "b"], "y", "w", indicators=True).collect()}
    np.testing.assert_allclose([got[k] for k in range(n)], plain_fold_scores(x, y, w, fold), atol=1e-7)
