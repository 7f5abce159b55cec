"""Edge cases of the operators on small literals."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.functions import expressions as X
from spanloom.operators import aggregates, audits, contracts, joins, metrics, rhythm, sets, signal, windows


def test_window_is_right_open_and_the_legacy_one_closed(spark):
    probes = spark.createDataFrame([(1, "a", 1300)], "probe int, s string, onset long")
    frames = spark.createDataFrame([("a", t) for t in (900, 1000, 1100, 1200, 1300)], "s string, t long")
    got = joins.lookback_join(probes, frames, ["s"], "onset", "t", 300, 300)
    assert sorted(r.t for r in got.collect()) == [1000, 1100, 1200]
    closed = joins.lookback_join(probes, frames, ["s"], "onset", "t", 400, 400, closed=True)
    assert closed.count() == 5


def test_probe_without_events_stays(spark):
    probes = spark.createDataFrame([(1, "a", 10), (1, "a", 10), (2, "b", 10)], "probe int, s string, onset long")
    frames = spark.createDataFrame([("a", 9)], "s string, t long")
    got = joins.lookback_join(probes, frames, ["s"], "onset", "t", 5, 5).collect()
    assert sorted((r.probe, r.t) for r in got if r.t is not None) == [(1, 9), (1, 9)]
    assert [r.probe for r in got if r.t is None] == [2]


def test_nearest_tie_goes_to_the_earlier(spark):
    left = spark.createDataFrame([("a", 10), ("a", 100), ("b", 5)], "k string, t long")
    right = spark.createDataFrame([("a", 5, 1.0), ("a", 15, 2.0)], "k string, u long, v double")
    got = {(r.k, r.t): (r.nearest_time, r.distance) for r in joins.nearest(left, right, ["k"], "t", "u", "v").collect()}
    assert got == {("a", 10): (5, 5), ("a", 100): (15, 85), ("b", 5): (None, None)}
    near = joins.nearest(left, right, ["k"], "t", "u", "v", tolerance=20).where("t = 100").first()
    assert near.nearest_value is None and near.distance == 85


def test_validated_join_fails_on_repeats(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y")], "k int, a string")
    b = spark.createDataFrame([(1, "z")], "k int, b string")
    assert contracts.validated_join(a, b, ["k"], validate="many_to_one").count() == 2
    with pytest.raises(Exception, match="repeated key"):
        contracts.validated_join(a, b, ["k"]).collect()


def test_same_keys_join_fails_on_a_missing_key(spark):
    a = spark.createDataFrame([(1, 1), (2, 2)], "k int, a int")
    b = spark.createDataFrame([(1, 3)], "k int, b int")
    with pytest.raises(Exception, match="lacks key"):
        joins.same_keys_join(a, [b], ["k"]).collect()


def test_monotonic(spark):
    d = spark.createDataFrame([(1, 5), (2, 4)], "i int, t int")
    with pytest.raises(Exception, match="monotonic"):
        contracts.monotonic(d, ["i"], "t").collect()


def test_gated_anchor(spark):
    d = spark.createDataFrame([("s", 1, None, 0.9), ("s", 2, 60.0, 0.0), ("s", 3, 70.0, 0.1), ("s", 4, 70.0, 0.12), ("t", 1, 50.0, 0.0)],
                              "b string, o int, v double, c double")
    got = {(r.b, r.o): r.anchor for r in windows.gated_anchor(d, ["b"], "o", "v", "c").collect()}
    assert got[("s", 1)] is None and got[("s", 2)] == 60 and got[("s", 3)] == 60
    assert got[("s", 4)] == pytest.approx(62) and got[("t", 1)] == 50


def test_beat_match_identity():
    import numpy as np

    x = np.arange(4.0)
    assert joins.pairs_in_order(x, x, 0.1) == [(i, i) for i in range(4)]


def test_table_difference(spark):
    a = spark.createDataFrame([("x", 1, 0.5), ("y", 2, 0.25)], "f string, n int, auc double")
    same = spark.createDataFrame([("y", 2, 0.25 + 1e-10), ("x", 1, 0.5)], "f string, n int, auc double")
    other = spark.createDataFrame([("x", 1, 0.5), ("y", 3, 0.25)], "f string, n int, auc double")
    assert sets.table_difference(a, same, ["f", "n"], ["auc"]).count() == 0
    assert sets.table_difference(a, other, ["f", "n"], ["auc"]).count() == 2


def test_package_union_refuses_other_signatures(spark):
    a = spark.createDataFrame([("x", 1)], "subject string, value int")
    assert sets.package_union({"m1": ({"seed": 1}, a), "m2": ({"seed": 1}, a)}).count() == 2
    with pytest.raises(ValueError, match="seed"):
        sets.package_union({"m1": ({"seed": 1}, a), "m2": ({"seed": 2}, a)})
    with pytest.raises(ValueError, match="columns"):
        sets.package_union({"m1": ({}, a), "m2": ({}, a.select("value", "subject"))})


def test_strict_and_lenient_parsing(spark):
    d = spark.createDataFrame([("1",), ("2.5",), (None,)], "x string")
    assert [r[0] for r in d.select(X.number("x")).collect()] == [1.0, 2.5, None]
    with pytest.raises(Exception, match="isn't a valid bigint"):
        d.select(X.strict_number("x", "bigint")).collect()
    flags = spark.createDataFrame([("TRUE",), ("no",), (None,)], "x string")
    assert [r[0] for r in flags.select(X.strict_flag("x")).collect()] == [True, False, None]
    assert [r[0] for r in flags.select(X.lenient_flag("x")).collect()] == [True, False, False]
    names = spark.createDataFrame([("block-1",), ("B1",), ("b1",), ("x",)], "x string")
    assert [r[0] for r in names.select(X.block_name("x")).collect()] == ["b1", "b1", "b1", None]


def test_unknown_correctness_counts_differently(spark):
    d = spark.createDataFrame([(None,), (0,), (1,)], "c int")
    assert [tuple(r) for r in d.select(X.error_strict("c"), X.error_lenient("c")).collect()] == [(0, 1), (1, 1), (0, 0)]


def test_closed_last_band(spark):
    d = spark.createDataFrame([(0.3,), (0.6,), (1.0,), (1.1,)], "d double")
    bands = [(0.3, 0.6, "near"), (0.6, 1.0, "far")]
    assert [r[0] for r in d.select(X.band(F.col("d"), bands, True)).collect()] == ["near", "far", "far", None]


def test_auc_against_pairs(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), rng.randrange(2), rng.randrange(6) / 5) for _ in range(80)]
    got = {r.g: r.auc for r in metrics.roc_auc(spark.createDataFrame(rows, "g string, y int, p double"), ["g"], "y", "p").collect()}
    for g in "ab":
        pos, neg = ([p for h, y, p in rows if h == g and y == k] for k in (1, 0))
        want = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))
        assert got[g] == pytest.approx(want)


def test_paired_bootstrap_of_one_score_is_zero(spark):
    rows = [(i % 5, i % 2, (i * 7 % 11) / 11) for i in range(60)]
    d = spark.createDataFrame(rows, "c int, y int, p double").withColumn("q", F.col("p"))
    got = metrics.paired_bootstrap_auc(d, "c", "y", "p", "q", 20).first()
    assert (got.delta, got.low, got.high) == (0, 0, 0)


def test_bootstraps_against_drawn_rows(spark):
    rng = random.Random(3)
    rows = [(rng.choice("abcd"), rng.randrange(2), rng.randrange(5), rng.choice([None, 1, 2, 3]), rng.randrange(4)) for _ in range(70)]
    d = spark.createDataFrame(rows, "c string, y int, p int, x int, q int")
    draws = {(r[0], r.rep): r.weight for r in metrics.bootstrap_weights(d, "c", 15, 5).collect()}

    def drawn(rep):
        return [r for r in rows for _ in range(1 if rep < 0 else draws.get((r[0], rep), 0))]

    def auc(sample, at):
        pos, neg = ([r[at] for r in sample if r[1] == k] for k in (1, 0))
        return sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))

    def rho(sample):
        x, q = zip(*[(r[3], r[4]) for r in sample if r[3] is not None])
        ranks = [[sum(b < a for b in v) + (sum(b == a for b in v) + 1) / 2 for a in v] for v in (x, q)]
        return np.corrcoef(*ranks)[0, 1]

    got = metrics.paired_bootstrap_auc(d, "c", "y", "p", "q", 15, 5).first()
    deltas = [auc(drawn(i), 4) - auc(drawn(i), 2) for i in range(-1, 15)]
    assert tuple(got) == pytest.approx((deltas[0], *np.percentile(deltas[1:], [2.5, 97.5])))
    got = metrics.bootstrap_spearman(d, "c", "x", "q", 15, 5).first()
    rhos = [rho(drawn(i)) for i in range(-1, 15)]
    assert tuple(got) == pytest.approx((rhos[0], *np.percentile(rhos[1:], [2.5, 97.5])))


def test_folds_are_disjoint(spark):
    d = spark.createDataFrame([(i % 13, i % 2) for i in range(100)], "g int, y int")
    rows = d.join(metrics.group_folds(d, "g", "y"), "g")
    assert metrics.fold_leaks(rows, "g", "fold").count() == 0 and rows.select("fold").distinct().count() == 5


def test_moving_mean_keeps_its_divisor(spark):
    d = spark.createDataFrame([(i, 5.0) for i in range(3)], "i int, x double")
    assert [r[0] for r in d.select(windows.moving_mean([], ["i"], "x")).collect()] == [3.0, 3.0, 3.0]


def test_empty_window_features(spark):
    d = spark.createDataFrame([(1, None, None, None, None)], "p int, at double, rt double, e int, o int")
    r = aggregates.behaviour_features(d, ["p"], "at", "rt", "e", "o").first()
    assert r.trial_count == 0 and r.error_count is None and r.rt_mean is None


def test_displacement_has_no_jumps(spark):
    import math

    rows = [("a", i, (0.9 * i) % (2 * math.pi)) for i in range(40)]
    got = signal.displacement(spark.createDataFrame(rows, "k string, i int, phi double"), ["k"], ["i"], "phi", 4 * math.pi).orderBy("i").collect()
    assert all(abs(r.displacement - 0.9 * r.i) < 1e-9 for r in got)


def test_alignment_and_beat_path_equal_every_choice():
    import itertools

    import numpy as np

    rng = random.Random(5)
    for _ in range(30):
        a, b = (np.array([rng.randrange(10, 30) for _ in range(rng.randrange(1, 5))], float) for _ in range(2))

        def cost(pairs):
            if any(abs(a[i] - b[j]) > 6 for i, j in pairs):
                return 1e9
            return sum(abs(a[i] - b[j]) for i, j in pairs) + 4 * (len(a) + len(b) - 2 * len(pairs))

        every = [list(zip(x, y)) for k in range(min(len(a), len(b)) + 1) for x in itertools.combinations(range(len(a)), k) for y in itertools.combinations(range(len(b)), k)]
        best = min(every, key=cost)
        pairs, total, cheapest = rhythm.interval_costs(a, b, 6, 4)
        assert abs(cheapest - cost(best)) < 1e-9 and abs(total + 4 * (len(a) + len(b) - 2 * pairs) - cheapest) < 1e-9
    s = np.zeros(400)
    s[[60, 110, 161, 212]] = 1
    other = np.zeros(400)
    other[[50, 101]] = 1
    paths = rhythm.best_paths(np.stack([s, other]), np.array([50.0, 50.0]), np.array([4.0, 4.0]), 30, 200)
    assert [[t for t in p if v[t]] for p, v in zip(paths, (s, other))] == [[60, 110, 161, 212], [50, 101]]


def test_best_path_equals_every_path():
    import itertools

    import numpy as np

    rng = np.random.default_rng(2)
    for n in (4, 9, 12):
        s = rng.normal(size=n)
        s[n // 2] = np.nan
        mean, spread, low, high = 3.0, 2.0, 2, 5

        def worth(path):
            return sum(s[t] for t in path) - sum(0.25 * ((b - a - mean) / spread) ** 2 for a, b in zip(path, path[1:]))

        able = [t for t in range(low, n) if np.isfinite(s[t])]
        # a beat that can follow another one does, so a path begins where none comes before
        paths = [p for k in range(1, n) for p in itertools.combinations(able, k)
                 if all(low <= b - a <= high for a, b in zip(p, p[1:])) and not any(low <= p[0] - t <= high for t in able)]
        found = rhythm.best_paths(s[None], np.array([mean]), np.array([1.0]), low, high)[0]
        assert abs(worth(found) - max(map(worth, paths))) < 1e-9


def test_pairs_of_two_series_equal_plain_walks():
    import numpy as np

    rng = random.Random(11)
    for _ in range(200):
        x, y = (np.sort(np.array([rng.randrange(0, 30) for _ in range(rng.randrange(0, 9))], float)) for _ in range(2))
        tolerance = rng.randrange(0, 5)
        taken, plain = set(), []
        for i, a in enumerate(x):
            j = next((j for j, b in enumerate(y) if abs(a - b) <= tolerance and j not in taken and all(j > k for k in taken)), None)
            if j is not None:
                taken.add(j)
                plain.append((i, j))
        assert joins.pairs_in_order(x, y, tolerance) == plain
        u, v, near = np.unique(x), np.unique(y), []
        for _, i, j in sorted((abs(a - b), i, j) for i, a in enumerate(u) for j, b in enumerate(v) if abs(a - b) <= tolerance):
            if i not in {p for p, _ in near} and j not in {q for _, q in near}:
                near.append((i, j))
        assert [(x[i], y[j]) for i, j in joins.nearest_pairs(x, y, tolerance)] == sorted((u[i], v[j]) for i, j in near)


def test_p_values_equal_closed_forms(spark):
    d = spark.createDataFrame([(t,) for t in (0.0, 0.5, 2.0, -6.0)], "t double")
    for freedom, plain in ((1.0, lambda t: 1 - 2 / math.pi * math.atan(abs(t))), (2.0, lambda t: 1 - abs(t) / math.sqrt(2 + t * t)),
                           (4.0, lambda t: 1 - abs(t) * (6 + t * t) / (4 + t * t) ** 1.5)):
        for r in d.select("t", audits.student_p(F.col("t"), F.lit(freedom)).alias("p")).collect():
            assert abs(r.p - plain(r.t)) < 1e-9
    near = d.select("t", audits.student_p(F.col("t"), F.lit(4999.0)).alias("p"), audits.student_p(F.col("t"), F.lit(5001.0)).alias("q")).collect()
    assert all(abs(r.p - r.q) < 1e-4 for r in near)
    x = 3.7
    found = spark.range(1).select(*[audits.chi2_p(F.lit(x), k).alias(f"k{k}") for k in (1, 2, 3, 4)]).first()
    tail = math.erfc(math.sqrt(x / 2))
    plain = (tail, math.exp(-x / 2), tail + math.sqrt(2 * x / math.pi) * math.exp(-x / 2), math.exp(-x / 2) * (1 + x / 2))
    assert all(abs(a - b) < 1e-6 for a, b in zip(found, plain))


def test_shape_and_temporal_contracts(spark):
    with pytest.raises(Exception, match="n is not 3"):
        contracts.expected(spark.createDataFrame([(2,)], "n long"), {"n": 3}).collect()


def test_registered_functions(spark):
    from spanloom.functions.registered import register

    register(spark)
    register(spark)
    r = spark.sql("SELECT valid_rt(0, 1, 200D) AS a, decision_of(0.7D) AS b, clamped_sigmoid(1000D) AS c, block_windows(0L, 100L, 10L, 30L, 20L) AS d").first()
    assert (r.a, r.b, r.c, list(r.d)) == (200.0, "positive", 1.0, [10, 30, 50])


def test_newton_sums_equal_one_fit(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 2))
    x[rng.random((120, 2)) < 0.1] = np.nan
    y = (np.nan_to_num(x[:, 0]) + rng.normal(size=120) > 0).astype(int)
    rows = [(i, int(i % 4), int(y[i]), *[None if np.isnan(v) else float(v) for v in x[i]]) for i in range(120)]
    got = {r.i: r.score for r in metrics.out_of_fold_scores(spark.createDataFrame(rows, "i int, fold int, y int, a double, b double"), "fold", ["i"], ["a", "b"], "y").collect()}
    for f in range(4):
        train = np.arange(120) % 4 != f
        z = np.where(np.isnan(x), np.nanmedian(x[train], axis=0), x)
        z = (z - z[train].mean(axis=0)) / z[train].std(axis=0)
        z = np.hstack([z, np.ones((120, 1))])
        w = np.where(y == 1, 0.5 / y[train].mean(), 0.5 / (1 - y[train].mean()))
        b, penalty = np.zeros(3), np.diag([1, 1, 1e-9])
        for _ in range(40):
            p = 1 / (1 + np.exp(-z[train] @ b))
            b = b + np.linalg.solve((z[train].T * (w[train] * p * (1 - p))) @ z[train] + penalty, z[train].T @ (w[train] * (y[train] - p)) - penalty @ b)
        assert all(abs(got[i] - 1 / (1 + np.exp(-z[i] @ b))) < 1e-7 for i in range(120) if i % 4 == f)


def test_any_step_from_zero_is_a_jump(spark):
    d = spark.createDataFrame([("a", i, v) for i, v in enumerate((0.0, 0.0, 5.0, 5.5, 0.0, None, 3.0))], "k string, i int, v double")
    here, ahead = windows.jump_mask(["k"], ["i"], "v")
    got = d.select("i", here.alias("here"), ahead.alias("ahead")).orderBy("i").collect()
    assert [r.here for r in got] == [False, False, True, False, True, False, False]
    assert [r.ahead for r in got] == [False, True, False, True, False, False, False]


def test_repaired_rate_of_a_long_series_is_the_plain_one_and_soon_done(spark):
    draw = random.Random(5)
    steps = [draw.uniform(0.7, 0.9) if i % 9 else 1.6 for i in range(400)]
    times = np.cumsum([0.0, *steps]).tolist()
    d = spark.createDataFrame([("long", t) for t in times] + [("short", 0.8 * i) for i in range(3)], "k string, t double")
    began = time.monotonic()
    got = signal.repaired_rate(d, ["k"], "t", F.lit(75.0), 30, 180).collect()
    assert time.monotonic() - began < 60
    x = np.diff(times)
    x = x[(x >= 60 / 180) & (x <= 60 / 30)]
    k = np.maximum(np.rint(x / 0.8), 1)
    x = np.where((k >= 2) & (k <= 3) & (abs(x / k - 0.8) <= 0.22 * 0.8), x / k, x)
    m = np.median(x)
    x = x[abs(x - m) <= max(0.1, 3.5 * 1.4826 * np.median(abs(x - m)), 0.2 * m)]
    mid = np.median(x)
    assert [r.k for r in got] == ["long"] and got[0].n == len(x)
    assert got[0].bpm == pytest.approx(60 / mid) and got[0].quality == pytest.approx(math.exp(-5 * 1.4826 * np.median(abs(x - mid)) / mid))


def test_gate_at_its_exact_deviation_follows_the_sum_in_order(spark):
    values = [None, 13.98, 53.98, 10.0, 50.0]
    d = spark.createDataFrame(list(enumerate(values)), "i int, v double").withColumn("k", F.lit(1))
    got = [r.g for r in d.select("i", signal.gated_std(["k"], "i", "v", 1, 20).alias("g")).orderBy("i").collect()]
    # the deviation of 13.98 and 53.98 is 20 but for the last bit, as DuckDB sums it too
    assert got == [None, None, None, 10.0, 50.0]


def test_bootstrap_makes_draws_without_a_join(spark):
    d = spark.createDataFrame([(f"c{i % 7}" if i % 8 else None, float(i)) for i in range(60)], "c string, x double")
    rows = d.groupBy("c").agg(F.sum("x").alias("s"))
    drawn = metrics.drawn_rows(rows, "c", 15, 5)
    joined = rows.join(metrics.bootstrap_weights(rows, "c", 15, 5), "c")
    assert sorted(map(tuple, drawn.select("c", "s", "rep", "weight").collect())) == sorted(map(tuple, joined.select("c", "s", "rep", "weight").collect()))
    plan = metrics.bootstrap_interval(d, "c", "x", 15)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "HashJoin" not in plan


def test_adjusted_p_values_use_running_frames(spark):
    p = [0.04, 0.001, None, 0.03, 0.04, 0.9]
    d = spark.createDataFrame(list(enumerate(p)), "i int, p double").withColumn("k", F.lit(1))
    out = windows.benjamini_hochberg(d, ["k"], "p", "i")
    assert "unboundedfollowing" not in out._jdf.queryExecution().executedPlan().toString().lower().replace("unboundedpreceding$(), unboundedfollowing$()", "")
    got = {r.i: r.q for r in out.collect()}
    assert [got[i] and round(got[i], 6) for i in range(6)] == [0.06, 0.006, 1.0, 0.06, 0.06, 1.0]


def test_percentiles_of_large_groups_are_exact_and_gathered_by_no_task(spark):
    rng = np.random.default_rng(3)
    values = {"a": rng.normal(size=2001), "b": rng.exponential(size=500) ** 9, None: np.repeat([2.0, 3.0], [7, 4]), "d": np.array([5.0]), "e": np.array([-1.0, float("inf"), 4.0]), "f": np.array([])}
    rows = [(k, float(v)) for k, vs in values.items() for v in vs] + [("a", None), ("f", None)]
    d = spark.createDataFrame(rows, "k string, v double")
    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {r.k: r.percentiles for r in aggregates.percentiles(d, ["k"], "v", shares).collect()}
    want = {r.k: r.q for r in d.where("v is not null").groupBy("k").agg(F.percentile("v", F.array(*map(F.lit, shares))).alias("q")).collect()}
    assert got == want
    e = d.where("k = 'a'").withColumn("ref", F.lit(0.0))
    for made in (aggregates.error_metrics(e, ["k"], "v", "ref"), aggregates.paired_delta(e, ["k"], "v", "ref", "ref"), aggregates.describe(e, ["k"], "v", "ref"), windows.inside_fences(e, ["k"], "v")):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "percentile(" not in plan and "median(" not in plan


def test_choices_are_walked_over_batches_after_one_shuffle(spark):
    rng = random.Random(7)
    rows = {(k, t, rng.randrange(3), rng.randrange(20)): rng.choice([None, 0.0, 1.0, 2.5, 7.0]) for k in ("a", "b", None) for t in range(30) for _ in range(rng.choice([1, 1, 2, 6]))}
    want = []
    for k in ("a", "b", None):
        last = None
        for t in range(30):
            cells = sorted((c, b, s) for (kk, tt, c, b), s in rows.items() if (kk, tt) == (k, t))
            top = max(cells, key=lambda x: (-1.0 if x[2] is None else x[2], -x[0], -x[1]))
            near = [x for x in cells if last and abs(x[1] - last[1]) <= 4]
            pick = max(near, key=lambda x: (math.log1p(x[2] or 0.0) - 0.2 * abs(x[1] - last[1]) - 0.5 * (x[0] != last[0]), -x[0], -x[1])) if near else top
            want.append((k, t, pick[0], pick[1], "near" if near else "fallback" if last else "start"))
            last = pick
    cells = spark.createDataFrame([(*k, s) for k, s in rows.items()], "k string, t int, channel int, bin int, score double")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
        made = signal.local_choices(cells, ["k"], "t", "score", 4)
        assert made._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
        got = [tuple(r) for r in made.collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert sorted(got, key=str) == sorted(want, key=str)
