"""Choices between candidate rates, narrow-band beats and respiration quality against direct forms of their definitions."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.operators import spectral, vitals

RATE = 10.0
TIME = np.arange(0, 60, 1 / RATE)
NOISE = np.random.default_rng(5).normal(size=len(TIME))


def series(spark, **windows):
    rows = [(name, i, None if v is None else float(v)) for name, x in windows.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "w string, i int, v double").repartition(3)


def by_window(df):
    return {r["w"]: r for r in df.collect()}


# -- spectra ----------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [4, 7, 64, 65])
def test_densities_keep_the_power(n):
    x = np.random.default_rng(n).normal(size=(3, n)) * 4 + 2
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    direct = []
    for row in x:
        y = (row - row.mean()) * w
        c = [abs(sum(y[t] * np.exp(-2j * np.pi * k * t / n) for t in range(n))) ** 2 for k in range(n)]
        # what negative frequencies hold is added to the positive ones
        direct.append([c[k] + (c[n - k] if 0 < k < n - k else 0) for k in range(n // 2 + 1)])
    np.testing.assert_allclose(vitals.densities(x, RATE), np.array(direct) / (RATE * (w ** 2).sum()), rtol=1e-9, atol=1e-12)


def test_densities_of_lines_and_short_rows_are_zero():
    assert np.allclose(vitals.densities(np.arange(20.0)[None] * 3 + 1, RATE, line=True), 0)
    assert vitals.densities(np.ones((2, 3)), RATE).tolist() == [[0, 0], [0, 0]]


# -- breath -----------------------------------------------------------------------------------------


def rate_of(spark, lines, time_hz):
    rows = spark.createDataFrame([("a", float(h), float(p)) for h, p in lines], "w string, hz double, power double")
    times = spark.createDataFrame([("a", time_hz)], "w string, time_hz double")
    r = vitals.breath_rates(rows, times, ["w"]).first()
    return r["hz"], r["reason"], r["top_hz"]


SPECTRUM = [(0.10, 1), (0.15, 6), (0.20, 2), (0.30, 10), (0.40, 1), (0.45, 5), (0.50, 0)]


@pytest.mark.parametrize("time_hz, expected", [(0.47, (0.45, "time", 0.30)), (0.21, (0.15, "time", 0.30)), (0.225, (0.30, "time", 0.30)), (None, (0.15, "half", 0.30)), (0.9, (0.15, "half", 0.30))])
def test_breath_rates_follow_the_time_rate_then_the_half(spark, time_hz, expected):
    assert rate_of(spark, SPECTRUM, time_hz) == expected


def test_breath_rates_without_half_or_peaks(spark):
    weak = [(h, 3 if h == 0.15 else p) for h, p in SPECTRUM]
    assert rate_of(spark, weak, None) == (0.30, "top", 0.30)
    assert rate_of(spark, [(0.1, 5), (0.15, 4), (0.2, 3)], None) == (0.1, "top", 0.1)       # falls all the way
    assert rate_of(spark, [(0.1, 2), (0.15, 2), (0.2, 2)], None) == (0.1, "top", 0.1)       # level: the lower of equals
    assert rate_of(spark, [(0.1, 0), (0.15, 4), (0.2, 3), (0.25, 4), (0.3, 0)], 0.2) == (0.25, "time", 0.25)     # equal peaks: the faster


def test_breath_choice_finds_the_rate_on_a_drift(spark):
    slow = np.sin(2 * np.pi * 0.25 * TIME) + 0.02 * TIME + 0.1 * NOISE
    fast = 3 * np.sin(2 * np.pi * 0.4 * TIME) + 5
    found = by_window(vitals.breath_choice(series(spark, slow=slow, fast=fast, flat=np.ones(80), none=[None] * 5, two=[1, 2]), ["w"], "i", "v", RATE))
    assert set(found) == {"slow", "fast", "flat"}
    assert abs(found["slow"]["hz"] - 0.25) < 0.01 and abs(found["slow"]["time_hz"] - 0.25) < 0.01 and found["slow"]["reason"] == "time"
    assert abs(found["fast"]["hz"] - 0.4) < 0.01
    assert found["flat"]["n_peaks"] == 0 and found["flat"]["score"] < 0


def test_breath_choice_scores_both_branches(spark):
    x = np.sin(2 * np.pi * 0.2 * TIME) + 0.4 * NOISE
    parts = vitals.breath_branches(series(spark, a=x), ["w"], "i", "v", RATE).orderBy("branch", "i").collect()
    t = TIME * RATE
    line = np.polyval(np.polyfit(t, x, 1), t)
    plain, sections = x - line, spectral.band_sections(RATE, 0.1, 0.5)
    steps = np.convolve(np.diff(plain, prepend=plain[0]), np.ones(5) / 5, mode="same")
    scores = {}
    for name, raw in (("direct", plain), ("steps", steps)):
        y = np.array([r["x"] for r in parts if r["branch"] == name])
        np.testing.assert_allclose(y, spectral.filtered_both_ways(raw[None], sections)[0], atol=1e-9)
        p = vitals.densities(y[None], RATE)[0]
        f = np.arange(len(p)) * RATE / len(y)
        band = p[(f >= 0.1) & (f <= 0.5)]
        peaks = spectral.swept_peaks(series(spark, a=y), ["w"], "i", "v", RATE, 6, 30, least_peaks=3, least_intervals=2).orderBy("i").collect()
        at = [r["i"] for r in peaks]
        time_hz = RATE / np.mean(np.diff(at))
        hz = rate_of(spark, list(zip(f[(f >= 0.1) & (f <= 0.5)], band)), float(time_hz))[0]
        scores[name] = band.max() / np.median(band) - 0.8 * abs(60 * hz - 60 * time_hz) - 0.6 * np.std(np.diff(y)) / np.std(y) + 0.08 * min(len(at), 30)
    got = vitals.breath_choice(series(spark, a=x), ["w"], "i", "v", RATE).first()
    assert got["branch"] == max(sorted(scores), key=scores.get)
    assert got["score"] == pytest.approx(scores[got["branch"]], rel=1e-9)


# -- heart ------------------------------------------------------------------------------------------


def clusters_of(values, reach):
    out = []
    for v in sorted(values):
        if out and abs(v - statistics.median(out[-1])) <= reach:
            out[-1].append(v)
        else:
            out.append([v])
    return out


def test_value_clusters_equal_lists(spark):
    rng = random.Random(3)
    cases = [[rng.uniform(40, 120) for _ in range(rng.randint(1, 30))] for _ in range(40)] + [[50.0, 50.0, 56.0, 56.0, 62.0, 68.1], [70.0]]
    rows = spark.createDataFrame([(k, sorted(c)) for k, c in enumerate(cases)], "k int, v array<double>")
    got = {r["k"]: r["s"] for r in rows.select("k", vitals.value_clusters(F.col("v"), 6.0).alias("s")).collect()}
    for k, case in enumerate(cases):
        sizes = [len(c) for c in clusters_of(case, 6.0)]
        assert got[k] == [sum(sizes[:j]) for j in range(len(sizes))]


def consensus(spark, frequency, time, windows):
    rates = spark.createDataFrame([("a", frequency, time)], "w string, f double, g double")
    rows = spark.createDataFrame([("a", c, t) for c, t in windows], "w string, c double, t double")
    return vitals.rate_consensus(rates, rows, ["w"], "f", "g", "c", "t").first()


def test_consensus_takes_the_best_cluster(spark):
    windows = [(70.0, 72.0), (71.0, 73.0), (69.0, 71.0), (72.0, 70.0), (70.0, 70.0), (110.0, 140.0), (None, None)]
    r = consensus(spark, 90.0, 71.0, windows)
    assert (r["rate"], r["time_rate"], r["source"], r["time_source"], r["clusters"], r["best_count"]) == (71.0, 71.0, "cluster", "cluster", 2, 5)
    # rates that agree stand when the windows do
    assert consensus(spark, 72.0, 71.0, windows[:5])["source"] == "frequency"
    # without a rate of its own the cluster stands
    r = consensus(spark, None, 71.0, windows[:5])
    assert (r["source"], r["rate"]) == ("cluster", 71.0)


def test_consensus_falls_back_in_order(spark):
    spread = [(50.0 + 20 * k, 51.0 + 20 * k) for k in range(5)]
    r = consensus(spark, 80.0, 90.0, spread)
    assert (r["source"], r["rate"], r["time_source"]) == ("fused", 90.5, "peaks")
    r = consensus(spark, 80.0, 90.0, [(c, c + 30) for c, _ in spread])
    assert (r["source"], r["rate"]) == ("time", 120.0)
    r = consensus(spark, 80.0, 90.0, [(c, None) for c, _ in spread])
    assert (r["source"], r["rate"]) == ("corrected", 90.0)
    r = consensus(spark, 90.0, 90.0, spread)
    assert (r["source"], r["rate"], r["time_rate"], r["time_source"]) == ("fused_varied", 90.5, 91.0, "time_varied")
    r = consensus(spark, 80.0, None, [])
    assert (r["source"], r["rate"], r["time_rate"], r["clusters"], r["best_count"]) == ("frequency", 80.0, None, 0, 0)


def test_heart_choice(spark):
    course = {n: None for n in vitals.COURSE_COSTS}
    plain = {"frequency": 70.0, "time": 71.0, "peaks": 200, "confidence": None, "usable": 1.0, "passed": True, **course}
    rows = [{"w": "a", "c": "near", **plain}, {"w": "a", "c": "far", **plain, "time": 85.0}, {"w": "a", "c": "unusable", **plain, "time": 70.0, "passed": False},
            {"w": "b", "c": "y", **plain}, {"w": "b", "c": "x", **plain}, {"w": "c", "c": "only", **plain, "time": None, "passed": None}]
    kinds = "w string, c string, frequency double, time double, peaks long, confidence double, usable double, passed boolean, " + ", ".join(f"{n} double" for n in course)
    candidates = spark.createDataFrame([tuple(r.values()) for r in rows], kinds)
    windows = spark.createDataFrame([("a", "near", 70.0, 71.0, None, True, True), ("a", "near", 74.0, 71.0, None, False, True)], "w string, c string, raw double, corrected double, timed double, locked boolean, changed boolean")
    got = by_window(vitals.heart_choice(candidates, windows, ["w"], "c"))
    assert got["a"]["c"] == "near" and got["a"]["score"] == pytest.approx(40 - 1.8 - 0.5 * 8 ** 0.5 - 0.4 * 0 - 0.2 * 40 - 1.5 - 0.8 + 2)
    assert got["b"]["c"] == "x" and got["b"]["score"] == pytest.approx(40 - 1.8 - 20 - 16 - 8 + 2)
    assert got["c"]["score"] == -1_000_000


def test_heart_score_weighs_the_course(spark):
    values = {"frequency": 60.0, "time": 75.0, "raw_std": 2.0, "corrected_std": None, "time_std": 1.0, "locked": 0, "changed": 0, "peaks": 5000, "confidence": 0.5, "usable": 0.8, "passed": True}
    values |= dict(zip(vitals.COURSE_COSTS, (30.0, 10.0, 3.0, 100.0, 6.0, 50.0)))
    got = spark.range(1).select(vitals.heart_score({k: F.lit(v) for k, v in values.items()}).alias("s")).first()["s"]
    expected = 40 - 27 - 1 - 0.8 - 0.2 + 8 - 20 - 0.35 * 25 - 4.5 - 0.45 - 5 - 0.9 - 17.5 + 2.5 - 6
    assert got == pytest.approx(expected)


# -- beats and belts -------------------------------------------------------------------------------


def test_beat_chain_equals_a_walk(spark):
    rng = random.Random(8)
    cases = [([rng.choice([0.0, 1.0, 2.0, rng.random()]) for _ in range(rng.randint(0, 60))], rng.uniform(0.4, 12)) for _ in range(60)]
    rows = spark.createDataFrame([(k, v, p) for k, (v, p) in enumerate(cases)], "k int, v array<double>, p double")
    got = {r["k"]: r["b"] for r in rows.select("k", vitals.beat_chain(F.col("v"), F.col("p")).alias("b")).collect()}
    for k, (v, p) in enumerate(cases):
        at, beats = 0, []
        while (span := range(int(at + 0.75 * p), min(int(at + 1.35 * p), len(v)))):
            beats.append(max(span, key=lambda j: (v[j], -j)))
            at = beats[-1] + 1
        assert got[k] == beats


def test_narrowband_beats_follow_each_windows_own_rate(spark):
    rate, t = 20.0, np.arange(0, 30, 0.05)
    x = {"slow": np.sin(2 * np.pi * 1.0 * t) + 0.5 * np.sin(2 * np.pi * 2.1 * t), "fast": np.sin(2 * np.pi * 1.6 * t) + 2 * np.sin(2 * np.pi * 0.3 * t), "unknown": t, "outside": t}
    f = spark.createDataFrame([("slow", 1.0), ("fast", 1.6), ("unknown", None), ("outside", 0.2)], "w string, hz double")
    got = vitals.narrowband_beats(series(spark, **x), f, ["w"], "i", "v", "hz", rate).collect()
    assert {r["w"] for r in got} == {"slow", "fast"}
    for w, hz in (("slow", 1.0), ("fast", 1.6)):
        beats = sorted(r["i"] for r in got if r["w"] == w)
        inner = [b for b in beats if 100 < b < 500]
        assert np.allclose(np.diff(inner), rate / hz, atol=1.01) and len(inner) >= 18
        y = spectral.filtered_both_ways(x[w][None], spectral.band_sections(rate, hz - 0.05, hz + 0.05))[0]
        assert all(abs(r["filtered"] - y[r["i"]]) < 1e-9 for r in got if r["w"] == w)


def test_respiration_qa(spark):
    x = {"good": 2 * np.sin(2 * np.pi * 0.25 * TIME) + 7, "weak": 0.05 * np.sin(2 * np.pi * 0.25 * TIME), "short": np.sin(TIME[:99]), "loose": np.where(TIME < 6, 20 * np.sin(2 * np.pi * 0.3 * TIME), 0.2 * np.sin(2 * np.pi * 0.3 * TIME))}
    got = by_window(vitals.respiration_qa(series(spark, **x), ["w"], "i", "v", RATE))
    assert set(got) == set(x)
    good = got["good"]
    assert abs(good["rate"] - 15) < 0.2 and good["usable"] and not good["loose"] and good["note"] is None and good["n_raw"] == 15 and good["n_kept"] == 14 and good["n_rejected"] == 0
    assert got["weak"]["note"] == "too_few_peaks" and not got["weak"]["usable"] and got["weak"]["rate"] is None
    assert got["short"]["note"] == "too_short" and got["short"]["amplitude"] is None and got["short"]["n_raw"] == 0
    assert got["loose"]["loose"]
    # the same figures from the filtered series itself
    y = spectral.filtered_both_ways((x["good"] - np.median(x["good"]))[None], spectral.band_sections(RATE, 0.1, 0.7))[0]
    assert good["amplitude"] == pytest.approx(np.ptp(y))


def test_empty_tables(spark):
    none = series(spark, a=[1.0]).where("false")
    f = spark.createDataFrame([], "w string, hz double")
    assert vitals.respiration_qa(none, ["w"], "i", "v", RATE).count() == 0
    assert vitals.breath_choice(none, ["w"], "i", "v", RATE).count() == 0
    assert vitals.narrowband_beats(none, f, ["w"], "i", "v", "hz", RATE).count() == 0
