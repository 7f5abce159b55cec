"""Target cells and feature rows of complex frames against the same figures from NumPy over whole cubes."""

import numpy as np
import pytest

from spanloom.operators import phase

FIRST, LAST, MOST = 1, 6, 3


def cube(seed, n=310, bins=8, channels=2):
    rng = np.random.default_rng(seed)
    t = np.cumsum(rng.choice([90, 100, 110, 400], size=n, p=[0.3, 0.4, 0.28, 0.02]))
    t[5] = t[4]         # two frames of one time
    t[6:] += 5
    angle = rng.normal(size=(n, bins, channels)).cumsum(axis=0) * 0.05 + np.linspace(0, 9, n)[:, None, None]
    s = t[:, None, None] / 1000
    angle[:, 3:4] += 1.5 * np.sin(2 * np.pi * 0.27 * s) + 0.2 * np.sin(2 * np.pi * 1.1 * s)
    power = rng.uniform(0.5, 4, size=(1, bins, channels)) * (1 + 0.05 * rng.normal(size=(n, bins, channels)))
    return t, power * np.exp(1j * angle)


def rows_of(spark, cubes):
    rows = [(w, int(t), b, c, float(z[k, b, c].real), float(z[k, b, c].imag), k) for w, (times, z) in cubes.items() for k, t in enumerate(times) for b in range(z.shape[1]) for c in range(z.shape[2])]
    return spark.createDataFrame(rows, "w string, t long, bin int, channel int, re double, im double, k int").repartition(5)


def scores(z):
    """(score, bin, channel, ratio) of candidates, best first."""
    p = (np.abs(z) ** 2).mean(axis=0)
    middle = np.median(p[FIRST:LAST + 1]) + 1e-12
    out = []
    for c in range(z.shape[2]):
        for b in sorted(range(FIRST, LAST + 1), key=lambda b: p[b, c])[-MOST:]:
            angle = np.unwrap(np.angle(z[:, b, c]))
            i = np.arange(len(angle))
            flat = angle - np.polyval(np.polyfit(i, angle, 1), i)
            a = np.abs(z[:, b, c])
            out.append((np.log1p(flat.std()) + 0.18 * np.log1p(p[b, c] / middle) - 0.35 * min(a.std() / a.mean(), 3), b, c, p[b, c] / middle))
    return sorted(out, reverse=True)


@pytest.fixture(scope="module")
def cubes():
    out = {f"w{k}": cube(k) for k in range(4)}
    out["w4"] = tuple(x[:61] for x in cube(9))
    return {w: (np.sort(t) + np.arange(len(t)), z) for w, (t, z) in out.items()}        # one frame a time: cells are ordered by it


@pytest.fixture(scope="module")
def found(spark, cubes):
    rows = phase.phase_rows(rows_of(spark, cubes), ["w"], "t", "bin", "channel", FIRST, LAST, MOST, 100)
    return {r["w"]: r for r in rows.collect()}


def test_target_cells_equal_whole_cubes(found, cubes):
    assert set(found) == set(cubes)
    for w, (_, z) in cubes.items():
        ranked, r = scores(z), found[w]
        assert (r["bin"], r["channel"]) == ranked[0][1:3]
        assert r["margin"] == pytest.approx(ranked[0][0] - ranked[1][0], abs=1e-9) and r["snr_db"] == pytest.approx(10 * np.log10(ranked[0][3]), abs=1e-9)
        n = len(z)
        thirds = [z[k * n // 3:k * n // 3 + n // 3] for k in range(3)]
        if n // 3 >= 100:
            assert r["stability"] == pytest.approx(np.mean([abs(scores(p)[0][1] - r["bin"]) for p in thirds]))
        else:
            assert r["stability"] is None


def lines(x, fs):
    """The density from its definition: the autocovariance-free sum of squares of cosines and sines."""
    n = len(x)
    i = np.arange(n)
    y = (x - np.polyval(np.polyfit(i, x, 1), i)) * (0.5 - 0.5 * np.cos(2 * np.pi * i / n))
    k = np.arange(n // 2 + 1)[:, None]
    power = ((y * np.cos(2 * np.pi * k * i / n)).sum(axis=1) ** 2 + (y * np.sin(2 * np.pi * k * i / n)).sum(axis=1) ** 2) / fs / ((0.5 - 0.5 * np.cos(2 * np.pi * i / n)) ** 2).sum()
    return k[:, 0] * fs / n, power * np.where((k[:, 0] == 0) | (2 * k[:, 0] == n), 1, 2)


def power_in(f, p, low, high):
    inside = (f >= low) & (f <= high)
    return np.trapezoid(p[inside], f[inside])


def mad(v):
    return np.median(np.abs(v - np.median(v)))


def test_features_equal_numpy(found, cubes):
    for w, (t, z) in cubes.items():
        r = found[w]
        a = z[:, r["bin"], r["channel"]]
        n, s = len(t), (t - t[0]) / 1000
        fs = (n - 1) / s[-1]
        angle, i, grid = np.unwrap(np.angle(a)), np.arange(n), np.linspace(0, s[-1], n)
        x = np.interp(grid, s, angle - np.polyval(np.polyfit(i, angle, 1), i))
        f, p = lines(x, fs)
        micro = (f >= 0.8) & (f <= 2.5)
        slow = f[(f >= 0.08) & (f <= 0.5)][p[(f >= 0.08) & (f <= 0.5)].argmax()]
        tones = [p[np.abs(f - k * slow) <= max(1.5 * fs / n, 0.025)].max() for k in range(2, 11) if 0.8 <= k * slow <= 2.5]
        q = p[micro] / p[micro].sum()
        dx, steps = np.diff(x), np.diff(s)
        amp = np.interp(grid, s, np.abs(a))
        parts = np.array_split(x, 3)
        stds = [v.std() for v in parts if len(v) >= 20]
        powers = [power_in(*lines(v, fs), 0.8, 2.5) for v in parts if len(v) >= max(40, int(5 * fs))]
        expected = {
            "phase_std": x.std(), "velocity_mad": mad(dx) * fs, "acceleration_mad": mad(np.diff(dx)) * fs * fs, "log_power_low": np.log1p(power_in(f, p, 0.08, 0.5)), "log_power_transition": np.log1p(power_in(f, p, 0.5, 0.8)),
            "log_power_micro": np.log1p(power_in(f, p, 0.8, 2.5)), "log_power_high": np.log1p(power_in(f, p, 2.5, 5)), "micro_fraction": power_in(f, p, 0.8, 2.5) / power_in(f, p, 0.08, 5), "micro_peak": f[micro][p[micro].argmax()],
            "micro_peak_share": 1.0, "micro_entropy": -(q * np.log(q)).sum() / np.log(len(q)), "harmonics": len(tones), "harmonic_fraction": sum(tones) / power_in(f, p, 0.8, 2.5), "std_cv": np.std(stds) / np.mean(stds),
            "micro_cv": np.std(powers) / np.mean(powers) if powers else None, "trend": np.polyfit(grid, np.interp(grid, s, angle), 1)[0], "amplitude_cv": amp.std() / amp.mean(), "jump_share": np.mean(np.abs(dx) > np.pi / 2),
            "gap_share": np.mean(steps > max(2 / fs, 2.5 * np.median(steps))), "gap_seconds_share": np.maximum(steps - 1 / fs, 0).sum() / s[-1], "frame_rate": fs, "frames": n}
        assert set(expected) | {"w", "bin", "channel", "snr_db", "margin", "stability"} == set(r.asDict())
        for name, value in expected.items():
            assert r[name] == (None if value is None else pytest.approx(value, rel=1e-6, abs=1e-6)), (w, name)


def test_edges(spark):
    kinds = "w string, t long, bin int, channel int, re double, im double"
    rows = [("one", 5, 1, 0, 1.0, 0.0), ("same", 5, 1, 0, 1.0, 0.0), ("same", 5, 1, 0, 1.0, 1.0), ("two", 0, 1, 0, 1.0, 0.0), ("two", 100, 1, 0, 0.0, 1.0), ("two", 200, 1, 0, None, 1.0), ("outside", 0, 7, 0, 1.0, 0.0)]
    got = phase.phase_rows(spark.createDataFrame(rows, kinds), ["w"], "t", "bin", "channel", FIRST, LAST, MOST).collect()
    assert [(r["w"], r["frames"], r["micro_peak"], r["micro_cv"], r["margin"]) for r in got] == [("two", 2, None, None, 0.0)]
    assert phase.phase_rows(spark.createDataFrame([], kinds), ["w"], "t", "bin", "channel").count() == 0
