"""Target cells of complex frames and one row of phase, spectrum and gap features for each window."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators import spectral
from spanloom.operators.signal import unwrapped
from spanloom.operators.vitals import densities

TINY = 1e-12


def cell_phases(frames: DataFrame, by: Sequence[str], time: str, bin_index: str, channel: str) -> DataFrame:
    """(by, channel, bin, time, __i, phase, amplitude, __n): the unwrapped phase of each cell's complex samples (re, im) in order of time."""
    keys = [*by, channel, bin_index]
    rows = frames.select(*keys, time, F.atan2("im", "re").alias("__a"), F.hypot("re", "im").alias("amplitude"))
    w = Window.partitionBy(*keys).orderBy(time)
    first, step = unwrapped(keys, [time], "__a")
    rows = rows.select(*keys, time, "amplitude", first.alias("__f"), step.alias("__s"), (F.row_number().over(w) - 1).alias("__i"), F.count("*").over(Window.partitionBy(*keys)).alias("__n"))
    return rows.select(*keys, time, "amplitude", "__i", "__n", (F.col("__f") + F.sum("__s").over(w.rowsBetween(Window.unboundedPreceding, 0))).alias("phase"))


def scored_cells(phases: DataFrame, by: Sequence[str], bin_index: str, channel: str, first_bin: int, last_bin: int, most: int) -> DataFrame:
    """(by, channel, bin, score, ratio): the `most` strongest cells of each channel between two bins, by phase modulation, power and steadiness.

    `ratio` is a cell's power over the median of all cells of its window inside the bins. Modulation is the deviation of the phase from its own line, so
    a cell is a few sums. Of equal powers the greater bin stays.
    """
    s, n = "__i", F.count("*")
    residual = F.regr_syy("phase", s) - F.coalesce(F.regr_sxy("phase", s) * F.regr_sxy("phase", s) / F.nullif(F.regr_sxx("phase", s), F.lit(0.0)), F.lit(0.0))
    cells = phases.where(F.col(bin_index).between(first_bin, last_bin)).groupBy(*by, channel, bin_index).agg(
        F.avg(F.col("amplitude") * F.col("amplitude")).alias("__p"), F.sqrt(F.greatest(residual, F.lit(0.0)) / n).alias("__d"), (F.stddev_pop("amplitude") / (F.avg("amplitude") + TINY)).alias("__c"))
    ranked = cells.withColumn("__m", F.median("__p").over(Window.partitionBy(*by)) + TINY).withColumn("__r", F.row_number().over(Window.partitionBy(*by, channel).orderBy(F.desc("__p"), F.desc(bin_index))))
    ratio = F.col("__p") / F.col("__m")
    score = F.log1p("__d") + 0.18 * F.log1p(ratio) - 0.35 * F.least(F.col("__c"), F.lit(3.0))
    return ranked.where(F.col("__r") <= most).select(*by, channel, bin_index, score.alias("score"), ratio.alias("ratio"))


def best_cells(scored: DataFrame, by: Sequence[str], bin_index: str, channel: str) -> DataFrame:
    """(by, channel, bin, score, ratio, margin): the best cell of each window, and how far the next one's score lies below; of equals the greater bin, then channel."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"), F.desc(bin_index), F.desc(channel))
    rows = scored.withColumns({"__r": F.row_number().over(w), "margin": F.col("score") - F.coalesce(F.lead("score").over(w), F.col("score"))})
    return rows.where("__r = 1").drop("__r")


def target_cells(frames: DataFrame, by: Sequence[str], time: str, bin_index: str, channel: str, first_bin: int = 8, last_bin: int = 180, most: int = 12, thirds: int = 100) -> DataFrame:
    """(by, channel, bin, score, ratio, margin, stability): the target cell of each window of complex frames (re, im).

    `stability` is the mean distance in bins of the best cells of the window's thirds of `thirds` frames or more from the chosen one, null without such.
    Every cell is one key of the shuffle, so a window of many frames and bins is spread; the sums over the whole and its thirds reuse that shuffle.
    """
    phases = cell_phases(frames.where(F.col(bin_index).between(first_bin, last_bin)), by, time, bin_index, channel)
    # a third begins at its share of the frames and has the same length everywhere; a whole turn's difference at its first frame is no deviation
    n, i = F.col("__n"), F.col("__i")
    third = F.floor(n / 3)
    inside = [F.when((third >= thirds) & (i >= F.floor(k * n / 3)) & (i < F.floor(k * n / 3) + third), F.lit(k)) for k in range(3)]
    parts = phases.withColumn("__t", F.explode(F.array_compact(F.array(F.lit(-1), *inside))))
    best = best_cells(scored_cells(parts, [*by, "__t"], bin_index, channel, first_bin, last_bin, most), [*by, "__t"], bin_index, channel)
    whole = F.max(F.when(F.col("__t") < 0, F.struct(channel, bin_index, "score", "ratio", "margin"))).alias("__w")
    rows = best.groupBy(*by).agg(whole, F.collect_list(F.when(F.col("__t") >= 0, F.col(bin_index))).alias("__b"))
    away = F.aggregate("__b", F.lit(0.0), lambda s, b: s + F.abs(b - F.col(f"__w.{bin_index}"))) / F.nullif(F.size("__b"), F.lit(0))
    return rows.select(*by, "__w.*", away.alias("stability"))


def area(hz: str, power: str, low: float, high: float) -> Column:
    """Trapezoid sum of a density (arrays in step) between the first and last line inside a band; null for fewer than two lines."""
    inside = F.filter(F.arrays_zip(hz, power), lambda c: c[hz].between(low, high))
    pairs = F.zip_with(F.slice(inside, 1, F.size(inside) - 1), F.slice(inside, 2, F.size(inside) - 1), lambda a, b: (a[power] + b[power]) / 2 * (b[hz] - a[hz]))
    return F.when(F.size(inside) >= 2, F.aggregate(pairs, F.lit(0.0), lambda s, v: s + v))


def _mad(v: np.ndarray) -> float | None:
    return float(np.median(np.abs(v - np.median(v)))) if len(v) else None


def _variation(v: np.ndarray) -> float | None:
    return float(v.std() / (v.mean() + TINY)) if len(v) else None


#: What `described` says of a window besides its even series.
SHAPES = ["phase_std", "velocity_mad", "acceleration_mad", "std_cv", "trend", "amplitude_cv", "jump_share", "gap_share", "gap_seconds_share"]


def described(t: np.ndarray, phase: np.ndarray, amplitude: np.ndarray) -> list:
    """The phase less its line on an even grid of as many points over time (ms), and the SHAPES of one window of two different times at least.

    Of equal times the first counts. Thirds of 20 samples or more, the first ones longer, give deviations. A gap is longer than two mean and two and a half median steps.
    """
    n, seconds = len(t), (t - t[0]) / 1000
    i = np.arange(n) - (n - 1) / 2
    flat = phase - phase.mean() - (i @ (phase - phase.mean())) / (i @ i) * i
    keep = np.concatenate([[True], np.diff(seconds) > 0])
    x, line, amp = (np.interp(np.linspace(0, seconds[-1], n), seconds[keep], v[keep]) for v in (flat, phase, amplitude))
    fs, steps, dx = (n - 1) / seconds[-1], np.diff(seconds), np.diff(x)
    mad, bend = _mad(dx), _mad(np.diff(dx))
    thirds = np.array([p.std() for p in np.array_split(x, 3) if len(p) >= 20])
    return [x, x.std(), mad * fs, None if bend is None else bend * fs * fs, _variation(thirds), i @ line / (i @ i) * fs if n > 2 else None, _variation(amp), np.mean(np.abs(dx) > np.pi / 2),
            np.mean(steps > max(2 / fs, 2.5 * np.median(steps))), np.maximum(steps - 1 / fs, 0).sum() / seconds[-1]]


def even_series(cells: DataFrame, by: Sequence[str], time: str) -> DataFrame:
    """(by, n, fs, x, SHAPES): the samples (time in ms, phase, amplitude) of each window as `described`; windows without two different times have no row."""
    ordered = F.sort_array(F.collect_list(F.struct(F.col(time).cast("double").alias("t"), F.col("phase").cast("double").alias("p"), F.col("amplitude").cast("double").alias("a"))))
    rows = cells.where("phase is not null").groupBy(*by).agg(ordered.alias("__s"), F.count("*").cast("int").alias("n"), ((F.max(time) - F.min(time)) / 1000).alias("__d")).where("__d > 0")

    @F.pandas_udf(f"x array<double>, {', '.join(f'{c} double' for c in SHAPES)}")
    def shapes(times: pd.Series, phases: pd.Series, sizes: pd.Series) -> pd.DataFrame:
        found = [described(*(np.asarray(v, float) for v in row)) for row in zip(times, phases, sizes)]
        return pd.DataFrame(found, columns=["x", *SHAPES])

    rows = rows.select(*by, "n", ((F.col("n") - 1) / F.col("__d")).alias("fs"), shapes(*[F.col(f"__s.{k}") for k in "tpa"]).alias("__r"))
    return rows.select(*by, "n", "fs", "__r.*")


def phase_features(cells: DataFrame, by: Sequence[str], time: str) -> DataFrame:
    """(by, 22 features) of the chosen cell's samples (time in ms, phase, amplitude) of each window of some tens of seconds.

    A window is one row: its even series, the series' shapes and the densities of the whole and of its thirds come from NumPy kernels over batches, the features
    of spectra are sums over density arrays in the JVM. Bands are 0.08, 0.5, 0.8, 2.5 and 5 Hz; a band with fewer than two lines has no power. Harmonics are
    multiples 2 to 10 of the slow peak between 0.8 and 2.5 Hz, each the greatest line within 1.5 lines or 0.025 Hz. Thirds count for powers from 40 samples and
    5 seconds on.
    """
    @F.pandas_udf("array<array<double>>")
    def spectra(series: pd.Series) -> pd.Series:
        """Densities of the whole and of its thirds, the first ones longer, at a rate of one."""
        whole = [np.asarray(v, float) for v in series]
        parts = pd.Series([p for x in whole for p in (x, *np.array_split(x, 3))], dtype=object)
        found = spectral.by_length(parts, lambda x: densities(x, 1.0, line=True))
        return pd.Series([[found[4 * k + j].tolist() for j in range(4)] for k in range(len(whole))], dtype=object)

    rows = even_series(cells, by, time).withColumn("__d", spectra("x"))
    # densities scale with the rate, frequencies too
    scaled = lambda k: F.transform(F.get("__d", F.lit(k)), lambda p: p / F.col("fs"))
    n, q = F.col("n"), F.floor(F.col("n") / 3).cast("int")
    sizes = [q + (n % 3 > k).cast("int") for k in range(3)]
    hertz = lambda power, size: F.transform(power, lambda _, i: i * F.col("fs") / size)
    rows = rows.withColumns({"power": scaled(0), **{f"__p{k}": scaled(k + 1) for k in range(3)}})
    rows = rows.withColumns({"hz": hertz("power", n), **{f"__f{k}": hertz(f"__p{k}", sizes[k]) for k in range(3)}})
    bands = {"low": (0.08, 0.5), "transition": (0.5, 0.8), "micro": (0.8, 2.5), "high": (2.5, 5.0), "total": (0.08, 5.0)}
    rows = rows.withColumns({f"__{b}": area("hz", "power", *edges) for b, edges in bands.items()})
    peak = lambda low, high: F.array_max(F.transform(F.filter(F.arrays_zip("power", "hz"), lambda c: c["hz"].between(low, high)), lambda c: F.struct(c["power"].alias("p"), (-c["hz"]).alias("f"))))
    rows = rows.withColumns({"__slow": -peak(0.08, 0.5)["f"], "__fast": peak(0.8, 2.5), "__line": F.filter(F.arrays_zip("hz", "power"), lambda c: c["hz"].between(0.8, 2.5) & (c["power"] > 0))})
    reach = F.greatest(1.5 * F.col("fs") / n, F.lit(0.025))
    tones = F.filter(F.transform(F.sequence(F.lit(2), F.lit(10)), lambda k: k * F.col("__slow")), lambda h: h.between(0.8, 2.5) & (F.col("__slow") > 0))
    tones = F.transform(tones, lambda h: F.array_max(F.transform(F.filter(F.arrays_zip("hz", "power"), lambda c: F.abs(c["hz"] - h) <= reach), lambda c: c["power"])))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    rows = rows.withColumn("__tones", F.filter(tones, lambda p: p.isNotNull()))
    # of shares p / S the entropy is ln S less the mean of ln p
    weighed = F.aggregate("__line", F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("l")), lambda a, c: F.struct((a["s"] + c["power"]).alias("s"), (a["l"] + c["power"] * F.ln(c["power"])).alias("l")))
    rows = rows.withColumn("__e", weighed)
    entropy = F.when(F.size("__line") >= 2, (F.ln("__e.s") - F.col("__e.l") / F.col("__e.s")) / F.ln(F.size("__line")))
    enough = lambda size: size >= F.greatest(F.lit(40), F.floor(5 * F.col("fs")))
    micros = [F.when(enough(sizes[k]), area(f"__f{k}", f"__p{k}", 0.8, 2.5)) for k in range(3)]
    rows = rows.withColumns({f"__m{k}": m for k, m in enumerate(micros)})
    known = sum((F.when(F.col(f"__m{k}").isNotNull(), 1).otherwise(0) for k in range(3)), F.lit(0))
    rows = rows.withColumn("__mean", sum((F.coalesce(f"__m{k}", F.lit(0.0)) for k in range(3)), F.lit(0.0)) / F.nullif(known, F.lit(0)))
    varied = F.sqrt(sum((F.coalesce((F.col(f"__m{k}") - F.col("__mean")) * (F.col(f"__m{k}") - F.col("__mean")), F.lit(0.0)) for k in range(3)), F.lit(0.0)) / F.nullif(known, F.lit(0)))
    return rows.select(
        *by, *SHAPES, *[F.log1p(f"__{b}").alias(f"log_power_{b}") for b in ("low", "transition", "micro", "high")], (F.col("__micro") / (F.col("__total") + TINY)).alias("micro_fraction"),
        (-F.col("__fast.f")).alias("micro_peak"), (F.col("__fast.p") / (F.col("__fast.p") + TINY)).alias("micro_peak_share"), entropy.alias("micro_entropy"), F.size("__tones").alias("harmonics"),
        (total("__tones") / (F.col("__micro") + TINY)).alias("harmonic_fraction"), (varied / (F.col("__mean") + TINY)).alias("micro_cv"), F.col("fs").alias("frame_rate"), n.alias("frames"))


def phase_rows(frames: DataFrame, by: Sequence[str], time: str, bin_index: str, channel: str, first_bin: int = 8, last_bin: int = 180, most: int = 12, thirds: int = 100) -> DataFrame:
    """(by, bin, channel, snr_db, margin, stability, the features of `phase_features`): one row for each window of complex frames (time in ms, bin, channel, re, im).

    Features are those of the window's target cell, whose samples alone are gathered. Frames without a number are left out; a window of one time has no row.
    """
    known = frames.where("re is not null and im is not null and not isnan(re) and not isnan(im)")
    target = target_cells(known, by, time, bin_index, channel, first_bin, last_bin, most, thirds)
    keys = [*by, channel, bin_index]
    cells = cell_phases(known.join(target.select(*keys), keys), by, time, bin_index, channel)
    features = phase_features(cells, by, time)
    snr = 10 * F.log10(F.col("ratio") + TINY)
    return target.select(*keys, snr.alias("snr_db"), "margin", "stability").join(features, list(by))
