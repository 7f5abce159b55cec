"""Candidates of breath and heart rates scored and chosen, beats in a narrow band, and the quality of a respiration reference."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators import spectral
from spanloom.operators.signal import detrended

# -- spectra of windows --------------------------------------------------------------------------------


def densities(x: np.ndarray, rate: float, line: bool = False) -> np.ndarray:
    """One-sided Hann-windowed power densities of rows of samples, less their mean or their least-squares line; rows under four samples are zero."""
    n = x.shape[1]
    if n < 4:
        return np.zeros((len(x), n // 2 + 1))
    t = np.arange(n) - (n - 1) / 2
    x = x - x.mean(axis=1, keepdims=True)
    if line:
        x = x - (x @ t / (t @ t))[:, None] * t
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    p = np.abs(np.fft.rfft(x * w, axis=1)) ** 2 / (rate * (w @ w))
    p[:, 1:(n + 1) // 2] *= 2
    return p


def band_lines(df: DataFrame, by: Sequence[str], index: str, value: str, rate: float, low: float, high: float) -> DataFrame:
    """(by, hz, power): the lines of each window's density from `low` to `high`."""
    @F.pandas_udf("array<double>")
    def density(series: pd.Series) -> pd.Series:
        return pd.Series(spectral.by_length(series, lambda x: densities(x, rate)), dtype=object)

    rows = spectral.window_arrays(df, by, index, value).select(*by, F.size("__v").alias("__n"), density("__v").alias("__p"))
    lines = rows.where("__n >= 4").select(*by, "__n", F.posexplode("__p").alias("__k", "power"))
    return lines.select(*by, (F.col("__k") * F.lit(float(rate)) / F.col("__n")).alias("hz"), "power").where(F.col("hz").between(low, high))


# -- breath -----------------------------------------------------------------------------------------


def breath_rates(lines: DataFrame, times: DataFrame, by: Sequence[str], near: float = 0.08, fast: float = 0.22, reach: float = 0.04, share: float = 0.35) -> DataFrame:
    """(by, hz, reason, top_hz, time_hz, snr): one rate of each spectrum (hz, power), held against the peaks' own rate (`times`: by, time_hz).

    The strongest spectral peak within `near` of the time rate stands. Without one, if the strongest of all is at least `fast`, the line nearest to its half
    stands when it lies within `reach` and has `share` of the power; else the strongest peak. A spectrum without peaks has its greatest line as the only one, the
    lower of equals; of equal peaks the faster stands. Peaks lie a twenty-fifth of the lines apart. `snr` is the greatest power over the median. Spectra are of bounded
    bands, so their lines are one array a key.
    """
    @F.pandas_udf("array<int>")
    def peaks(series: pd.Series) -> pd.Series:
        out = []
        for v in series:
            x = np.asarray(v, float)
            at = spectral.prominences(x)[0]
            at = at[spectral.thinned(at, x[at], max(1, len(x) // 25))]
            out.append((at if len(at) else np.array([x.argmax()])).astype(int).tolist())
        return pd.Series(out, dtype=object)

    rows = lines.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col("hz"), F.col("power")))).alias("__l"),
                                  (F.max("power") / F.greatest(F.median("power"), F.lit(1e-12))).alias("snr"))
    rows = rows.join(times.select(*by, "time_hz"), list(by), "left").withColumn("__i", peaks(F.transform("__l", lambda c: c["power"])))
    rows = rows.withColumn("__c", F.transform("__i", lambda i: F.struct(F.get("__l", i)["power"].alias("power"), F.get("__l", i)["hz"].alias("hz"))))
    rows = rows.withColumn("__t", F.array_max("__c")).withColumn("__n", F.array_max(F.filter("__c", lambda c: F.abs(c["hz"] - F.col("time_hz")) <= near)))
    half = F.col("__t.hz") / 2
    rows = rows.withColumn("__h", F.array_min(F.transform("__l", lambda c: F.struct(F.abs(c["hz"] - half).alias("d"), c["hz"].alias("hz"), c["power"].alias("power")))))
    halved = (F.col("__t.hz") >= fast) & (F.col("__h.d") <= reach) & (F.col("__h.power") >= share * F.col("__t.power"))
    timed = F.col("__n").isNotNull()
    return rows.select(*by, F.when(timed, F.col("__n.hz")).when(halved, F.col("__h.hz")).otherwise(F.col("__t.hz")).alias("hz"),
                       F.when(timed, "time").when(halved, "half").otherwise("top").alias("reason"), F.col("__t.hz").alias("top_hz"), "time_hz", "snr")


def breath_score(snr: Column, hz: Column, time_hz: Column, roughness: Column, peaks: Column) -> Column:
    """Worth of a breath series: its line over the noise and its peaks, less roughness and 0.8 for each breath a minute between both rates (20 if one lacks)."""
    mismatch = F.coalesce(F.abs(60 * hz - 60 * time_hz), F.lit(20.0))
    return F.coalesce(snr, F.lit(0.0)) - 0.8 * mismatch - 0.6 * roughness + 0.08 * F.least(peaks, F.lit(30)) - F.when(peaks < 2, 12.0).otherwise(0.0)


def breath_branches(samples: DataFrame, by: Sequence[str], index: str, value: str, rate: float, low: float = 0.1, high: float = 0.5) -> DataFrame:
    """(by, branch, index, x): each window less its line, band-passed (`direct`), and its steps averaged over five and band-passed (`steps`)."""
    rows = detrended(samples.where(F.col(value).isNotNull()).select(*by, index, F.col(value).cast("double").alias("__v")), by, index, "__v").select(*by, index, F.col("detrended").alias("x"))
    w = Window.partitionBy(*by).orderBy(index)
    step = F.coalesce(F.col("x") - F.lag("x").over(w), F.lit(0.0))
    steps = rows.select(*by, index, step.alias("__d")).select(*by, index, (F.sum("__d").over(w.rowsBetween(-2, 2)) / 5).alias("x"))
    both = rows.withColumn("branch", F.lit("direct")).unionByName(steps.withColumn("branch", F.lit("steps")))
    return spectral.filtered(both, [*by, "branch"], index, "x", spectral.band_sections(rate, low, high)).withColumnRenamed("filtered", "x")


def breath_choice(samples: DataFrame, by: Sequence[str], index: str, value: str, rate: float, least_peaks: int = 3, least_intervals: int = 2) -> DataFrame:
    """(by, branch, hz, reason, time_hz, n_peaks, roughness, snr, score): the better of two ways to read a breath rate from each window.

    Both branches are cleaned, swept for peaks from 6 to 30 a minute and scored; the greater score stands, `direct` of equals. `roughness` is the deviation
    of steps over that of samples. Windows under four samples have no row; null samples are left out.
    """
    keys = [*by, "branch"]
    series = breath_branches(samples, by, index, value, rate)
    w = Window.partitionBy(*keys).orderBy(index)
    rough = series.withColumn("__d", F.col("x") - F.lag("x").over(w)).groupBy(*keys).agg((F.stddev_pop("__d") / F.greatest(F.stddev_pop("x"), F.lit(1e-8))).alias("roughness"))
    peaks = spectral.swept_peaks(series, keys, index, "x", rate, 6, 30, least_peaks=least_peaks, least_intervals=least_intervals)
    times = peaks.groupBy(*keys).agg(F.count("*").alias("n_peaks"), ((F.count("*") - 1) * F.lit(float(rate)) / F.nullif(F.max(index) - F.min(index), F.lit(0))).alias("time_hz"))
    found = breath_rates(band_lines(series, keys, index, "x", rate, 0.1, 0.5), times, keys).join(rough, keys).join(times.select(*keys, "n_peaks"), keys, "left")
    found = found.withColumn("n_peaks", F.coalesce("n_peaks", F.lit(0)))
    found = found.withColumn("score", breath_score(F.col("snr"), F.col("hz"), F.col("time_hz"), F.col("roughness"), F.col("n_peaks")))
    names = ["branch", "hz", "reason", "time_hz", "n_peaks", "roughness", "snr", "score"]
    return found.groupBy(*by).agg(F.max_by(F.struct(*names), F.struct(F.col("score"), F.col("branch") == "direct")).alias("__b")).select(*by, "__b.*")


# -- heart --------------------------------------------------------------------------------------------


def value_clusters(sorted_values: Column, reach: float) -> Column:
    """Places where clusters begin in an ascending array: a value more than `reach` from the median of the cluster before it begins the next.

    A cluster of sorted values is a stretch of the array, so its median is one or two look-ups and the fold keeps its beginning only.
    """
    median = lambda low, end: (F.get(sorted_values, F.floor((low + end) / 2).cast("int")) + F.get(sorted_values, F.ceil((low + end) / 2).cast("int"))) / 2
    places = F.when(F.size(sorted_values) > 1, F.sequence(F.lit(1), F.size(sorted_values) - 1)).otherwise(F.array().cast("array<int>"))
    last = lambda starts: F.element_at(starts, -1)
    return F.aggregate(places, F.array(F.lit(0)), lambda starts, i: F.when(F.abs(F.get(sorted_values, i) - median(last(starts), i - 1)) <= reach, starts).otherwise(F.concat(starts, F.array(i))))


def rate_consensus(rates: DataFrame, windows: DataFrame, by: Sequence[str], frequency: str, time: str, corrected: str, timed: str, reach: float = 6.0, agree: float = 8.0, least: int = 5) -> DataFrame:
    """(by, rate, time_rate, source, time_source, clusters, best_count, best_center): one rate of each recording from its own two rates and its windows'.

    A window stands for the mean of both its rates when they agree within `agree`, else for its time rate, else for the corrected one. These values
    form clusters in ascending order; the best has most windows and agreement, little deviation and is near the recording's time rate, the slower of equals.
    Its median stands if it has `least` windows and the recording's rates differ by over 3, or one lacks, or corrected rates vary by over 8. Else, over that
    difference, the median of the agreeing, time or corrected rates does, the first with `least` of them; and of the agreeing ones where corrected rates vary by over
    10. Otherwise the frequency rate. A recording's windows are one array; keys without windows keep their rates.
    """
    c, t = F.col(corrected).cast("double"), F.col(timed).cast("double")
    fused = F.coalesce(F.abs(c - t) <= agree, F.lit(False))
    value = F.when(fused, 0.5 * (c + t)).otherwise(F.coalesce(t, c))
    kind = F.when(fused, "fused").when(t.isNotNull(), "time").otherwise("corrected")
    rows = windows.select(*by, c.alias("__c"), t.alias("__t"), value.alias("__v"), kind.alias("__k"))
    listed = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.when(F.col("__v").isNotNull(), F.struct("__v", "__k", "__t")))).alias("__r"), F.stddev_samp("__c").alias("__s"),
                                   *[F.struct(F.count(x).alias("n"), F.median(x).alias("m")).alias(n) for n, x in (("__mc", F.col("__c")), ("__mt", F.col("__t")), ("__mf", F.when(F.col("__k") == "fused", F.col("__v"))))])
    whole = rates.select(*by, F.col(frequency).cast("double").alias("__f"), F.col(time).cast("double").alias("__g")).join(listed, list(by), "left")
    starts = whole.withColumn("__b", value_clusters(F.transform("__r", lambda r: r["__v"]), reach))
    members = starts.select(*by, "__g", "__b", F.posexplode("__r").alias("__i", "r")).select(*by, "__g", F.size(F.filter("__b", lambda s: s <= F.col("__i"))).alias("cluster"), "r.*")
    of = lambda k: F.count(F.when(F.col("__k") == k, 1))
    groups = members.groupBy(*by, "cluster").agg(F.count("*").alias("n"), F.median("__v").alias("center"), F.median("__t").alias("time"), F.coalesce(F.stddev_samp("__v"), F.lit(0.0)).alias("__d"),
                                                 (1.5 * of("fused") + 0.4 * of("time")).alias("__w"), F.first("__g").alias("__g"))
    score = 3.0 * F.col("n") + F.col("__w") - 0.6 * F.col("__d") - 0.15 * F.coalesce(F.abs(F.col("center") - F.col("__g")), F.lit(0.0))
    best = groups.groupBy(*by).agg(F.max_by(F.struct("n", "center", "time"), F.struct(score, -F.col("cluster"))).alias("__best"), F.count("*").alias("clusters"))
    rows = whole.join(best, list(by), "left")
    gap, spread = F.abs(F.col("__f") - F.col("__g")), F.col("__s")
    many = lambda name: F.coalesce(F.col(f"{name}.n") >= least, F.lit(False))
    apart = F.coalesce(gap > 3, F.lit(False))
    clustered = many("__best") & (gap.isNull() | apart | F.coalesce(spread > 8, F.lit(False)))
    varied = ~apart & gap.isNotNull() & F.coalesce(spread > 10, F.lit(False)) & many("__mf")
    source = (F.when(clustered, "cluster").when(apart & many("__mf"), "fused").when(apart & many("__mt"), "time").when(apart & many("__mc"), "corrected").when(varied, "fused_varied").otherwise("frequency"))
    rows = rows.withColumn("source", source)
    is_ = lambda *names: F.col("source").isin(*names)
    rate = F.when(is_("cluster"), F.col("__best.center")).when(is_("fused", "fused_varied"), F.col("__mf.m")).when(is_("time"), F.col("__mt.m")).when(is_("corrected"), F.col("__mc.m")).otherwise(F.col("__f"))
    near = F.when(is_("cluster") & F.col("__best.time").isNotNull(), F.struct(F.col("__best.time").alias("v"), F.lit("cluster").alias("s"))).when(
        is_("fused_varied"), F.struct(F.col("__mt.m").alias("v"), F.lit("time_varied").alias("s"))).otherwise(F.struct(F.col("__g").alias("v"), F.lit("peaks").alias("s")))
    return rows.withColumn("__n", near).select(*by, rate.alias("rate"), F.col("__n.v").alias("time_rate"), "source", F.col("__n.s").alias("time_source"), F.coalesce("clusters", F.lit(0)).alias("clusters"),
                                               F.coalesce(F.col("__best.n"), F.lit(0)).alias("best_count"), F.col("__best.center").alias("best_center"))


#: Measure of a rate's course, points lost for each unit of it, the most units that count.
COURSE_COSTS = {"course_std": (0.35, 25.0), "course_jump": (0.45, 20.0), "course_agreement": (0.15, 30.0), "beat_std": (0.10, 50.0), "beat_jump": (0.15, 60.0), "beat_jump_share": (0.35, 100.0)}


def heart_score(values: dict[str, Column]) -> Column:
    """Worth of a heart candidate. `values`: frequency and time (rates), raw_std, corrected_std, time_std of its windows, locked, changed and peaks (counts),
    the measures of COURSE_COSTS, confidence, usable (a share) and passed.

    Null measures of the course cost nothing; null rates or deviations cost the most they can, a null corrected deviation that of the raw rates. A candidate whose
    signal didn't pass is worth a million less than nothing.
    """
    v = values
    gap = F.abs(v["frequency"] - v["time"])
    capped = lambda x, most: F.when(x > most, most).otherwise(x)
    raw = F.coalesce(v["raw_std"], F.lit(999.0))
    score = (40.0 - 1.8 * capped(F.coalesce(gap, F.lit(999.0)), 30.0) - 0.5 * capped(raw, 40.0) - 0.4 * capped(F.coalesce(v["corrected_std"], raw), 40.0)
             - 0.2 * capped(F.coalesce(v["time_std"], F.lit(999.0)), 40.0) - 1.5 * v["locked"] - 0.4 * v["changed"] + capped(v["peaks"] / 100.0, 8.0))
    score = score - F.when(F.coalesce(gap, F.lit(999.0)) > 10.0, 20.0).otherwise(0.0)
    for name, (cost, most) in COURSE_COSTS.items():
        score = score - F.coalesce(cost * capped(v[name], most), F.lit(0.0))
    score = score + F.coalesce(5.0 * v["confidence"], F.lit(0.0)) - 30.0 * (1.0 - F.coalesce(v["usable"], F.lit(0.0)))
    return F.when(F.coalesce(v["passed"], F.lit(False)), score).otherwise(F.lit(-1_000_000.0))


def heart_choice(candidates: DataFrame, windows: DataFrame, by: Sequence[str], candidate: str) -> DataFrame:
    """(by, candidate, score): the candidate of the greatest score of each recording, the first by name of equals.

    `candidates` has a row of (frequency, time, peaks, confidence, usable, passed and the measures of COURSE_COSTS) for each candidate, `windows` rows of
    (raw, corrected, timed, locked, changed), summed to one row for each before the join.
    """
    keys = [*by, candidate]
    sums = windows.groupBy(*keys).agg(*[F.stddev_samp(x).alias(n) for n, x in (("raw_std", "raw"), ("corrected_std", "corrected"), ("time_std", "timed"))],
                                      *[F.count(F.when(F.col(x), 1)).alias(x) for x in ("locked", "changed")])
    rows = candidates.join(sums, keys, "left").fillna(0, ["locked", "changed"])
    names = ["frequency", "time", "peaks", "confidence", "usable", "passed", *COURSE_COSTS, "raw_std", "corrected_std", "time_std", "locked", "changed"]
    scored = rows.select(*keys, heart_score({n: F.col(n) for n in names}).alias("score"))
    best = F.min_by(F.struct(candidate, "score"), F.struct(-F.col("score"), F.col(candidate)))
    return scored.groupBy(*by).agg(best.alias("__b")).select(*by, f"__b.{candidate}", "__b.score")


# -- beats in a narrow band ---------------------------------------------------------------------------


def beat_chain(values: Column, period: Column) -> Column:
    """Places of beats in an array: from the place after a beat (at first 0), the greatest value from 0.75 to 1.35 periods on, the first of equals."""
    n = F.size(values)
    steps = F.sequence(F.lit(0), F.floor(n / (F.floor(0.75 * period) + 1)).cast("int"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("beats"))

    def following(state: Column, _: Column) -> Column:
        low = F.floor(state["at"] + 0.75 * period).cast("int")
        high = F.least(F.floor(state["at"] + 1.35 * period).cast("int"), n)
        near = F.slice(values, low + 1, F.greatest(high - low, F.lit(0)))
        beat = (low + F.array_position(near, F.array_max(near)) - 1).cast("int")
        return F.when((low < n) & (high > low), F.struct((beat + 1).alias("at"), F.concat(state["beats"], F.array(beat)).alias("beats"))).otherwise(state)

    return F.aggregate(steps, start, following, lambda s: s["beats"])


def narrowband_beats(samples: DataFrame, frequencies: DataFrame, by: Sequence[str], index: str, value: str, frequency: str, rate: float, reach: float = 0.05, least: float = 0.5) -> DataFrame:
    """(by, index, filtered): beats of each window in the band within `reach` of its own frequency (`frequencies`: by, frequency; Hz), from `least` on.

    Windows of one length go through their filters together, each its own. Windows without a frequency, or whose band isn't inside (0, rate / 2), have no row.
    """
    @F.pandas_udf("array<double>")
    def through(series: pd.Series, center: pd.Series) -> pd.Series:
        out: list[np.ndarray] = [np.zeros(0)] * len(series)
        sizes, low = series.map(len).to_numpy(), np.maximum(center.to_numpy(float) - reach, least)
        for size in np.unique(sizes[sizes > 0]):
            at = np.flatnonzero(sizes == size)
            sections = np.stack([spectral.band_sections(rate, low[k], center.iloc[k] + reach) for k in at], axis=-1)
            for k, row in zip(at, spectral.filtered_both_ways(np.stack([np.asarray(series.iloc[k], float) for k in at]), sections)):
                out[k] = row
        return pd.Series(out, dtype=object)

    f = F.col(frequency)
    known = frequencies.select(*by, frequency).where((f + reach > least) & (f + reach < rate / 2) & (f > 0))
    rows = spectral.window_arrays(samples, by, index, value).join(known, list(by)).select(*by, "__i", f.alias("__h"), through("__v", frequency).alias("__f"))
    beats = rows.select(*by, "__i", "__f", F.explode(beat_chain(F.col("__f"), rate / F.col("__h"))).alias("__b"))
    return beats.select(*by, F.get("__i", F.col("__b")).alias(index), F.get("__f", F.col("__b")).alias("filtered"))


# -- respiration reference -------------------------------------------------------------------------------


def respiration_qa(samples: DataFrame, by: Sequence[str], index: str, value: str, rate: float, seconds: float = 10.0, band: tuple[float, float] = (0.1, 0.7), prominence: float = 0.2,
                   rates: tuple[float, float] = (6.0, 42.0), share: float = 0.8, loose: float = 0.25) -> DataFrame:
    """(by, n_raw, n_rejected, n_kept, valid_ratio, rate, usable, amplitude, loose, note): the quality of each window of a respiration belt.

    A window less its median is band-passed; peaks half a second apart with the prominence give periods, of which those of possible rates count. `valid_ratio` is
    such periods over peaks, usable from `share` on; the rate is that of the median period, of two at least. A belt is loose where the median size of
    the signal is under `loose` of its greatest. Windows shorter than `seconds` are `too_short`, under three peaks `too_few_peaks`, under two periods `too_few_periods`.
    """
    rows = samples.where(F.col(value).isNotNull()).select(*by, index, F.col(value).cast("double").alias("__v"))
    sizes = rows.groupBy(*by).agg(F.count("*").alias("__n"), F.median("__v").alias("__m"))
    long = rows.join(sizes.where(F.col("__n") >= rate * seconds), list(by)).select(*by, index, (F.col("__v") - F.col("__m")).alias("x"))
    clean = spectral.filtered(long, by, index, "x", spectral.band_sections(rate, *band))
    size = F.abs("filtered")
    shape = clean.groupBy(*by).agg((F.max("filtered") - F.min("filtered")).alias("amplitude"), (F.median(size) < loose * F.max(size)).alias("loose"))
    peaks = spectral.prominent_peaks(clean, by, index, "filtered", max(1, int(0.5 * rate))).where(F.col("prominence") >= prominence)
    w = Window.partitionBy(*by).orderBy(index)
    steps = peaks.withColumn("__p", (F.col(index) - F.lag(index).over(w)) / F.lit(float(rate)))
    valid = F.when((60 / F.col("__p")).between(*rates), F.col("__p"))
    periods = steps.groupBy(*by).agg(F.count("*").alias("n_raw"), F.count("__p").alias("__d"), F.count(valid).alias("__k"), F.median(valid).alias("__q"))
    out = sizes.join(shape, list(by), "left").join(periods, list(by), "left").withColumn("n_raw", F.coalesce("n_raw", F.lit(0)))
    enough = F.col("n_raw") >= 3
    kept = F.when(enough, F.col("__k")).otherwise(F.lit(0))
    ratio = kept / F.greatest(F.col("n_raw"), F.lit(1))
    note = F.when(F.col("amplitude").isNull(), "too_short").when(~enough, "too_few_peaks").when(kept < 2, "too_few_periods")
    return out.select(*by, "n_raw", F.when(enough, F.col("__d") - F.col("__k")).otherwise(F.lit(0)).alias("n_rejected"), kept.alias("n_kept"), ratio.alias("valid_ratio"),
                      F.when(kept >= 2, 60 / F.col("__q")).alias("rate"), (enough & (ratio >= share)).alias("usable"), "amplitude", F.coalesce("loose", F.lit(False)).alias("loose"), note.alias("note"))
