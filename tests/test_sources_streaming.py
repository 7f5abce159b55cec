"""Sources, sinks, stages, kernels and the streaming forms, each on small inputs."""

import io
import json
import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.operators import signal, windows
from spanloom.plans.stages import Stage, execute, ordered
from spanloom.sources import readers, shards, sinks
from spanloom.streaming import operators as S


def test_timestamps_fall_back_to_the_second_column(spark, tmp_path):
    (tmp_path / "t.csv").write_text("0,10,11\n1,20\nx,y,z\n2,30,31\n")
    got = readers.timestamps(spark, str(tmp_path / "t.csv")).orderBy("frame_id").collect()
    assert [(r.frame_id, r.ts_ms) for r in got] == [(0, 11), (1, 20), (2, 31)]


def test_timestamps_must_rise_where_asked(spark, tmp_path):
    (tmp_path / "t.csv").write_text("0,10,11\n1,20,21\n2,15,16\n")
    assert readers.timestamps(spark, str(tmp_path / "t.csv")).count() == 3
    with pytest.raises(Exception, match="monotonic"):
        readers.timestamps(spark, str(tmp_path / "t.csv"), rising=True).collect()


def test_manifests_nested_windows_and_markers(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "manifest.json").write_text('{"name": "x", "stage": "one",\n "rows": 3}')
    (tmp_path / "b.json").write_text("no json")
    got = readers.manifests(spark, str(tmp_path / "*" / "manifest.json")).collect()
    assert [(r.name, r.stage, r.manifest["rows"]) for r in got] == [("x", "one", "3")]
    (tmp_path / "w.json").write_text('{"windows": [{"t": 1, "v": 0.5},\n {"t": 2, "v": null}]}')
    assert [(r.position, r.t, r.v) for r in readers.nested_windows(spark, str(tmp_path / "w.json"), "t: int, v: double").orderBy("t").collect()] == [(0, 1, 0.5), (1, 2, None)]
    (tmp_path / "m.csv").write_text("event,detail,unix_ms\nstart,b1,10\nstop,b1,x\n")
    assert [(r.event, r.unix_ms) for r in readers.markers(spark, str(tmp_path / "m.csv")).collect()] == [("start", 10)]


def test_gzip_logs_and_chosen_columns(spark, tmp_path):
    import gzip

    with gzip.open(tmp_path / "g.csv.gz", "wt") as f:
        f.write("unix_ms,x\n5,a\n6,b\n")
    got = readers.csv_logs(spark, str(tmp_path / "g.csv.gz"), ["unix_ms"], ["unix_ms"])
    assert sorted(r.unix_ms for r in got.collect()) == [5.0, 6.0] and "x" not in got.columns


def test_timestamp_matrix_fails_on_a_falling_clock(spark, tmp_path):
    (tmp_path / "t.csv").write_text("0,10,60\n1,20,70\n")
    assert readers.timestamp_matrix(spark, str(tmp_path / "t.csv")).count() == 2
    (tmp_path / "u.csv").write_text("0,10,60\n1,9,70\n")
    with pytest.raises(Exception, match="falls"):
        readers.timestamp_matrix(spark, str(tmp_path / "u.csv")).collect()


def test_csv_logs_and_trials(spark, tmp_path):
    (tmp_path / "b1.csv").write_text("﻿subject,is_probe,rt\n001,0,250\n001,1,\n001,0,bad\n", encoding="utf-8")
    got = readers.csv_logs(spark, str(tmp_path), ["rt", "is_probe"]).collect()
    assert [(r.subject, r.rt) for r in got] == [("001", 250.0), ("001", None), ("001", None)]


def test_marker_edges(spark):
    d = spark.createDataFrame([("s", i, a, b) for i, (a, b) in enumerate([(0, 0), (5, 0), (5, 0), (0, 0), (5, 5)])], "s string, i int, a int, b int")
    assert [(r.i, r.code) for r in readers.marker_edges(d, ["a", "b"], ["s"], "i").orderBy("i").collect()] == [(1, 1), (4, 3)]


class Counted(io.FileIO):
    """A file that counts the bytes read from it."""

    total = 0

    def readinto(self, buffer):
        n = super().readinto(buffer)
        self.total += n or 0
        return n

    def read(self, size=-1):
        data = super().read(size)
        self.total += len(data)
        return data


def test_headers_and_ranges_read_few_bytes(tmp_path):
    cube = np.arange(4000 * 8 * 4, dtype=np.float32).reshape(4000, 8, 4).astype(np.complex64)
    np.savez(tmp_path / "a.npz", tx1=cube, tx2=cube[:5], other=cube[:1])
    size = (tmp_path / "a.npz").stat().st_size
    with Counted(tmp_path / "a.npz") as f:
        assert [(h.name, h.shape) for h in shards.headers(f)] == [("tx1", (4000, 8, 4)), ("tx2", (5, 8, 4))]
        assert f.total < size / 100
    with Counted(tmp_path / "a.npz") as f:
        got = list(shards.read_frames(f, "tx1", 1000, 1600))
        assert [at for at, _ in got] == [1000, 1256, 1512] and np.array_equal(np.concatenate([c for _, c in got]), cube[1000:1600])
        assert f.total < cube[:600].nbytes + size / 100


def test_conditions_reach_the_shard_source(spark, tmp_path):
    cubes = [np.full((n, 2, 1), n + 1j, np.complex64) for n in (3, 4, 5)]
    for i, c in enumerate(cubes):
        np.savez_compressed(tmp_path / f"part{i}.npz", tx1=c, tx2=-c)
    table = shards.shard_index(spark, str(tmp_path))
    entries = json.dumps([[r.path, r.array, r.first_frame, r.n_frames] for r in table.collect()])
    source = spark.read.format("npz_frames").option("index", entries).load()
    assert source.count() == 2 * 2 * 12 and source.rdd.getNumPartitions() == 3
    part = source.where("array = 'tx2' and frame > 2 and frame <= 4 and channel = 0")
    assert part.rdd.getNumPartitions() == 1 and sorted((r.frame, r.bin, r.re) for r in part.collect()) == [(3, 0, -4), (3, 1, -4), (4, 0, -4), (4, 1, -4)]
    assert source.where("array = 'tx3'").count() == 0 and source.where("frame = 7").select("array", "re").distinct().count() == 2
    chunks = shards.frame_chunks(spark, str(tmp_path), "tx1", 1, 11, 4, table).select("frame", "chunk").distinct().collect()
    assert sorted((r.frame, r.chunk) for r in chunks) == [(f, (f - 1) // 4) for f in range(1, 11)]


def test_frames_read_only_their_shards(spark, tmp_path):
    rng = np.random.default_rng(0)
    cubes = [(rng.normal(size=(n, 2, 1)) + 1j).astype(np.complex64) for n in (3, 4)]
    for i, c in enumerate(cubes):
        np.savez(tmp_path / f"part{i}.npz", tx1=c)
    index = shards.shard_index(spark, str(tmp_path)).orderBy("path").collect()
    assert [(r.first_frame, r.n_frames) for r in index] == [(0, 3), (3, 4)]
    got = shards.frames(spark, str(tmp_path), "tx1", 2, 5).orderBy("frame", "bin").collect()
    whole = np.concatenate(cubes)[2:5, :, 0].ravel()
    assert np.allclose([r.re + 1j * r.im for r in got], whole)
    table = shards.shard_index(spark, str(tmp_path)).persist()
    assert shards.frames(spark, str(tmp_path), "tx1", 0, 2, table).select("frame").distinct().count() == 2
    assert shards.frames(spark, str(tmp_path), "tx1", 50, 60, table).count() == 0


def test_exclusive_and_restartable_sinks(spark, tmp_path):
    d = spark.createDataFrame([(1, float("nan")), (2, 0.5)], "k int, x double")
    sinks.write_new(d, str(tmp_path / "a"))
    with pytest.raises(Exception):
        sinks.write_new(d, str(tmp_path / "a"))
    sinks.append_once(d, str(tmp_path / "b"), ["k"])
    sinks.append_once(d.union(spark.createDataFrame([(3, 1.0)], d.schema)), str(tmp_path / "b"), ["k"])
    assert spark.read.parquet(str(tmp_path / "b")).count() == 3
    assert [r.value for r in sinks.as_json(d).collect()] == ['{"k":1}', '{"k":2,"x":0.5}']
    assert sinks.manifest(d, "m", {"d": d})["result"] == sinks.manifest(d.orderBy(F.desc("k")), "m", {})["result"]


def test_unions_copies_models_and_marked_files(spark, tmp_path):
    a, b = spark.createDataFrame([(1, "x")], "k int, a string"), spark.createDataFrame([(2, 0.5)], "k int, b double")
    sinks.write_union({"a": a, "b": b}, str(tmp_path / "u"))
    got = spark.read.option("header", True).csv(str(tmp_path / "u"))
    assert set(got.columns) == {"k", "a", "b", "source"} and got.count() == 2
    sinks.write_new(a, str(tmp_path / "in" / "t"))
    copied = sinks.copy_tables(spark, str(tmp_path / "in"), str(tmp_path / "out"), ["t"]).first()
    assert copied.rows == 1 and copied.digest == sinks.content_digest(a)["digest"]
    with pytest.raises(Exception):
        sinks.copy_tables(spark, str(tmp_path / "in"), str(tmp_path / "out"), ["t"])
    sinks.write_new(a, str(tmp_path / "m"), "csv", marked=True)
    part = next((tmp_path / "m").glob("part-*.csv")).read_bytes()
    assert part.startswith(b"\xef\xbb\xbfk,a")
    sinks.write_models(spark.createDataFrame([("s1", 0.5, [1.0])], "subject string, intercept double, coef array<double>"), str(tmp_path / "models"), ["subject"])
    assert spark.read.json(str(tmp_path / "models")).first().subject == "s1"


def test_stages_run_in_order_and_skip_what_exists(spark, tmp_path):
    ran = []

    def make(name):
        def run(s, tables):
            ran.append(name)
            return s.range(len(tables) + 1)
        return run

    stages = [Stage("c", make("c"), ("a", "b")), Stage("a", make("a"), (), ("raw",)), Stage("b", make("b"), ("a",))]
    assert [s.name for s in ordered(stages, ["b"])] == ["a", "b"]
    out = execute(spark, stages, str(tmp_path), {"raw": spark.range(1)})
    assert ran == ["a", "b", "c"] and out["c"].count() == 3
    execute(spark, stages, str(tmp_path), {"raw": spark.range(1)})
    assert ran == ["a", "b", "c"]
    with pytest.raises(ValueError, match="missing"):
        execute(spark, stages, str(tmp_path), {})
    with pytest.raises(ValueError, match="itself"):
        ordered([Stage("x", make("x"), ("y",)), Stage("y", make("y"), ("x",))])


def test_complex_mean_and_detrend(spark):
    cube = spark.createDataFrame([(f, b, 3.0 + f * b, 4.0) for f in range(5) for b in range(2)], "frame int, bin int, re double, im double")
    means = signal.mean_subtracted(cube, ["bin"]).groupBy("bin").agg(F.avg("re").alias("r"), F.avg("im").alias("i")).collect()
    assert all(abs(r.r) < 1e-12 and abs(r.i) < 1e-12 for r in means)
    line = spark.createDataFrame([("a", float(t), 2.0 * t + 1) for t in range(6)], "k string, t double, x double")
    assert all(abs(r.detrended) < 1e-9 for r in signal.detrended(line, ["k"], "t", "x").collect())


def test_band_peak_of_a_sine(spark):
    rows = [("w", t / 20, math.sin(2 * math.pi * 1.25 * t / 20)) for t in range(600)]
    r = signal.band_features(spark.createDataFrame(rows, "w string, t double, x double"), ["w"], "t", "x", 20.0, {"heart": (0.8, 2.5), "breath": (0.08, 0.5)}).first()
    assert abs(r.peak_heart - 1.25) < 0.05 and r.power_heart > 100 * r.power_breath and 0 < r.entropy < 0.5


def test_interval_rate(spark):
    peaks = spark.createDataFrame([("s", 0.8 * i) for i in range(20)], "s string, t double")
    r = signal.interval_rate(peaks, ["s"], "t").first()
    assert abs(r.bpm - 75) < 1e-6 and r.rmssd < 1e-9


def stream_of(spark, frame, folder):
    frame.write.parquet(folder)
    return spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)


def drain(stream, name, mode="append"):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()


def test_streamed_windows_equal_batch(spark, sf_dir, tmp_path):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "value", F.col("ts").cast("timestamp").alias("ts"))
    agg = [F.count("*").alias("n"), F.sum("value").alias("s")]
    drain(S.windowed(stream_of(spark, e, str(tmp_path / "e")), ["user_id"], "ts", agg, "6 hours"), "windows_test", "complete")
    batch = e.groupBy("user_id", F.window("ts", "6 hours").alias("w")).agg(*agg)
    assert spark.table("windows_test").exceptAll(batch).count() == 0 and spark.table("windows_test").count() == batch.count()


def test_streamed_sessions_repeats_and_lookback(spark, sf_dir, tmp_path):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"))
    agg = [F.count("*").alias("n")]
    drain(S.sessions(stream_of(spark, e, str(tmp_path / "s")), ["user_id"], "ts", "6 hours", agg, "100 days"), "sessions_test", "complete")
    batch = e.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(*agg)
    assert spark.table("sessions_test").exceptAll(batch).count() == 0 and spark.table("sessions_test").count() == batch.count()
    drain(S.once(stream_of(spark, e.union(e), str(tmp_path / "o")), ["event_id"], "ts", "100 days"), "once_test")
    assert spark.table("once_test").count() == e.count()
    probes = e.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("probe"), F.col("ts").alias("onset"))
    others = e.where("event_type <> 'signup'").select("user_id", "event_id", "ts")
    joined = S.lookback(stream_of(spark, probes, str(tmp_path / "p")), stream_of(spark, others, str(tmp_path / "q")), "user_id", "onset", "ts", "24 hours", "100 days")
    drain(joined.select("probe", "event_id"), "lookback_test")
    want = probes.join(others, "user_id").where("ts >= onset - interval 24 hours and ts < onset").select("probe", "event_id")
    assert spark.table("lookback_test").exceptAll(want).count() == 0 and spark.table("lookback_test").count() == want.count() > 0


def test_streamed_anchor_equals_batch(spark, tmp_path):
    d = spark.createDataFrame([(k, i, None if i == 0 else float(50 + i * 3 % 7), (i % 4) / 10) for k in "ab" for i in range(9)], "k string, o int, v double, c double")
    drain(S.anchors(stream_of(spark, d, str(tmp_path / "a")), ["k"], "o", "v", "c"), "anchors_test")
    want = {(r.k, r.o): r.anchor for r in windows.gated_anchor(d, ["k"], "o", "v", "c").collect()}
    got = {(r.k, r.o): r.anchor for r in spark.table("anchors_test").collect()}
    assert {k: None if v is None or math.isnan(v) else round(v, 9) for k, v in got.items()} == {k: None if v is None else round(v, 9) for k, v in want.items()}


def test_idle_anchors_expire(spark, tmp_path):
    """A key that has been idle begins anew with its next value; without a limit it goes on."""
    parts = [[("a", 1, 50.0, 1.0), ("b", 1, 10.0, 1.0)], [("b", 2, 20.0, 1.0)], [("a", 2, 100.0, 1.0), ("b", 3, 30.0, 1.0)]]
    for name, idle, want in (("short", 1, {("a", 2): 100.0}), ("long", None, {("a", 2): 60.0, ("b", 2): 12.0, ("b", 3): 15.6})):
        folder = tmp_path / name
        folder.mkdir()
        schema = "k string, o int, v double, c double"
        spark.createDataFrame([], schema).write.parquet(str(folder / "in" / "none"))
        stream = spark.readStream.schema(schema).parquet(str(folder / "in" / "*"))
        q = S.anchors(stream, ["k"], "o", "v", "c", idle_ms=idle).writeStream.format("memory").queryName(f"idle_{name}").trigger(processingTime="200 milliseconds").start()
        try:
            for n in range(len(parts)):
                spark.createDataFrame(parts[n], schema).coalesce(1).write.parquet(str(folder / "in" / str(n)))
                until = time.time() + 40
                while spark.table(f"idle_{name}").count() < sum(map(len, parts[:n + 1])) and time.time() < until:
                    time.sleep(0.3)
                time.sleep(3)       # for the timers
        finally:
            q.stop()
        got = {(r.k, r.o): r.anchor for r in spark.table(f"idle_{name}").collect()}
        assert len(got) == 5 and got[("a", 1)] == 50 and all(abs(got[k] - v) < 1e-9 for k, v in want.items()), (name, got)


def test_table_function_asks_for_its_columns(spark):
    from spanloom.functions.registered import register

    register(spark)
    d = spark.createDataFrame([("x", 2, 20.0, 0.1), ("x", 1, 10.0, 0.0), ("x", 3, 20.0, 0.5), ("x", 4, None, 0.5), ("y", 1, None, 1.0), ("y", 2, 5.0, None)], "session string, step int, value double, confidence double")
    got = {(r.session, r.step): r.anchor for r in spark.sql("SELECT * FROM gated_anchor(TABLE({d}))", d=d.repartition(3)).collect()}
    assert got == {("x", 1): 10.0, ("x", 2): 10.0, ("x", 3): 12.0, ("x", 4): 12.0, ("y", 1): None, ("y", 2): 5.0}
    with pytest.raises(Exception, match="takes a table"):
        spark.sql("SELECT * FROM gated_anchor(TABLE({d}))", d=d.drop("value")).collect()
