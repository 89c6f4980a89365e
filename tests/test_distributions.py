"""Quantiles of large groups, stored sketches, lags, linear heads, windows, approaches and list states against plain computations."""

from __future__ import annotations

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelens.operators import approaches, forecast, metrics, quantiles, rolling, windows
from tracelens.streaming import streams


def plain(values, q, higher):
    v = np.sort(np.asarray(values, float))
    return float(v[math.ceil((len(v) - 1) * q)]) if higher else float(np.quantile(v, q))


@pytest.mark.parametrize("higher", [False, True])
def test_quantiles_by_histograms_equal_sorting(spark, monkeypatch, higher):
    rng = np.random.default_rng(1)
    groups = {
        "even": rng.uniform(size=20_000),
        "steep": np.exp(rng.normal(scale=40, size=9_000)),  # most values in one bin
        "ties": rng.integers(0, 4, 12_000).astype(float),
        "flat": np.full(6_000, 7.5),
        "ends": np.concatenate([np.full(3_000, -1e308), rng.normal(size=3_000), np.full(3_000, 1e308)]),
        "far": 1e12 + np.arange(5_000) % 977,
        "few": rng.normal(size=50),
        "one": np.array([3.0]),
    }
    rows = [(g, float(x)) for g, v in groups.items() for x in v] + [(None, 1.0), (None, 2.0), ("even", None), ("few", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(8)
    levels = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.9503, "e": 1.0}
    want = {g: tuple(plain(v, q, higher) for q in levels.values()) for g, v in {**groups, None: [1.0, 2.0]}.items()}
    for few in (500, 1_000_000):
        monkeypatch.setattr(quantiles, "FEW", few)
        got = {r.g: tuple(r)[1:] for r in quantiles.quantiles(df, "v", levels, ["g"], higher).collect()}
        assert got.keys() == want.keys()
        for g in want:
            assert got[g] == pytest.approx(want[g], rel=1e-12), (few, g)
        whole = quantiles.quantiles(df.where("g = 'even'"), "v", {"m": 0.37}, [], higher).collect()
        assert [r.m for r in whole] == pytest.approx([plain(groups["even"], 0.37, higher)])
        assert quantiles.quantiles(df.where("false"), "v", {"m": 0.5}, [], higher).collect() == []
        assert quantiles.quantiles(df.where("v is null"), "v", {"m": 0.5}, ["g"], higher).collect() == []


def test_sketches_of_parts_are_folded(spark, tmp_path):
    rows = spark.range(60_000).select((F.col("id") % 6).alias("day"), F.concat(F.lit("s"), F.col("id") % 2).alias("msname"), F.expr("id * 7919 % 9973").cast("string").alias("who"), (F.expr("id * 104729 % 60000") / 60_000).alias("v"))
    path, args = f"{tmp_path}/sketches", ("day", ["msname"], "who", "v")
    assert quantiles.add_parts(rows.where("day < 5"), path, *args) == [0, 1, 2, 3, 4]
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "sketches").glob("*.parquet")}
    assert quantiles.add_parts(rows, path, *args) == [5] and quantiles.add_parts(rows, path, *args) == []
    assert all(p.stat().st_mtime_ns == t for p, t in before.items())
    levels = {"p05": 0.05, "p50": 0.5, "p99": 0.99}
    folded = {r.msname: r for r in quantiles.estimates(quantiles.fold(spark.read.parquet(path), ["msname"]), ["msname"], levels).collect()}
    once = {r.msname: r for r in quantiles.estimates(quantiles.fold(quantiles.part_sketches(rows.withColumn("day", F.lit(0)), *args), ["msname"]), ["msname"], levels).collect()}
    exact = {r.msname: r for r in rows.groupBy("msname").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.count_distinct("who").alias("who")).collect()}
    for s, e in exact.items():
        for made in (folded[s], once[s]):
            assert made.n == e.n and made["mean"] == pytest.approx(e["mean"])
            assert abs(made.distinct - e.who) <= 0.05 * e.who
            assert all(abs(made[name] - q) <= 0.01 for name, q in levels.items())  # values are even, so a value is its rank


def test_all_lags_equal_direct_sums(spark):
    rng = np.random.default_rng(2)
    series = {"waves": np.sin(np.arange(300) * 2 * np.pi / 24) + 0.2 * rng.normal(size=300), "short": np.array([1.0, 3.0, 2.0]), "flat": np.ones(50), "one": np.ones(1), "far": 1e6 + rng.normal(size=100)}
    df = spark.createDataFrame([(s, i, float(x)) for s, v in series.items() for i, x in enumerate(v)] + [("short", 99, None)], "msname string, t long, load double").repartition(4)
    made = rolling.all_autocorrelations(df, 120)
    got = {(r.msname, r.lag): r.acf for r in made.collect()}
    want = {}
    for s, v in series.items():
        c = v - v.mean()
        if len(v) > 1 and c @ c / len(v) >= 1e-12:
            want |= {(s, k): float(c[:-k] @ c[k:]) / (len(v) - k) / (c @ c / len(v)) for k in range(1, min(120, len(v) - 1) + 1)}
    assert got == pytest.approx(want, abs=1e-7)
    peaks = {r.msname: r.lag for r in rolling.peak_autocorrelation(made, 18, 60).collect()}
    assert peaks["waves"] == max(range(18, 61), key=lambda k: abs(want["waves", k])) and "short" not in peaks


def window_frame(spark, n=90, length=8, offset=0.0):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(n):
        x = rng.normal(size=(length, 2)) + offset
        y = [[float(x[:, 0].mean() + 0.5 * x[-1, 0] + 0.1 * rng.normal())], [float(x[-1, 0] - x[0, 0] + 0.1 * rng.normal())]]
        rows.append(("s", "train" if i < 60 else "test", i, x.tolist(), y))
    return rows, spark.createDataFrame(rows, "msname string, split string, win_start long, x array<array<double>>, y array<array<double>>").repartition(5)


@pytest.mark.parametrize(("kind", "offset"), [("flat", 0.0), ("trend_seasonal", 0.0), ("trend_seasonal", 1e5)])
def test_heads_equal_normal_equations(spark, kind, offset):
    rows, df = window_frame(spark, offset=offset)
    kernel, length = 4, 8
    def features(x):
        x = np.array(x)
        if kind == "flat":
            return x.ravel()
        padded = np.concatenate([np.full(kernel // 2, x[0, 0]), x[:, 0], np.full(kernel - 1 - kernel // 2, x[-1, 0])])
        trend = np.array([padded[i : i + kernel].mean() for i in range(length)])
        return np.concatenate([trend, x[:, 0] - trend])

    flat = np.array([features(r[3]) for r in rows])
    got = {(r.win_start, r.h): r.pred for r in forecast.linear_direct(df, kind=kind, kernel=kernel).collect()}
    train = flat[:60]
    spread, mean = train.std(axis=0, ddof=1), train.mean(axis=0)
    z = (train - mean) / spread
    for h in (1, 2):
        y = np.array([r[4][h - 1][0] for r in rows])
        scale = y[:60].std(ddof=1)
        beta = np.linalg.solve(z.T @ z / 60 + 1e-3 / scale * np.eye(z.shape[1]), z.T @ (y[:60] - y[:60].mean()) / 60)
        want = y[:60].mean() + ((flat - mean) / spread) @ beta
        assert [got[i, h] for i in range(90)] == pytest.approx(want, abs=2e-3 if not offset else 0.02)
    with pytest.raises(ValueError, match="no train"):
        forecast.linear_direct(df.where("split = 'test'"))


def test_a_gap_anywhere_in_a_window_counts(spark):
    times = [t for t in range(20) if t not in (9,)]
    rows = spark.createDataFrame([("a", "train", i, 60 * t, float(t)) for i, t in enumerate(times)], "msname string, split string, pos long, t long, v double")
    got = sorted(r.win_start // 60 for r in windows.windowize(rows, 4, 2, 1, ["v"], ["v"], contiguous=60).collect())
    assert got == [s for s in times if all(s + k in times for k in range(6))]
    doubled = spark.createDataFrame([("a", "train", i, 60 * t, 1.0) for i, t in enumerate([0, 1, 1, 3, 4, 5])], "msname string, split string, pos long, t long, v double")
    assert windows.windowize(doubled, 4, 2, 1, ["v"], ["v"], contiguous=60).collect() == []  # a gap and a repeat don't cancel


def test_origin_of_a_forecast(spark):
    rows = spark.createDataFrame([("a", i, float(i * i % 17), "train" if i < 30 else "val" if i < 35 else "test") for i in range(50)], "msname string, pos long, cpu double, split string")
    model = forecast.fit_ar1(rows.where("split = 'train'"))
    moved, kept = (forecast.ar1_from(model, rows, o).first() for o in ("test_start", "train_end"))
    assert (moved.phi, moved.drift) == (kept.phi, kept.drift)
    assert (kept["last"], moved["last"], moved.last_d) == (float(29 * 29 % 17), float(34 * 34 % 17), float(34 * 34 % 17 - 33 * 33 % 17))


def test_naive_direction_is_that_of_its_last_change(spark):
    rows = [(1, 2.0, 1.5, 1.0, 0.5), (2, 2.0, 2.5, 1.0, 0.5), (2, 0.0, 0.5, 1.0, 2.0), (2, 3.0, 3.0, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "h int, y double, pred double, last double, second_last double")
    got = {r.metric: r for r in metrics.compare_all(df, 2).collect()}
    assert set(got) == set(metrics.METRICS)
    assert got["mda"].naive == pytest.approx(200 / 3) and got["mda"].last_step == 100 and got["mda"].delta == pytest.approx(100 / 3)
    assert got["mae"].naive == pytest.approx(4 / 3) and got["mae"].avg_steps == pytest.approx((0.5 + 1 / 3) / 2) and got["mae"].delta == pytest.approx(100 * (1 / 3 - 4 / 3) / (4 / 3))


def test_approaches_by_name_are_kept_by_parameters(spark, tmp_path):
    rows, df = window_frame(spark, 6)
    df.withColumn("v", F.lit(1)).write.parquet(f"{tmp_path}/source")
    source, folder, made = spark.read.parquet(f"{tmp_path}/source"), f"{tmp_path}/cache", []

    def make():
        made.append(1)
        return source.select("msname", "split", "win_start", "x", "y")

    get = lambda name, **p: {r.win_start: r.x for r in approaches.prepared(spark, folder, source, make, name, 2, **p).collect()}
    assert get("none") == {r[2]: r[3] for r in rows}
    haar, smooth = get("wavelet", level=1, wavelet="haar"), get("smoothing", width=3)
    for i, r in enumerate(rows):
        x = np.array(r[3])
        want = np.stack([(x[:, c] + s * np.roll(x[:, c], -1)) / math.sqrt(2) for c in (0, 1) for s in (1, -1)], axis=1)
        assert np.allclose(haar[i], want) and np.allclose(np.array(smooth[i])[1:-1], (x[:-2] + x[1:-1] + x[2:]) / 3, atol=0.0051)
    assert len(made) == 3 and get("wavelet", level=1, wavelet="haar") == haar and len(made) == 3
    assert len(next(iter(get("wavelet", level=2, wavelet="haar").values()))[0]) == 6 and len(made) == 4
    with pytest.raises(ValueError, match="no approach"):
        approaches.prepare(df, "other", 2)


def _run(spark, folder, rows, build):
    from tracelens.plans.stream_queries import _rocksdb, _written

    df = spark.createDataFrame(rows, "msname string, ts long, value double")
    df.write.mode("append").parquet(f"{folder}/in")
    with _rocksdb(spark):
        return _written(build(spark.readStream.schema(df.schema).parquet(f"{folder}/in")), path=f"{folder}/out")


def test_list_states_are_trimmed_and_idle_keys_go(spark, tmp_path):
    build = lambda df: streams.stream_history(df, 3)
    for k in range(4):
        out = _run(spark, tmp_path / "kept", [("a", 5 * k + i, float(5 * k + i)) for i in range(5)], build)
    got = {r.ts: r.history for r in out.collect()}
    assert got == {t: [t - 2.0, t - 1.0, float(t)] for t in range(2, 20)}


def test_what_an_idle_key_has_kept_goes(spark, tmp_path):
    """Samples go after 10 s without one; batches that follow at once take less, on slow machines too."""
    from tracelens.plans.stream_queries import _rocksdb

    schema = "msname string, ts long, value double"
    put = lambda *times: spark.createDataFrame([("a", t, float(t)) for t in times], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    put(0, 1)
    seen = []
    with _rocksdb(spark):
        made = streams.stream_history(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), 3, idle=10_000)
        q = made.writeStream.foreachBatch(lambda df, _: seen.extend(df.collect())).option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="500 milliseconds").start()
        try:
            for times in ((), (2, 3), (4,)):
                if times:
                    time.sleep(13 if times == (2, 3) else 0)
                    put(*times)
                until = time.time() + 30
                want = {(): 2, (2, 3): 4, (4,): 5}[times]
                while sum(p["numInputRows"] for p in q.recentProgress) < want and time.time() < until:
                    time.sleep(0.2)
        finally:
            q.stop()
    assert [list(r.history) for r in seen] == [[2.0, 3.0, 4.0]]  # 0 and 1 were gone


def test_rows_behind_the_watermark_are_reported(spark, tmp_path):
    heard = streams.LateRows()
    spark.streams.addListener(heard)
    schema, dropped = "msname string, ts timestamp, cpu double", []
    for times in ([3600 * i for i in range(10)], [0, 3600, 3600 * 11]):
        rows = spark.createDataFrame([("a", t, 1.0) for t in times], "msname string, t long, cpu double").select("msname", F.timestamp_seconds("t").alias("ts"), "cpu")
        rows.write.mode("append").parquet(f"{tmp_path}/in")
        made = streams.stream_buckets(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "1 hour", "1 hour", {"cpu": F.avg("cpu")})
        q = made.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        dropped.append(streams.late_rows(q))
    for _ in range(50):
        if heard.dropped[str(q.id)]:
            break
        time.sleep(0.2)
    spark.streams.removeListener(heard)
    assert dropped == [0, 2] and heard.dropped[str(q.id)] == 2
