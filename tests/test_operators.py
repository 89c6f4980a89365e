"""Hand-made frames: traps, properties, and stateful operators against a plain replay."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelens.functions import scalars
from tracelens.operators import conformal, dependence, metrics, profile, rolling, scaling, series, signal, telemetry, windows, workload
from tracelens.plans import forecast_queries as fq
from tracelens.plans import series_queries as sq
from tracelens.sources import catalog, logs, traces


def test_splits_use_double_arithmetic(spark):
    rows = series.with_positions(spark.range(10).select(F.lit("a").alias("msname"), F.col("id").alias("t")))
    split = [r.split for r in series.assign_split(rows).orderBy("pos").collect()]
    assert split == ["train"] * 7 + ["test"] * 3  # int(10 * (0.7 + 0.1)) is 7
    hours = series.assign_split(rows, hours=(2.5, 1.5, None), freq="1h").orderBy("pos").collect()
    assert [r.split for r in hours] == ["train"] * 2 + ["val"] * 2 + ["test"] * 6
    assert series.assign_split(rows, hours=(2, 2, 3), freq="1h").count() == 7


def test_windows_count_and_stay_in_their_split(spark):
    rows = spark.range(57).select(F.lit("a").alias("msname"), F.col("id").alias("t"), F.col("id").alias("pos"), (F.col("id") * 1.0).alias("v"), F.when(F.col("id") < 40, "train").otherwise("test").alias("split"))
    got = windows.windowize(rows, 6, 3, 4, ["v"], ["v"]).collect()
    count = lambda n: (n - 9) // 4 + 1
    assert len(got) == count(40) + count(17)
    for r in got:
        assert [x[0] for x in r.x] == [r.win_start + i for i in range(6)]
        assert [y[0] for y in r.y] == [r.win_start + 6 + i for i in range(3)]
        assert r["last"] == [r.win_start + 5.0] and r.second_last == [r.win_start + 4.0] and r.sid == r.win_start + 5
    gap = rows.where("t <> 20")
    assert windows.windowize(gap, 6, 3, 4, ["v"], ["v"], contiguous=1).count() < windows.windowize(gap, 6, 3, 4, ["v"], ["v"]).count()


def test_moving_average_edges(spark):
    one = lambda values, width: spark.range(1).select(windows.moving_average(F.array(*[F.lit(float(v)) for v in values]), width).alias("m")).first().m
    assert one([1, 2, 3, 4], 3) == pytest.approx([4 / 3, 2, 3, 11 / 3])
    assert one([1, 2, 3, 4], 2) == pytest.approx([1, 1.5, 2.5, 3.5])
    assert len(one([1, 2], 9)) == 2


def test_gaps_duplicates_and_short_series(spark):
    rows = spark.createDataFrame([("gap", 0), ("gap", 60), ("gap", 180), ("dup", 0), ("dup", 0), ("fine", 0), ("fine", 60), ("short", 0)], "msname string, t long")
    bad = {r.msname for r in series.bad_services(rows, freq="1m", least=2).collect()}
    assert bad == {"gap", "dup", "short"}
    assert {r.msname for r in series.bad_services(rows).collect()} == {"dup"}


def test_constant_series_have_no_correlation(spark):
    rows = spark.range(50).select(F.lit("a").alias("msname"), F.col("id").alias("t"), F.lit(1.0).alias("x"), (F.col("id") * 1.0).alias("y"))
    got = dependence.lagged_correlation(rows, [("x", "y"), ("y", "y")], [2], ["msname"]).collect()
    assert {r["pair"]: r.r for r in got}["x->y"] is None
    assert {r["pair"]: r.r for r in got}["y->y"] == pytest.approx(1.0)
    flat = series.with_positions(rows.select("msname", "t", "x", "y"))
    assert dependence.distance_correlation(flat, "x", "y").first().dcor == 0.0
    assert dependence.distance_correlation(flat.limit(1), "y", "y").first().dcor == 0.0
    assert dependence.distance_correlation(flat, "y", "y").first().dcor == pytest.approx(1.0)
    assert dependence.sample_entropy(flat, "x").first().entropy is None
    assert dependence.sample_entropy(flat.where("pos < 7"), "y").first().entropy is None  # under eight rows


def test_correlations_of_instances_are_averaged(spark):
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for i, n in enumerate((60, 50, 12)):  # the last is too short
        cpu, mem, mcr = rng.normal(size=(3, n))
        cpu = np.full(n, 0.5) if i == 3 else cpu
        rows += [("s", i, t, float(a), float(b), float(c)) for t, (a, b, c) in enumerate(zip(cpu, mem, mcr, strict=True))]
        if n >= 15:
            for h in range(1, 6):
                want.setdefault(h, []).append(np.corrcoef(mcr[:-h], cpu[h:])[0, 1])
    rows += [("few", 0, t, float(t), 1.0, 1.0) for t in range(99)]
    df = spark.createDataFrame(rows, "msname string, msinstanceid long, t long, cpu double, mem double, mcr double")
    got = {r.h: r for r in dependence.instance_correlation(df).where("pair = 'mcr->cpu'").collect()}
    assert {r.msname for r in got.values()} == {"s"} and {(r.n_instances, r.n_samples) for r in got.values()} == {(2, 122)}
    assert {h: r.r for h, r in got.items()} == pytest.approx({h: np.mean(v) for h, v in want.items()})


def test_oscillation_skips_flat_windows(spark):
    rows = spark.range(30).select(F.lit("a").alias("msname"), F.col("id").alias("t"), F.when(F.col("id") < 10, 5.0).otherwise(F.col("id") % 2).alias("load"))
    got = rolling.oscillation(rows, 5, 1.0).collect()
    assert all(r.n_points == 5 and r.max_load > r.min_load for r in got)
    assert min(r.win_start for r in got) > 4


def test_higher_quantile_is_the_upper_neighbour(spark):
    rows = spark.createDataFrame([("a", float(v)) for v in (5, 1, 4, 2, 3)] + [("b", 7.0), ("b", None)], "k string, s double")
    got = {r.k: r["quantile"] for r in profile.higher_quantile(rows, "s", 0.6, ["k"]).collect()}
    assert got == {"a": 4.0, "b": 7.0}


def test_empty_sketch_and_histogram(spark):
    none = spark.createDataFrame([], "v double")
    assert profile.sketch_quantile(profile.sketch(none, "v", 10), 0.9, 10).first()["quantile"] == 0.5
    assert [r.n for r in profile.histogram(none, "v", 4).orderBy("bin").collect()] == [0, 0, 0, 0]
    one = spark.createDataFrame([(2.0,), (2.0,)], "v double")
    assert [r.n for r in profile.auto_histogram(one, "v", 4).orderBy("bin").collect()] == [0, 0, 2, 0]


def test_zero_replicas_count_as_one(spark):
    rows = spark.createDataFrame([("a", 0, 0.5), ("b", 2, 9.0)], "msname string, replicas int, cpu double")
    assert [r.cpu for r in telemetry.per_capacity(rows, "cpu", {"a": 2.0}).orderBy("msname").collect()] == [0.25, 1.0]


def test_no_spikes_and_too_few_residuals(spark):
    rows = spark.createDataFrame([("a", 0.5, 0.4, 0.4, 0.6)] * 3, "k string, y double, pred double, lower double, upper double")
    got = metrics.spike_metrics(rows, ["k"], threshold=0.9).first()
    assert (got.n_spikes, got.spike_coverage, got.spike_miss, got.mean_excess) == (0, 1.0, 0.0, 0.0)
    assert (got.upper_in_spike, got.upper_outside) == (0.0, pytest.approx(0.6))
    fitted = conformal.split_fit(rows, 0.1, ["k"])
    assert fitted.count() == 0
    assert conformal.split_apply(rows.drop("lower", "upper"), fitted, ["k"]).first().upper == 0.4


def test_metrics_by_hand(spark):
    rows = spark.createDataFrame([("a", 1.0, 0.5, 0.0, 0.75), ("a", 0.0, 1.0, 0.0, 1.0), ("a", 2.0, 2.5, 1.0, 1.5), ("a", 4.0, 1.0, 3.0, 4.5)], "k string, y double, pred double, last double, upper double")
    got = metrics.point_metrics(rows, ["k"]).first()
    assert (got.under_rate, got.over_rate) == (50.0, 50.0)
    assert got.mape == pytest.approx(100 * (0.5 + 0.25 + 0.75) / 3)
    zero = metrics.point_metrics(rows.withColumn("y", F.lit(0.0)), ["k"]).first()
    assert zero.mape == 0.0 and zero.r2 == 0.0
    got = metrics.persistence_diagnostics(rows, ["k"]).first()
    assert got.corr_last_true == pytest.approx(np.corrcoef([0, 0, 1, 3], [1, 0, 2, 4])[0, 1])
    assert got.beat_rate == 50.0
    assert got.r2_vs_persistence == pytest.approx(1 - (0.25 + 1 + 0.25 + 9) / 3)
    assert metrics.persistence_diagnostics(rows.limit(1), ["k"]).count() == 0
    spikes = metrics.spike_metrics(rows.withColumn("lower", F.lit(0.0)), ["k"], threshold=0.5).first()
    assert (spikes.n_spikes, spikes.spike_coverage) == (3, pytest.approx(1 / 3))
    assert spikes.mean_excess == pytest.approx((0.25 + 0.5 + 0) / 3)
    log = spark.createDataFrame([("a", t, float(t), float(t + 2), 1.0) for t in range(9)] + [("b", t, 1.0, 1.0, 0.0) for t in range(5)], "k string, t long, cpu double, pred_cpu double, delta_cpu double")
    got = metrics.aligned_errors(log, 3, ["k"]).collect()
    assert [(r.k, r.n, r.final_mse, r.raw_mae, r.naive_mae) for r in got] == [("a", 6, 1.0, 2.0, 3.0)]


def test_losses_over_two_targets(spark):
    rows = spark.createDataFrame([("a", 5, 0.5, 0.505, 0.2, 0.1), ("a", 4, 0.5, 0.4, 0.2, 0.2)], "k string, h int, pred_cpu double, y_cpu double, pred_mem double, y_mem double")
    targets = {"cpu": metrics.Target(0.01, under_weight=3.0), "mem": metrics.Target(0.002, relative=0.5)}
    got = metrics.target_losses(rows, ["k"], targets).first()
    small, large = 0.005**2 / 0.02, 0.1 - 0.005
    assert got.huber == pytest.approx(0.5 * (3 * small + large) / 2 + 0.5 * ((0.1 - 0.001) / 2 + 0.5 * (0.1 / 0.100001) / 2))
    assert got.mixed == pytest.approx((0.005**2 + 0.01) / 2 + 0.05)
    assert got.joint == pytest.approx(got.mse / 2)
    assert metrics.target_losses(rows, ["k"], targets, last_step=4).first().mse == pytest.approx(0.01)


def test_scores_inside_the_quantiles_count_as_zero():
    state, cfg = conformal.AdaptiveConfig().fresh(), conformal.AdaptiveConfig()
    for y in (0.5, 0.45, 0.55):
        state.update(y, 0.4, 0.6, cfg)
    assert state.scores_upper == state.scores_lower == [0.0] * 3
    assert state.interval(0.4, 0.6) == (0.4, 0.6)


def test_adaptive_replay_equals_a_plain_loop(spark):
    rng = np.random.default_rng(1)
    rows = [("a", "cpu", i, float(v), 0.4, 0.6, i < 20) for i, v in enumerate(rng.uniform(0.2, 0.9, 80))]
    df = spark.createDataFrame(rows, "msname string, target string, pos long, y double, q_lo double, q_hi double, warmup boolean")
    cfg = conformal.AdaptiveConfig(window=10, eta=0.05)
    got = {r.pos: r for r in conformal.adaptive_replay(df, cfg).collect()}
    up, low, au, al = [], [], cfg.alpha_upper, cfg.alpha_lower
    pick = lambda s, a: sorted(s)[math.ceil((len(s) - 1) * (1 - a))]
    bounds = lambda lo, hi: (lo, hi) if not up else (lo - pick(low, al), hi + pick(up, au))
    for k, (_, _, i, y, lo, hi, warm) in enumerate(rows):
        assert (got[i].lower, got[i].upper) == pytest.approx(bounds(lo, hi))
        if warm or (k >= cfg.horizon and not rows[k - cfg.horizon][6]):  # a test row learns from the forecast made `horizon` rows ago
            lo, hi = (lo, hi) if warm else rows[k - cfg.horizon][4:6]
            a, b = bounds(lo, hi)
            up, low = [*up, max(0, y - hi)][-10:], [*low, max(0, lo - y)][-10:]
            au = min(max(au + cfg.eta * (cfg.alpha_upper - (y > b)), cfg.least), cfg.most)
            al = min(max(al + cfg.eta * (cfg.alpha_lower - (y < a)), cfg.least), cfg.most)
    state = cfg.fresh()
    for i in range(9):
        state.step(i, 0.7 + 0.01 * i, 0.4, 0.6, i < 2, cfg)
    assert len(state.pending) == cfg.horizon and conformal.restore(conformal.snapshot(state)) == state
    assert cfg.fresh().interval(0.4, 0.6, "zero") == (0.0, 0.0)


@pytest.mark.parametrize("live", [False, True])
def test_no_interval_knows_a_later_value(spark, live):
    """A jump at one time changes no interval made before it, and the first that it changes is the next one, or its own if learnt first."""
    rng = np.random.default_rng(4)
    values = rng.uniform(0.4, 0.6, 60)
    rows = lambda jump: [("a", "cpu", i, float(v if i < jump else v + 3), 0.45, 0.55, i < 10) for i, v in enumerate(values)]
    cfg, schema = conformal.AdaptiveConfig(learn_first=live), "msname string, target string, pos long, y double, q_lo double, q_hi double, warmup boolean"
    made = [{r.pos: (r.lower, r.upper) for r in conformal.adaptive_replay(spark.createDataFrame(rows(jump), schema), cfg).collect()} for jump in (40, 99)]
    changed = [i for i in made[0] if made[0][i] != made[1][i]]
    assert min(changed) == (40 if live else 41)


def test_a_forecast_whose_value_never_comes_is_dropped(spark):
    cfg = conformal.AdaptiveConfig(horizon=3)
    state = cfg.fresh()
    for pos in (0, 1, 2, 5, 6):  # rows 3 and 4 are missing: the forecasts of 0 and 1 are never checked
        state.step(pos, 0.9, 0.4, 0.6, False, cfg)
    assert len(state.scores_upper) == 1 and [p[0] for p in state.pending] == [5, 6]


def _live_rows(values, missing=()):
    return [("a", 1_700_000_000 + 60 * i, float(v), 0.45, 0.55, i < 10) for i, v in enumerate(values) if i not in missing]


def _live(spark, folder, rows, checkpoint="one"):
    from tracelens.plans.stream_queries import _rocksdb, _written
    from tracelens.streaming import streams

    df = spark.createDataFrame(rows, "msname string, s long, y double, q_lo double, q_hi double, warmup boolean").select("msname", F.timestamp_seconds("s").alias("ts"), "y", "q_lo", "q_hi", "warmup")
    df.write.mode("append").parquet(f"{folder}/in-{checkpoint}")
    with _rocksdb(spark):
        out = _written(streams.stream_conformal(spark.readStream.schema(df.schema).parquet(f"{folder}/in-{checkpoint}"), horizon=300, delay="2 minutes"), path=f"{folder}/out-{checkpoint}")
    return {(r.ts - 1_700_000_000) // 60: (r.lower, r.upper) for r in out.collect()}


def test_stream_learns_when_values_come_and_no_sooner(spark, tmp_path):
    values = np.random.default_rng(4).uniform(0.4, 0.6, 60)
    rows, jump = _live_rows(values), _live_rows([v if i < 40 else v + 3 for i, v in enumerate(values)])
    cfg, schema = conformal.AdaptiveConfig(learn_first=True), "msname string, pos long, y double, q_lo double, q_hi double, warmup boolean"
    plain = spark.createDataFrame([("a", (s - 1_700_000_000) // 60, *rest) for _, s, *rest in rows], schema)
    batch = {r.pos: (r.lower, r.upper) for r in conformal.adaptive_replay(plain, cfg, keys=("msname",)).collect()}
    _live(spark, tmp_path, rows[:25])
    stream = _live(spark, tmp_path, rows[25:])  # a second run goes on with the forecasts that wait
    assert stream.keys() == batch.keys() and all(stream[k] == pytest.approx(batch[k]) for k in batch)
    moved = _live(spark, tmp_path, jump, "jump")
    assert min(i for i in stream if stream[i] != moved[i]) == 40
    gap = _live(spark, tmp_path, _live_rows(values, missing=range(20, 24))[:30], "gap")
    assert set(gap) == set(range(34)) - set(range(20, 24))


def test_wavelets_keep_energy_and_turn_back():
    rows = np.random.default_rng(2).normal(size=(5, 32))
    for wavelet in ("haar", "sym4"):
        made = signal.swt(rows, 3, wavelet)
        assert made.shape == (5, 4, 32)
        assert signal.iswt(made, wavelet) == pytest.approx(rows, abs=1e-8)
        share = (made[:, 0] ** 2).sum(1) / 8 + sum((made[:, 4 - k] ** 2).sum(1) / 2**k for k in (1, 2, 3))
        assert share == pytest.approx((rows**2).sum(1), rel=1e-6)


def test_flat_windows_are_dropped_or_kept_raw(spark):
    rows = spark.createDataFrame([(1, [[1.0]] * 8), (2, [[float(i % 3)] for i in range(8)])], "id int, x array<array<double>>")
    made = {r.id: r.channels for r in signal.decompose(rows, level=2).collect()}
    assert made[1] is None and len(made[2]) == 3
    raw = {r.id: r.channels for r in signal.decompose(rows, level=2, fallback=True).collect()}
    assert raw[1][0] == [1.0] * 8 and raw[1][1] == [0.0] * 8


def test_feature_sets_are_checked():
    assert catalog.feature_set("cpu_mem_http_rpc").tables == ("msresource", "msrtmcre")
    assert catalog.feature_set("cpu_mem").bounded and not catalog.feature_set("cpu_mem_http_rpc").bounded
    assert catalog.feature_set("cpu_mem").targets == ("cpu_utilization",) and catalog.feature_set("cpu_mem_both").targets == ("cpu_utilization", "memory_utilization")
    assert catalog.feature_set("node_cpu_mem").tables == ("msresource", "node") and catalog.feature_set("mcr_http").base == "msrtmcre"
    with pytest.raises(ValueError):
        catalog.feature_set("nothing")
    with pytest.raises(ValueError):
        catalog.FeatureSet("odd", ("cpu_utilization",), ("memory_utilization",))


def test_durations_and_parts():
    assert [scalars.duration_seconds(t) for t in ("1m", "60s", "2h", "1d", "1d12")] == [60, 60, 7200, 86400, 129600]
    assert traces.part_range("0d0", "1d0", 30) == (0, 47)
    with pytest.raises(ValueError):
        scalars.duration_seconds("soon")


def test_malformed_log_lines_are_marked(spark):
    lines = spark.createDataFrame([('h - - [01/Jul/1995:00:00:01 -0400] "GET"',), ("junk",), (None,), ("h - - [99/Jul/1995:00:00:01] x",)], "value string")
    got = logs.parse_access_log(lines).collect()
    assert [r.ok for r in got] == [True, False, None, False] and (got[0].day, got[0].hour, got[0].minute) == (1, 0, 0)


def test_files_without_a_needed_column_are_skipped(spark, tmp_path):
    (tmp_path / "good.csv").write_text("timestamp,msname,x\n1,a,2.5\n2,b,\n")
    (tmp_path / "turned.csv").write_text("x,timestamp,msname\n3.5,3,c\n")
    (tmp_path / "lacking.csv").write_text("timestamp,msname\n4,d\n")
    kept, skipped = traces.valid_files(spark, str(tmp_path), ["timestamp", "x"])
    assert len(kept) == 2 and [(r.file.rsplit("/", 1)[1], r.lacks) for r in skipped.collect()] == [("lacking.csv", ["x"])]
    rows = traces.read_csv_trace(spark, f"{tmp_path}/*.csv", ["msname"], ["x"]).orderBy("timestamp").collect()
    assert [(r.timestamp, r.msname, r.x) for r in rows] == [(1, "a", 2.5), (3, "c", 3.5)]
    assert traces.read_csv_trace(spark, f"{tmp_path}/none*.csv", ["msname"], ["x"]).count() == 0


def test_shared_folder_must_be_named_on_a_cluster():
    from types import SimpleNamespace

    from tracelens.session import shared_dir

    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(ValueError):
        shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=context))


def test_curve_rounds_half_to_even(spark):
    curve = spark.createDataFrame([(0, 0.25), (1, 0.75), (2, 1.0)], "minute long, load double")
    assert [r.n for r in workload.request_counts(curve, 2).orderBy("slot").collect()] == [0, 2, 2]


def test_scale_up_is_capped_and_dead_band_holds(spark):
    rows = spark.createDataFrame([("a", 1, 9.0, 0.1), ("b", 4, 0.85, 0.1), ("c", 9, 0.01, 0.01), ("d", 5, 1.6, 0.0), ("e", 5, 0.0, 0.0)], "msname string, replicas int, load_cpu double, load_mem double")
    got = {r.msname: (r.desired, r.limited) for r in scaling.desired_replicas(rows).collect()}
    assert got == {"a": (10, True), "b": (4, False), "c": (1, False), "d": (10, True), "e": (1, False)}


def test_only_a_positive_median_is_predictive(spark):
    rows = [("a", 30, 0.5, 0.4, 0.1, 0.9, 0.0), ("b", 30, 0.5, 0.4, 0.0, 0.9, 0.9), ("c", 3, 0.5, 0.4, 0.1, 0.9, 0.9)]
    rows = spark.createDataFrame(rows, "msname string, history int, cpu double, mem double, pred_cpu double, upper_cpu double, upper_mem double")
    got = {r.msname: (r.mode, r.load_cpu, r.load_mem) for r in scaling.chosen_load(rows, True, 24).collect()}
    assert got == {"a": ("predictive", 0.9, 0.0), "b": ("reactive", 0.5, 0.4), "c": ("waiting", 0.5, 0.4)}


def test_windows_are_ranked_by_oscillation_and_pattern(spark):
    rows = spark.createDataFrame([("a", 1, 0.5, 9.0, 0.4), ("b", 1, 0.2, 1.0, 0.9), ("c", 1, 0.9, 5.0, None)], "msname string, win_end long, oscillation double, avg_load double, pattern double")
    score = lambda mode: [(r.msname, r.score) for r in rolling.rank_windows(rows, mode, 5).collect()]
    assert score("both_pattern") == [("a", pytest.approx(0.2)), ("b", pytest.approx(0.18))]
    assert score("pattern") == [("b", 0.9), ("a", 0.4)]
    assert score("both") == [("a", 0.5), ("c", pytest.approx(0.45)), ("b", 0.0)]
    joined = rolling.with_pattern(rows.drop("pattern"), spark.createDataFrame([("a", 1, 0.7)], "msname string, t long, pattern double"))
    assert {r.msname: r.pattern for r in joined.collect()} == {"a": 0.7, "b": None, "c": None}


def test_newly_arrived_files_are_ingested_once(spark, tmp_path):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("timestamp", T.LongType()), T.StructField("msname", T.StringType())])
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text("timestamp,msname\n1,x\nbad,y\n")
    for _ in range(2):
        traces.ingest_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), schema).awaitTermination()
    (tmp_path / "in/b.csv").write_text("timestamp,msname\n2,z\n")
    traces.ingest_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), schema).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out"))
    assert rows.where("bad = 'false'").count() == 2 and rows.where("bad = 'true'").count() == 1


def test_windows_queries_have_full_inputs(spark, sf_dir):
    assert {len(r.x) for r in sq.hourly_windows(spark, sf_dir).select("x").collect()} == {sq.L}
