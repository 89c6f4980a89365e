from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelens.operators import dependence, forecast, series
from tracelens.plans import series_queries, views


def brute_entropy(v):
    n, r = len(v) - 2, 0.2 * np.std(v, ddof=1)
    near = lambda k: np.abs(v[k : k + n, None] - v[None, k : k + n]) <= r
    both = np.triu(near(0) & near(1), 1)
    a, b = np.sum(both & near(2)), np.sum(both)
    return -math.log(a / b)


def brute_dcor(x, y):
    def centred(v):
        d = np.abs(v[:, None] - v[None, :])
        return d - d.mean(0) - d.mean(1)[:, None] + d.mean()

    a, b = centred(x), centred(y)
    return math.sqrt(max((a * b).mean(), 0) / math.sqrt((a * a).mean() * (b * b).mean()))


def test_all_rows_of_a_long_series_count(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([np.sin(np.arange(600)), rng.normal(size=600)])  # the end is unlike the start
    y = np.concatenate([x[:600], rng.normal(size=600)])
    rows = spark.createDataFrame([("s", i, float(u), float(v)) for i, (u, v) in enumerate(zip(x, y, strict=True))], "msname string, pos long, x double, y double")
    assert dependence.distance_correlation(rows, "x", "y").first().dcor == pytest.approx(brute_dcor(x, y), abs=1e-6)
    assert dependence.sample_entropy(rows, "x", sample=2000).first().entropy == pytest.approx(brute_entropy(x), abs=1e-9)
    drawn = sorted(sorted(range(1200), key=lambda i: hashlib.md5(f"42|s|{i}".encode()).hexdigest())[:1000])
    assert dependence.sample_entropy(rows, "x").first().entropy == pytest.approx(brute_entropy(x[drawn]), abs=1e-9)


def test_distance_correlation_with_ties(spark):
    rng, rows, want = np.random.default_rng(2), [], {}
    for k, n in (("two", 2), ("odd", 37), ("ties", 64), ("more", 65)):
        x, y = rng.integers(0, 5, n).astype(float), rng.integers(0, 4, n).astype(float)
        want[k] = brute_dcor(x, y)
        rows += [(k, float(u), float(v)) for u, v in zip(x, y, strict=True)]
    df = spark.createDataFrame(rows, "msname string, x double, y double")
    assert {r.msname: r.dcor for r in dependence.distance_correlation(df, "x", "y").collect()} == pytest.approx(want, abs=1e-7)


def test_distance_correlation_far_from_zero(spark):
    """Distances don't change with an offset, and a series is fully dependent on itself."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=400)
    y = np.abs(x) + 0.3 * rng.normal(size=400)
    rows = [(f"{o:g}", float(u + o), float(v - o)) for o in (0, 1e6, 1e9) for u, v in zip(x, y, strict=True)] + [("self", float(u + 1e7), float(u + 1e7)) for u in x]
    got = {r.msname: r.dcor for r in dependence.distance_correlation(spark.createDataFrame(rows, "msname string, x double, y double"), "x", "y").collect()}
    want = brute_dcor(x, y)
    assert got == {"0": pytest.approx(want, abs=1e-9), "1e+06": pytest.approx(want, abs=1e-8), "1e+09": pytest.approx(want, abs=1e-6), "self": pytest.approx(1, abs=1e-9)}
    assert max(got.values()) <= 1


def test_distance_correlation_by_windows_equals_arrays(spark, monkeypatch):
    """Long keys go through windows, short ones through arrays; null keys are a key, nulls and NaN are passed over."""
    rng, rows, want = np.random.default_rng(4), [], {}
    for k, n in ((None, 90), ("long", 130), ("short", 9), ("one", 1)):
        x, y = rng.normal(size=n), rng.integers(0, 5, n).astype(float)
        y += np.abs(x)
        want[k] = brute_dcor(x, y) if n > 1 else 0.0
        rows += [(k, "p", float(u), float(v)) for u, v in zip(x, y, strict=True)] + [(k, "p", math.nan, 1.0), (k, "p", 2.0, None)]
    df = spark.createDataFrame(rows, "msname string, pair string, x double, y double")
    for most in (500_000, 10):
        monkeypatch.setattr(dependence, "SERIES", most)
        got = dependence.distance_correlation(df, "x", "y", ["msname", "pair"])
        assert {r.msname: r.dcor for r in got.collect()} == pytest.approx(want, abs=1e-9)
    assert dependence.distance_correlation(df.limit(0), "x", "y").collect() == []


def test_linear_heads_equal_normal_equations(spark):
    """Ridge regression on standardised inputs with an intercept, solved directly."""
    rng = np.random.default_rng(6)
    rows = []
    for i in range(80):
        x = rng.normal(size=(4, 2))
        y = [[float(x[:, 0].sum() + 0.1 * rng.normal())], [float(x[-1, 1] - x[0, 0] + 0.1 * rng.normal())]]
        rows.append(("s", "train" if i < 60 else "test", i, x.tolist(), y))
    df = spark.createDataFrame(rows, "msname string, split string, win_start long, x array<array<double>>, y array<array<double>>")
    got = {(r.win_start, r.h): r.pred for r in forecast.linear_direct(df).collect()}
    flat = np.array([np.ravel(r[3]) for r in rows])
    train = flat[:60]
    spread = train.std(axis=0, ddof=1)
    z, mean = (train - train.mean(axis=0)) / spread, train.mean(axis=0)
    for h in (1, 2):
        y = np.array([r[4][h - 1][0] for r in rows])
        scale = y[:60].std(ddof=1)
        beta = np.linalg.solve(z.T @ z / 60 + 1e-3 / scale * np.eye(8), z.T @ (y[:60] - y[:60].mean()) / 60)
        pred = y[:60].mean() + ((flat - mean) / spread) @ beta
        assert [got[i, h] for i in range(80)] == pytest.approx(pred, abs=2e-3)


def test_entropy_groups_query_takes_whole_series(spark, monkeypatch):
    seen, sf_dir = [], "/root/testdata/sf0.01"
    monkeypatch.setattr(dependence, "entropy_groups", lambda rows, entropy, **_: seen.append(entropy) or entropy)
    series_queries.g4_entropy_groups(spark, sf_dir)
    rows = series.with_positions(views.load_hourly(spark, sf_dir))
    want = {r.msname: np.array([p.load for p in sorted(r.s)]) for r in rows.groupBy("msname").agg(F.collect_list(F.struct("pos", "load")).alias("s")).collect()}
    assert max(map(len, want.values())) > 300
    for r in seen[0].collect():
        assert r.entropy == pytest.approx(brute_entropy(want[r.msname]), abs=1e-6)
