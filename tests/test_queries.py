"""Every registered telemetry query against its SQL twin on DuckDB."""

from __future__ import annotations

import math

import duckdb
import pytest

from tracelens.plans import all_queries, all_sql

#: Queries that SQL cannot express, and the tests that hold their numbers against a plain computation.
NUMERIC_TESTS = {
    "m4_linear_direct": "test_linear_heads_equal_normal_equations",
    "m4_trend_seasonal": "test_heads_equal_normal_equations",
    "g1_g2_wavelet_windows": "test_wavelets_keep_energy_and_turn_back",
    "g4_entropy_groups": "test_entropy_groups_query_takes_whole_series",
}
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def flat(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 5) + 0.0
    if isinstance(value, list):
        return tuple(flat(v) for v in value)
    return value


def order(row):
    return [str(v) for v in row if not isinstance(v, float)], [v for v in row if isinstance(v, float)]


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query_equals_its_sql(spark, duck, sf_dir, name):
    df = all_queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(flat(r[c]) for c in columns) for r in df.collect()), key=order)
    if name not in all_sql():
        assert got and name in NUMERIC_TESTS
        return
    cursor = duck.execute(all_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted((tuple(flat(dict(zip(names, r, strict=True))[c]) for c in columns) for r in cursor.fetchall()), key=order)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or (isinstance(x, float) and y is not None and math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-5)), (a, b)


def test_times_at_the_end_of_a_minute_equal_their_sql(spark, tmp_path):
    """Milliseconds go to the nearest: the last half of one before a minute ends belongs to the next minute."""
    ends = ["00:00:59.999499", "00:00:59.9995", "00:00:59.999999", "01:59:59.9996", "23:59:59.9995", "00:01:00", "00:01:00.0004", "12:00:30.4999"]
    rows = ", ".join(f"({i}, TIMESTAMP '2024-01-31 {t}')" for i, t in enumerate(ends))
    con = duckdb.connect()
    con.execute(f"CREATE TABLE events AS SELECT CAST(i AS BIGINT) AS event_id, t AS ts FROM (VALUES {rows}, (90, NULL)) x(i, t)")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet'")
    got = all_queries()["f4_f5_f6_times"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(all_sql()["f4_f5_f6_times"]).fetchall())
    assert len(got) == 9
