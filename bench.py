"""Runs headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line. With `--duckdb` it times their SQL twins there.

`--grow N FOLDER` writes tables with N times the events to FOLDER, for BENCH_SF_DIR; BENCH_SKIP names queries to leave out.
"""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tracelens.plans import all_queries, all_sql
from tracelens.session import build_session

HEADLINE = (
    "w1_w3_t2_ranked_oscillation",
    "p1_a6_a7_cpu_histogram",
    "a9_service_extremes",
    "a10_a11_j6_instance_stats",
    "a1_a2_bucket_mean",
    "j1_build_series",
    "j3_p9_merge_metrics",
    "w5_pattern_score",
    "d4_d5_d6_d8_windows",
    "c1_c5_instance_correlation",
    "c2_c5_lagged_correlation",
    "c3_j10_distance_correlation",
    "m6_empirical_quantiles",
    "m8_e4_cqr_interval_quality",
    "e1_point_metrics",
    "h3_stabilised",
    "l2_schedule",
)


def timed(run) -> float:
    """Median of $BENCH_RUNS runs, three by default, after one that warms up."""
    runs = []
    for _ in range(int(os.environ.get("BENCH_RUNS", "3")) + 1):
        began = time.perf_counter()
        run()
        runs.append(time.perf_counter() - began)
    return round(median(runs[1:]), 3)


def duckdb_times(sf_dir: str, cpus: int) -> dict[str, float]:
    import duckdb

    con = duckdb.connect(config={"threads": cpus})
    for table in ("customer", "supplier", "orders", "lineitem", "events"):
        path = f"{sf_dir}/{table}.parquet"
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return {name: timed(lambda name=name: con.execute(all_sql()[name]).fetchall()) for name in chosen()}


def chosen() -> list[str]:
    return [name for name in HEADLINE if name not in os.environ.get("BENCH_SKIP", "").split(",")]


def grow(spark: SparkSession, sf_dir: str, times: int, folder: str) -> None:
    """The tables in `folder`, with `times` runs of the events, each some days after the one before."""
    os.makedirs(folder)
    for file in os.listdir(sf_dir):
        if file != "events.parquet":
            os.symlink(f"{sf_dir}/{file}", f"{folder}/{file}")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    span = events.agg(F.date_diff(F.max("ts"), F.min("ts")) + 1, F.max("event_id") + 1).first()
    runs = events.join(spark.range(times).withColumnRenamed("id", "run"))
    later = runs.withColumns({"ts": F.expr(f"ts + make_dt_interval(cast(run * {span[0]} as int))"), "event_id": F.expr(f"event_id + run * {span[1]}")})
    later.select(events.columns).write.parquet(f"{folder}/events.parquet")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "4"))
    if "--duckdb" in sys.argv:
        print(json.dumps(duckdb_times(sf_dir, cpus)))
        return
    spark = build_session(f"local[{cpus}]", shuffle_partitions=cpus)
    if "--grow" in sys.argv:
        times, folder = sys.argv[sys.argv.index("--grow") + 1 :][:2]
        grow(spark, sf_dir, int(times), folder)
        return
    queries = all_queries()
    took = {name: timed(lambda name=name: queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()) for name in chosen()}
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
