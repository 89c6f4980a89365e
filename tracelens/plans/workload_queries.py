"""Queries over logs and workload curves, scalar functions, sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelens.functions import scalars
from tracelens.operators import series, windows, workload
from tracelens.plans import views
from tracelens.plans.registry import query
from tracelens.plans.series_queries import WINDOWS, hourly_windows
from tracelens.session import materialise, scratch
from tracelens.sources import catalog, files, logs, tables, traces


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as common-log lines, every 50th malformed."""
    e = views.table(spark, sf_dir, "events")
    stamp = F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss")
    line = F.concat(F.lit("host - - ["), F.when(F.col("event_id") % 50 == 0, F.lit("?")).otherwise(stamp), F.lit(' +0000] "GET / HTTP/1.0" 200 1'))
    return e.select(line.alias("value"))


#: The zone whose wall clock logs are written in.
ZONE = "Asia/Kolkata"
COUNTS = "counts AS (SELECT (day(ts) - 1) * 1440 + hour(ts) * 60 + minute(ts) AS minute, count(*) AS n FROM events WHERE event_id % 50 <> 0 GROUP BY ALL)"
CURVE = f"{COUNTS}, filled AS (SELECT CAST(r.m AS BIGINT) AS minute, coalesce(n, 0) AS n FROM range(0, (SELECT max(minute) // 1440 + 1 FROM counts) * 1440) r(m) LEFT JOIN counts ON counts.minute = r.m), curve AS (SELECT minute, n::DOUBLE / max(n) OVER () AS load FROM filled)"


@query(f"WITH {COUNTS} SELECT CAST(minute AS BIGINT) AS minute, n FROM counts")
def s10_a16_f2_requests_per_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "log")
    log_lines(spark, sf_dir).write.option("compression", "gzip").text(path)
    return workload.requests_per_minute(logs.read_access_log(spark, path))


@query(f"WITH {CURVE} SELECT minute, R(load;R) AS load FROM curve")
def w14_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curve(spark, sf_dir)


def curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The load curve; the counts per minute, at most those of a month, are made once."""
    counts = workload.requests_per_minute(logs.parse_access_log(log_lines(spark, sf_dir)).where("ok"))
    return workload.build_curve(materialise(counts.coalesce(1), "counts"), 1)


REQUESTS = f"{CURVE}, part AS (SELECT minute - 600 AS slot, load / (max(load) OVER ()) AS l FROM curve WHERE minute >= 600 AND minute < 1800), req AS (SELECT slot, CAST(greatest(round_even(l * 30, 0), 0) AS BIGINT) AS n FROM part)"


@query(f"WITH {REQUESTS} SELECT slot, n FROM req")
def l1_request_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workload.request_counts(curve(spark, sf_dir), 30, 600, 1200)


@query(f"WITH {REQUESTS}, s AS (SELECT slot, n, unnest(range(0, n)) AS s FROM req) SELECT slot, s, R(slot * 60 + s * 60.0::DOUBLE / n;R) AS at, s % 7 AS owner FROM s")
def l2_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workload.schedule(workload.request_counts(curve(spark, sf_dir), 30, 600, 1200), 7)


@query(f"WITH {REQUESTS} SELECT slot, n AS expected, CASE WHEN slot % 3 = 0 THEN 0 ELSE n END AS actual FROM req WHERE slot % 3 = 0 AND n <> 0")
def l3_count_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = workload.request_counts(curve(spark, sf_dir), 30, 600, 1200)
    return workload.count_mismatches(counts, counts.where("slot % 3 <> 0"))


@query("SELECT msname, t, R(round(cpu, 9);R) AS cpu FROM series_hourly")
def s1_s2_k6_csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trace written as CSV, with one file that lacks a column, and ingested again."""
    path = scratch(spark, "trace")
    rows = views.series_hourly(spark, sf_dir).select((F.col("t") * 1000).alias("timestamp"), "msname", F.lit("i").alias("msinstanceid"), F.round("cpu", 9).alias("cpu_utilization"))
    tables.write_csv(rows, f"{path}/good")
    tables.write_csv(rows.drop("cpu_utilization").limit(5), f"{path}/lacking")
    back = traces.read_csv_trace(spark, f"{path}/*/*.csv", ["msname", "msinstanceid"], ["cpu_utilization"])
    return back.select("msname", F.expr("timestamp div 1000").alias("t"), F.col("cpu_utilization").alias("cpu"))


@query("WITH p AS (SELECT event_id, (CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) - min(CAST(floor(epoch_us(ts) / 1000000) AS BIGINT)) OVER ()) // 1800 AS part FROM events) SELECT CAST(part AS INTEGER) AS part, count(*) AS n FROM p WHERE part BETWEEN 48 AND 95 GROUP BY part")
def s4_part_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples in files of 30 minutes each; those of the second day are read, from files chosen by the index in their names."""
    path, begin = _part_files(spark, sf_dir)
    picked = files.read_parts(spark, path, "timestamp long", 30, begin=str(begin), start="1d0", end="2d0")
    return picked.groupBy(F.expr(f"cast((timestamp - {begin}) div 1800000 as int)").alias("part")).agg(F.count(F.lit(1)).alias("n"))


@query("WITH p AS (SELECT event_type, value, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS tm, min(CAST(floor(epoch_us(ts) / 1000000) AS BIGINT)) OVER () AS b FROM events) SELECT event_type AS msname, count(*) AS n, R(avg(value / 200.0);R) AS cpu FROM p WHERE tm >= b + 100000 AND tm < b + 250000 GROUP BY event_type")
def s5_pushed_time_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A comparison of times in a query chooses the files, three columns of which are read."""
    path, begin = _part_files(spark, sf_dir)
    rows = files.read_parts(spark, path, "timestamp long, msname string, cpu double", 30, begin=str(begin))
    some = rows.where((F.col("timestamp") >= begin + 100_000_000) & (F.col("timestamp") < begin + 250_000_000))
    return some.groupBy("msname").agg(F.count(F.lit(1)).alias("n"), F.avg("cpu").alias("cpu"))


def _part_files(spark: SparkSession, sf_dir: str) -> tuple[str, int]:
    """The events as part files of 30 minutes each, and the time in ms at which the first begins."""
    path, e = scratch(spark, "parts"), views.table(spark, sf_dir, "events")
    rows = e.select((scalars.epoch_seconds(F.col("ts")) * 1000).alias("timestamp"), F.col("event_type").alias("msname"), F.col("user_id").alias("msinstanceid"), (F.col("value") / 200.0).alias("cpu"))
    begin = rows.agg(F.min("timestamp")).first()[0]
    files.write_part_files(rows.withColumn("part", F.expr(f"(timestamp - {begin}) div 1800000")), path, "MSResource", "part")
    return path, begin


def _scaler_csv(spark: SparkSession, sf_dir: str) -> str:
    """A scaler log in a zone's wall clock, every tenth stamp unreadable."""
    path, log = scratch(spark, "scaler"), views.scaler_log(spark, sf_dir)
    stamp = F.when(F.col("pos") % 10 == 0, F.lit("never")).otherwise(scalars.epoch_to_wall(F.col("t"), ZONE))
    tables.write_csv(log.select(stamp.alias("timestamp"), "msname", "cpu", "mem", "replicas"), path)
    return path


@query("SELECT msname, t AS ts, R(cpu;R) AS cpu FROM scaler_log WHERE pos % 10 <> 0")
def s7_f6_scaler_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.read_scaler_log(spark, _scaler_csv(spark, sf_dir), ZONE).select("msname", "ts", "cpu")


@query("SELECT count(*) AS unparsed FROM scaler_log WHERE pos % 10 = 0")
def s7_unparsed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.count_unparsed(spark, _scaler_csv(spark, sf_dir), ZONE)


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id WHEN event_id % 3 = 1 THEN CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) END AS at FROM events")
def f6_time_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers, wall clocks and neither as time arguments."""
    e = views.table(spark, sf_dir, "events")
    wall = scalars.epoch_to_wall(scalars.epoch_seconds(F.col("ts")), ZONE)
    text = F.when(F.col("event_id") % 3 == 0, F.col("event_id").cast("string")).when(F.col("event_id") % 3 == 1, wall).otherwise(F.lit("soon"))
    return e.select("event_id", scalars.parse_time_argument(text, ZONE).alias("at"))


@query("SELECT msname AS deployment, count(*) AS n, R(sum(cpu);R) AS cpu, R(sum(CASE WHEN msname <> 'click' THEN mem END);R) AS memory FROM scaler_log GROUP BY msname", digits=6)
def s8_experiment_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One CSV per deployment, named by its file, one of them with fewer columns; a file without a timestamp is skipped."""
    path, log = scratch(spark, "experiments"), views.scaler_log(spark, sf_dir).select(F.col("t").cast("string").alias("timestamp"), "cpu", F.col("mem").alias("memory"), "msname")
    for name in [r.msname for r in log.select("msname").distinct().collect()]:  # names of deployments
        one = log.where(F.col("msname") == name).drop("msname", *(["memory"] if name == "click" else []))
        tables.write_one_csv(one, f"{path}/{name}.csv")
    tables.write_one_csv(log.select("cpu"), f"{path}/lacking.csv")
    rows = logs.read_experiment_logs(spark, f"{path}/*.csv")
    return rows.groupBy("deployment").agg(F.count(F.lit(1)).alias("n"), F.sum("cpu").alias("cpu"), F.sum("memory").alias("memory"))


def _matrix(metric: Column, log: DataFrame, value: Column) -> DataFrame:
    points = log.groupBy("msname").agg(F.collect_list(F.array(F.col("t").cast("string"), value)).alias("values"))
    return points.select(F.to_json(F.array(F.struct(metric.alias("metric"), "values"))).alias("result"))


@query("SELECT metric, entity, namespace, ts, CASE WHEN pos % 7 = 0 THEN 0.0::DOUBLE ELSE round(cpu, 9) END AS value FROM (SELECT t AS ts, pos, cpu, unnest([{'metric': 'cpu', 'entity': msname, 'namespace': 'prod'}, {'metric': 'rps', 'entity': CASE WHEN msname = 'click' THEN 'unknown' ELSE msname END, 'namespace': 'mesh'}, {'metric': 'replicas', 'entity': msname, 'namespace': 'given'}], recursive := true) FROM scaler_log)")
def s9_f1_f11_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series of three metrics as query-range JSON texts, bad values among them, and back; each has labels of its own."""
    log = views.scaler_log(spark, sf_dir)
    value = F.when(F.col("pos") % 7 == 0, F.lit("bad")).otherwise(F.round("cpu", 9).cast("string"))
    text = lambda s: F.lit(s)
    metrics = {
        "cpu": F.create_map(text("pod"), F.concat("msname", F.lit("-7f9c-x2k")), text("namespace"), text("prod")),
        "rps": F.create_map(F.when(F.col("msname") == "click", "workload").otherwise("destination_workload"), F.col("msname"), text("destination_workload_namespace"), text("mesh")),
        "replicas": F.create_map(text("hpa"), F.concat("msname", F.lit("-hpa"))),
    }
    out = None
    for name, labels in metrics.items():
        one = logs.explode_matrix(_matrix(labels, log, value), name, "given").withColumn("metric", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT name, list_aggregate(list_transform(regexp_extract_all(name, '[0-9]+|[^0-9]+'), lambda r: CASE WHEN regexp_matches(r, '^[0-9]') THEN lpad(r, 12, '0') ELSE r END), 'string_agg', '') AS key, regexp_replace(name, '-hpa$', '') AS plain, array_to_string(string_split(name, '-')[:-3], '-') AS stem FROM (SELECT DISTINCT 'shard-' || CAST(user_id AS VARCHAR) || '-a' || CAST(user_id % 3 AS VARCHAR) || '-hpa' AS name FROM events)")
def f1_f3_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.table(spark, sf_dir, "events")
    name = F.concat(F.lit("shard-"), F.col("user_id").cast("string"), F.lit("-a"), (F.col("user_id") % 3).cast("string"), F.lit("-hpa"))
    rows = e.select(name.alias("name")).distinct()
    return rows.select("name", scalars.natural_key(F.col("name")).alias("key"), scalars.strip_hpa(F.col("name")).alias("plain"), scalars.strip_pod_suffix(F.col("name")).alias("stem"))


@query("SELECT event_id, (epoch_ms(ts) // 60000) * 60000 AS minute, (CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) // 7200) * 7200 AS two_hours, strftime(ts + INTERVAL 330 MINUTE, '%Y-%m-%d %H:%M:%S') AS wall FROM events")
def f4_f5_f6_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.table(spark, sf_dir, "events")
    sec = scalars.epoch_seconds(F.col("ts"))
    return e.select("event_id", scalars.floor_ms_to_minute(scalars.epoch_millis(F.col("ts"))).alias("minute"), scalars.floor_to(sec, "2h").alias("two_hours"), scalars.epoch_to_wall(sec, ZONE).alias("wall"))


@query("SELECT event_id, R(round_even(value, 0);R) AS even, CAST(sign(value - 100) AS DOUBLE) AS sign, CAST(ceil(value / 7) AS BIGINT) AS up, R(value / nullif(user_id % 3, 0);R) AS safe FROM events")
def f7_f8_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.table(spark, sf_dir, "events")
    return e.select("event_id", F.bround("value", 0).alias("even"), F.signum(F.col("value") - 100).alias("sign"), F.ceil(F.col("value") / 7).alias("up"), F.try_divide("value", F.col("user_id") % 3).alias("safe"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def f10_nested_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.table(spark, sf_dir, "events")
    envelope = F.to_json(F.struct(F.col("props").alias("payload")))
    return e.select("event_id", scalars.nested_json(envelope, "$.payload", "$.k").alias("k"))


@query("SELECT 'cpu_mem_http_rpc' AS name, msname, count(*) AS n, R(avg(cpu);R) AS cpu_utilization, R(avg(mem);R) AS memory_utilization, R(sum(http_mcr);R) AS http_mcr, R(sum(providerrpc_mcr);R) AS providerrpc_mcr FROM trace_hourly JOIN (SELECT msname, sum(http_mcr) AS http_mcr, sum(providerrpc_mcr) AS providerrpc_mcr FROM calls_hourly GROUP BY msname) USING (msname) GROUP BY msname, http_mcr, providerrpc_mcr".replace("R(sum(http_mcr);R)", "R(http_mcr;R)").replace("R(sum(providerrpc_mcr);R)", "R(providerrpc_mcr;R)"), digits=6)
def s12_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feature set resolved to tables, columns and aggregates."""
    chosen = catalog.feature_set("cpu_mem_http_rpc")
    raw = {
        "msresource": views.trace_hourly(spark, sf_dir).select("msname", F.col("cpu").alias("cpu_utilization"), F.col("mem").alias("memory_utilization")),
        "msrtmcre": views.calls_hourly(spark, sf_dir),
    }
    out = None
    for table in chosen.tables:
        aggregates = [a.alias(f) for f, a in chosen.aggregates(table).items()]
        one = raw[table].groupBy("msname").agg(*([F.count(F.lit(1)).alias("n")] if out is None else []), *aggregates)
        out = one if out is None else out.join(one, "msname")
    return out.withColumn("name", F.lit(chosen.name))


@query("SELECT msname, t, pos, R(cpu;R) AS cpu, CAST(greatest(1, first_value(replicas) OVER (PARTITION BY msname ORDER BY pos)) AS INTEGER) AS base_replicas FROM scaler_log")
def s13_k3_series_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A series made once, read from its keyed cache, with each service's base replicas."""
    folder = scratch(spark, "cache")
    source = views.table(spark, sf_dir, "events")
    for _ in range(2):
        kept = tables.cached(spark, folder, "series", source, {"freq": "1h"}, lambda: views.scaler_log(spark, sf_dir))
    return tables.read_series(kept, ["cpu"], kept.select("msname", "pos", "replicas"))


@query("SELECT msname, count(*) AS n FROM trace_hourly GROUP BY msname")
def k4_k5_cached_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the services listed in a cache, which is read twice, cleared, made again and passed over."""
    folder, rows = scratch(spark, "services"), views.trace_hourly(spark, sf_dir)
    made = [tables.distinct_services(spark, folder, rows) for _ in range(2)]
    if made[0].count() != made[1].count() or not tables.clear_cache(spark, folder):
        raise ValueError("the cache of services was not kept")
    again = tables.distinct_services(spark, folder, rows)
    straight = tables.cached(spark, folder, "other", rows, {}, lambda: rows.select("msname").distinct(), disabled=True)
    return series.only_services(series.only_services(rows, again), straight).groupBy("msname").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT msname, R(avg(cpu);R) AS cpu, count(*) AS n FROM trace_hourly GROUP BY msname", digits=8)
def k6_json_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result table as JSON, and back."""
    path, rows = scratch(spark, "results"), views.trace_hourly(spark, sf_dir)
    made = rows.groupBy("msname").agg(F.avg("cpu").alias("cpu"), F.count(F.lit(1)).alias("n"))
    tables.write_json(made, path)
    return spark.read.schema(made.schema).json(path)


@query(f"WITH {WINDOWS} SELECT msname, split, win_start FROM w WHERE split = 'test'")
def k1_k2_s11_written_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows written by split, written again, and one split read."""
    path = scratch(spark, "windows")
    for _ in range(2):
        tables.write_windows(hourly_windows(spark, sf_dir), path)
    return tables.read_windows(spark, path, "test").select("msname", "split", "win_start")


@query(f"WITH {WINDOWS} SELECT msname, split, win_start, R(list_sum(xc);R) AS x_cpu FROM w")
def k2_window_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows written by split and group of services; one group is written again, the others are left as they are."""
    path, made = scratch(spark, "groups"), materialise(hourly_windows(spark, sf_dir), "windows")
    tables.write_window_groups(made, path, 4)
    tables.write_window_groups(made, path, 4, again=(1,))
    rows = spark.read.parquet(path).select("msname", "split", "win_start", "x")
    return rows.select("msname", "split", "win_start", F.aggregate("x", F.lit(0.0), lambda s, v: s + v[0]).alias("x_cpu"))


@query("SELECT msname, t, R(load;R) AS load FROM load_hourly WHERE t >= 1704067200")
def k1_sorted_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "parts")
    traces.write_parts(views.load_hourly(spark, sf_dir), path, 4, ["t", "msname"])
    return traces.scan_parts(spark, path, ["msname", "t", "load"]).where("t >= 1704067200")


@query("WITH g AS (SELECT msname FROM (SELECT msname, t, lag(t) OVER (PARTITION BY msname ORDER BY t) AS b FROM scaler_log) GROUP BY msname HAVING count(*) < 29 OR bool_or(t - b <> 3600)), z AS (SELECT msname, t, pos, n, (cpu - min(cpu) OVER ()) / (max(cpu) OVER () - min(cpu) OVER ()) AS cpu, mem FROM (SELECT msname, t, pos, n, round(cpu, 12) AS cpu, round(mem, 12) AS mem FROM scaler_log)), k AS (SELECT *, CASE WHEN pos < floor(n * 0.7::DOUBLE) THEN 'train' WHEN pos < floor(n * (0.7::DOUBLE + 0.1::DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM z WHERE msname NOT IN (SELECT msname FROM g)), w0 AS (SELECT msname, split, list(cpu ORDER BY pos) AS c, list(mem ORDER BY pos) AS m, list(t ORDER BY pos) AS t FROM k GROUP BY ALL HAVING count(*) >= 29), w1 AS (SELECT *, unnest(range(0, len(c) - 29 + 1, 5)) AS i FROM w0) SELECT msname, split, t[i + 1] AS win_start, R(list_sum(c[i + 1:i + 24]);R) AS x_cpu, R(list_sum(m[i + 25:i + 29]);R) AS y_mem FROM w1")
def d11_log_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scaler log read from CSV, scaled over all services before any row goes, without gapped or short ones, to windows."""
    path, log = scratch(spark, "scaler"), views.scaler_log(spark, sf_dir)
    stamp = scalars.epoch_to_wall(F.col("t"), ZONE)
    tables.write_csv(log.select(stamp.alias("timestamp"), "msname", F.round("cpu", 12).alias("cpu"), F.round("mem", 12).alias("mem")), path)
    rows = series.min_max_global(logs.read_scaler_log(spark, path, ZONE), ["cpu"]).withColumnRenamed("ts", "t")
    rows = series.with_positions(series.without_bad(rows, series.bad_services(rows, freq="1h", least=29)))
    made = windows.windowize(series.assign_split(rows), 24, 5, 5, ["cpu", "mem"], ["cpu", "mem"])
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v)
    return made.select("msname", "split", "win_start", total(windows.channel(F.col("x"), 0)).alias("x_cpu"), total(windows.channel(F.col("y"), 1)).alias("y_mem"))


@query("SELECT msname, R((cpu - lo) / (hi - lo);R) AS cpu, t FROM (SELECT msname, t, cpu, min(cpu) OVER () AS lo, max(cpu) OVER () AS hi FROM scaler_log) WHERE t % 7200 = 0")
def d11_log_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log's columns scaled over all services before any row goes."""
    return series.min_max_global(views.scaler_log(spark, sf_dir), ["cpu"]).where("t % 7200 = 0").select("msname", "cpu", "t")


@query("SELECT DISTINCT msname, first_value(t) OVER (PARTITION BY msname ORDER BY t) AS t FROM load_hourly")
def t1_sorted_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = Window.partitionBy("msname").orderBy("t")
    rows = views.load_hourly(spark, sf_dir).withColumn("_r", F.row_number().over(first)).where("_r = 1")
    return rows.select("msname", "t").orderBy("msname", "t")
