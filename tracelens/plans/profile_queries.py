"""Queries over raw samples: filters, bucket aggregates, joins, fleet profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelens.operators import profile, quantiles, series, telemetry
from tracelens.operators.rolling import active_services
from tracelens.plans import views
from tracelens.plans.registry import query
from tracelens.session import scratch


@query("SELECT CAST(b.bin AS INTEGER) AS bin, count(x.bin2) AS n FROM range(20) b(bin) LEFT JOIN (SELECT CAST(least(floor(cpu * 20), 19) AS INTEGER) AS bin2 FROM (SELECT msname, ts, avg(cpu) AS cpu FROM trace_hourly WHERE cpu BETWEEN 0 AND 1 AND mem BETWEEN 0 AND 1 GROUP BY ALL)) x ON x.bin2 = b.bin GROUP BY b.bin")
def p1_a6_a7_cpu_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid range, per-timestamp means, dense histogram."""
    return profile.histogram(profile.per_timestamp_means(series.valid_range(views.trace_hourly(spark, sf_dir))), "cpu", 20)


@query("SELECT R(avg(cpu);R) AS cpu, R(avg(mem);R) AS mem FROM (SELECT msname, ts, avg(cpu) AS cpu, avg(mem) AS mem FROM trace_hourly WHERE cpu BETWEEN 0 AND 1 AND mem BETWEEN 0 AND 1 GROUP BY ALL)")
def a6_two_level_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.per_timestamp_means(series.valid_range(views.trace_hourly(spark, sf_dir))).agg(F.avg("cpu").alias("cpu"), F.avg("mem").alias("mem"))


@query("SELECT list(n ORDER BY bin) AS counts FROM (SELECT b.bin, count(x.b2) AS n FROM range(10) b(bin) LEFT JOIN (SELECT CAST(least(floor(mem * 10), 9) AS INTEGER) AS b2 FROM trace_hourly WHERE mem BETWEEN 0 AND 1) x ON x.b2 = b.bin GROUP BY b.bin)")
def a7_histogram_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.histogram_list(profile.histogram(views.trace_hourly(spark, sf_dir), "mem", 10))


@query("WITH s AS (SELECT avg(load) AS v FROM load_hourly GROUP BY msname, t // 86400), e AS (SELECT min(v) AS lo, max(v) AS hi FROM s) SELECT CAST(b.bin AS INTEGER) AS bin, count(x.b2) AS n FROM range(12) b(bin) LEFT JOIN (SELECT CAST(least(floor((v - lo) / (hi - lo) * 12), 11) AS INTEGER) AS b2 FROM s, e) x ON x.b2 = b.bin GROUP BY b.bin")
def a8_auto_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = views.load_hourly(spark, sf_dir).groupBy("msname", F.expr("t div 86400").alias("d")).agg(F.avg("load").alias("v"))
    return profile.auto_histogram(daily, "v", 12)


@query("SELECT msname, R(max(cpu);R) AS max_cpu, R(min(cpu);R) AS min_cpu, R(max(mem);R) AS max_mem, R(min(mem);R) AS min_mem FROM (SELECT msname, ts, avg(cpu) AS cpu, avg(mem) AS mem FROM trace_daily WHERE cpu BETWEEN 0 AND 1 AND mem BETWEEN 0 AND 1 GROUP BY ALL) GROUP BY msname")
def a9_service_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.service_extremes(profile.per_timestamp_means(series.valid_range(views.trace_daily(spark, sf_dir))))


@query("WITH v AS (SELECT * FROM trace_daily WHERE cpu BETWEEN 0 AND 1 AND mem BETWEEN 0 AND 1), a AS (SELECT msname, avg(i) AS avg_instances FROM (SELECT msname, ts, count(DISTINCT msinstanceid) AS i FROM v GROUP BY ALL) GROUP BY msname), b AS (SELECT msname, count(DISTINCT msinstanceid) AS total_instances FROM v GROUP BY msname) SELECT a.msname, R(avg_instances;R) AS avg_instances, total_instances FROM a LEFT JOIN b USING (msname)")
def a10_a11_j6_instance_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.instance_stats(series.valid_range(views.trace_daily(spark, sf_dir)))


@query("WITH v AS (SELECT * FROM trace_hourly WHERE cpu BETWEEN 0 AND 1 AND mem BETWEEN 0 AND 1), b AS (SELECT msname, count(DISTINCT msinstanceid) AS total_instances FROM v GROUP BY msname) SELECT R(avg(total_instances);R) AS avg_total_instances, max(total_instances) AS max_total_instances, min(total_instances) AS min_total_instances FROM b")
def a12_fleet_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.fleet_summary(profile.instance_stats(series.valid_range(views.trace_hourly(spark, sf_dir))), ["total_instances"])


@query("SELECT t, msname, R(cpu;R) AS cpu, R(mem;R) AS mem FROM means_hourly")
def a1_a2_bucket_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.bucket(series.valid_range(views.trace_hourly(spark, sf_dir)), ["msname"], "1h", {"cpu": F.avg("cpu"), "mem": F.avg("mem")})


@query("SELECT t, msname, R(load;R) AS load FROM load_hourly")
def a3_a13_bucket_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.load_hourly(spark, sf_dir)


@query("SELECT ts - ts % 86400 AS t, msname, R(arg_max(cpu, (ts, cpu));R) AS cpu, R(arg_max(mem, (ts, mem));R) AS mem FROM (SELECT msname, ts, cpu, mem FROM trace_hourly) GROUP BY ALL")
def a4_last_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.bucket(views.trace_hourly(spark, sf_dir).drop("msinstanceid"), ["msname"], "1d")


@query("SELECT DISTINCT msname FROM trace_hourly")
def a14_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.trace_hourly(spark, sf_dir).select("msname").distinct().orderBy("msname")


@query("SELECT t, msname, R(avg(cpu);R) AS cpu FROM (SELECT ts - ts % 3600 AS t, msname, msinstanceid, avg(cpu) AS cpu FROM trace_hourly GROUP BY ALL) GROUP BY ALL")
def a15_mean_over_pods(spark: SparkSession, sf_dir: str) -> DataFrame:
    pods = series.bucket(views.trace_hourly(spark, sf_dir), ["msname", "msinstanceid"], "1h", {"cpu": F.avg("cpu")})
    return profile.mean_by(pods, ["t", "msname"], ["cpu"])


@query("SELECT msname, R(avg(cpu);R) AS avg, R(quantile_cont(cpu, 0.5);R) AS p50, R(quantile_cont(cpu, 0.95);R) AS p95, R(min(cpu);R) AS min, R(max(cpu);R) AS max FROM trace_hourly GROUP BY msname")
def a17_percentile_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.summary(views.trace_hourly(spark, sf_dir), "cpu", ["msname"])


@query("WITH s AS (SELECT msname, cpu, percent_rank() OVER (PARTITION BY msname ORDER BY cpu) AS r FROM trace_hourly) SELECT msname, count(*) AS n, R(avg(cpu);R) AS mean, true AS distinct_close, true AS p50_close, true AS p95_close FROM s GROUP BY msname")
def a11_a18_a5_folded_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of each day, added day by day, folded: counts and means are exact, distinct instances within 5 per cent, quantiles within 1 per cent of rank."""
    rows = views.trace_hourly(spark, sf_dir).withColumn("day", F.expr("ts div 86400"))
    path, args = scratch(spark, "sketches"), ("day", ["msname"], "msinstanceid", "cpu")
    middle = rows.agg(F.expr("(min(day) + max(day)) div 2")).first()[0]
    quantiles.add_parts(rows.where(F.col("day") <= middle), path, *args)
    quantiles.add_parts(rows, path, *args)  # the days that are there cost nothing
    got = quantiles.estimates(quantiles.fold(spark.read.parquet(path), ["msname"]), ["msname"], {"p50": 0.5, "p95": 0.95})
    at = lambda c, q: F.abs(F.avg((F.col("cpu") <= F.col(c)).cast("double")) - q) <= 0.01 + 1 / F.count(F.lit(1))
    exact = rows.join(F.broadcast(got), "msname").groupBy("msname").agg(F.count_distinct("msinstanceid").alias("instances"), at("p50", 0.5).alias("p50_close"), at("p95", 0.95).alias("p95_close"))
    near = F.abs(F.col("distinct") - F.col("instances")) <= 0.05 * F.col("instances")
    return got.join(exact, "msname").select("msname", "n", "mean", near.alias("distinct_close"), "p50_close", "p95_close")


@query("SELECT CAST(floor(greatest(0.0, least(1.0, cpu)) * 99) AS INTEGER) AS bin, count(*) AS n FROM trace_hourly WHERE cpu IS NOT NULL GROUP BY ALL")
def a18_histogram_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.sketch(views.trace_hourly(spark, sf_dir), "cpu", 100)


@query("WITH h AS (SELECT CAST(floor(greatest(0.0, least(1.0, cpu)) * 99) AS INTEGER) AS bin, count(*) AS n FROM trace_hourly GROUP BY ALL), c AS (SELECT bin, sum(n) OVER (ORDER BY bin) AS upto, sum(n) OVER () AS total FROM h) SELECT R(coalesce(min(bin) / 99.0, 0.5);R) AS quantile FROM c WHERE upto >= 0.95 * total")
def a19_sketch_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.sketch_quantile(profile.sketch(views.trace_hourly(spark, sf_dir), "cpu", 100), 0.95, 100)


@query("SELECT count(*) AS points, R(avg(replicas);R) AS avg_replicas, R(avg(cpu);R) AS avg_cpu, R(avg(mem);R) AS avg_mem FROM scaler_log")
def a20_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.overall(views.scaler_log(spark, sf_dir))


@query("SELECT t // 86400 AS d, R(avg(load);R) AS mean, R(stddev_pop(load);R) AS std, R(min(load);R) AS min, R(max(load);R) AS max, count(load) AS n FROM load_hourly GROUP BY ALL")
def a21_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.spread(views.load_hourly(spark, sf_dir).withColumn("d", F.expr("t div 86400")), "load", ["d"])


@query("WITH s AS (SELECT msname, cpu, row_number() OVER (PARTITION BY msname ORDER BY cpu) AS r, count(*) OVER (PARTITION BY msname) AS n FROM series_hourly) SELECT msname, R(cpu;R) AS quantile FROM s WHERE r = ceil((n - 1) * 0.9::DOUBLE) + 1")
def a22_higher_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.higher_quantile(views.series_hourly(spark, sf_dir), "cpu", 0.9, ["msname"])


@query("SELECT msname, count(*) AS n, CAST(count(*) - floor(0.8::DOUBLE * count(*)) AS BIGINT) AS test_n FROM load_hourly GROUP BY msname")
def a23_series_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.load_hourly(spark, sf_dir).groupBy("msname").agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) - F.floor(F.lit(0.8) * F.count(F.lit(1)))).cast("long").alias("test_n"))


@query("WITH c AS (SELECT msname AS series, t AS ts, sum(load) OVER (PARTITION BY msname ORDER BY t) % 100000 AS value FROM load_hourly), d AS (SELECT series, ts, value, value - lag(value) OVER w AS g, ts - lag(ts) OVER w AS p FROM c WINDOW w AS (PARTITION BY series ORDER BY ts)) SELECT ts, series AS workload, R(sum(CASE WHEN g < 0 THEN value ELSE g END / p);R) AS rate FROM d WHERE g IS NOT NULL GROUP BY ALL")
def a24_counter_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("msname").orderBy("t")
    counters = views.load_hourly(spark, sf_dir).select(F.col("msname").alias("series"), F.col("msname").alias("workload"), F.col("t").alias("ts"), (F.sum("load").over(w) % 100000).alias("value"))
    return profile.counter_rate(counters, "workload")


@query("SELECT t.msname, count(*) AS n FROM trace_hourly t WHERE msname IN (SELECT msname FROM load_hourly GROUP BY msname HAVING max(load) > 0) AND ts >= 1700000000 AND ts < 1900000000 GROUP BY ALL")
def p2_p3_services_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = series.between_times(views.trace_hourly(spark, sf_dir), 1_700_000_000, 1_900_000_000)
    return series.only_services(rows, active_services(views.load_hourly(spark, sf_dir))).groupBy("msname").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT msname, ts, R(http_mcr + providerrpc_mcr + 1.0;R) AS total_mcr FROM calls_hourly WHERE http_mcr IS NOT NULL AND providerrpc_mcr IS NOT NULL")
def p4_p5_total_mcr(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.calls_hourly(spark, sf_dir).withColumn("providermq_mcr", F.lit(1.0)).dropna(subset=["http_mcr", "providerrpc_mcr"])
    return series.total_mcr(rows).select("msname", "ts", "total_mcr")


@query("SELECT msname, t, R(least(cpu / ((CASE WHEN replicas = 0 THEN 1 ELSE replicas END) * (CASE msname WHEN 'click' THEN 0.5 ELSE 1.0 END)), 1.0);R) AS cpu FROM scaler_log", digits=12)
def p6_per_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.per_capacity(views.scaler_log(spark, sf_dir), "cpu", {"click": 0.5}).select("msname", "t", "cpu")


@query("WITH b AS (SELECT min(load) AS lo, max(load) AS hi FROM load_hourly) SELECT msname, t, R((load - lo) / (hi - lo);R) AS load FROM load_hourly, b")
def p7_global_min_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.min_max_global(views.load_hourly(spark, sf_dir), ["load"]).select("msname", "t", "load")


@query("SELECT msname, t, R(CASE WHEN max(load) OVER w = min(load) OVER w THEN 0.5 ELSE (load - min(load) OVER w) / (max(load) OVER w - min(load) OVER w) END;R) AS load FROM load_hourly WINDOW w AS (PARTITION BY msname)")
def p8_min_max_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.load_hourly(spark, sf_dir)
    return rows.select("msname", "t", series.min_max_within(rows, "load", "msname").alias("load"))


@query("SELECT msname, R(sum(CASE WHEN msname IN ('click', 'view') THEN http_mcr ELSE providerrpc_mcr END);R) AS rate FROM calls_hourly GROUP BY msname")
def p10_rate_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.calls_hourly(spark, sf_dir)
    return rows.groupBy("msname").agg(F.sum(series.rate_column(rows, ["click", "view"])).alias("rate"))


@query("WITH node AS (SELECT ts AS t, nodeid, avg(cpu) AS node_cpu FROM trace_daily GROUP BY ALL), s AS (SELECT ts AS t, msname, nodeid, avg(cpu) AS cpu FROM trace_daily GROUP BY ALL) SELECT t, nodeid, msname, R(cpu;R) AS cpu, R(node_cpu;R) AS node_cpu FROM s LEFT JOIN node USING (t, nodeid) WHERE cpu IS NOT NULL AND node_cpu IS NOT NULL")
def j1_build_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of services with those of their nodes on (t, nodeid)."""
    rows = views.trace_daily(spark, sf_dir)
    node = series.bucket(rows, ["nodeid"], "1d", {"node_cpu": F.avg("cpu")})
    service = series.bucket(rows, ["msname", "nodeid"], "1d", {"cpu": F.avg("cpu")})
    return series.build_series([service, node], ["nodeid"]).select("t", "nodeid", "msname", "cpu", "node_cpu")


@query("SELECT m.t, m.msname, R(cpu;R) AS cpu, R(mem;R) AS mem, R(load;R) AS load FROM means_hourly m LEFT JOIN load_hourly USING (t, msname) WHERE load IS NOT NULL")
def d1_series_with_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = series.bucket(series.valid_range(views.trace_hourly(spark, sf_dir)), ["msname"], "1h", {"cpu": F.avg("cpu"), "mem": F.avg("mem")})
    return series.build_series([means, views.load_hourly(spark, sf_dir)], ["msname"])


@query("WITH a AS (SELECT msname, ts // 60 AS m, arg_max(cpu, (ts, cpu)) AS cpu, msinstanceid AS i FROM trace_hourly GROUP BY msname, ts // 60, msinstanceid), b AS (SELECT event_type AS msname, user_id AS i, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) // 60 AS m, sum(value) AS load FROM events GROUP BY ALL) SELECT a.msname, count(*) AS n, R(sum(cpu * load);R) AS s FROM a JOIN b USING (msname, i, m) GROUP BY a.msname", digits=3)
def j2_w16_instance_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last value per service, instance and minute, joined on all three."""
    rows = views.trace_hourly(spark, sf_dir)
    last = series.bucket(rows.drop("mem"), ["msname", "msinstanceid"], "1m")
    load = series.bucket(rows, ["msname", "msinstanceid"], "1m", {"load": F.sum(F.col("cpu") * 200.0)})
    return last.join(load, ["t", "msname", "msinstanceid"]).groupBy("msname").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("cpu") * F.col("load")).alias("s"))


@query("WITH cpu AS (SELECT t, msname, cpu AS value FROM means_hourly), rep AS (SELECT t, msname, replicas AS value FROM scaler_log) SELECT coalesce(c.t, r.t) AS t, coalesce(c.msname, r.msname) AS msname, coalesce(round_even(c.value, 9), 0.0) AS cpu, CAST(coalesce(r.value, 0) AS INTEGER) AS replicas, 0.0::DOUBLE AS http_mcr FROM cpu c FULL JOIN rep r ON c.t = r.t AND c.msname = r.msname WHERE coalesce(c.msname, r.msname) <> 'error'")
def j3_p9_merge_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours with valid samples, and hours with any: the former lack some of the latter."""
    valid, log = views.series_hourly(spark, sf_dir), views.scaler_log(spark, sf_dir)
    frames = {"cpu": valid.select("t", "msname", F.col("cpu").alias("value")), "replicas": log.select("t", "msname", F.col("replicas").cast("double").alias("value"))}
    return telemetry.merge_metrics(frames, ["t", "msname"], every=["http_mcr"], digits=9, exclude="error")


@query("WITH a AS (SELECT msname, t AS ts, cpu AS value FROM means_hourly), b AS (SELECT msname, ts, max(mem) AS value FROM trace_hourly GROUP BY ALL), u AS (SELECT msname, ts FROM a UNION SELECT msname, ts FROM b), w AS (SELECT u.msname, u.ts, a.value AS cpu, b.value AS mem FROM u LEFT JOIN a USING (msname, ts) LEFT JOIN b USING (msname, ts)) SELECT msname, ts, R(last_value(cpu IGNORE NULLS) OVER o;R) AS cpu, R(last_value(mem IGNORE NULLS) OVER o;R) AS mem FROM w WINDOW o AS (PARTITION BY msname ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def j8_u2_locf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly means of one metric carried forward to the samples of another, and the other way round."""
    cpu = views.series_hourly(spark, sf_dir).select("msname", F.col("t").alias("ts"), F.col("cpu").alias("value"))
    mem = views.trace_hourly(spark, sf_dir).groupBy("msname", "ts").agg(F.max("mem").alias("value"))
    return telemetry.locf({"cpu": cpu, "mem": mem}, "msname")


@query("WITH s AS (SELECT msname, t, t - lag(t) OVER (PARTITION BY msname ORDER BY t) AS d FROM load_hourly), b AS (SELECT msname FROM s GROUP BY msname HAVING bool_or(d <> 3600) OR count(*) < 700) SELECT msname, count(*) AS n FROM load_hourly WHERE msname NOT IN (SELECT msname FROM b) GROUP BY ALL")
def j9_w9_d2_without_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.load_hourly(spark, sf_dir)
    return series.without_bad(rows, series.bad_services(rows, freq="1h", least=700)).groupBy("msname").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT a.msname, a.t, R(a.cpu / nullif(a.replicas, 0);R) AS ratio FROM scaler_log a")
def j12_usage_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = views.scaler_log(spark, sf_dir)
    return telemetry.usage_ratio(log.select("msname", "t", F.col("cpu").alias("value")), log.select("msname", "t", F.col("replicas").cast("double").alias("value")), ["msname", "t"])


@query("SELECT msname, t, R(cpu;R) AS cpu FROM (SELECT msname, ts - ts % 60 AS t, cpu, row_number() OVER (PARTITION BY msname, ts - ts % 60 ORDER BY ts, cpu) AS r FROM trace_hourly WHERE cpu IS NOT NULL) WHERE r = 1")
def w15_first_finite(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.trace_hourly(spark, sf_dir).select("msname", (F.col("ts") - F.col("ts") % 60).alias("t"), "cpu", F.struct("ts", "cpu").alias("o"))
    return telemetry.first_finite(rows, ["msname", "t"], ["cpu"], "o").select("msname", "t", "cpu")


@query("SELECT msname, 'hourly' AS kind, count(*) AS n FROM trace_hourly GROUP BY ALL UNION ALL SELECT msname, 'daily', count(*) FROM trace_daily GROUP BY ALL")
def u1_u3_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda df, kind: df.groupBy("msname").agg(F.count(F.lit(1)).alias("n")).select("msname", F.lit(kind).alias("kind"), "n")
    return count(views.trace_hourly(spark, sf_dir), "hourly").unionByName(count(views.trace_daily(spark, sf_dir), "daily"))


@query("SELECT event_type AS msname, count(*) AS n, R(avg(value);R) AS value FROM events WHERE value BETWEEN 0 AND 200 GROUP BY ALL")
def s5_s6_sql_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan as SQL text over a Parquet path: two columns read, the filter pushed."""
    return spark.sql("SELECT event_type AS msname, count(*) AS n, avg(value) AS value FROM {events} WHERE value BETWEEN 0 AND 200 GROUP BY ALL", events=views.table(spark, sf_dir, "events"))
