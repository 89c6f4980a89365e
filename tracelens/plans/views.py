"""Telemetry views over the driver tables, once as DataFrames and once as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelens.functions.scalars import epoch_seconds
from tracelens.operators import series


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trace_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    mem = F.get_json_object("props", "$.k").cast("double") / 100.0
    return e.select(F.col("event_type").alias("msname"), F.col("user_id").alias("msinstanceid"), epoch_seconds(F.col("ts")).alias("ts"), (F.col("value") / 200.0).alias("cpu"), mem.alias("mem"))


def calls_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("msname"), epoch_seconds(F.col("ts")).alias("ts"), F.col("value").alias("http_mcr"), F.get_json_object("props", "$.k").cast("double").alias("providerrpc_mcr"))


def trace_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, orders, supplier = (table(spark, sf_dir, n) for n in ("lineitem", "orders", "supplier"))
    joined = line.join(orders, line["l_orderkey"] == orders["o_orderkey"]).join(supplier, line["l_suppkey"] == supplier["s_suppkey"])
    return joined.select(F.col("o_orderpriority").alias("msname"), F.col("l_suppkey").alias("msinstanceid"), F.col("s_nationkey").alias("nodeid"), epoch_seconds(F.col("l_shipdate")).alias("ts"), (F.col("l_quantity") / 50.0).alias("cpu"), ((F.col("l_discount") + 0.0) * 10.0).alias("mem"))


def calls_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("msname"), epoch_seconds(F.col("o_orderdate")).alias("ts"), F.col("o_totalprice").alias("http_mcr"))


def series_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per service and hour: mean cpu and mem of valid samples, positions and length."""
    means = series.bucket(series.valid_range(trace_hourly(spark, sf_dir)), ["msname"], "1h", {"cpu": F.avg("cpu"), "mem": F.avg("mem")})
    return series.with_positions(means)


def load_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.bucket(calls_hourly(spark, sf_dir), ["msname"], "1h", {"load": F.sum("http_mcr")})


def scaler_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = series.bucket(trace_hourly(spark, sf_dir), ["msname"], "1h", {"cpu": F.avg("cpu"), "mem": F.avg("mem"), "replicas": (1 + F.count_distinct("msinstanceid") % 10).cast("int")})
    return series.with_positions(rows)


def forecast_log(spark: SparkSession, sf_dir: str, horizon: int = 5) -> DataFrame:
    """(msname, pos, t, y, last, pred, q_lo, q50, q_hi, lower, upper): the value `horizon` hours ago, nudged, as the forecast."""
    w = Window.partitionBy("msname").orderBy("pos")
    last = F.lag("cpu", horizon).over(w)
    rows = series_hourly(spark, sf_dir).select("msname", "pos", "n", "t", F.col("cpu").alias("y"), last.alias("last"), F.lag("cpu", horizon + 1).over(w).alias("second_last")).where("last is not null and second_last is not null")
    rows = rows.withColumn("pred", 0.8 * F.col("last") + 0.1)
    return rows.withColumns({"q_lo": F.col("pred") - 0.1, "q50": F.col("pred"), "q_hi": F.col("pred") + 0.1, "lower": F.col("pred") - 0.1, "upper": F.col("pred") + 0.1})


CTES = {
    "trace_hourly": "SELECT event_type AS msname, user_id AS msinstanceid, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS ts, value / 200.0 AS cpu, CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100.0 AS mem FROM events",
    "calls_hourly": "SELECT event_type AS msname, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS ts, value AS http_mcr, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS providerrpc_mcr FROM events",
    "trace_daily": "SELECT o_orderpriority AS msname, l_suppkey AS msinstanceid, s_nationkey AS nodeid, CAST(floor(epoch_us(CAST(l_shipdate AS TIMESTAMP)) / 1000000) AS BIGINT) AS ts, l_quantity / 50.0 AS cpu, (l_discount + 0.0) * 10.0 AS mem FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey",
    "calls_daily": "SELECT o_orderpriority AS msname, CAST(floor(epoch_us(CAST(o_orderdate AS TIMESTAMP)) / 1000000) AS BIGINT) AS ts, o_totalprice AS http_mcr FROM orders",
    "means_hourly": "SELECT msname, ts - ts % 3600 AS t, avg(cpu) AS cpu, avg(mem) AS mem FROM trace_hourly WHERE cpu BETWEEN 0 AND 1 AND mem BETWEEN 0 AND 1 GROUP BY ALL",
    "series_hourly": "SELECT *, CAST(row_number() OVER (PARTITION BY msname ORDER BY t) - 1 AS BIGINT) AS pos, count(*) OVER (PARTITION BY msname) AS n FROM means_hourly",
    "load_hourly": "SELECT msname, ts - ts % 3600 AS t, sum(http_mcr) AS load FROM calls_hourly GROUP BY ALL",
    "scaler_rows": "SELECT msname, ts - ts % 3600 AS t, avg(cpu) AS cpu, avg(mem) AS mem, CAST(1 + count(DISTINCT msinstanceid) % 10 AS INTEGER) AS replicas FROM trace_hourly GROUP BY ALL",
    "scaler_log": "SELECT *, CAST(row_number() OVER (PARTITION BY msname ORDER BY t) - 1 AS BIGINT) AS pos, count(*) OVER (PARTITION BY msname) AS n FROM scaler_rows",
    "forecast_rows": "SELECT msname, pos, n, t, cpu AS y, lag(cpu, 5) OVER w AS last, lag(cpu, 6) OVER w AS second_last FROM series_hourly WINDOW w AS (PARTITION BY msname ORDER BY pos)",
    "forecast_log": "SELECT *, 0.8::DOUBLE * last + 0.1::DOUBLE AS pred, 0.8::DOUBLE * last + 0.1::DOUBLE - 0.1::DOUBLE AS q_lo, 0.8::DOUBLE * last + 0.1::DOUBLE AS q50, 0.8::DOUBLE * last + 0.1::DOUBLE + 0.1::DOUBLE AS q_hi, 0.8::DOUBLE * last + 0.1::DOUBLE - 0.1::DOUBLE AS lower, 0.8::DOUBLE * last + 0.1::DOUBLE + 0.1::DOUBLE AS upper FROM forecast_rows WHERE last IS NOT NULL AND second_last IS NOT NULL",
    "split_hourly": "SELECT *, CASE WHEN pos < floor(n * 0.7::DOUBLE) THEN 'train' WHEN pos < floor(n * (0.7::DOUBLE + 0.1::DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM series_hourly",
}


def with_views(sql: str) -> str:
    """The SQL behind the views it names, and those that these name."""
    needed, todo = set(), [sql]
    while todo:
        text = todo.pop()
        for name, body in CTES.items():
            if name not in needed and name in text:
                needed.add(name)
                todo.append(body)
    head = ", ".join(f"{n} AS ({b})" for n, b in CTES.items() if n in needed)
    body = sql.strip()
    if not head:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head}, {body[15:]}"
    return f"WITH {head}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {head} {body}"
