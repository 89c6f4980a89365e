"""Streaming queries, run over what the tables hold and read back as tables."""

from __future__ import annotations

import gzip

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelens.operators import conformal
from tracelens.plans import forecast_queries as fq
from tracelens.plans import views
from tracelens.plans.registry import query
from tracelens.session import materialise, scratch
from tracelens.sources import files, traces
from tracelens.streaming import streams


def _written(df: DataFrame, mode: str = "append", path: str | None = None) -> DataFrame:
    """Drains a stream into a Parquet table in the shared folder; with the path of an earlier run it goes on from there."""
    spark = df.sparkSession
    path = path or scratch(spark, "out")
    q = df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


def _as_stream(spark: SparkSession, df: DataFrame) -> DataFrame:
    path = scratch(spark, "in")
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1000).parquet(path)


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table itself as a stream."""
    schema = views.table(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")  # a file or a folder of that name
    return rows.select(F.col("event_type").alias("msname"), F.col("ts").cast("timestamp").alias("ts"), (F.col("value") / 200.0).alias("cpu"))


@query("SELECT msname, count(*) AS n, R(sum(round(cpu, 9));R) AS cpu FROM means_hourly GROUP BY msname", digits=6)
def s3_ingested_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV files ingested as they arrive, half of them before the first run; rows that don't parse are set apart."""
    source, target = scratch(spark, "arrived"), scratch(spark, "ingested")
    rows = views.series_hourly(spark, sf_dir).select((F.col("t") * 1000).alias("timestamp"), "msname", F.round("cpu", 9).alias("cpu"), "pos")
    bad = rows.groupBy("msname").agg(F.lit("not a time").alias("timestamp"), F.lit(0.0).alias("cpu")).select("timestamp", "msname", "cpu")
    schema = T.StructType([T.StructField("timestamp", T.LongType()), T.StructField("msname", T.StringType()), T.StructField("cpu", T.DoubleType())])
    for part in (rows.where("pos % 2 = 0").drop("pos"), rows.where("pos % 2 = 1").drop("pos"), bad):
        part.write.mode("append").option("header", True).csv(source)
        for _ in range(2):  # the second run finds nothing new
            traces.ingest_stream(spark, source, target, f"{target}-state", schema).awaitTermination()
    good = spark.read.parquet(target).where("not bad")
    return good.groupBy("msname").agg(F.count(F.lit(1)).alias("n"), F.sum("cpu").alias("cpu"))


@query("SELECT 'read' AS status, count(*) AS n FROM means_hourly UNION ALL SELECT 'set apart', 2")
def s3_quarantined_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV files that arrive with one that breaks off and one that lacks a column: rows read, and files set apart."""
    source, target = scratch(spark, "arrived"), scratch(spark, "ingested")
    rows = views.series_hourly(spark, sf_dir).select((F.col("t") * 1000).alias("timestamp"), "msname", F.round("cpu", 9).alias("cpu"))
    schema = T.StructType([T.StructField("timestamp", T.LongType()), T.StructField("msname", T.StringType()), T.StructField("cpu", T.DoubleType())])
    rows.write.option("header", True).option("compression", "gzip").csv(source)
    system, path = files.filesystem(source)
    with system.open_output_stream(f"{path}/broken.csv.gz", compression=None) as out:
        out.write(gzip.compress(b"timestamp,msname,cpu\n1,a,0.5\n" * 1000)[:60])
    with system.open_output_stream(f"{path}/lacking.csv") as out:
        out.write(b"timestamp,msname\n1,a\n")
    for _ in range(2):  # the second run finds nothing new
        files.ingest_files(spark, source, target, f"{target}-state", schema, schema.names).awaitTermination()
    read = spark.read.parquet(f"{target}/rows").where("not bad").agg(F.lit("read").alias("status"), F.count(F.lit(1)).alias("n"))
    apart = spark.read.parquet(f"{target}/files").where("reason is not null").agg(F.lit("set apart").alias("status"), F.count(F.lit(1)).alias("n"))
    return read.unionByName(apart)


@query("WITH b AS (SELECT ts - ts % 3600 AS t, msname, avg(cpu) AS cpu, count(*) AS n FROM trace_hourly GROUP BY ALL), w AS (SELECT max(ts) AS last FROM trace_hourly) SELECT t, msname, R(cpu;R) AS cpu, n FROM b, w WHERE t + 3600 <= last - 3600")
def r1_r7_stream_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly buckets that the watermark has closed; equals the batch buckets of closed hours."""
    made = streams.stream_buckets(_samples(spark, sf_dir), "1 hour", "1 hour", {"cpu": F.avg("cpu"), "n": F.count(F.lit(1))})
    return _written(made).select(F.col("t").cast("long").alias("t"), "msname", "cpu", "n")


@query("SELECT count(CASE WHEN pos < 12 THEN 1 END) AS dropped, count(CASE WHEN pos >= 24 AND t + 3600 <= last - 3600 THEN 1 END) AS buckets FROM (SELECT *, max(t) OVER () AS last FROM series_hourly)")
def r7_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours that arrive when the watermark is far beyond them are dropped, and counted."""
    rows = views.series_hourly(spark, sf_dir).select("msname", "pos", F.timestamp_seconds("t").alias("ts"), "cpu")
    arrived, path, dropped = scratch(spark, "in"), scratch(spark, "out"), 0
    for part in (rows.where("pos >= 24"), rows.where("pos < 12")):
        part.drop("pos").write.mode("append").parquet(arrived)
        source = spark.readStream.schema(part.drop("pos").schema).parquet(arrived)
        made = streams.stream_buckets(source, "1 hour", "1 hour", {"cpu": F.avg("cpu")})
        q = made.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
        q.awaitTermination()
        dropped += streams.late_rows(q)
    return spark.read.parquet(path).agg(F.lit(dropped).cast("long").alias("dropped"), F.count(F.lit(1)).alias("buckets"))


@query("SELECT p.msname, p.ts AS made, a.ts AS ts, R(p.v;R) AS pred, R(a.v;R) AS y FROM (SELECT msname, t AS ts, cpu AS v FROM means_hourly) p JOIN (SELECT msname, t AS ts, cpu AS v FROM means_hourly) a ON a.msname = p.msname AND a.ts = p.ts + 18000")
def r3_matured_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.series_hourly(spark, sf_dir).select("msname", F.timestamp_seconds("t").alias("ts"), "cpu")
    predictions = _as_stream(spark, rows.withColumnRenamed("cpu", "pred"))
    actuals = _as_stream(spark, rows.withColumnRenamed("cpu", "y"))
    out = _written(streams.stream_mature(predictions, actuals, "5 HOURS", "30 days"))
    return out.select("msname", F.col("made").cast("long").alias("made"), F.col("ts").cast("long").alias("ts"), "pred", "y")


@query("SELECT msname, R(arg_max(cpu, (ts, cpu));R) AS cpu, count(cpu) AS valid_rows, max(ts) AS last_time FROM trace_hourly GROUP BY msname")
def r8_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = streams.stream_latest(_samples(spark, sf_dir).withColumn("ts", F.col("ts").cast("long")), ["cpu"])
    path = scratch(spark, "latest")
    write = lambda batch, _: batch.write.mode("overwrite").parquet(path)
    q = rows.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(rows.schema).parquet(path)


@query("WITH s AS (SELECT msname, t AS ts, count(*) OVER (PARTITION BY msname ORDER BY t ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS k, sum(cpu) OVER (PARTITION BY msname ORDER BY t ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS v FROM means_hourly) SELECT msname, ts, R(v;R) AS total FROM s WHERE k = 24", digits=8)
def r2_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.series_hourly(spark, sf_dir).select("msname", F.col("t").alias("ts"), F.col("cpu").alias("value"))
    with _rocksdb(spark):
        out = _written(streams.stream_history(_as_stream(spark, rows), 24))
    return out.select("msname", "ts", F.aggregate("history", F.lit(0.0), lambda a, v: a + v).alias("total"))


@query(fq._replay_sql(("cpu",), "SELECT s.msname, h.t AS ts, R(lo;R) AS lower, R(hi;R) AS upper FROM st s JOIN split_hourly h ON h.msname = s.msname AND h.pos = s.pos WHERE k > 0", live=True))
def r4_r6_stream_conformal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples and forecasts arrive in two halves; the second run goes on from the state, and the forecasts, that the first has left."""
    rows = materialise(fq.online_rows(spark, sf_dir).select("msname", F.timestamp_seconds("t").alias("ts"), "y", "q_lo", "q_hi", (F.col("split") == "val").alias("warmup")), "online")
    middle = rows.agg(F.timestamp_seconds((F.min(F.col("ts").cast("long")) + F.max(F.col("ts").cast("long"))) / 2)).first()[0]
    arrived, path = scratch(spark, "in"), scratch(spark, "out")
    with _rocksdb(spark):
        for part in (rows.where(F.col("ts") <= F.lit(middle)), rows.where(F.col("ts") > F.lit(middle))):
            part.write.mode("append").parquet(arrived)
            out = _written(streams.stream_conformal(spark.readStream.schema(rows.schema).parquet(arrived), conformal.AdaptiveConfig(), 3600 * fq.H, "1 hour"), path=path)
    return out


@query(f"WITH {fq.DESIRED} SELECT msname, ts, CASE WHEN desired > replicas THEN desired ELSE max(desired) OVER (PARTITION BY msname ORDER BY ts RANGE BETWEEN 10799 PRECEDING AND CURRENT ROW) END AS stable FROM f")
def r5_stream_stabilised(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fq.decisions(spark, sf_dir).select("msname", "ts", "replicas", "desired")
    with _rocksdb(spark):
        return _written(streams.stream_stabilise(_as_stream(spark, rows), 10_800))


class _rocksdb:  # noqa: N801
    """The RocksDB state store, which keyed state needs, while a stream runs."""

    KEY = "spark.sql.streaming.stateStore.providerClass"

    def __init__(self, spark: SparkSession) -> None:
        self.conf = spark.conf

    def __enter__(self) -> None:
        self.before = self.conf.get(self.KEY, None)
        self.conf.set(self.KEY, streams.ROCKSDB)

    def __exit__(self, *_: object) -> None:
        self.conf.set(self.KEY, self.before) if self.before else self.conf.unset(self.KEY)
