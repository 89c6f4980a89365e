"""Log sources: scaler logs, experiment logs, query-range JSON, access logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelens.functions.scalars import first_label, strip_hpa, strip_pod_suffix, wall_to_epoch
from tracelens.sources.traces import valid_files

MATRIX = "array<struct<metric:map<string,string>,values:array<array<string>>>>"


#: The labels that name a metric's entity, in order, and the namespace of series without one.
METRIC_LABELS = {
    "replicas": ("horizontalpodautoscaler", "hpa"),
    "rps": ("destination_workload",),
    "rps_http": ("destination_workload",),
    "rps_grpc": ("destination_workload",),
    "cpu": ("pod",),
    "memory": ("pod",),
}
NAMESPACE_LABELS = ("namespace", "destination_workload_namespace")
UNKNOWN = "unknown"


def read_scaler_log(spark: SparkSession, path: str, zone: str) -> DataFrame:
    """(msname, ts, numbers); rows whose wall clock can't be parsed go."""
    rows = spark.read.option("header", True).csv(path)
    numbers = [c for c in rows.columns if c not in ("timestamp", "msname")]
    parsed = rows.select("msname", wall_to_epoch(F.col("timestamp"), zone).alias("ts"), *[F.col(c).try_cast("double").alias(c) for c in numbers])
    return parsed.where("ts is not null")


def count_unparsed(spark: SparkSession, path: str, zone: str) -> DataFrame:
    rows = spark.read.option("header", True).csv(path)
    return rows.agg(F.count_if(wall_to_epoch(F.col("timestamp"), zone).isNull()).alias("unparsed"))


def read_experiment_logs(spark: SparkSession, path: str) -> DataFrame:
    """(deployment, timestamp, numbers): one CSV per deployment, named by its file; files without a timestamp column are skipped.

    Files may hold different columns; what a file lacks is null.
    """
    heads, _ = valid_files(spark, path, ["timestamp"])
    groups: dict[tuple[str, ...], list[str]] = {}
    for file, columns in heads.items():
        groups.setdefault(tuple(columns), []).append(file)
    out = spark.createDataFrame([], "deployment string, timestamp string")
    for columns, files in groups.items():
        schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
        rows = spark.read.schema(schema).option("header", True).csv(files).withColumn("deployment", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)\.csv", 1))
        numbers = [F.col(c).try_cast("double").alias(c) for c in columns if c != "timestamp"]
        out = out.unionByName(rows.select("deployment", "timestamp", *numbers), allowMissingColumns=True)
    return out.where("timestamp is not null")


def explode_matrix(results: DataFrame, metric: str, namespace: str, column: str = "result") -> DataFrame:
    """Query-range JSON text of a metric to (entity, namespace, ts, value).

    The entity is the first of the metric's labels that is there, else unknown; of a pod the last two parts of its name go,
    of an autoscaler its ending. The namespace is that of the series, of its destination, or the one given. A bad value is 0.
    """
    labels = METRIC_LABELS[metric]
    rows = results.select(F.explode(F.from_json(column, MATRIX)).alias("r"))
    name = F.coalesce(first_label(F.col("r.metric"), list(labels)), F.lit(UNKNOWN))
    plain = F.when(name == UNKNOWN, name).otherwise(strip_pod_suffix(name) if "pod" in labels else strip_hpa(name))
    points = rows.select(plain.alias("entity"), F.coalesce(first_label(F.col("r.metric"), list(NAMESPACE_LABELS)), F.lit(namespace)).alias("namespace"), F.explode("r.values").alias("v"))
    value = F.element_at("v", 2).try_cast("double")
    return points.select("entity", "namespace", F.element_at("v", 1).try_cast("double").cast("long").alias("ts"), F.coalesce(F.when(~F.isnan(value), value), F.lit(0.0)).alias("value"))


def parse_access_log(lines: DataFrame, column: str = "value") -> DataFrame:
    """(day, hour, minute, ok) of common-log lines, whose time stands in brackets; ok is false where it can't be read.

    The zone after the time is not looked at: a wall clock's day, hour and minute are asked for.
    """
    field = F.substring_index(F.substring_index(F.col(column), "]", 1), "[", -1)
    at = F.try_to_timestamp(F.substring_index(field, " ", 1), F.lit("dd/MMM/yyyy:HH:mm:ss"))
    return lines.select(F.day(at).alias("day"), F.hour(at).alias("hour"), F.minute(at).alias("minute"), F.when(F.col(column).isNotNull(), at.isNotNull()).alias("ok"))


def read_access_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_access_log(spark.read.text(path)).where("ok").drop("ok")
