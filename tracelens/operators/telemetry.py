"""Metric frames: joins, as-of alignment, deduplication, normalisation, ratios."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge_metrics(frames: dict[str, DataFrame], keys: list[str], every: list[str] | None = None, digits: int = 6, exclude: str | None = None) -> DataFrame:
    """Full outer join of (keys, value) frames into a column each: one union and one grouping instead of n - 1 joins.

    Missing values, and columns of `every` that have no frame, are 0; values are rounded half to even; replicas are whole.
    """
    long = reduce(DataFrame.unionByName, [f.select(*keys, F.lit(n).alias("_m"), "value") for n, f in frames.items()])
    names = list(dict.fromkeys([*frames, *(every or [])]))
    wide = long.groupBy(*keys).agg(*[F.coalesce(F.bround(F.max(F.when(F.col("_m") == n, F.col("value"))), digits), F.lit(0.0)).alias(n) for n in names])
    if "replicas" in names:
        wide = wide.withColumn("replicas", F.col("replicas").cast("int"))
    return wide if exclude is None else wide.where(F.col(keys[-1]) != exclude)


def locf(frames: dict[str, DataFrame], key: str, time: str = "ts") -> DataFrame:
    """Sparse series on the union of their timestamps, each carrying its last value forward."""
    long = reduce(DataFrame.unionByName, [f.select(key, time, F.lit(n).alias("_m"), "value") for n, f in frames.items()])
    wide = long.groupBy(key, time).agg(*[F.max(F.when(F.col("_m") == n, F.col("value"))).alias(n) for n in frames])
    before = Window.partitionBy(key).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    return wide.select(key, time, *[F.last(n, ignorenulls=True).over(before).alias(n) for n in frames])


def first_finite(df: DataFrame, keys: list[str], values: list[str], order: str) -> DataFrame:
    """The first row of each key, and only rows whose values are all finite."""
    for v in values:
        df = df.where(F.col(v).isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    first = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")


def per_capacity(df: DataFrame, column: str, limits: dict[str, float], key: str = "msname") -> DataFrame:
    """value / (replicas, 0 counting as 1, times the key's limit, 1.0 by default), at most 1."""
    limit = F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in limits.items() for v in kv]), F.col(key)), F.lit(1.0)) if limits else F.lit(1.0)
    pods = F.when(F.col("replicas") == 0, 1).otherwise(F.col("replicas"))
    return df.withColumn(column, F.least(F.col(column) / (pods * limit), F.lit(1.0)))


def usage_ratio(usage: DataFrame, requested: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ratio): used over requested, null where nothing is requested."""
    return usage.select(*keys, F.col("value").alias("_u")).join(requested.select(*keys, F.col("value").alias("_r")), keys).select(*keys, F.try_divide("_u", "_r").alias("ratio"))


def overall(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("points"), F.avg("replicas").alias("avg_replicas"), F.avg("cpu").alias("avg_cpu"), F.avg("mem").alias("avg_mem"))
