"""Fleet profiles: two-level means, histograms, extremes, instance counts, quantile summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelens.operators.quantiles import join_on, quantiles
from tracelens.session import materialise


def per_timestamp_means(df: DataFrame, time: str = "ts") -> DataFrame:
    """Mean over instances for each service and timestamp: the first level of every fleet figure, computed once."""
    return df.groupBy("msname", time).agg(F.avg("cpu").alias("cpu"), F.avg("mem").alias("mem"))


def histogram(df: DataFrame, column: str, bins: int, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """(bin, n) for every bin of a fixed range, empty ones too; the last bin holds its upper end."""
    place = F.least(F.floor((F.col(column) - low) / (high - low) * bins), F.lit(bins - 1)).cast("int")
    counted = df.where(F.col(column).between(low, high)).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counted, "bin", "left").select("bin", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def auto_histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Equal widths from the minimum to the maximum; a range of one value is widened by 0.5 to both sides."""
    ends = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    ends = ends.select(F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    place = F.least(F.floor((F.col(column) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)).cast("int")
    counted = df.where(F.col(column).isNotNull()).join(F.broadcast(ends)).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counted, "bin", "left").select("bin", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def histogram_list(hist: DataFrame) -> DataFrame:
    """One row with the counts in bin order; a histogram has as many rows as bins."""
    return hist.agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "n"))), lambda x: x["n"]).alias("counts"))


def sketch(df: DataFrame, column: str, bins: int) -> DataFrame:
    """(bin, n): values clipped to [0, 1], bin floor(v * (bins - 1)); NaN and null are skipped. Sketches merge by adding n."""
    v = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(column)))
    return df.where(F.col(column).isNotNull() & ~F.isnan(column)).groupBy(F.floor(v * (bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def sketch_quantile(hist: DataFrame, tau: float, bins: int) -> DataFrame:
    """The first bin whose running count reaches tau of all, over bins - 1; 0.5 for an empty sketch."""
    running = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # at most `bins` rows
    cdf = hist.select("bin", F.sum("n").over(running).alias("upto"), F.sum("n").over(Window.partitionBy()).alias("total"))
    return cdf.where(F.col("upto") >= tau * F.col("total")).agg(F.coalesce(F.min("bin") / (bins - 1), F.lit(0.5)).alias("quantile"))


def service_extremes(means: DataFrame) -> DataFrame:
    return means.groupBy("msname").agg(F.max("cpu").alias("max_cpu"), F.min("cpu").alias("min_cpu"), F.max("mem").alias("max_mem"), F.min("mem").alias("min_mem"))


def instance_stats(df: DataFrame, time: str = "ts", approximate: bool = False) -> DataFrame:
    """Per service: average distinct instances per timestamp, and distinct instances in all.

    Both come from the distinct (service, time, instance) rows, counted by time and by instance, so that none is expanded.
    """
    if not approximate:
        seen = df.select("msname", time, "msinstanceid").distinct()
        times = seen.groupBy("msname", time).agg(F.count("msinstanceid").alias("n")).groupBy("msname").agg(F.avg("n").alias("avg_instances"))
        instances = seen.where("msinstanceid is not null").groupBy("msname", "msinstanceid").agg(F.count(F.lit(1)).alias("n"))
        total = instances.groupBy("msname").agg(F.count(F.lit(1)).alias("total_instances"))
        return times.join(total, "msname", "left").fillna(0, ["total_instances"])
    distinct = F.approx_count_distinct
    per_time = df.groupBy("msname", time).agg(distinct("msinstanceid").alias("instances"))
    average = per_time.groupBy("msname").agg(F.avg("instances").alias("avg_instances"))
    total = df.groupBy("msname").agg(distinct("msinstanceid").alias("total_instances"))
    return average.join(total, "msname", "left")


def fleet_summary(stats: DataFrame, columns: list[str]) -> DataFrame:
    """One row: average, maximum and minimum of each per-service figure."""
    return stats.agg(*[f(c).alias(f"{p}_{c}") for c in columns for p, f in (("avg", F.avg), ("max", F.max), ("min", F.min))])


def summary(df: DataFrame, column: str, by: list[str], exact: bool = True) -> DataFrame:
    """avg, p50, p95, min, max; the quantiles exact with linear interpolation, or approximate. Groups may be of any size."""
    plain = [F.avg(column).alias("avg"), F.min(column).alias("min"), F.max(column).alias("max")]
    if not exact:
        return df.groupBy(*by).agg(*plain, F.percentile_approx(column, 0.5).alias("p50"), F.percentile_approx(column, 0.95).alias("p95"))
    kept = materialise(df.select(*by, column), "summary")
    return join_on(kept.groupBy(*by).agg(*plain), quantiles(kept, column, {"p50": 0.5, "p95": 0.95}, by), by)


def spread(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"), F.min(column).alias("min"), F.max(column).alias("max"), F.count(column).alias("n"))


def higher_quantile(df: DataFrame, score: str, q: float, by: list[str]) -> DataFrame:
    """The conservative quantile: of n sorted scores the one at ceil((n - 1) q), counted from 0. Groups may be of any size."""
    return quantiles(df, score, {"quantile": q}, by, higher=True)


def counter_rate(df: DataFrame, by: str, value: str = "value", time: str = "ts", series: tuple[str, ...] = ("series",)) -> DataFrame:
    """Per-second rate of counters between samples, resets counted from 0, summed by (time, by)."""
    w = Window.partitionBy(*series).orderBy(time)
    grown, passed = F.col(value) - F.lag(value).over(w), F.col(time) - F.lag(time).over(w)
    rates = df.withColumn("_rate", F.try_divide(F.when(grown < 0, F.col(value)).otherwise(grown), passed))
    return rates.where("_rate is not null").groupBy(time, by).agg(F.sum("_rate").alias("rate"))


def mean_by(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in columns])


