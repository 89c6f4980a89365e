"""Workload shaping: request counts from logs, curves, schedules, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def requests_per_minute(log: DataFrame) -> DataFrame:
    """(minute_of_month, n) from rows with day, hour, minute; month and year are not looked at."""
    minute = (F.col("day") - 1) * 1440 + F.col("hour") * 60 + F.col("minute")
    return log.groupBy(minute.cast("long").alias("minute")).agg(F.count(F.lit(1)).alias("n"))


def build_curve(counts: DataFrame, start_day: int, end_day: int | None = None) -> DataFrame:
    """(minute, load): every minute of the days, missing ones 0, over the peak; the last active day ends it by default."""
    if end_day is None:
        found = counts.agg(F.max(F.expr("minute div 1440"))).first()[0]
        end_day = start_day if found is None else int(found) + 1
    first, last = (start_day - 1) * 1440, end_day * 1440
    every = counts.sparkSession.range(first, last).select(F.col("id").alias("minute"))
    filled = every.join(counts, "minute", "left").select("minute", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    peak = filled.agg(F.max("n").alias("peak"))
    return filled.join(F.broadcast(peak)).select("minute", F.coalesce(F.try_divide(F.col("n").cast("double"), F.col("peak")), F.lit(0.0)).alias("load"))  # one row


def request_counts(curve: DataFrame, most: int, start: int = 0, minutes: int | None = None) -> DataFrame:
    """(slot, n): the curve from `start` on, scaled so that its own peak is `most` requests, half to even."""
    part = curve.where(F.col("minute") >= start)
    if minutes is not None:
        part = part.where(F.col("minute") < start + minutes)
    peak = part.agg(F.max("load").alias("_peak"))
    n = F.greatest(F.bround(F.coalesce(F.try_divide(F.col("load"), F.col("_peak")), F.lit(0.0)) * most).cast("long"), F.lit(0))
    return part.join(F.broadcast(peak)).select((F.col("minute") - start).alias("slot"), n.alias("n"))  # one row


def schedule(counts: DataFrame, pool: int) -> DataFrame:
    """(slot, s, at, owner): request s of a minute at slot * 60 + s * 60 / n seconds, by owner s % pool."""
    rows = counts.where("n > 0").select("slot", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("s"))
    return rows.select("slot", "s", (F.col("slot") * 60 + F.col("s") * 60.0 / F.col("n")).alias("at"), (F.col("s") % pool).alias("owner"))


def count_mismatches(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(slot, expected, actual) of minutes whose counts differ."""
    both = expected.select("slot", F.col("n").alias("expected")).join(actual.select("slot", F.col("n").alias("_a")), "slot", "left")
    return both.select("slot", "expected", F.coalesce("_a", F.lit(0).cast("long")).alias("actual")).where("expected <> actual")
