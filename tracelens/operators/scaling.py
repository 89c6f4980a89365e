"""Replica recommendations as Columns and windows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ScalingConfig:
    target: float = 0.80
    deadband: float = 0.10
    least: int = 1
    most: int = 10
    interval: int = 60
    step: int = 15
    step_share: float = 1.0
    step_pods: int = 4
    stabilise: int = 300


def raw_replicas(current: Column, load: Column, cfg: ScalingConfig) -> Column:
    """ceil(current * ratio), the ratio taken as 1 within the dead band."""
    ratio = load / cfg.target
    return F.ceil(current * F.when(F.abs(ratio - 1) <= cfg.deadband, 1.0).otherwise(ratio)).cast("int")


def scale_up_ceiling(current: Column, cfg: ScalingConfig) -> Column:
    """What interval / step steps of growth can reach."""
    steps = F.sequence(F.lit(1), F.lit(max(1, cfg.interval // cfg.step)))
    grown = F.aggregate(steps, current.cast("int"), lambda r, _: r + F.greatest(F.floor(r * cfg.step_share).cast("int"), F.lit(cfg.step_pods)))
    return F.least(grown, F.lit(cfg.most))


def chosen_load(df: DataFrame, predictive: bool, window: int) -> DataFrame:
    """Adds load_cpu, load_mem and mode: the upper bounds if predictive, with enough history and a positive median forecast pred_cpu, else what is observed."""
    waiting = F.col("history") < window
    usable = F.lit(predictive) & ~waiting & (F.col("pred_cpu") > 0)
    mode = F.when(F.lit(predictive) & waiting, "waiting").when(usable, "predictive").otherwise("reactive")
    return df.withColumns({"load_cpu": F.when(usable, F.col("upper_cpu")).otherwise(F.col("cpu")), "load_mem": F.when(usable, F.col("upper_mem")).otherwise(F.col("mem")), "mode": mode})


def desired_replicas(df: DataFrame, cfg: ScalingConfig = ScalingConfig()) -> DataFrame:
    """Adds desired and limited (the wish reaches the maximum): the larger of both wishes, clamped, and not beyond the scale-up ceiling."""
    wish = F.greatest(raw_replicas(F.col("replicas"), F.col("load_cpu"), cfg), raw_replicas(F.col("replicas"), F.col("load_mem"), cfg))
    out = df.withColumn("_wish", wish)
    clamped = F.greatest(F.lit(cfg.least), F.least(F.lit(cfg.most), F.col("_wish")))
    capped = F.when(clamped > F.col("replicas"), F.least(clamped, scale_up_ceiling(F.col("replicas"), cfg))).otherwise(clamped)
    return out.withColumns({"limited": F.col("_wish") >= cfg.most, "desired": capped}).drop("_wish")


def stabilise(df: DataFrame, cfg: ScalingConfig = ScalingConfig(), key: str = "msname", time: str = "ts") -> DataFrame:
    """Adds stable: unless scaling up, the largest recommendation of the last `stabilise` seconds (later than that many ago)."""
    recent = Window.partitionBy(key).orderBy(F.col(time).cast("long")).rangeBetween(-(cfg.stabilise - 1), 0)
    highest = F.max("desired").over(recent)
    return df.withColumn("stable", F.when(F.col("desired") > F.col("replicas"), F.col("desired")).otherwise(highest))
