"""Window functions over per-service series: rolling statistics, oscillation, periodicity, ranking.

All of them share one partitioning and order (service, time), so a pipeline of them pays for one exchange and one sort.
A series holds one row per time step, so a service's window is bounded by the length of the trace.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tracelens.functions.scalars import corr_guarded


def trailing(n: int, key: str = "msname", time: str = "t") -> WindowSpec:
    return Window.partitionBy(key).orderBy(time).rowsBetween(-(n - 1), 0)


def window_stats(df: DataFrame, n: int, value: str = "load") -> DataFrame:
    """Statistics of each row's trailing n rows, partial frames too."""
    w = trailing(n)
    return df.withColumns(
        {
            "n_points": F.count(F.lit(1)).over(w),
            "n_active": F.count(F.when(F.col(value) > 0, 1)).over(w),
            "avg_load": F.avg(value).over(w),
            "std_load": F.stddev_samp(value).over(w),
            "min_load": F.min(value).over(w),
            "max_load": F.max(value).over(w),
            "win_start": F.min("t").over(w),
            "win_end": F.max("t").over(w),
        }
    )


def oscillation(df: DataFrame, n: int, min_ratio: float = 0.9, value: str = "load") -> DataFrame:
    """Windows with score std / (max - min); flat ones, and those with under n * min_ratio rows, go."""
    out = window_stats(df, n, value)
    out = out.withColumn("oscillation", F.try_divide(F.col("std_load"), F.col("max_load") - F.col("min_load")))
    return out.where(F.col("oscillation").isNotNull() & (F.col("n_points") >= max(1, int(n * min_ratio))))


def active_services(df: DataFrame, value: str = "load") -> DataFrame:
    """Services with any load at all."""
    return df.groupBy("msname").agg(F.max(value).alias("_most")).where("_most > 0").select("msname")


def full_mean(value: Column, n: int) -> Column:
    """Rolling mean, null until the window is full."""
    w = trailing(n)
    return F.when(F.count(value).over(w) == n, F.avg(value).over(w))


def pattern_score(df: DataFrame, n: int, lags: list[int], value: str = "load") -> DataFrame:
    """Adds `pattern`: the largest absolute rolling autocorrelation of samples centred on their own window's mean.

    Lags up to half the window count. The first score needs about 2 n + lag rows; flat windows have none.
    """
    out = df.withColumn("_c", F.col(value) - full_mean(F.col(value), n))
    scores = []
    for lag in sorted({x for x in lags if 0 < x <= n // 2}):
        m = n - lag
        back = F.lag("_c", lag).over(Window.partitionBy("msname").orderBy("t"))
        out = out.withColumn("_b", back)
        both, left, right = (full_mean(c, m) for c in (F.col("_c") * F.col("_b"), F.col("_c") * F.col("_c"), F.col("_b") * F.col("_b")))
        out = out.withColumn(f"_r{lag}", F.abs(F.try_divide(both, F.sqrt(left * right)))).drop("_b")
        scores.append(F.col(f"_r{lag}"))
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    return out.withColumn("pattern", best).select(*df.columns, "pattern")


def with_pattern(windows: DataFrame, scores: DataFrame) -> DataFrame:
    """Adds the pattern score of (service, window end), null where there is none."""
    return windows.join(scores.select("msname", F.col("t").alias("win_end"), "pattern"), ["msname", "win_end"], "left")


def rank_windows(df: DataFrame, mode: str = "oscillation", k: int = 20) -> DataFrame:
    """The k best windows by oscillation, mcr, both, pattern or both_pattern; ties by service and window end.

    `both` is oscillation times the average load scaled over all candidates, with a zero span 0; `both_pattern` is
    oscillation times pattern. Rows without a score go. Sorting is a top-k, not a full sort.
    """
    if mode == "both":
        ends = df.agg(F.min("avg_load").alias("_lo"), F.max("avg_load").alias("_hi"))
        df = df.join(F.broadcast(ends))  # one row
        load = F.coalesce(F.try_divide(F.col("avg_load") - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0))
        score = load * F.col("oscillation")
    elif mode == "both_pattern":
        score = F.col("oscillation") * F.col("pattern")
    else:
        score = F.col({"oscillation": "oscillation", "mcr": "avg_load", "pattern": "pattern"}[mode])
    scored = df.withColumn("score", score).where("score is not null")
    return scored.orderBy(F.desc("score"), "msname", "win_end").limit(k).drop("_lo", "_hi")


def autocorrelation(df: DataFrame, lags: list[int], value: str = "load", time: str = "t") -> DataFrame:
    """(msname, lag, acf): unbiased autocovariance at each lag over the variance of the whole series."""
    of = Window.partitionBy("msname")
    centred = df.withColumn("_c", F.col(value) - F.avg(value).over(of))
    order = of.orderBy(time)
    each = centred.select("msname", F.col("_c"), *[F.lead("_c", k).over(order).alias(f"_l{k}") for k in lags])
    sums = each.groupBy("msname").agg(F.avg(F.col("_c") * F.col("_c")).alias("_v"), *[F.avg(F.col("_c") * F.col(f"_l{k}")).alias(f"_a{k}") for k in lags])
    pairs = F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"_a{k}").alias("cov")) for k in lags])
    return sums.select("msname", "_v", F.explode(pairs).alias("x")).select("msname", F.col("x.lag").alias("lag"), F.try_divide(F.col("x.cov"), F.col("_v")).alias("acf"))


def all_autocorrelations(df: DataFrame, most: int = 2880, value: str = "load", time: str = "t") -> DataFrame:
    """(msname, lag, acf) for lags from 1 to `most`, or as many as the series allows: a Fourier transform of the padded series.

    A series is one task, in n log n for all its lags. Series of one row, or that don't vary, have none; null values go.
    """

    def transform(rows: pd.DataFrame) -> pd.DataFrame:
        v = rows.sort_values(time)[value].to_numpy(float)
        n, c = len(v), v - v.mean()
        variance = float(c @ c) / n
        if n < 2 or variance < 1e-12:
            return pd.DataFrame({"msname": pd.Series(dtype=object), "lag": pd.Series(dtype="int32"), "acf": pd.Series(dtype=float)})
        spectrum = np.fft.rfft(c, 1 << (2 * n - 1).bit_length())
        lags = np.arange(1, min(most, n - 1) + 1)
        sums = np.fft.irfft(spectrum * spectrum.conj())[lags]
        return pd.DataFrame({"msname": rows["msname"].iloc[0], "lag": lags, "acf": sums / ((n - lags) * variance)})

    return df.where(F.col(value).isNotNull()).select("msname", time, value).groupBy("msname").applyInPandas(transform, "msname string, lag int, acf double")


def peak_autocorrelation(lags: DataFrame, low: int = 1, high: int | None = None) -> DataFrame:
    """(msname, lag, acf): of each series the lag, from low to high, of the largest absolute value, the first of equal ones."""
    some = lags.where((F.col("lag") >= low) & (F.lit(True) if high is None else F.col("lag") <= high))
    best = some.groupBy("msname").agg(F.max_by(F.struct("lag", "acf"), F.struct(F.abs("acf").alias("a"), (-F.col("lag")).alias("l"))).alias("x"))
    return best.select("msname", "x.lag", "x.acf")


def day_over_day(df: DataFrame, value: str = "load", step: int = 3600) -> DataFrame:
    """(msname, mean, std, n): Pearson correlation of each day's profile with the next day's, over days."""
    days = df.select("msname", F.expr("t div 86400").alias("day"), F.expr(f"(t % 86400) div {step}").alias("slot"), F.col(value).alias("x"))
    after = days.select("msname", (F.col("day") - 1).alias("day"), "slot", F.col("x").alias("y"))
    each = days.join(after, ["msname", "day", "slot"]).groupBy("msname", "day").agg(corr_guarded(F.col("x"), F.col("y")).alias("r"))
    return each.groupBy("msname").agg(F.avg("r").alias("mean"), F.stddev_pop("r").alias("std"), F.count("r").alias("n"))


def best_service(df: DataFrame, test_from: float, rows: int, k: int = 5) -> DataFrame:
    """The k services with the largest std(cpu) + std(mem) over the first `rows` rows of the test split; shorter ones are not eligible."""
    first = F.floor(F.col("n") * F.lit(test_from))
    part = df.where((F.col("pos") >= first) & (F.col("pos") < first + rows))
    scored = part.groupBy("msname").agg((F.stddev_pop("cpu") + F.stddev_pop("mem")).alias("score"), F.count(F.lit(1)).alias("rows"))
    return scored.where(F.col("rows") == rows).orderBy(F.desc("score"), "msname").limit(k)
