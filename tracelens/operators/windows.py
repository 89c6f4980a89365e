"""Supervised windows: sliding cuts of each split, smoothing, quantising, filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelens.functions.scalars import array_std


def windowize(df: DataFrame, length: int, horizon: int, stride: int, features: list[str], targets: list[str], keys: tuple[str, ...] = ("msname", "split"), contiguous: int | None = None) -> DataFrame:
    """(keys, win_start, x, y, last, second_last, sid): inputs [i, i+length), targets [i+length, i+length+horizon).

    Each series is gathered once, sorted by position, and sliced at every `stride`, so rows aren't repeated `length`
    times; splits are part of the key, so no window crosses one. Series shorter than length + horizon give none. With
    `contiguous`, windows whose time steps, through the last target, aren't all that many seconds go. sid: the last feature at the last step as a
    whole number, kept for compatibility.
    """
    row = F.struct("pos", "t", F.array(*[F.col(c).cast("double") for c in features]).alias("f"), F.array(*[F.col(c).cast("double") for c in targets]).alias("g"))
    series = df.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("s"))
    whole = length + horizon
    cut = series.where(F.size("s") >= whole).select(*keys, "s", F.explode(F.sequence(F.lit(0), F.size("s") - whole, F.lit(stride))).alias("i"))
    cut = cut.select(*keys, F.slice("s", F.col("i") + 1, length).alias("a"), F.slice("s", F.col("i") + 1 + length, horizon).alias("b"))
    if contiguous:
        times = F.transform(F.concat("a", "b"), lambda r: r["t"])
        steps = F.zip_with(F.slice(times, 1, whole - 1), F.slice(times, 2, whole - 1), lambda p, q: q - p == contiguous)
        cut = cut.where(F.forall(steps, lambda s: s))
    return cut.select(
        *keys,
        F.element_at("a", 1)["t"].alias("win_start"),
        F.transform("a", lambda r: r["f"]).alias("x"),
        F.transform("b", lambda r: r["g"]).alias("y"),
        F.element_at("a", -1)["g"].alias("last"),
        (F.element_at("a", -2) if length > 1 else F.element_at("a", -1))["g"].alias("second_last"),
        F.element_at(F.element_at("a", -1)["f"], -1).cast("int").alias("sid"),
    )


def inference_windows(df: DataFrame, length: int, features: list[str]) -> DataFrame:
    """Every window of inputs, without targets."""
    return windowize(df, length, 0, 1, features, features[:1], keys=("msname",)).drop("y")


def channel(x: Column, k: int) -> Column:
    return F.transform(x, lambda r: F.element_at(r, k + 1))


def drop_near_constant(windows: DataFrame, target_channels: list[int], least: float = 1e-12) -> DataFrame:
    """Windows whose target channels all vary over the input."""
    for k in target_channels:
        windows = windows.where(array_std(channel(F.col("x"), k)) >= least)
    return windows


def matching(windows: DataFrame, kept: DataFrame, keys: tuple[str, ...] = ("msname", "split", "win_start")) -> DataFrame:
    """Windows (smoothed ones, say) whose raw counterparts were kept."""
    return windows.join(kept.select(*keys), list(keys), "left_semi")


def moving_average(values: Column, width: int, front: int | None = None) -> Column:
    """Edge-padded moving average of an array, as long as the input.

    `front` values are padded before and the rest of width - 1 behind; by default width // 2, so that an even width is
    off-centre and keeps the first outputs. A width beyond the array is cut to it.
    """
    n = F.size(values)
    k = F.least(F.lit(width), n)
    before = F.least(F.lit(front), k - 1) if front is not None else F.floor(k / 2).cast("int")
    at = lambda j: F.element_at(values, F.least(F.greatest(j, F.lit(0)), n - 1) + 1)
    span = F.sequence(F.lit(0), k - 1)
    mean = lambda i: F.aggregate(F.transform(span, lambda d: at(i - before + d)), F.lit(0.0), lambda a, v: a + v) / k
    return F.transform(F.sequence(F.lit(0), n - 1), mean)


def smooth_windows(windows: DataFrame, width: int, channels: int) -> DataFrame:
    """Smooths every channel of x, then rounds x and y to two decimals."""
    smoothed = F.arrays_zip(*[moving_average(channel(F.col("x"), k), width).alias(f"c{k}") for k in range(channels)])
    x = F.transform(smoothed, lambda r: F.array(*[r[f"c{k}"] for k in range(channels)]))
    return quantise_windows(windows.withColumn("x", x))


def quantise_windows(windows: DataFrame, inputs: bool = True) -> DataFrame:
    """Two decimals, half to even, in y and, if every channel is bounded, in x. Noise beyond nine decimals doesn't break ties."""
    rounded = lambda c: F.transform(c, lambda r: F.transform(r, lambda v: F.bround(F.round(v, 9), 2)))
    out = windows.withColumn("y", rounded(F.col("y")))
    return out.withColumn("x", rounded(F.col("x"))) if inputs else out


def trend_seasonal(values: Column, kernel: int) -> list[Column]:
    """Trend: moving average padded kernel // 2 in front, kernel - 1 - kernel // 2 behind; seasonal: the rest."""
    trend = moving_average(values, kernel, front=kernel // 2)
    return [trend.alias("trend"), F.zip_with(values, trend, lambda v, t: v - t).alias("seasonal")]


def head_slice(windows: DataFrame, percent: float | None = None, most: int | None = None) -> DataFrame:
    """The first windows in (msname, win_start) order: max(1, floor(n percent / 100)) of each split, or `most`.

    Counts per service tell where each service's share ends, so no task sorts more than one service's windows.
    """
    if most is not None:
        return windows.orderBy("msname", "win_start").limit(most)
    if percent is None or percent <= 0 or percent >= 100:
        return windows
    counts = windows.groupBy("split", "msname").agg(F.count(F.lit(1)).alias("_n"))  # one row for each service and split
    of = Window.partitionBy("split")
    before = F.coalesce(F.sum("_n").over(of.orderBy("msname").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = F.greatest(F.lit(1), F.floor(F.sum("_n").over(of) * F.lit(percent) / 100)) - before
    placed = windows.join(counts.select("split", "msname", kept.alias("_k")).where("_k > 0"), ["split", "msname"])
    inside = F.row_number().over(Window.partitionBy("split", "msname").orderBy("win_start"))
    return placed.withColumn("_r", inside).where("_r <= _k").select(windows.columns)


def seeded_sample(df: DataFrame, keys: list[str], n: int, seed: int) -> DataFrame:
    """n rows without replacement, the same in every run: a top-n by a seeded hash."""
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(seed), *[F.col(k).cast("string") for k in keys])), *keys).limit(n)
