"""How windows are prepared, chosen by name: as they are, smoothed, or decomposed by wavelets; kept by name and parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelens.operators import signal, windows
from tracelens.sources.tables import cached


def _none(made: DataFrame, channels: int) -> DataFrame:
    return made


def _smoothing(made: DataFrame, channels: int, width: int = 5) -> DataFrame:
    return windows.smooth_windows(made, width, channels)


def _wavelet(made: DataFrame, channels: int, level: int = 2, wavelet: str = "sym4", levels: dict[int, int] | None = None) -> DataFrame:
    """Each channel becomes its approximation and details, `levels` by channel if they differ; a window that can't be decomposed is its own approximation."""
    for k in range(channels):
        made = signal.decompose(made, k, (levels or {}).get(k, level), wavelet, fallback=True).withColumnRenamed("channels", f"_c{k}")
    parts = F.concat(*[f"_c{k}" for k in range(channels)])
    steps = F.sequence(F.lit(1), F.size("x"))
    return made.withColumn("_all", parts).withColumn("x", F.transform(steps, lambda i: F.transform("_all", lambda c: F.element_at(c, i)))).drop("_all", *[f"_c{k}" for k in range(channels)])


APPROACHES: dict[str, Callable[..., DataFrame]] = {"none": _none, "smoothing": _smoothing, "wavelet": _wavelet}


def prepare(made: DataFrame, approach: str, channels: int, **parameters) -> DataFrame:
    """Windows whose x, of `channels` values a step, has gone through the approach of that name."""
    if approach not in APPROACHES:
        raise ValueError(f"no approach {approach}: {', '.join(APPROACHES)}")
    return APPROACHES[approach](made, channels, **parameters)


def prepared(spark: SparkSession, folder: str, source: DataFrame, make: Callable[[], DataFrame], approach: str, channels: int, **parameters) -> DataFrame:
    """`prepare` over what `make` gives, kept for as long as source's files, the approach and its parameters stay the same."""
    return cached(spark, folder, f"windows-{approach}", source, {"approach": approach, "channels": channels, **parameters}, lambda: prepare(make(), approach, channels, **parameters))
