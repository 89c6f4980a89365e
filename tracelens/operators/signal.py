"""Stationary wavelet decomposition of windows, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

#: Low-pass decomposition taps of the public Symlet-4 and Haar wavelets.
TAPS = {
    "sym4": (-0.07576571478927333, -0.02963552764599851, 0.49761866763201545, 0.8037387518059161, 0.29785779560527736, -0.09921954357684722, -0.012603967262037833, 0.0322231006040427),
    "haar": (0.7071067811865476, 0.7071067811865476),
}


def channel_names(level: int) -> list[str]:
    return [f"A{level}", *[f"D{k}" for k in range(level, 0, -1)]]


def swt(rows: np.ndarray, level: int, wavelet: str = "sym4") -> np.ndarray:
    """(n, level + 1, L): channels A_level, D_level .. D_1; circular, holes between taps doubled at each level."""
    low = np.array(TAPS[wavelet])
    high = low[::-1] * (-1.0) ** np.arange(len(low))
    approx, details = rows.astype(float), []
    for k in range(level):
        shifted = [np.roll(approx, -(i << k), axis=1) for i in range(len(low))]
        details.append(sum(h * s for h, s in zip(high, shifted, strict=True)))
        approx = sum(c * s for c, s in zip(low, shifted, strict=True))
    return np.stack([approx, *details[::-1]], axis=1)


def iswt(channels: np.ndarray, wavelet: str = "sym4") -> np.ndarray:
    """The rows again: at each level the average of both phases, which is half the adjoint."""
    low = np.array(TAPS[wavelet])
    high = low[::-1] * (-1.0) ** np.arange(len(low))
    approx, level = channels[:, 0], channels.shape[1] - 1
    for k in range(level - 1, -1, -1):
        detail = channels[:, level - k]
        approx = 0.5 * sum(c * np.roll(approx, i << k, axis=1) + h * np.roll(detail, i << k, axis=1) for i, (c, h) in enumerate(zip(low, high, strict=True)))
    return approx


def decompose(windows: DataFrame, target: int = 0, level: int = 2, wavelet: str = "sym4", fallback: bool = False) -> DataFrame:
    """Adds `channels`, array of arrays, of one input channel; null for windows shorter than 2 ** level or flat.

    With `fallback` (inference) those get the raw values as approximation and zeros as details; without, drop the nulls.
    """
    ready = windows.withColumn("_raw", F.transform("x", lambda r: F.element_at(r, target + 1)))
    schema = StructType([*ready.schema.fields, StructField("channels", ArrayType(ArrayType(DoubleType())))])

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list = [None] * len(batch)
            raw = [np.asarray(r, float) for r in batch["_raw"]]
            for length in {len(r) for r in raw}:
                same = [i for i, r in enumerate(raw) if len(r) == length]
                rows = np.array([raw[i] for i in same])
                fine = (rows.std(axis=1) >= 1e-12) & (length >= 2**level)
                made = swt(rows, level, wavelet)
                for i, ok, m, r in zip(same, fine, made, rows, strict=True):
                    out[i] = m.tolist() if ok else ([r.tolist()] + [[0.0] * length] * level if fallback else None)
            yield batch.assign(channels=out)

    return ready.mapInPandas(work, schema).drop("_raw")
