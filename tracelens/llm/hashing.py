"""64-bit hashes of words and shingles for whole batches of text at once."""

from __future__ import annotations

import numpy as np

MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a permutation of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64, at least n of them; kept between batches."""
    if base not in _powers or len(_powers[base]) < n:
        step = np.full(max(n, 1 << 16), base, np.uint64)
        step[0] = 1
        _powers[base] = np.cumprod(step)
    return _powers[base]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """h with h[j] - h[i] depending on data[i:j] and i only; see `span_hash`."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(_BASE, len(data))[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], equal for equal bytes wherever they stand."""
    return mix((prefix[end] - prefix[start]) * powers(_BASE_INVERSE, len(prefix))[start] + (end - start).astype(np.uint64))


def word_spans(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of True that don't cross the bounds of texts."""
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    filled = bounds[:-1][bounds[:-1] < bounds[1:]]
    first[filled] = inside[filled]
    ended = bounds[1:][bounds[:-1] < bounds[1:]] - 1
    last[ended] = inside[ended]
    return np.flatnonzero(first), np.flatnonzero(last) + 1
