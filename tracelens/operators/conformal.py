"""Conformal intervals: quantile-regression, split and online adaptive."""

from __future__ import annotations

import math
from collections import deque
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelens.operators.profile import higher_quantile


def cqr_fit(df: DataFrame, alpha: float, by: list[str]) -> DataFrame:
    """(by, q_conf): the conservative 1 - alpha quantile of max(0, q_lo - y, y - q_hi)."""
    score = F.greatest(F.lit(0.0), F.col("q_lo") - F.col("y"), F.col("y") - F.col("q_hi"))
    return higher_quantile(df.withColumn("_s", score), "_s", 1 - alpha, by).withColumnRenamed("quantile", "q_conf")


def cqr_apply(df: DataFrame, fitted: DataFrame, by: list[str]) -> DataFrame:
    return df.join(fitted, by, "left").withColumn("lower", F.col("q_lo") - F.coalesce("q_conf", F.lit(0.0))).withColumn("upper", F.col("q_hi") + F.coalesce("q_conf", F.lit(0.0))).drop("q_conf")


def split_fit(df: DataFrame, alpha: float, by: list[str], least: int = 50) -> DataFrame:
    """(by, radius): the conservative quantile of absolute residuals; groups with fewer than `least` of them have no row."""
    scores = df.withColumn("_s", F.abs(F.col("y") - F.col("pred"))).where("_s is not null and not isnan(_s)")
    enough = scores.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select(*by)
    return higher_quantile(scores.join(enough, by), "_s", 1 - alpha, by).withColumnRenamed("quantile", "radius")


def split_apply(df: DataFrame, fitted: DataFrame, by: list[str]) -> DataFrame:
    """lower, upper, and one_sided for scaling; without a radius all three are the prediction."""
    radius = F.coalesce("radius", F.lit(0.0))
    return df.join(fitted, by, "left").withColumns({"lower": F.col("pred") - radius, "upper": F.col("pred") + radius, "one_sided": F.col("pred") + radius}).drop("radius")


@dataclass
class AdaptiveState:
    """Bounded buffers of upper and lower scores and their levels, and the forecasts whose values are not known yet; the same for batch replay and for streams."""

    scores_upper: list[float] = field(default_factory=list)
    scores_lower: list[float] = field(default_factory=list)
    alpha_upper: float = 0.05
    alpha_lower: float = 0.10
    pending: deque[tuple[int, float, float]] = field(default_factory=deque)

    def interval(self, q_lo: float, q_hi: float, empty: str = "raw") -> tuple[float, float]:
        """Before any score: the raw quantiles, or 0 with empty='zero'."""
        if not self.scores_upper:
            return (0.0, 0.0) if empty == "zero" else (q_lo, q_hi)
        return q_lo - conservative(self.scores_lower, 1 - self.alpha_lower), q_hi + conservative(self.scores_upper, 1 - self.alpha_upper)

    def update(self, y: float, q_lo: float, q_hi: float, cfg: AdaptiveConfig) -> None:
        """The bound that holds now decides the miss; then the scores, 0 inside the raw quantiles, are kept; then the levels move."""
        low, high = self.interval(q_lo, q_hi, cfg.empty)
        self.scores_upper = [*self.scores_upper, max(0.0, y - q_hi)][-cfg.window :]
        self.scores_lower = [*self.scores_lower, max(0.0, q_lo - y)][-cfg.window :]
        self.alpha_upper = min(max(self.alpha_upper + cfg.eta * (cfg.alpha_upper - (y > high)), cfg.least), cfg.most)
        self.alpha_lower = min(max(self.alpha_lower + cfg.eta * (cfg.alpha_lower - (y < low)), cfg.least), cfg.most)

    def mature(self, pos: int, y: float, cfg: AdaptiveConfig) -> None:
        """Learns from the forecast that was due at pos; older ones, whose values never came, are dropped."""
        while self.pending and self.pending[0][0] + cfg.horizon <= pos:
            made, q_lo, q_hi = self.pending.popleft()
            if made + cfg.horizon == pos:
                self.update(y, q_lo, q_hi, cfg)

    def step(self, pos: int, y: float, q_lo: float, q_hi: float, warmup: bool, cfg: AdaptiveConfig) -> tuple[float, float]:
        """The interval of the forecast made at pos, when y is the value at pos; no later value has been seen."""
        if cfg.learn_first and not warmup:
            self.mature(pos, y, cfg)
        low, high = self.interval(q_lo, q_hi, cfg.empty)
        if warmup:
            self.update(y, q_lo, q_hi, cfg)
        else:
            self.pending.append((pos, q_lo, q_hi))
            self.mature(pos, y, cfg)
        return (min(max(low, 0.0), 1.0), min(max(high, 0.0), 1.0)) if cfg.clip else (low, high)


@dataclass(frozen=True)
class AdaptiveConfig:
    """`horizon`: rows between a forecast and its value. `learn_first`: a value is learnt before the interval of its own row is made."""

    window: int = 100
    eta: float = 0.01
    alpha_upper: float = 0.05
    alpha_lower: float = 0.10
    least: float = 0.001
    most: float = 0.5
    empty: str = "raw"
    clip: bool = False
    horizon: int = 5
    learn_first: bool = False

    def fresh(self) -> AdaptiveState:
        return AdaptiveState(alpha_upper=self.alpha_upper, alpha_lower=self.alpha_lower)


def conservative(scores: list[float], q: float) -> float:
    """sorted[ceil((n - 1) q)]."""
    return sorted(scores)[math.ceil((len(scores) - 1) * q)]


STATE = "scores_upper array<double>, scores_lower array<double>, alpha_upper double, alpha_lower double, pending array<struct<pos:bigint,q_lo:double,q_hi:double>>"


def adaptive_replay(df: DataFrame, cfg: AdaptiveConfig = AdaptiveConfig(), keys: tuple[str, ...] = ("msname", "target"), states: DataFrame | None = None) -> DataFrame:
    """Replays (keys, pos, y, q_lo, q_hi, warmup) in order per key; rows out: keys, pos, y, lower, upper, alphas, warmup.

    y is the value at pos, the quantiles foretell that at pos + horizon. A forecast waits in a queue until its value comes,
    so no interval depends on a later value. Warm-up rows move the state at once, by their own y. It is sequential by nature,
    so a key is one task; keys run in parallel. With `states`, from `adaptive_states`, each key goes on from where it was,
    forecasts that wait included; keys without one start afresh.
    """
    schema = ", ".join(f"{k} string" for k in keys) + ", pos long, y double, lower double, upper double, alpha_upper double, alpha_lower double, warmup boolean"

    def replay(rows: pd.DataFrame) -> pd.DataFrame:
        rows, out = rows.sort_values("pos"), []
        state = restore(rows["_state"].iloc[0], cfg)
        for pos, y, q_lo, q_hi, warm in rows[["pos", "y", "q_lo", "q_hi", "warmup"]].itertuples(index=False):
            alphas = state.alpha_upper, state.alpha_lower
            out.append((pos, y, *state.step(pos, y, q_lo, q_hi, warm, cfg), *alphas, bool(warm)))
        made = pd.DataFrame(out, columns=["pos", "y", "lower", "upper", "alpha_upper", "alpha_lower", "warmup"])
        for i, k in enumerate(keys):
            made.insert(i, k, rows[k].iloc[0])
        return made

    rows = df.select(*keys, "pos", "y", "q_lo", "q_hi", "warmup")
    saved = F.struct("scores_upper", "scores_lower", "alpha_upper", "alpha_lower", "pending").alias("_state")
    if states is None:
        states = df.sparkSession.createDataFrame([], ", ".join(f"{k} string" for k in keys) + f", {STATE}")
    return rows.join(states.select(*keys, saved), list(keys), "left").groupBy(*keys).applyInPandas(replay, schema)


def adaptive_states(df: DataFrame, cfg: AdaptiveConfig = AdaptiveConfig(), keys: tuple[str, ...] = ("msname", "target")) -> DataFrame:
    """(keys, scores_upper, scores_lower, alpha_upper, alpha_lower, pending): each key's state after its rows, to be kept and gone on from."""

    def last(rows: pd.DataFrame) -> pd.DataFrame:
        state = cfg.fresh()
        for row in rows.sort_values("pos")[["pos", "y", "q_lo", "q_hi", "warmup"]].itertuples(index=False):
            state.step(*row, cfg)
        return pd.DataFrame([{**{k: rows[k].iloc[0] for k in keys}, **snapshot(state)}])

    return df.select(*keys, "pos", "y", "q_lo", "q_hi", "warmup").groupBy(*keys).applyInPandas(last, ", ".join(f"{k} string" for k in keys) + f", {STATE}")


def snapshot(state: AdaptiveState) -> dict:
    return {**asdict(state), "pending": [dict(zip(("pos", "q_lo", "q_hi"), p, strict=True)) for p in state.pending]}


def restore(saved: dict | None, cfg: AdaptiveConfig = AdaptiveConfig()) -> AdaptiveState:
    """The state that was saved, or a fresh one."""
    if saved is None:
        return cfg.fresh()
    waiting = deque((p["pos"], p["q_lo"], p["q_hi"]) for p in saved["pending"])
    return AdaptiveState(list(saved["scores_upper"]), list(saved["scores_lower"]), saved["alpha_upper"], saved["alpha_lower"], waiting)
