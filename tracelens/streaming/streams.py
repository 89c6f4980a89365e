"""Structured Streaming: event-time buckets, bounded histories, matured forecasts, keyed conformal state, latest rows."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import asdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener

from tracelens.operators.conformal import AdaptiveConfig, AdaptiveState

#: The state store that transformWithState needs.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_buckets(df: DataFrame, freq: str, delay: str, aggs: dict[str, Column], time: str = "ts", key: str = "msname") -> DataFrame:
    """Tumbling buckets, emitted once the watermark has passed them; later events are dropped and show in the progress."""
    of = df.withWatermark(time, delay).groupBy(F.window(time, freq), key)
    return of.agg(*[a.alias(n) for n, a in aggs.items()]).select(F.col("window.start").alias("t"), key, *aggs)


def stream_mature(predictions: DataFrame, actuals: DataFrame, horizon: str, delay: str) -> DataFrame:
    """Predictions (msname, ts, pred) with the actual (msname, ts, y) `horizon` later; both sides' state is bounded by the watermarks."""
    p = predictions.withWatermark("ts", delay).select(F.col("msname").alias("_k"), F.col("ts").alias("made"), "pred")
    a = actuals.withWatermark("ts", delay)
    due = F.col("ts") == F.col("made") + F.expr(f"INTERVAL {horizon}")
    return p.join(a, (F.col("_k") == F.col("msname")) & due).select("msname", "made", "ts", "pred", "y")


class History(StatefulProcessor):
    """The last `length` samples of each key; a row once it is full, and at every sample after.

    Samples are a list state to which new ones are appended; it is written anew only when it holds twice as many as are
    needed. With `idle`, what a key has kept goes after as many milliseconds without a sample.
    """

    length, idle = 24, None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", "value double", self.idle)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        held = [v[0] for v in self.kept.get()] if self.kept.exists() else []
        kept, out = held[-self.length :], []
        new = pd.concat(list(rows)).sort_values("ts")
        for ts, value in zip(new["ts"], new["value"], strict=True):
            kept = [*kept, float(value)][-self.length :]
            if len(kept) == self.length:
                out.append((key[0], ts, list(kept)))
        if len(held) + len(new) > 2 * self.length:
            self.kept.put([(v,) for v in kept])
        else:
            self.kept.appendList([(float(v),) for v in new["value"]])
        yield pd.DataFrame(out, columns=["msname", "ts", "history"])

    def close(self) -> None:
        pass


def stream_history(df: DataFrame, length: int = 24, idle: int | None = None) -> DataFrame:
    """df: msname, ts long, value double. Out: msname, ts, history. `idle`: milliseconds after which a key's state goes."""
    processor = type("HistoryOf", (History,), {"length": length, "idle": idle})()
    return df.groupBy("msname").transformWithStateInPandas(processor, "msname string, ts long, history array<double>", "Append", "ProcessingTime" if idle else "None")


class Conformal(StatefulProcessor):
    """Adaptive conformal intervals per key, made when the forecast is made; the state learns when a forecast's value comes.

    Forecasts wait in a map by the time they are due, with an event-time timer each: the row of that time is the value, and
    if the watermark passes without one the forecast is dropped. So at most those of one horizon wait.
    """

    cfg, seconds = AdaptiveConfig(), 300

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "scores_upper array<double>, scores_lower array<double>, alpha_upper double, alpha_lower double")
        self.waiting = handle.getMapState("waiting", "due bigint", "q_lo double, q_hi double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        state, cfg, out = self.cfg.fresh(), self.cfg, []
        if self.state.exists():
            upper, lower, alpha_upper, alpha_lower = self.state.get()
            state = AdaptiveState(list(upper), list(lower), alpha_upper, alpha_lower)
        for r in pd.concat(list(rows)).sort_values("ts").itertuples(index=False):
            now = r.ts.value // 1_000_000_000
            if self.waiting.containsKey((now,)):
                state.update(r.y, *self.waiting.getValue((now,)), cfg)
                self.waiting.removeKey((now,))
                self.handle.deleteTimer(1000 * now)
            low, high = state.interval(r.q_lo, r.q_hi, cfg.empty)
            if r.warmup:
                state.update(r.y, r.q_lo, r.q_hi, cfg)
            else:
                self.waiting.updateValue((now + self.seconds,), (r.q_lo, r.q_hi))
                self.handle.registerTimer(1000 * (now + self.seconds))
            out.append((key[0], now, low, high))
        self.state.update((state.scores_upper, state.scores_lower, state.alpha_upper, state.alpha_lower))
        yield pd.DataFrame(out, columns=["msname", "ts", "lower", "upper"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        self.waiting.removeKey((expiredTimerInfo.getExpiryTimeInMs() // 1000,))
        yield pd.DataFrame({"msname": pd.Series(dtype=object), "ts": pd.Series(dtype="int64"), "lower": pd.Series(dtype=float), "upper": pd.Series(dtype=float)})

    def close(self) -> None:
        pass


def stream_conformal(df: DataFrame, cfg: AdaptiveConfig = AdaptiveConfig(), horizon: int = 300, delay: str = "10 minutes") -> DataFrame:
    """df: msname, ts timestamp, y, q_lo, q_hi, warmup: the value at ts and the quantiles foretold there for `horizon` seconds later.

    Out: msname, ts in seconds, lower, upper. A value is learnt before the interval of its own row is made; rows later than the watermark are dropped.
    """
    processor = type("ConformalOf", (Conformal,), {"cfg": cfg, "seconds": horizon})()
    return df.withWatermark("ts", delay).groupBy("msname").transformWithStateInPandas(processor, "msname string, ts long, lower double, upper double", "Append", "EventTime")


class Stabiliser(StatefulProcessor):
    """The recommendations of the last `seconds`, at most `most` of them; each row gets the largest unless it scales up.

    They are a list state, appended to, and written anew only when half of it is out of date.
    """

    seconds, most, idle = 300, 200, None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getListState("recent", "at bigint, wish int", self.idle)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        held = [(v[0], v[1]) for v in self.recent.get()] if self.recent.exists() else []
        recent, new, out = held, [], []
        for r in pd.concat(list(rows)).sort_values("ts").itertuples(index=False):
            new.append((int(r.ts), int(r.desired)))
            recent = [(t, w) for t, w in [*recent, new[-1]] if t > r.ts - self.seconds][-self.most :]
            out.append((key[0], int(r.ts), int(r.desired) if r.desired > r.replicas else max(w for _, w in recent)))
        if len(held) + len(new) > 2 * len(recent):
            self.recent.put(recent)
        else:
            self.recent.appendList(new)
        yield pd.DataFrame(out, columns=["msname", "ts", "stable"])

    def close(self) -> None:
        pass


def stream_stabilise(df: DataFrame, seconds: int = 300, idle: int | None = None) -> DataFrame:
    """df: msname, ts long, replicas, desired. Out: msname, ts, stable. `idle`: milliseconds after which a key's state goes."""
    processor = type("StabiliserOf", (Stabiliser,), {"seconds": seconds, "idle": idle})()
    return df.groupBy("msname").transformWithStateInPandas(processor, "msname string, ts long, stable int", "Append", "ProcessingTime" if idle else "None")


class LateRows(StreamingQueryListener):
    """Counts, for each query by its id, the rows that came after the watermark had passed them and were dropped.

    Before an aggregation, rows of a task that share a group and a bucket count as one.
    """

    def __init__(self) -> None:
        self.dropped: Counter[str] = Counter()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self.dropped[str(event.progress.id)] += sum(s.numRowsDroppedByWatermark for s in event.progress.stateOperators)

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass


def late_rows(query: StreamingQuery) -> int:
    """The rows that a query's run has dropped as late, from the progress of its batches (the last hundred by default)."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])


def stream_latest(df: DataFrame, columns: list[str], key: str = "msname", time: str = "ts") -> DataFrame:
    """The last row of each key, its count of rows without nulls, and its time; for update or complete mode."""
    valid = F.lit(True)
    for c in columns:
        valid = valid & F.col(c).isNotNull()
    last = F.max_by(F.struct(*columns), F.struct(time, *columns))
    return df.groupBy(key).agg(last.alias("_last"), F.count_if(valid).alias("valid_rows"), F.max(time).alias("last_time")).select(key, "_last.*", "valid_rows", "last_time")
