"""Table-level forecasts: persistence, autoregression on differences, empirical quantiles, linear heads, ensembles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelens.functions.scalars import softmax_over
from tracelens.operators.quantiles import quantiles
from tracelens.session import materialise


def persistence(df: DataFrame, horizon: int, value: str = "cpu") -> DataFrame:
    """(msname, pos, h, pred): the value at pos, for the h steps after it."""
    steps = F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h")
    return df.select("msname", "pos", steps, F.col(value).alias("pred"))


def match_horizon(forecasts: DataFrame, actuals: DataFrame, value: str = "cpu") -> DataFrame:
    """Adds y, the actual at pos + h."""
    y = actuals.select("msname", F.col("pos").alias("_at"), F.col(value).alias("y"))
    of = forecasts.withColumn("_at", F.col("pos") + F.col("h"))
    return of.join(y, ["msname", "_at"]).drop("_at")


def fit_ar1(df: DataFrame, value: str = "cpu") -> DataFrame:
    """(msname, phi, drift, last, before): least squares of d(t) on d(t-1) over train rows; the end of the series."""
    w = Window.partitionBy("msname").orderBy("pos")
    d = df.withColumn("d", F.col(value) - F.lag(value).over(w)).withColumn("d1", F.lag("d").over(w))
    both = F.when(F.col("d").isNotNull() & F.col("d1").isNotNull(), F.col("d"))
    x = F.when(both.isNotNull(), F.col("d1"))
    fitted = d.groupBy("msname").agg(
        F.covar_pop(both, x).alias("_cov"), F.var_pop(x).alias("_var"), F.avg(both).alias("_my"), F.avg(x).alias("_mx"),
        F.max_by(F.col(value), F.col("pos")).alias("last"), F.max_by(F.col("d"), F.col("pos")).alias("last_d"),
    )
    phi = F.coalesce(F.col("_cov") / F.when(F.col("_var") > 1e-12, F.col("_var")), F.lit(0.0))
    return fitted.withColumn("phi", phi).select("msname", "phi", (F.coalesce("_my", F.lit(0.0)) - F.col("phi") * F.coalesce("_mx", F.lit(0.0))).alias("drift"), "last", F.coalesce("last_d", F.lit(0.0)).alias("last_d"))


def ar1_from(model: DataFrame, rows: DataFrame, origin: str = "test_start", value: str = "cpu") -> DataFrame:
    """The model of `fit_ar1` with its series' end moved: to the last row before test (`test_start`), or left at the end of train."""
    if origin == "train_end":
        return model
    before = rows.where("split <> 'test'").withColumn("_d", F.col(value) - F.lag(value).over(Window.partitionBy("msname").orderBy("pos")))
    ends = before.groupBy("msname").agg(F.max_by(F.col(value), F.col("pos")).alias("last"), F.coalesce(F.max_by(F.col("_d"), F.col("pos")), F.lit(0.0)).alias("last_d"))
    return model.drop("last", "last_d").join(ends, "msname")


def ar1_forecast(model: DataFrame, horizon: int) -> DataFrame:
    """(msname, h, pred): d(h) = drift + phi d(h-1), summed onto the last value."""
    begin = F.struct(F.col("last").alias("y"), F.col("last_d").alias("d"))

    def step(acc, _):
        d = F.col("drift") + F.col("phi") * acc["d"]
        return F.struct((acc["y"] + d).alias("y"), d.alias("d"))

    steps = model.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h"))
    return steps.select("msname", "h", F.aggregate(F.sequence(F.lit(1), F.col("h")), begin, step, lambda acc: acc["y"]).alias("pred"))


def ar1_rolling(df: DataFrame, horizon: int, refit: int = 25, history: int = 128, value: str = "cpu") -> DataFrame:
    """(msname, origin, h, pred): the model fitted anew every `refit` rows on the trailing `history` rows.

    Each row belongs to the few origins whose history holds it, so it is repeated history / refit times at most.
    """
    origins = F.sequence(F.call_function("div", F.col("pos") + refit, F.lit(refit)), F.call_function("div", F.col("pos") + history, F.lit(refit)))
    spread = df.select("msname", "pos", "n", value, F.explode(origins).alias("o"))
    spread = spread.withColumn("origin", F.col("o") * refit).where((F.col("origin") > F.col("pos")) & (F.col("origin") <= F.col("pos") + history) & (F.col("origin") < F.col("n")) & (F.col("origin") >= history))
    keyed = spread.select(F.concat_ws("\u0001", "msname", F.col("origin").cast("string")).alias("msname"), "pos", value)
    out = ar1_forecast(fit_ar1(keyed, value), horizon)
    parts = F.split("msname", "\u0001")
    return out.select(parts[0].alias("msname"), parts[1].cast("long").alias("origin"), "h", "pred")


def select_order(df: DataFrame, value: str = "cpu", lags: tuple[int, ...] = (0, 1, 2, 5), diffs: tuple[int, ...] = (0, 1)) -> DataFrame:
    """(msname, p, d, aic): least squares for each (p, d) and the Gaussian AIC; (1, 1) where none can be fitted."""

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        y = rows.sort_values("pos")[value].to_numpy(float)
        best = (np.inf, 1, 1)
        for d in diffs:
            z = np.diff(y, n=d)
            for p in lags:
                n = len(z) - max(lags)
                if n < p + 3:
                    continue
                x = np.column_stack([np.ones(n), *[z[max(lags) - k : len(z) - k] for k in range(1, p + 1)]])
                coef, *_ = np.linalg.lstsq(x, z[max(lags) :], rcond=None)
                rss = float(((z[max(lags) :] - x @ coef) ** 2).sum())
                best = min(best, (n * np.log(max(rss / n, 1e-300)) + 2 * (p + 2), p, d))
        return pd.DataFrame({"msname": [rows["msname"].iloc[0]], "p": [best[1]], "d": [best[2]], "aic": [best[0]]})

    return df.select("msname", "pos", value).groupBy("msname").applyInPandas(fit, "msname string, p int, d int, aic double")


def average_matrix(length: int, kernel: int) -> np.ndarray:
    """What a row of values is multiplied with to give its edge-padded moving average, kernel // 2 values in front."""
    at = np.clip(np.arange(length)[:, None] + np.arange(kernel) - kernel // 2, 0, length - 1)
    out = np.zeros((length, length))
    np.add.at(out, (at, np.arange(length)[:, None]), 1 / kernel)
    return out


def _inputs(batch: pa.RecordBatch, kind: str, target: int, kernel: int) -> np.ndarray:
    """A row for each window: all inputs (`flat`), or the target's trend and what is left of it (`trend_seasonal`)."""
    rows = batch.column(batch.schema.get_field_index("x"))
    x = rows.flatten().flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(rows[0]), -1)
    if kind == "flat":
        return x.reshape(batch.num_rows, -1)
    trend = x[:, :, target] @ average_matrix(x.shape[1], kernel)
    return np.hstack([trend, x[:, :, target] - trend])


def _outputs(batch: pa.RecordBatch, target: int) -> np.ndarray:
    rows = batch.column(batch.schema.get_field_index("y"))
    return rows.flatten().flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(rows[0]), -1)[:, :, target]


def linear_heads(windows: DataFrame, target: int = 0, ridge: float = 1e-3, kind: str = "flat", kernel: int = 25) -> tuple[np.ndarray, np.ndarray]:
    """(weights, a column for each horizon, and intercepts) of ridge regressions on train windows, all horizons at once.

    One pass: each task adds up the products of its inputs with each other and with all outputs, and these sums, a few
    thousand numbers, are added by cell. Products are taken from the first window on, so that they don't cancel for values far
    from zero. Inputs count by their standard deviation, constant ones not at all.
    """
    train = windows.where("split = 'train'").select("x", "y")
    first = train.limit(1).toArrow()
    if not first.num_rows:
        raise ValueError("no train windows")
    begin = first.combine_chunks().to_batches()[0]
    pilot = np.concatenate([_inputs(begin, kind, target, kernel)[0], _outputs(begin, target)[0], [0.0]])
    outputs = len(_outputs(begin, target)[0])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(pilot), len(pilot)))
        for batch in batches:
            if batch.num_rows:
                rows = np.hstack([_inputs(batch, kind, target, kernel), _outputs(batch, target), np.ones((batch.num_rows, 1))]) - pilot
                total += rows.T @ rows
        i, j = np.triu_indices(len(pilot))
        yield pa.record_batch([pa.array(i), pa.array(j), pa.array(total[i, j])], names=["i", "j", "v"])

    sums = np.zeros((len(pilot), len(pilot)))
    for r in train.mapInArrow(work, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        sums[r.i, r.j] = sums[r.j, r.i] = r.v
    n, inputs = sums[-1, -1], len(pilot) - 1 - outputs
    mean = sums[-1, :-1] / n
    cross = sums[:-1, :-1] / n - np.outer(mean, mean)
    spread = np.sqrt(np.maximum(np.diag(cross), 0) * n / max(n - 1, 1))
    used = np.flatnonzero(spread[:inputs] > 1e-9)
    weights = np.zeros((inputs, outputs))
    for h in range(outputs):
        if len(used) and spread[inputs + h] > 1e-12:
            gram = cross[np.ix_(used, used)] / np.outer(spread[used], spread[used]) + ridge / spread[inputs + h] * np.eye(len(used))
            weights[used, h] = np.linalg.solve(gram, cross[used, inputs + h] / spread[used]) / spread[used]
    centre = mean + pilot[:-1]
    return weights, centre[inputs:] - centre[:inputs] @ weights


def linear_direct(windows: DataFrame, target: int = 0, ridge: float = 1e-3, kind: str = "flat", kernel: int = 25) -> DataFrame:
    """(msname, split, win_start, h, pred, y): linear heads fitted on train windows; `kind` as in `linear_heads`.

    The windows are written once, as they are read for fitting and for forecasting. All have the same shape.
    """
    windows = materialise(windows.select("msname", "split", "win_start", "x", "y"), "windows")
    weights, intercepts = linear_heads(windows, target, ridge, kind, kernel)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = _inputs(batch, kind, target, kernel) @ weights + intercepts
                yield pa.record_batch([*[batch.column(i) for i in range(3)], pa.array(made.tolist()), pa.array(_outputs(batch, target).tolist())], names=["msname", "split", "win_start", "p", "q"])

    made = windows.mapInArrow(work, "msname string, split string, win_start long, p array<double>, q array<double>")
    each = made.select("msname", "split", "win_start", F.posexplode(F.arrays_zip("p", "q")).alias("h", "s"))
    return each.select("msname", "split", "win_start", (F.col("h") + 1).alias("h"), F.col("s.p").alias("pred"), F.col("s.q").alias("y"))


def empirical_quantiles(df: DataFrame, horizon: int, levels: tuple[float, float, float] = (0.10, 0.50, 0.95), value: str = "cpu", train: str = "split = 'train'") -> DataFrame:
    """(msname, h, q_lo, q50, q_hi): exact quantiles of h-step changes over train rows."""
    w = Window.partitionBy("msname").orderBy("pos")
    rows = df.where(train)
    changes = rows.select("msname", F.array(*[F.struct(F.lit(h).alias("h"), (F.lead(value, h).over(w) - F.col(value)).alias("d")) for h in range(1, horizon + 1)]).alias("all"))
    steps = changes.select("msname", F.explode("all").alias("x"))
    flat = steps.select("msname", "x.h", "x.d").where("d is not null")
    return quantiles(flat, "d", dict(zip(("q_lo", "q50", "q_hi"), levels, strict=True)), ["msname", "h"])


def quantile_forecast(df: DataFrame, changes: DataFrame, value: str = "cpu") -> DataFrame:
    """(msname, pos, h, q_lo, q50, q_hi): the value at pos plus the quantiles of its service's changes."""
    return df.select("msname", "pos", F.col(value).alias("_v")).join(changes, "msname").select("msname", "pos", "h", *[(F.col("_v") + F.col(q)).alias(q) for q in ("q_lo", "q50", "q_hi")])


def ensemble(forecasts: DataFrame, weights: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pred): forecasts (model, keys, pred) averaged with softmax weights (model, weight)."""
    shares = weights.select("model", softmax_over(F.col("weight")).alias("share"))
    return forecasts.join(shares, "model").groupBy(*keys).agg(F.sum(F.col("share") * F.col("pred")).alias("pred"))


def add_last(df: DataFrame, delta: str = "delta", last: str = "last", masked: bool = False) -> DataFrame:
    """A forecast from a predicted change: the last value plus the change (no change where the target is masked)."""
    return df.withColumn("pred", F.col(last) + (F.lit(0.0) if masked else F.col(delta)))
