"""Forecast metrics as grouped aggregates: one pass, partial sums before the shuffle."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelens.functions.scalars import corr_guarded
from tracelens.operators.quantiles import join_on, quantiles
from tracelens.operators.rolling import full_mean


def point_metrics(df: DataFrame, by: list[str], y: str = "y", pred: str = "pred", last: str | None = "last", guard: float = 0.0, trend: str | None = None) -> DataFrame:
    """MSE, MAE, RMSE, R2, MAPE (only |y| > 1e-12; 0 without such rows), direction hit rate, under- and over-prediction; rates in per cent.

    The direction foretold is that from `last` to the forecast or, if `trend` names the value before the last, that from there to `last`.
    """
    e = F.col(pred) - F.col(y)
    total = F.var_pop(y) * F.count(y)
    aggs = [
        F.avg(e * e).alias("mse"),
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.when(total > guard, 1 - F.sum(e * e) / F.when(total > guard, total)).otherwise(0.0).alias("r2"),
        (100 * F.coalesce(F.avg(F.when(F.abs(y) > 1e-12, F.abs(e / F.when(F.abs(y) > 1e-12, F.col(y))))), F.lit(0.0))).alias("mape"),
        (100 * F.avg((e < 0).cast("double"))).alias("under_rate"),
        (100 * F.avg((e > 0).cast("double"))).alias("over_rate"),
        F.coalesce(F.avg(F.when(e < 0, -e)), F.lit(0.0)).alias("mean_under"),
        F.coalesce(F.max(F.when(e < 0, -e)), F.lit(0.0)).alias("max_under"),
        F.coalesce(F.avg(F.when(e > 0, e)), F.lit(0.0)).alias("mean_over"),
        F.coalesce(F.max(F.when(e > 0, e)), F.lit(0.0)).alias("max_over"),
    ]
    if last:
        told = F.col(last) - F.col(trend) if trend else F.col(pred) - F.col(last)
        aggs.append((100 * F.avg((F.signum(F.col(y) - F.col(last)) == F.signum(told)).cast("double"))).alias("mda"))
    return df.groupBy(*by).agg(*aggs)


def compare_naive(df: DataFrame, horizon: int) -> DataFrame:
    """One row: errors at the last step and on average over steps, those of persistence, and the change in per cent.

    The change is null where the naive error is about 0.
    """
    e, naive = F.col("pred") - F.col("y"), F.col("last") - F.col("y")
    end = F.col("h") == horizon
    out = df.agg(
        F.avg(F.when(end, e * e)).alias("mse_last"), F.avg(F.when(end, naive * naive)).alias("naive_mse_last"),
        F.avg(F.when(end, F.abs(e))).alias("mae_last"), F.avg(F.when(end, F.abs(naive))).alias("naive_mae_last"),
    )
    steps = df.groupBy("h").agg(F.avg(e * e).alias("m"), F.avg(naive * naive).alias("n")).agg(F.avg("m").alias("mse_mean"), F.avg("n").alias("naive_mse_mean"))
    both = out.join(F.broadcast(steps))  # one row each
    delta = lambda a, b: (100 * (F.col(a) - F.col(b)) / F.when(F.abs(b) > 1e-12, F.col(b)))
    return both.withColumns({"mse_last_delta": delta("mse_last", "naive_mse_last"), "mae_last_delta": delta("mae_last", "naive_mae_last"), "mse_mean_delta": delta("mse_mean", "naive_mse_mean")})


#: The metrics of `point_metrics`, and those of them that are per cent of something already.
METRICS = ("mse", "mae", "rmse", "r2", "mape", "mda", "under_rate", "over_rate", "mean_under", "mean_over", "max_under", "max_over")
IN_POINTS = ("mape", "mda", "under_rate", "over_rate")


def compare_all(df: DataFrame, horizon: int, trend: str | None = "second_last") -> DataFrame:
    """(metric, last_step, avg_steps, naive, delta): each metric at the last step, averaged over steps, and of persistence.

    Persistence foretells the direction of its last change. The difference of the last step from it is in points for
    metrics in per cent, else in per cent of the naive figure; null where that is about 0.
    """
    listed = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in METRICS])
    steps = point_metrics(df, ["h"]).select("h", F.explode(listed).alias("x")).select("h", "x.*")
    naive = point_metrics(df.where(F.col("h") == horizon), [], pred="last", trend=trend).select(F.explode(listed).alias("x")).select("x.metric", F.col("x.v").alias("naive"))
    both = steps.groupBy("metric").agg(F.max(F.when(F.col("h") == horizon, F.col("v"))).alias("last_step"), F.avg("v").alias("avg_steps")).join(naive, "metric")
    points = F.col("last_step") - F.col("naive")
    share = F.when(F.abs("naive") >= 1e-12, 100 * points / F.when(F.abs("naive") >= 1e-12, F.abs("naive")))
    return both.withColumn("delta", F.when(F.col("metric").isin(*IN_POINTS), points).otherwise(share))


def persistence_diagnostics(df: DataFrame, by: list[str]) -> DataFrame:
    """How much of a forecast is persistence: correlations, R2 against it, per cent of rows that beat it, ratio of errors.

    Groups of one row have no diagnostics.
    """
    y, p, last = F.col("y"), F.col("pred"), F.col("last")
    naive = F.avg((y - last) * (y - last))
    found = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"),
        corr_guarded(p, y).alias("corr_pred_true"),
        corr_guarded(p, last).alias("corr_pred_last"),
        corr_guarded(last, y).alias("corr_last_true"),
        (1 - F.avg((y - p) * (y - p)) / F.when(naive > 1e-12, naive)).alias("r2_vs_persistence"),
        (100 * F.avg((F.abs(y - p) < F.abs(y - last)).cast("double"))).alias("beat_rate"),
        (F.avg(F.abs(y - p)) / F.when(F.avg(F.abs(y - last)) > 1e-12, F.avg(F.abs(y - last)))).alias("mae_ratio"),
    )
    return found.where("_n >= 2").drop("_n")


def inside(y: str = "y", low: str = "lower", high: str = "upper") -> Column:
    return ((F.col(y) >= F.col(low)) & (F.col(y) <= F.col(high))).cast("double")


def interval_quality(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(inside()).alias("picp"), F.avg(F.col("upper") - F.col("lower")).alias("mpiw"))


def spike_metrics(df: DataFrame, by: list[str], quantile: float = 0.95, threshold: float | None = None) -> DataFrame:
    """Coverage of spikes, values strictly above a threshold or each group's quantile; without spikes 1, 0 and 0.

    The excess over the upper bound is averaged over all spikes, 0 where it held; the mean upper bound of no rows is 0.
    """
    if threshold is not None:
        marked = df.withColumn("threshold", F.lit(float(threshold)))
    else:
        marked = join_on(df, quantiles(df, "y", {"threshold": quantile}, by), by)
    spike, miss = F.col("y") > F.col("threshold"), F.col("y") > F.col("upper")
    return marked.groupBy(*by).agg(
        F.max("threshold").alias("threshold"),
        F.count(F.when(spike, 1)).alias("n_spikes"),
        F.coalesce(F.avg(F.when(spike, (~miss).cast("double"))), F.lit(1.0)).alias("spike_coverage"),
        F.coalesce(F.avg(F.when(spike, miss.cast("double"))), F.lit(0.0)).alias("spike_miss"),
        F.coalesce(F.avg(F.when(spike, F.greatest(F.col("y") - F.col("upper"), F.lit(0.0)))), F.lit(0.0)).alias("mean_excess"),
        F.coalesce(F.avg(F.when(spike, F.col("upper"))), F.lit(0.0)).alias("upper_in_spike"),
        F.coalesce(F.avg(F.when(~spike, F.col("upper"))), F.lit(0.0)).alias("upper_outside"),
    )


def rolling_coverage(df: DataFrame, n: int) -> DataFrame:
    """Coverage and upper and lower miss rates over full trailing windows of each series."""
    return df.withColumns({"coverage": full_mean(inside(), n), "upper_miss": full_mean((F.col("y") > F.col("upper")).cast("double"), n), "lower_miss": full_mean((F.col("y") < F.col("lower")).cast("double"), n)})


def aligned_errors(df: DataFrame, horizon: int, keys: list[str], order: str = "t") -> DataFrame:
    """Per deployment, the forecast made `horizon` rows earlier against the value: final (less its correction), raw, naive.

    Deployments with fewer aligned rows than `horizon` have none.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    y = F.lead("cpu", horizon).over(w)
    rows = df.withColumn("_y", y).withColumn("_raw", F.greatest(F.col("pred_cpu") - F.col("delta_cpu"), F.lit(0.0))).where("_y is not null")
    err = {"final": F.col("pred_cpu"), "raw": F.col("_raw"), "naive": F.col("cpu")}
    aggs = [f(F.col("_y") - c).alias(f"{n}_{m}") for n, c in err.items() for m, f in (("mse", lambda e: F.avg(e * e)), ("mae", lambda e: F.avg(F.abs(e))))]
    return rows.groupBy(*keys).agg(*aggs, F.count(F.lit(1)).alias("n")).where(F.col("n") >= horizon)


def pinball(df: DataFrame, by: list[str], levels: dict[str, float], weights: dict[str, float] | None = None) -> DataFrame:
    """Average pinball loss of each quantile column, and their weighted mean."""
    loss = {c: F.avg(F.greatest(q * (F.col("y") - F.col(c)), (q - 1) * (F.col("y") - F.col(c)))) * (weights or {}).get(c, 1.0) for c, q in levels.items()}
    return df.groupBy(*by).agg(*[x.alias(f"pinball_{c}") for c, x in loss.items()], (sum(loss.values()) / len(loss)).alias("pinball"))


def huber_loss(error: Column, beta: float) -> Column:
    size = F.abs(error)
    return F.when(size < beta, size * size / (2 * beta)).otherwise(size - beta / 2)


def huber(df: DataFrame, by: list[str], beta: float, weight: float = 1.0, relative: float = 0.0, eps: float = 1e-6, under_weight: float = 1.0) -> DataFrame:
    """Weighted Huber loss, plus a relative term; `under_weight` multiplies the loss of under-predictions."""
    e = F.col("pred") - F.col("y")
    loss = _target_loss("pred", "y", Target(beta, weight, under_weight, relative), eps)
    return df.groupBy(*by).agg(loss.alias("huber"), F.avg(e * e).alias("l2"), F.avg(F.abs(e)).alias("l1"))


@dataclass(frozen=True)
class Target:
    """How one target counts in a loss over several: Huber's beta, its share, weight of under-predictions, relative term."""

    beta: float
    share: float = 0.5
    under_weight: float = 1.0
    relative: float = 0.0


def _target_loss(pred: str, y: str, target: Target, eps: float) -> Column:
    e = F.col(pred) - F.col(y)
    side = F.when(F.col(y) > F.col(pred), target.under_weight).otherwise(1.0)
    rel = F.avg(F.abs(e) / (F.abs(y) + eps)) * target.relative if target.relative else F.lit(0.0)
    return target.share * (F.avg(huber_loss(e, target.beta) * side) + rel)


def target_losses(df: DataFrame, by: list[str], targets: dict[str, Target], last_step: int | None = None, eps: float = 1e-6) -> DataFrame:
    """Losses over targets t with columns y_t and pred_t, one row per step h: the sum of Huber losses by share (`huber`), of mean
    squares (`mse`), of mean squares but for mean absolute errors of targets after the first (`mixed`), and the mean square of
    all targets together (`joint`). With `last_step` only rows of that step count.
    """
    rows = df if last_step is None else df.where(F.col("h") == last_step)
    error = {t: F.col(f"pred_{t}") - F.col(f"y_{t}") for t in targets}
    square, absolute = ({t: F.avg(f(e)) for t, e in error.items()} for f in (lambda e: e * e, F.abs))
    first = next(iter(targets))
    return rows.groupBy(*by).agg(
        sum(_target_loss(f"pred_{t}", f"y_{t}", how, eps) for t, how in targets.items()).alias("huber"),
        sum(square.values()).alias("mse"),
        sum(square[t] if t == first else absolute[t] for t in targets).alias("mixed"),
        (sum(square.values()) / len(targets)).alias("joint"),
    )
