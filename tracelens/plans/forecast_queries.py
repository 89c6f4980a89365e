"""Queries over forecasts: baselines, calibration, metrics, scaling decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelens.functions.scalars import ordered_quantiles
from tracelens.operators import conformal, forecast, metrics, scaling, series, windows
from tracelens.plans import views
from tracelens.plans.registry import query
from tracelens.plans.series_queries import L, hourly_windows
from tracelens.session import materialise

H = 5


def split_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.assign_split(views.series_hourly(spark, sf_dir))


@query("SELECT p.msname, p.pos, CAST(h AS INTEGER) AS h, R(p.cpu;R) AS pred, R(a.cpu;R) AS y FROM series_hourly p CROSS JOIN range(1, 6) x(h) JOIN series_hourly a ON a.msname = p.msname AND a.pos = p.pos + x.h")
def m1_j7_persistence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.series_hourly(spark, sf_dir)
    return forecast.match_horizon(forecast.persistence(rows, H), rows).select("msname", "pos", "h", "pred", "y")


AR1 = "d AS (SELECT msname, pos, cpu, cpu - lag(cpu) OVER w AS d FROM split_hourly WHERE split = 'train' WINDOW w AS (PARTITION BY msname ORDER BY pos)), e AS (SELECT *, lag(d) OVER (PARTITION BY msname ORDER BY pos) AS d1 FROM d), f AS (SELECT msname, coalesce(covar_pop(d, d1) / nullif(var_pop(d1), 0), 0) AS phi, avg(d) AS my, avg(d1) AS mx FROM e WHERE d IS NOT NULL AND d1 IS NOT NULL GROUP BY msname), l AS (SELECT msname, arg_max(cpu, pos) AS last, arg_max(d, pos) AS last_d FROM d GROUP BY msname), m AS (SELECT msname, phi, my - phi * mx AS drift, last, last_d FROM f JOIN l USING (msname))"


@query(f"WITH RECURSIVE {AR1}, s AS (SELECT msname, phi, drift, 1 AS h, drift + phi * last_d AS dd, last + drift + phi * last_d AS pred FROM m UNION ALL SELECT msname, phi, drift, h + 1, drift + phi * dd, pred + drift + phi * dd FROM s WHERE h < 5) SELECT msname, CAST(h AS INTEGER) AS h, R(pred;R) AS pred FROM s")
def m2_autoregression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecast.ar1_forecast(forecast.fit_ar1(split_series(spark, sf_dir).where("split = 'train'")), H)


@query(f"WITH RECURSIVE {AR1}, b AS (SELECT msname, pos, cpu, cpu - lag(cpu) OVER (PARTITION BY msname ORDER BY pos) AS d FROM split_hourly WHERE split <> 'test'), n AS (SELECT msname, arg_max(cpu, pos) AS last, arg_max(d, pos) AS last_d FROM b GROUP BY msname), s AS (SELECT m.msname, phi, drift, 1 AS h, drift + phi * n.last_d AS dd, n.last + drift + phi * n.last_d AS pred FROM m JOIN n USING (msname) UNION ALL SELECT msname, phi, drift, h + 1, drift + phi * dd, pred + drift + phi * dd FROM s WHERE h < 5) SELECT msname, CAST(h AS INTEGER) AS h, R(pred;R) AS pred FROM s")
def m2_from_test_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted on train, forecast from the last row before test."""
    rows = materialise(split_series(spark, sf_dir), "split")
    return forecast.ar1_forecast(forecast.ar1_from(forecast.fit_ar1(rows.where("split = 'train'")), rows), H)


@query("WITH o AS (SELECT s.msname, b.o * 25 AS origin FROM (SELECT msname, max(n) AS n FROM series_hourly GROUP BY msname) s CROSS JOIN range(1, 4000) b(o) WHERE b.o * 25 < s.n AND b.o * 25 >= 128), r AS (SELECT s.msname, o.origin, pos, cpu FROM series_hourly s JOIN o ON o.msname = s.msname AND s.pos < o.origin AND s.pos >= o.origin - 128), d AS (SELECT *, cpu - lag(cpu) OVER (PARTITION BY msname, origin ORDER BY pos) AS d FROM r), e AS (SELECT *, lag(d) OVER (PARTITION BY msname, origin ORDER BY pos) AS d1 FROM d), f AS (SELECT msname, origin, coalesce(covar_pop(d, d1) / nullif(var_pop(d1), 0), 0) AS phi, avg(d) AS my, avg(d1) AS mx FROM e WHERE d1 IS NOT NULL GROUP BY ALL), l AS (SELECT msname, origin, arg_max(cpu, pos) AS last, arg_max(d, pos) AS last_d FROM d GROUP BY ALL), g AS (SELECT msname, origin, phi, my - phi * mx AS drift, last, last_d, unnest(range(1, 6)) AS h FROM f JOIN l USING (msname, origin)) SELECT msname, CAST(origin AS BIGINT) AS origin, CAST(h AS INTEGER) AS h, R(list_reduce(list_prepend({'y': last, 'd': last_d}, list_transform(range(h), lambda k: {'y': last, 'd': last_d})), lambda s, k: {'y': s.y + drift + phi * s.d, 'd': drift + phi * s.d}).y;R) AS pred FROM g")
def m2_rolling_refit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecast.ar1_rolling(views.series_hourly(spark, sf_dir), H)


def _orders_sql() -> str:
    d0 = "z0 AS (SELECT msname, pos, cpu AS z FROM split_hourly WHERE split = 'train')"
    d1 = "z1 AS (SELECT msname, pos, z - lag(z) OVER (PARTITION BY msname ORDER BY pos) AS z FROM z0 QUALIFY z IS NOT NULL)"
    fits = []
    for d in (0, 1):
        lagged = f"(SELECT msname, z, lag(z) OVER (PARTITION BY msname ORDER BY pos) AS x FROM z{d})"
        for p, rss in ((0, "var_pop(z)"), (1, "(var_pop(z) - covar_pop(z, x) ** 2 / nullif(var_pop(x), 0))")):
            fits.append(f"SELECT msname, count(*) * ln(greatest({rss}, 1e-300)) + {2 * (p + 2)} AS aic, {p} AS p, {d} AS d FROM {lagged} WHERE x IS NOT NULL GROUP BY msname HAVING count(*) >= {p + 3}")
    return f"WITH {d0}, {d1}, fits AS ({' UNION ALL '.join(fits)}) SELECT msname, CAST(p AS INTEGER) AS p, CAST(d AS INTEGER) AS d, R(aic;R) AS aic FROM fits QUALIFY row_number() OVER (PARTITION BY msname ORDER BY aic, p, d) = 1"


@query(_orders_sql(), digits=5)
def m3_order_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over orders that SQL can fit too; the operator's own grid has longer ones."""
    return forecast.select_order(split_series(spark, sf_dir).where("split = 'train'"), lags=(0, 1))


@query()
def m4_linear_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = forecast.linear_direct(hourly_windows(spark, sf_dir))
    return metrics.point_metrics(made.where("split = 'test'"), ["h"], last=None)


@query()
def m4_trend_seasonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = forecast.linear_direct(hourly_windows(spark, sf_dir), kind="trend_seasonal", kernel=7)
    return metrics.point_metrics(made.where("split = 'test'"), ["h"], last=None)


@query("SELECT msname, pos, R(last + (pred - last) * 0.5;R) AS pred, R(last;R) AS masked FROM forecast_log")
def m5_change_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = views.forecast_log(spark, sf_dir).withColumn("delta", (F.col("pred") - F.col("last")) * 0.5)
    masked = forecast.add_last(log, masked=True).withColumnRenamed("pred", "masked").select("msname", "pos", "masked")
    return forecast.add_last(log).select("msname", "pos", "pred").join(masked, ["msname", "pos"])


QUANTILES = "c AS (SELECT a.msname, CAST(x.h AS INTEGER) AS h, b.cpu - a.cpu AS d FROM split_hourly a CROSS JOIN range(1, 6) x(h) JOIN split_hourly b ON a.msname = b.msname AND b.pos = a.pos + x.h WHERE a.split = 'train' AND b.split = 'train'), q AS (SELECT msname, h, quantile_cont(d, 0.10) AS q_lo, quantile_cont(d, 0.50) AS q50, quantile_cont(d, 0.95) AS q_hi FROM c GROUP BY ALL)"


@query(f"WITH {QUANTILES} SELECT msname, h, R(q_lo;R) AS q_lo, R(q50;R) AS q50, R(q_hi;R) AS q_hi FROM q")
def m6_empirical_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecast.empirical_quantiles(split_series(spark, sf_dir), H)


def quantile_rows(spark: SparkSession, sf_dir: str, target: str = "cpu") -> DataFrame:
    """Quantile forecasts of validation and test rows with the values they foretold."""
    rows = split_series(spark, sf_dir)
    made = forecast.quantile_forecast(rows, forecast.empirical_quantiles(rows, H, value=target), target)
    y = rows.select("msname", (F.col("pos") - H).alias("pos"), F.col(target).alias("y"), "split")
    return made.where(F.col("h") == H).join(y, ["msname", "pos"])


ROWS = f"{QUANTILES}, g AS (SELECT a.msname, a.pos, a.cpu + q_lo AS q_lo, a.cpu + q50 AS q50, a.cpu + q_hi AS q_hi, b.cpu AS y, b.split FROM split_hourly a JOIN q ON q.msname = a.msname AND q.h = 5 JOIN split_hourly b ON b.msname = a.msname AND b.pos = a.pos + 5)"


@query(f"WITH {ROWS}, s AS (SELECT msname, greatest(0, q_lo - y, y - q_hi) AS s FROM g WHERE split = 'val'), o AS (SELECT msname, s, row_number() OVER (PARTITION BY msname ORDER BY s) AS r, count(*) OVER (PARTITION BY msname) AS n FROM s), f AS (SELECT msname, s AS q_conf FROM o WHERE r = ceil((n - 1) * 0.9::DOUBLE) + 1), t AS (SELECT g.msname, y, q_lo - coalesce(q_conf, 0) AS lower, q_hi + coalesce(q_conf, 0) AS upper FROM g LEFT JOIN f USING (msname) WHERE split = 'test') SELECT msname, R(avg(CASE WHEN y >= lower AND y <= upper THEN 1.0 ELSE 0.0 END);R) AS picp, R(avg(upper - lower);R) AS mpiw FROM t GROUP BY msname")
def m8_e4_cqr_interval_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialise(quantile_rows(spark, sf_dir), "quantiles")
    fitted = conformal.cqr_fit(rows.where("split = 'val'"), 0.1, ["msname"])
    return metrics.interval_quality(conformal.cqr_apply(rows.where("split = 'test'"), fitted, ["msname"]), ["msname"])


@query(f"WITH {ROWS}, s AS (SELECT msname, abs(y - q50) AS s FROM g WHERE split = 'val'), o AS (SELECT msname, s, row_number() OVER (PARTITION BY msname ORDER BY s) AS r, count(*) OVER (PARTITION BY msname) AS n FROM s), f AS (SELECT msname, s AS radius FROM o WHERE n >= 50 AND r = ceil((n - 1) * 0.9::DOUBLE) + 1) SELECT g.msname, pos, R(q50 - coalesce(radius, 0);R) AS lower, R(q50 + coalesce(radius, 0);R) AS upper, R(q50 + coalesce(radius, 0);R) AS one_sided FROM g LEFT JOIN f USING (msname) WHERE split = 'test'")
def m9_split_conformal(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialise(quantile_rows(spark, sf_dir), "quantiles").withColumn("pred", F.col("q50"))
    fitted = conformal.split_fit(rows.where("split = 'val'"), 0.1, ["msname"])
    return conformal.split_apply(rows.where("split = 'test'"), fitted, ["msname"]).select("msname", "pos", "lower", "upper", "one_sided")


def _rows_of(target: str) -> str:
    """The rows of `online_rows` for a target, as common table expressions named after it."""
    return f"c_{target} AS (SELECT a.msname, b.{target} - a.{target} AS d FROM split_hourly a JOIN split_hourly b ON a.msname = b.msname AND b.pos = a.pos + 5 WHERE a.split = 'train' AND b.split = 'train'), q_{target} AS (SELECT msname, quantile_cont(d, 0.10) AS q_lo, quantile_cont(d, 0.95) AS q_hi FROM c_{target} GROUP BY ALL), g_{target} AS (SELECT a.msname, '{target}' AS target, a.pos, a.{target} + q_lo AS q_lo, a.{target} + q_hi AS q_hi, a.{target} AS y, a.split, a.t FROM split_hourly a JOIN q_{target} q ON q.msname = a.msname WHERE a.split <> 'train')"


def _replay_sql(targets: tuple[str, ...], then: str, live: bool = False) -> str:
    """The adaptive state row by row: each step reads the one before. A test row learns from the forecast made five rows before it,
    or `live` from that made five hours before it, and then before its own interval is made."""
    union = " UNION ALL ".join(f"SELECT * FROM g_{t}" for t in targets)
    bound = "list_sort({s})[CAST(ceil((len({s}) - 1) * (1 - {a})) AS BIGINT) + 1]"
    low = "CASE WHEN len({su}) = 0 THEN {q} ELSE {q} - " + bound.format(s="{sl}", a="{al}") + " END"
    high = "CASE WHEN len({su}) = 0 THEN {q} ELSE {q} + " + bound.format(s="{su}", a="{au}") + " END"
    kept = "CASE WHEN u_lo IS NULL THEN {s} ELSE list_append({s}, greatest(0.0::DOUBLE, {x}))[-100:] END"
    level = "CASE WHEN u_lo IS NULL THEN {a} ELSE least(greatest({a} + 0.01::DOUBLE * ({c}::DOUBLE - CASE WHEN {miss} THEN 1 ELSE 0 END), 0.001::DOUBLE), 0.5::DOUBLE) END"
    old, new = {"su": "su", "sl": "sl", "au": "au", "al": "al"}, {"su": "su2", "sl": "sl2", "au": "au2", "al": "al2"}
    shown = "CASE WHEN {first} THEN {b} ELSE {a} END"
    before = "FROM (SELECT s.*, p.su2 AS su, p.sl2 AS sl, p.au2 AS au, p.al2 AS al FROM st p JOIN src s ON s.msname = p.msname AND s.target = p.target AND s.k = p.k + 1)"
    missed = f"SELECT *, {low.format(q='u_lo', **old)} AS ulow, {high.format(q='u_hi', **old)} AS uhigh {before}"
    learnt = f"SELECT *, {kept.format(s='su', x='y - u_hi')} AS su2, {kept.format(s='sl', x='u_lo - y')} AS sl2, {level.format(a='au', c='0.05', miss='y > uhigh')} AS au2, {level.format(a='al', c='0.10', miss='y < ulow')} AS al2 FROM ({missed})"
    first = "split <> 'val'" if live else "false"
    lo = shown.format(first=first, a=low.format(q="q_lo", **old), b=low.format(q="q_lo", **new))
    hi = shown.format(first=first, a=high.format(q="q_hi", **old), b=high.format(q="q_hi", **new))
    step = f"SELECT msname, target, k, pos, y, split, {lo} AS lo, {hi} AS hi, au, al, su2, sl2, au2, al2 FROM ({learnt})"
    start = "SELECT msname, target, 0::BIGINT AS k, 0::BIGINT AS pos, 0.0::DOUBLE AS y, '' AS split, 0.0::DOUBLE AS lo, 0.0::DOUBLE AS hi, 0.0::DOUBLE AS au, 0.0::DOUBLE AS al, []::DOUBLE[] AS su2, []::DOUBLE[] AS sl2, 0.05::DOUBLE AS au2, 0.10::DOUBLE AS al2 FROM (SELECT DISTINCT msname, target FROM src)"
    ago = "max({}) OVER (PARTITION BY msname, target ORDER BY t RANGE BETWEEN 18000 PRECEDING AND 18000 PRECEDING)" if live else "lag({}, 5) OVER w"
    used = ", ".join(f"CASE WHEN split = 'val' THEN q_{s} WHEN {ago.format('split')} = 'test' THEN {ago.format(f'q_{s}')} END AS u_{s}" for s in ("lo", "hi"))
    return f"WITH RECURSIVE {', '.join(_rows_of(t) for t in targets)}, src AS (SELECT *, row_number() OVER w AS k, {used} FROM ({union}) WINDOW w AS (PARTITION BY msname, target ORDER BY pos)), st AS ({start} UNION ALL {step}) {then}"


CLIPPED = "R(least(greatest(lo, 0), 1);R) AS lower, R(least(greatest(hi, 0), 1);R) AS upper"


def online_rows(spark: SparkSession, sf_dir: str, target: str = "cpu") -> DataFrame:
    """Validation and test rows as they come: the value of the row, y, and the quantiles foretold there for `H` rows later."""
    rows = split_series(spark, sf_dir)
    made = forecast.quantile_forecast(rows, forecast.empirical_quantiles(rows, H, value=target), target).where(F.col("h") == H)
    return made.join(rows.select("msname", "pos", "t", F.col(target).alias("y"), "split"), ["msname", "pos"]).where("split <> 'train'")


def adaptive_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of both targets; those of the validation split warm a state up. Each target has a state of its own."""
    both = [online_rows(spark, sf_dir, t).withColumn("target", F.lit(t)) for t in ("cpu", "mem")]
    return both[0].unionByName(both[1]).withColumn("warmup", F.col("split") == "val")


@query(_replay_sql(("cpu", "mem"), f"SELECT msname, target, pos, R(y;R) AS y, {CLIPPED}, R(au;R) AS alpha_upper, R(al;R) AS alpha_lower FROM st WHERE k > 0 AND split = 'test'"))
def m10_m11_m13_adaptive_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test rows are reported; intervals are clipped."""
    out = conformal.adaptive_replay(adaptive_rows(spark, sf_dir), conformal.AdaptiveConfig(clip=True))
    return out.where("not warmup").drop("warmup")


@query(_replay_sql(("cpu", "mem"), f", made AS (SELECT *, {CLIPPED} FROM st WHERE k > 0 AND split = 'test'), met AS (SELECT m.msname, m.target, R(a.y;R) AS y, m.lower, m.upper FROM made m JOIN made a ON a.msname = m.msname AND a.target = m.target AND a.pos = m.pos + 5) SELECT msname, target, R(avg(CASE WHEN y >= lower AND y <= upper THEN 1.0 ELSE 0.0 END);R) AS picp, R(avg(upper - lower);R) AS mpiw FROM met GROUP BY ALL"))
def m13_e4_replay_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the value five rows later lies in the interval that was made for it."""
    made = materialise(conformal.adaptive_replay(adaptive_rows(spark, sf_dir), conformal.AdaptiveConfig(clip=True)).where("not warmup"), "replay")
    made = made.withColumns({c: F.round(c, 9) for c in ("y", "lower", "upper")})  # so that equal values count as equal
    later = made.select("msname", "target", (F.col("pos") - H).alias("pos"), "y")
    return metrics.interval_quality(made.drop("y").join(later, ["msname", "target", "pos"]), ["msname", "target"])


@query(_replay_sql(("cpu", "mem"), f"SELECT msname, target, pos, {CLIPPED} FROM (SELECT *, min(pos) OVER (PARTITION BY msname, target) AS first FROM st WHERE k > 0 AND split = 'test') WHERE pos >= first + 20"))
def m12_state_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state after 20 test rows, forecasts that wait for their values included, is kept as a table, and later rows go on from it."""
    first = Window.partitionBy("msname", "target")
    rows = adaptive_rows(spark, sf_dir).withColumn("first", F.min(F.when(~F.col("warmup"), F.col("pos"))).over(first) + 20)
    rows, cfg = materialise(rows, "adaptive"), conformal.AdaptiveConfig(clip=True)
    states = materialise(conformal.adaptive_states(rows.where("pos < first"), cfg), "states")
    return conformal.adaptive_replay(rows.where("pos >= first"), cfg, states=states).select("msname", "target", "pos", "lower", "upper")


MODELS = "f AS (SELECT 'a' AS model, msname, pos, pred FROM forecast_log UNION ALL SELECT 'b', msname, pos, last FROM forecast_log UNION ALL SELECT 'c', msname, pos, second_last FROM forecast_log), w AS (SELECT model, exp(weight) / sum(exp(weight)) OVER () AS share FROM (VALUES ('a', 1.0::DOUBLE), ('b', 0.5::DOUBLE), ('c', 0.0::DOUBLE)) v(model, weight))"


@query(f"WITH {MODELS} SELECT msname, pos, R(sum(share * pred);R) AS pred FROM f JOIN w USING (model) GROUP BY ALL")
def m7_f12_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = views.forecast_log(spark, sf_dir)
    rows = log.select("msname", "pos", F.explode(F.create_map(F.lit("a"), "pred", F.lit("b"), "last", F.lit("c"), "second_last")).alias("model", "pred"))
    weights = spark.createDataFrame([("a", 1.0), ("b", 0.5), ("c", 0.0)], "model string, weight double")
    return forecast.ensemble(rows, weights, ["msname", "pos"])


@query("SELECT msname, pos, R(pred - ln(1 + exp(last));R) AS q_lo, R(pred;R) AS q50, R(pred + ln(1 + exp(second_last));R) AS q_hi FROM forecast_log")
def p11_ordered_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.forecast_log(spark, sf_dir).select("msname", "pos", *ordered_quantiles(F.col("pred"), F.col("last"), F.col("second_last")))


@query("SELECT msname, pos, round_even(greatest(round(pred - last, 9), 0.0::DOUBLE), 2) AS v FROM forecast_log")
def p12_quantised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.forecast_log(spark, sf_dir).select("msname", "pos", F.bround(F.greatest(F.round(F.col("pred") - F.col("last"), 9), F.lit(0.0)), 2).alias("v"))


POINT = "R(avg((pred - y) * (pred - y));R) AS mse, R(avg(abs(pred - y));R) AS mae, R(sqrt(avg((pred - y) * (pred - y)));R) AS rmse, R(CASE WHEN var_pop(y) > 0 THEN 1 - sum((pred - y) * (pred - y)) / (var_pop(y) * count(y)) ELSE 0 END;R) AS r2, R(100 * coalesce(avg(CASE WHEN abs(y) > 1e-12 THEN abs((pred - y) / y) END), 0);R) AS mape, R(100 * avg(CASE WHEN pred < y THEN 1.0 ELSE 0.0 END);R) AS under_rate, R(100 * avg(CASE WHEN pred > y THEN 1.0 ELSE 0.0 END);R) AS over_rate, R(coalesce(avg(CASE WHEN pred < y THEN y - pred END), 0);R) AS mean_under, R(coalesce(max(CASE WHEN pred < y THEN y - pred END), 0);R) AS max_under, R(coalesce(avg(CASE WHEN pred > y THEN pred - y END), 0);R) AS mean_over, R(coalesce(max(CASE WHEN pred > y THEN pred - y END), 0);R) AS max_over, R(100 * avg(CASE WHEN sign(y - last) = sign(pred - last) THEN 1.0 ELSE 0.0 END);R) AS mda"


@query(f"SELECT msname, {POINT} FROM forecast_log GROUP BY msname", digits=7)
def e1_point_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.point_metrics(views.forecast_log(spark, sf_dir), ["msname"])


@query("WITH f AS (SELECT *, 1 + pos % 5 AS h FROM forecast_log), a AS (SELECT avg(CASE WHEN h = 5 THEN (pred - y) * (pred - y) END) AS mse_last, avg(CASE WHEN h = 5 THEN (last - y) * (last - y) END) AS naive_mse_last, avg(CASE WHEN h = 5 THEN abs(pred - y) END) AS mae_last, avg(CASE WHEN h = 5 THEN abs(last - y) END) AS naive_mae_last FROM f), b AS (SELECT avg(m) AS mse_mean, avg(n) AS naive_mse_mean FROM (SELECT h, avg((pred - y) * (pred - y)) AS m, avg((last - y) * (last - y)) AS n FROM f GROUP BY h)) SELECT R(mse_last;R) AS mse_last, R(naive_mse_last;R) AS naive_mse_last, R(mae_last;R) AS mae_last, R(naive_mae_last;R) AS naive_mae_last, R(mse_mean;R) AS mse_mean, R(naive_mse_mean;R) AS naive_mse_mean, R(100 * (mse_last - naive_mse_last) / naive_mse_last;R) AS mse_last_delta, R(100 * (mae_last - naive_mae_last) / naive_mae_last;R) AS mae_last_delta, R(100 * (mse_mean - naive_mse_mean) / naive_mse_mean;R) AS mse_mean_delta FROM a, b", digits=8)
def e2_compare_naive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.compare_naive(views.forecast_log(spark, sf_dir).withColumn("h", 1 + F.col("pos") % 5), 5)


PLAIN = POINT.replace("R(", "(").replace(";R)", ")")
NAMES = ", ".join(metrics.METRICS)


@query(f"WITH f AS (SELECT *, 1 + pos % 5 AS h FROM forecast_log), s AS (SELECT h, {PLAIN} FROM f GROUP BY h), u AS (SELECT h, metric, v FROM (UNPIVOT s ON {NAMES} INTO NAME metric VALUE v)), n0 AS (SELECT {PLAIN.replace('pred', 'last').replace('sign(last - last)', 'sign(last - second_last)')} FROM f WHERE h = 5), n AS (SELECT metric, v AS naive FROM (UNPIVOT n0 ON {NAMES} INTO NAME metric VALUE v)), b AS (SELECT metric, max(CASE WHEN h = 5 THEN v END) AS last_step, avg(v) AS avg_steps, any_value(naive) AS naive FROM u JOIN n USING (metric) GROUP BY metric) SELECT metric, R(last_step;R) AS last_step, R(avg_steps;R) AS avg_steps, R(naive;R) AS naive, R(CASE WHEN metric IN ('mape', 'mda', 'under_rate', 'over_rate') THEN last_step - naive WHEN abs(naive) >= 1e-12 THEN 100 * (last_step - naive) / abs(naive) END;R) AS delta FROM b", digits=6)
def e1_e2_all_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve metrics at the last step, over all steps, and of persistence, whose direction is that of its last change."""
    return metrics.compare_all(views.forecast_log(spark, sf_dir).withColumn("h", 1 + F.col("pos") % 5), 5)


CORR = "covar_pop({x}, {y}) / CASE WHEN stddev_pop({x}) * stddev_pop({y}) > 1e-12 THEN stddev_pop({x}) * stddev_pop({y}) END"


@query(f"SELECT msname, R({CORR.format(x='pred', y='y')};R) AS corr_pred_true, R({CORR.format(x='pred', y='last')};R) AS corr_pred_last, R({CORR.format(x='last', y='y')};R) AS corr_last_true, R(1 - avg((y - pred) * (y - pred)) / CASE WHEN avg((y - last) * (y - last)) > 1e-12 THEN avg((y - last) * (y - last)) END;R) AS r2_vs_persistence, R(100 * avg(CASE WHEN abs(y - pred) < abs(y - last) THEN 1.0 ELSE 0.0 END);R) AS beat_rate, R(avg(abs(y - pred)) / avg(abs(y - last));R) AS mae_ratio FROM forecast_log GROUP BY msname HAVING count(*) >= 2", digits=8)
def e3_persistence_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.persistence_diagnostics(views.forecast_log(spark, sf_dir), ["msname"])


@query("WITH t AS (SELECT msname, quantile_cont(y, 0.95) AS threshold FROM forecast_log GROUP BY msname), f AS (SELECT f.*, threshold, y > threshold AS spike, y > upper AS miss FROM forecast_log f JOIN t USING (msname)) SELECT msname, R(max(threshold);R) AS threshold, count(CASE WHEN spike THEN 1 END) AS n_spikes, R(coalesce(avg(CASE WHEN spike THEN CASE WHEN miss THEN 0.0 ELSE 1.0 END END), 1);R) AS spike_coverage, R(coalesce(avg(CASE WHEN spike THEN CASE WHEN miss THEN 1.0 ELSE 0.0 END END), 0);R) AS spike_miss, R(coalesce(avg(CASE WHEN spike THEN greatest(y - upper, 0) END), 0);R) AS mean_excess, R(coalesce(avg(CASE WHEN spike THEN upper END), 0);R) AS upper_in_spike, R(coalesce(avg(CASE WHEN NOT spike THEN upper END), 0);R) AS upper_outside FROM f GROUP BY msname", digits=8)
def e5_spike_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.spike_metrics(views.forecast_log(spark, sf_dir), ["msname"])


@query("WITH f AS (SELECT msname, pos, pos AS t, y AS cpu, pred AS pred_cpu, 0.01::DOUBLE AS delta_cpu FROM forecast_log), g AS (SELECT *, lead(cpu, 5) OVER (PARTITION BY msname ORDER BY t) AS yy, greatest(pred_cpu - delta_cpu, 0) AS raw FROM f) SELECT msname, R(avg((yy - pred_cpu) * (yy - pred_cpu));R) AS final_mse, R(avg(abs(yy - pred_cpu));R) AS final_mae, R(avg((yy - raw) * (yy - raw));R) AS raw_mse, R(avg(abs(yy - raw));R) AS raw_mae, R(avg((yy - cpu) * (yy - cpu));R) AS naive_mse, R(avg(abs(yy - cpu));R) AS naive_mae, count(*) AS n FROM g WHERE yy IS NOT NULL GROUP BY msname HAVING count(*) >= 5")
def e6_e7_aligned_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = views.forecast_log(spark, sf_dir).select("msname", F.col("pos").alias("t"), F.col("y").alias("cpu"), F.col("pred").alias("pred_cpu"), F.lit(0.01).alias("delta_cpu"))
    return metrics.aligned_errors(log, 5, ["msname"])


def _pinball(c: str, q: float) -> str:
    return f"avg(greatest({q}::DOUBLE * (y - {c}), ({q}::DOUBLE - 1) * (y - {c})))"


@query(f"SELECT msname, R({_pinball('q_lo', 0.1)};R) AS pinball_q_lo, R({_pinball('q50', 0.5)};R) AS pinball_q50, R({_pinball('q_hi', 0.95)};R) AS pinball_q_hi, R(({_pinball('q_lo', 0.1)} + {_pinball('q50', 0.5)} + {_pinball('q_hi', 0.95)}) / 3;R) AS pinball FROM forecast_log GROUP BY msname")
def e8_pinball(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.pinball(views.forecast_log(spark, sf_dir), ["msname"], {"q_lo": 0.1, "q50": 0.5, "q_hi": 0.95})


@query("SELECT msname, R(2.0 * (avg(CASE WHEN abs(pred - y) < 0.1::DOUBLE THEN (pred - y) * (pred - y) / 0.2::DOUBLE ELSE abs(pred - y) - 0.05::DOUBLE END) + 0.5 * avg(abs(pred - y) / (abs(y) + 0.000001::DOUBLE)));R) AS huber, R(avg((pred - y) * (pred - y));R) AS l2, R(avg(abs(pred - y));R) AS l1 FROM forecast_log GROUP BY msname")
def e9_huber(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.huber(views.forecast_log(spark, sf_dir), ["msname"], 0.1, weight=2.0, relative=0.5)


@query("SELECT msname, R(avg((CASE WHEN abs(pred - y) < 0.1::DOUBLE THEN (pred - y) * (pred - y) / 0.2::DOUBLE ELSE abs(pred - y) - 0.05::DOUBLE END) * CASE WHEN y > pred THEN 3.0 ELSE 1.0 END);R) AS huber, R(avg((pred - y) * (pred - y));R) AS l2, R(avg(abs(pred - y));R) AS l1 FROM forecast_log GROUP BY msname")
def e10_asymmetric_huber(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.huber(views.forecast_log(spark, sf_dir), ["msname"], 0.1, under_weight=3.0)


TWO = "two AS (SELECT a.msname, CAST(x.h AS INTEGER) AS h, a.cpu AS pred_cpu, b.cpu AS y_cpu, a.mem AS pred_mem, b.mem AS y_mem FROM series_hourly a CROSS JOIN range(1, 6) x(h) JOIN series_hourly b ON b.msname = a.msname AND b.pos = a.pos + x.h)"


def _huber(t: str, beta: float, under: float) -> str:
    return f"avg((CASE WHEN abs(pred_{t} - y_{t}) < {beta}::DOUBLE THEN (pred_{t} - y_{t}) ** 2 / (2 * {beta}::DOUBLE) ELSE abs(pred_{t} - y_{t}) - {beta}::DOUBLE / 2 END) * CASE WHEN y_{t} > pred_{t} THEN {under}::DOUBLE ELSE 1.0 END)"


def _two_target_sql(under: float, relative: float, where: str = "") -> str:
    rel = f" + {relative}::DOUBLE * avg(abs(pred_mem - y_mem) / (abs(y_mem) + 0.000001::DOUBLE))" if relative else ""
    return f"WITH {TWO} SELECT msname, R(0.5 * {_huber('cpu', 0.01, under)} + 0.5 * ({_huber('mem', 0.002, under)}{rel});R) AS huber, R(avg((pred_cpu - y_cpu) ** 2) + avg((pred_mem - y_mem) ** 2);R) AS mse, R(avg((pred_cpu - y_cpu) ** 2) + avg(abs(pred_mem - y_mem));R) AS mixed, R((avg((pred_cpu - y_cpu) ** 2) + avg((pred_mem - y_mem) ** 2)) / 2;R) AS joint FROM two {where} GROUP BY msname"


def two_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persistence forecasts of both targets, one row per step."""
    rows, frames = views.series_hourly(spark, sf_dir), []
    for t in ("cpu", "mem"):
        made = forecast.match_horizon(forecast.persistence(rows, H, t), rows, t)
        frames.append(made.select("msname", "pos", "h", F.col("pred").alias(f"pred_{t}"), F.col("y").alias(f"y_{t}")))
    return frames[0].join(frames[1], ["msname", "pos", "h"])


@query(_two_target_sql(1.0, 0.25))
def e9_two_target_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = {"cpu": metrics.Target(0.01), "mem": metrics.Target(0.002, relative=0.25)}
    return metrics.target_losses(two_targets(spark, sf_dir), ["msname"], targets)


@query(_two_target_sql(3.0, 0.0, "WHERE h = 5"))
def e10_two_target_last_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = {"cpu": metrics.Target(0.01, under_weight=3.0), "mem": metrics.Target(0.002, under_weight=3.0)}
    return metrics.target_losses(two_targets(spark, sf_dir), ["msname"], targets, last_step=H)


@query("WITH f AS (SELECT msname, pos, CASE WHEN y BETWEEN lower AND upper THEN 1.0 ELSE 0.0 END AS i, CASE WHEN y > upper THEN 1.0 ELSE 0.0 END AS u, CASE WHEN y < lower THEN 1.0 ELSE 0.0 END AS l FROM forecast_log) SELECT msname, pos, R(CASE WHEN count(*) OVER w = 48 THEN avg(i) OVER w END;R) AS coverage, R(CASE WHEN count(*) OVER w = 48 THEN avg(u) OVER w END;R) AS upper_miss, R(CASE WHEN count(*) OVER w = 48 THEN avg(l) OVER w END;R) AS lower_miss FROM f WINDOW w AS (PARTITION BY msname ORDER BY pos ROWS BETWEEN 47 PRECEDING AND CURRENT ROW)")
def w12_rolling_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.rolling_coverage(views.forecast_log(spark, sf_dir), 48).select("msname", "pos", "coverage", "upper_miss", "lower_miss")


DESIRED = "z AS (SELECT msname, t, replicas, pos, round(cpu, 9) AS cpu, round(mem, 9) AS mem FROM scaler_log), a AS (SELECT msname, t AS ts, replicas, pos AS history, cpu, mem, round(cpu - 0.4::DOUBLE, 9) AS pred_cpu, cpu * 2 AS upper_cpu, mem * 2 AS upper_mem FROM z), b AS (SELECT *, history >= 24 AND pred_cpu > 0 AS usable FROM a), c AS (SELECT *, CASE WHEN usable THEN upper_cpu ELSE cpu END / 0.80::DOUBLE AS rc, CASE WHEN usable THEN upper_mem ELSE mem END / 0.80::DOUBLE AS rm, CASE WHEN history < 24 THEN 'waiting' WHEN usable THEN 'predictive' ELSE 'reactive' END AS mode FROM b), d AS (SELECT *, greatest(ceil(replicas * CASE WHEN abs(rc - 1) <= 0.1::DOUBLE THEN 1.0 ELSE rc END), ceil(replicas * CASE WHEN abs(rm - 1) <= 0.1::DOUBLE THEN 1.0 ELSE rm END)) AS wish FROM c), e AS (SELECT *, greatest(1, least(10, wish)) AS clamped, list_reduce([replicas, 1, 2, 3, 4], lambda r, s: r + greatest(r, 4)) AS grown FROM d), f AS (SELECT msname, ts, mode, replicas, CAST(CASE WHEN clamped > replicas THEN least(clamped, least(grown, 10)) ELSE clamped END AS INTEGER) AS desired, wish >= 10 AS limited FROM e)"


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = views.scaler_log(spark, sf_dir).withColumns({"cpu": F.round("cpu", 9), "mem": F.round("mem", 9)})
    log = log.select("msname", F.col("t").alias("ts"), "replicas", F.col("pos").alias("history"), "cpu", "mem", F.round(F.col("cpu") - 0.4, 9).alias("pred_cpu"), (F.col("cpu") * 2).alias("upper_cpu"), (F.col("mem") * 2).alias("upper_mem"))
    return scaling.desired_replicas(scaling.chosen_load(log, True, 24))


@query(f"WITH {DESIRED} SELECT msname, ts, mode, desired, limited FROM f")
def h1_h2_h4_desired_replicas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions(spark, sf_dir).select("msname", "ts", "mode", "desired", "limited")


@query(f"WITH {DESIRED} SELECT msname, ts, CASE WHEN desired > replicas THEN desired ELSE max(desired) OVER (PARTITION BY msname ORDER BY ts RANGE BETWEEN 10799 PRECEDING AND CURRENT ROW) END AS stable FROM f")
def h3_stabilised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scaling.stabilise(decisions(spark, sf_dir), scaling.ScalingConfig(stabilise=10_800)).select("msname", "ts", "stable")


@query("SELECT msname, split, CAST((count(*) - 240) // 24 + 1 AS BIGINT) AS n FROM split_hourly GROUP BY ALL HAVING count(*) >= 240")
def d2_minimum_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of nine days and a day's horizon: only splits that are long enough give any."""
    made = windows.windowize(split_series(spark, sf_dir), 216, 24, 24, ["cpu"], ["cpu"])
    return made.groupBy("msname", "split").agg(F.count(F.lit(1)).alias("n"))
