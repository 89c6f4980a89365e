"""Queries over per-service series: rolling windows, ranking, splits, supervised windows, dependence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelens.functions import scalars
from tracelens.functions.scalars import epoch_seconds
from tracelens.operators import approaches, dependence, rolling, series, signal, windows
from tracelens.plans import views
from tracelens.plans.registry import query
from tracelens.session import scratch
from tracelens.sources import catalog

STATS = "SELECT msname, t, load, count(*) OVER w AS n_points, count(CASE WHEN load > 0 THEN 1 END) OVER w AS n_active, avg(load) OVER w AS avg_load, stddev_samp(load) OVER w AS std_load, min(load) OVER w AS min_load, max(load) OVER w AS max_load, min(t) OVER w AS win_start, max(t) OVER w AS win_end FROM load_hourly WINDOW w AS (PARTITION BY msname ORDER BY t ROWS BETWEEN 24 PRECEDING AND CURRENT ROW)"


def _ranked(score: str, k: int = 50, more: str = "") -> str:
    return f"WITH s AS ({STATS}), o AS (SELECT *, std_load / nullif(max_load - min_load, 0) AS oscillation FROM s), c AS (SELECT * FROM o WHERE oscillation IS NOT NULL AND n_points >= 22){more} SELECT msname, win_start, win_end, R({score};R) AS score FROM c ORDER BY {score} DESC, msname, win_end LIMIT {k}"


@query(STATS.replace("avg(load) OVER w AS", "R(avg(load) OVER w;R) AS").replace("stddev_samp(load) OVER w AS", "R(stddev_samp(load) OVER w;R) AS").replace("min(load) OVER w AS", "R(min(load) OVER w;R) AS").replace("max(load) OVER w AS", "R(max(load) OVER w;R) AS").replace("msname, t, load,", "msname, t, R(load;R) AS load,"), digits=7)
def w1_window_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling.window_stats(views.load_hourly(spark, sf_dir), 25)


@query(_ranked("oscillation"))
def w1_w3_t2_ranked_oscillation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: the most oscillating day-long windows of services with load."""
    loads = views.load_hourly(spark, sf_dir)
    loads = series.only_services(loads, rolling.active_services(loads))
    best = rolling.rank_windows(rolling.oscillation(loads, 25), "oscillation", 50)
    return best.select("msname", "win_start", "win_end", "score")


@query(_ranked("avg_load", 20))
def t2_ranked_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling.rank_windows(rolling.oscillation(views.load_hourly(spark, sf_dir), 25), "mcr").select("msname", "win_start", "win_end", "score")


@query(_ranked("(avg_load - lo) / (hi - lo) * oscillation", 20, ", e AS (SELECT min(avg_load) AS lo, max(avg_load) AS hi FROM c)").replace("FROM c ORDER", "FROM c, e ORDER"))
def t2_ranked_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling.rank_windows(rolling.oscillation(views.load_hourly(spark, sf_dir), 25), "both").select("msname", "win_start", "win_end", "score")


def _pattern_sql(n: int, lags: list[int]) -> str:
    steps = [f"WITH p0 AS (SELECT *, CASE WHEN count(load) OVER w = {n} THEN load - avg(load) OVER w END AS c FROM load_hourly WINDOW w AS (PARTITION BY msname ORDER BY t ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW))"]
    for i, lag in enumerate(lags):
        m = n - lag
        full = lambda x: f"CASE WHEN count({x}) OVER w = {m} THEN avg({x}) OVER w END"  # noqa: B023,E731
        steps.append(f"q{i} AS (SELECT *, lag(c, {lag}) OVER (PARTITION BY msname ORDER BY t) AS b FROM p{i})")
        steps.append(f"p{i + 1} AS (SELECT * EXCLUDE (b), abs(({full('c*b')}) / nullif(sqrt(({full('c*c')}) * ({full('b*b')})), 0)) AS r{lag} FROM q{i} WINDOW w AS (PARTITION BY msname ORDER BY t ROWS BETWEEN {m - 1} PRECEDING AND CURRENT ROW))")
    return ", ".join(steps) + f" SELECT msname, t, R(greatest({', '.join(f'r{k}' for k in lags)});R) AS pattern FROM p{len(lags)}"


def _ranked_pattern(score: str) -> str:
    scores = _pattern_sql(24, [6, 12]).removeprefix("WITH ").replace("R(greatest(", "(greatest(").replace(";R) AS pattern", ") AS pattern")
    steps, last = scores.rsplit(" SELECT ", 1)
    return f"WITH {steps}, pat AS (SELECT {last}), s AS ({STATS}), o AS (SELECT *, std_load / nullif(max_load - min_load, 0) AS oscillation FROM s), c AS (SELECT o.*, pattern FROM o LEFT JOIN pat ON pat.msname = o.msname AND pat.t = o.win_end WHERE oscillation IS NOT NULL AND n_points >= 22) SELECT msname, win_start, win_end, R({score};R) AS score FROM c WHERE pattern IS NOT NULL ORDER BY {score} DESC, msname, win_end LIMIT 50"


def _pattern_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    loads = views.load_hourly(spark, sf_dir)
    return rolling.with_pattern(rolling.oscillation(loads, 25), rolling.pattern_score(loads, 24, [6, 12, 18]))


@query("WITH s AS (SELECT msname, max(t) AS max_ts, count(*) AS n, max(load) AS most FROM load_hourly GROUP BY msname HAVING max(load) > 0) SELECT l.msname, l.t, max_ts, n, CAST(n - floor(0.8::DOUBLE * n) AS BIGINT) AS test_n FROM load_hourly l JOIN s USING (msname) WHERE l.t > max_ts - 86400")
def j4_j5_w2_test_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    loads = views.load_hourly(spark, sf_dir)
    ends = loads.groupBy("msname").agg(F.max("t").alias("max_ts"), F.count(F.lit(1)).alias("n"), F.max("load").alias("most")).where("most > 0").drop("most")
    return loads.join(ends, "msname").where(F.col("t") > F.col("max_ts") - 86400).select("msname", "t", "max_ts", "n", (F.col("n") - F.floor(F.lit(0.8) * F.col("n"))).cast("long").alias("test_n"))


@query("SELECT msname, t, R(CASE WHEN count(load) OVER w = 24 THEN avg(load) OVER w END;R) AS mean, R(lag(load, 3) OVER o;R) AS lag3, R(lead(load, 3) OVER o;R) AS lead3 FROM load_hourly WINDOW w AS (PARTITION BY msname ORDER BY t ROWS BETWEEN 23 PRECEDING AND CURRENT ROW), o AS (PARTITION BY msname ORDER BY t)", digits=7)
def w4_w8_full_mean_and_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = Window.partitionBy("msname").orderBy("t")
    return views.load_hourly(spark, sf_dir).select("msname", "t", rolling.full_mean(F.col("load"), 24).alias("mean"), F.lag("load", 3).over(o).alias("lag3"), F.lead("load", 3).over(o).alias("lead3"))


@query(_ranked_pattern("pattern"), digits=6)
def t2_j6_ranked_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling.rank_windows(_pattern_candidates(spark, sf_dir), "pattern", 50).select("msname", "win_start", "win_end", "score")


@query(_ranked_pattern("(oscillation * pattern)"), digits=6)
def t2_j6_ranked_both_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling.rank_windows(_pattern_candidates(spark, sf_dir), "both_pattern", 50).select("msname", "win_start", "win_end", "score")


@query(_pattern_sql(24, [6, 12]), digits=6)
def w5_pattern_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling.pattern_score(views.load_hourly(spark, sf_dir), 24, [6, 12, 18]).select("msname", "t", "pattern")


@query("WITH c AS (SELECT msname, t, load - avg(load) OVER (PARTITION BY msname) AS c FROM load_hourly), l AS (SELECT msname, c, lead(c, 1) OVER w AS l1, lead(c, 24) OVER w AS l24 FROM c WINDOW w AS (PARTITION BY msname ORDER BY t)), s AS (SELECT msname, avg(c * c) AS v, avg(c * l1) AS a1, avg(c * l24) AS a24 FROM l GROUP BY msname) SELECT msname, CAST(1 AS INTEGER) AS lag, R(a1 / v;R) AS acf FROM s UNION ALL SELECT msname, CAST(24 AS INTEGER), R(a24 / v;R) FROM s")
def w6_autocorrelation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling.autocorrelation(views.load_hourly(spark, sf_dir), [1, 24])


ALL_LAGS = "c AS (SELECT msname, load - avg(load) OVER (PARTITION BY msname) AS c, row_number() OVER (PARTITION BY msname ORDER BY t) AS i, count(*) OVER (PARTITION BY msname) AS n FROM load_hourly), v AS (SELECT msname, avg(c * c) AS v FROM c GROUP BY msname), l AS (SELECT a.msname, b.i - a.i AS lag, sum(a.c * b.c) / max(a.n - b.i + a.i) AS cov FROM c a JOIN c b ON a.msname = b.msname AND b.i > a.i AND b.i - a.i <= 2880 GROUP BY a.msname, b.i - a.i), acf AS (SELECT msname, CAST(lag AS INTEGER) AS lag, cov / v AS acf FROM l JOIN v USING (msname) WHERE v >= 1e-12)"


@query(f"WITH {ALL_LAGS} SELECT msname, lag, R(acf;R) AS acf FROM acf", digits=7)
def w6_all_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling.all_autocorrelations(views.load_hourly(spark, sf_dir))


@query(f"WITH {ALL_LAGS} SELECT msname, arg_max(lag, (abs(acf), -lag)) AS lag, R(arg_max(acf, (abs(acf), -lag));R) AS acf FROM acf WHERE lag BETWEEN 12 AND 168 GROUP BY msname", digits=7)
def w6_peak_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest period between half a day and a week."""
    return rolling.peak_autocorrelation(rolling.all_autocorrelations(views.load_hourly(spark, sf_dir)), 12, 168)


@query("WITH d AS (SELECT msname, t // 86400 AS day, (t % 86400) // 3600 AS slot, load AS x FROM load_hourly), j AS (SELECT a.msname, a.day, covar_pop(a.x, b.x) / CASE WHEN stddev_pop(a.x) * stddev_pop(b.x) > 1e-12 THEN stddev_pop(a.x) * stddev_pop(b.x) END AS r FROM d a JOIN d b ON a.msname = b.msname AND a.day = b.day - 1 AND a.slot = b.slot GROUP BY ALL) SELECT msname, R(avg(r);R) AS mean, R(stddev_pop(r);R) AS std, count(r) AS n FROM j GROUP BY msname")
def w7_day_over_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling.day_over_day(views.load_hourly(spark, sf_dir))


@query("SELECT msname, pos, split FROM split_hourly")
def w13_d3_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.assign_split(views.series_hourly(spark, sf_dir)).select("msname", "pos", "split")


@query("SELECT msname, R(stddev_pop(cpu) + stddev_pop(mem);R) AS score, count(*) AS rows FROM series_hourly WHERE pos >= floor(n * (0.7::DOUBLE + 0.1::DOUBLE)) AND pos < floor(n * (0.7::DOUBLE + 0.1::DOUBLE)) + 48 GROUP BY msname HAVING count(*) = 48 ORDER BY stddev_pop(cpu) + stddev_pop(mem) DESC, msname LIMIT 5")
def t3_best_service(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling.best_service(views.series_hourly(spark, sf_dir), 0.7 + 0.1, 48)


@query("SELECT msname, t FROM series_hourly ORDER BY md5('7|' || msname || '|' || t), msname, t LIMIT 100")
def t4_seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.seeded_sample(views.series_hourly(spark, sf_dir).select("msname", "t"), ["msname", "t"], 100, 7)


@query("SELECT msname, count(*) AS n FROM load_hourly WHERE msname IN (SELECT DISTINCT msname FROM load_hourly ORDER BY msname LIMIT 3) GROUP BY msname")
def t5_first_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    loads = views.load_hourly(spark, sf_dir)
    return series.only_services(loads, loads.select("msname").distinct().orderBy("msname").limit(3)).groupBy("msname").agg(F.count(F.lit(1)).alias("n"))


L, H, STRIDE = 24, 5, 5
WINDOWS = f"w0 AS (SELECT msname, split, list(cpu ORDER BY pos) AS c, list(mem ORDER BY pos) AS m, list(t ORDER BY pos) AS t FROM split_hourly GROUP BY ALL HAVING count(*) >= {L + H}), w1 AS (SELECT *, unnest(range(0, len(c) - {L + H} + 1, {STRIDE})) AS i FROM w0), w AS (SELECT msname, split, t[i + 1] AS win_start, c[i + 1:i + {L}] AS xc, m[i + 1:i + {L}] AS xm, c[i + {L} + 1:i + {L + H}] AS y, c[i + {L}] AS last, c[i + {L} - 1] AS second_last, CAST(trunc(m[i + {L}]) AS INTEGER) AS sid FROM w1)"


def hourly_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = series.assign_split(views.series_hourly(spark, sf_dir))
    return windows.windowize(rows, L, H, STRIDE, ["cpu", "mem"], ["cpu"])


@query(f"WITH {WINDOWS} SELECT msname, split, win_start, R(list_sum(xc);R) AS x_cpu, R(list_sum(xm);R) AS x_mem, R(list_sum(y);R) AS y, R(last;R) AS last, R(second_last;R) AS second_last, sid FROM w")
def d4_d5_d6_d8_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v)
    w = hourly_windows(spark, sf_dir)
    y = F.transform("y", lambda r: F.element_at(r, 1))
    return w.select("msname", "split", "win_start", total(windows.channel(F.col("x"), 0)).alias("x_cpu"), total(windows.channel(F.col("x"), 1)).alias("x_mem"), total(y).alias("y"), F.element_at("last", 1).alias("last"), F.element_at("second_last", 1).alias("second_last"), "sid")


@query(f"WITH {WINDOWS.replace('SELECT msname, split, t[i + 1] AS win_start', 'SELECT msname, split, t, i, t[i + 1] AS win_start')} SELECT msname, split, win_start FROM w WHERE list_bool_and([t[i + k + 1] - t[i + k] = 3600 for k in range(1, {L + H})])")
def d4_contiguous_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows without a gap, from the first input to the last target."""
    rows = series.assign_split(views.series_hourly(spark, sf_dir))
    return windows.windowize(rows, L, H, STRIDE, ["cpu", "mem"], ["cpu"], contiguous=3600).select("msname", "split", "win_start")


@query(f"WITH {WINDOWS} SELECT msname, split, win_start, list_transform(y, lambda v: round_even(round(v, 9), 2)) AS y FROM w")
def d7_quantised_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = hourly_windows(spark, sf_dir)
    w = w.withColumn("y", F.transform("y", lambda r: F.transform(r, lambda v: F.round(v, 9))))
    return windows.quantise_windows(w).select("msname", "split", "win_start", F.flatten("y").alias("y"))


@query(f"WITH {WINDOWS} SELECT msname, split, win_start, R(list_sum([round_even(round(v, 9), 2) for v in xc]);R) AS bounded, R(list_sum(xc);R) AS unbounded FROM w", digits=11)
def d7_inputs_of_feature_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs of a feature set are rounded only if all its features are shares."""
    w, total = hourly_windows(spark, sf_dir), lambda x: scalars.array_sum(windows.channel(x, 0))
    rounded = {c: windows.quantise_windows(w, catalog.feature_set(name).bounded) for c, name in (("bounded", "cpu_mem_both"), ("unbounded", "cpu_mem_http_rpc"))}
    sums = [df.select("msname", "split", "win_start", total(F.col("x")).alias(c)) for c, df in rounded.items()]
    return sums[0].join(sums[1], ["msname", "split", "win_start"])


@query(f"WITH {WINDOWS} SELECT msname, split, win_start, R(list_sum(xc[3:8]);R) AS some, R(list_avg(xc);R) AS mean, R(list_stddev_pop(xc);R) AS std, R(list_sort(xc)[3];R) AS third, R(list_max([round(list_sum(xc[i:i + 3]), 9) for i in range(1, {L - 2})]);R) AS busiest FROM w", digits=11)
def f9_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each input: the sum of a slice, mean, deviation, the third smallest, and the largest sum over four steps."""
    x = windows.channel(F.col("x"), 0)
    w = hourly_windows(spark, sf_dir).select("msname", "split", "win_start", x.alias("x"))
    busiest = F.array_max(F.transform(F.sequence(F.lit(1), F.lit(L - 3)), lambda i: F.round(scalars.array_sum(F.slice("x", i, F.lit(4))), 9)))
    return w.select("msname", "split", "win_start", scalars.array_sum(F.slice("x", 3, 6)).alias("some"), scalars.array_mean(F.col("x")).alias("mean"), scalars.array_std(F.col("x")).alias("std"), F.get(F.array_sort("x"), 2).alias("third"), busiest.alias("busiest"))


@query(f"WITH {WINDOWS} SELECT msname, split, count(*) AS n FROM w WHERE list_stddev_pop(xc) >= 0.11::DOUBLE GROUP BY ALL")
def d9_near_constant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.drop_near_constant(hourly_windows(spark, sf_dir), [0], 0.11).groupBy("msname", "split").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {WINDOWS} SELECT msname, split, win_start, R(list_sum([round((xc[greatest(i - 2, 1)] + xc[greatest(i - 1, 1)] + xc[i] + xc[least(i + 1, {L})] + xc[least(i + 2, {L})]) / 5.0, 9) for i in range(1, {L + 1})]);R) AS smooth FROM w")
def w10_moving_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = hourly_windows(spark, sf_dir)
    smooth = windows.moving_average(windows.channel(F.col("x"), 0), 5)
    return w.select("msname", "split", "win_start", F.aggregate(F.transform(smooth, lambda v: F.round(v, 9)), F.lit(0.0), lambda a, v: a + v).alias("smooth"))


def _smooth(c: str) -> str:
    """Half to even on whole billionths."""
    mean = f"({c}[greatest(i - 2, 1)] + {c}[greatest(i - 1, 1)] + {c}[i] + {c}[least(i + 1, {L})] + {c}[least(i + 2, {L})]) / 5.0"
    k = f"CAST(round({mean} * 1000000000) AS BIGINT)"
    return f"({k} // 10000000 + CASE WHEN {k} % 10000000 > 5000000 OR ({k} % 10000000 = 5000000 AND {k} // 10000000 % 2 = 1) THEN 1 ELSE 0 END) / 100.0"


@query(f"WITH {WINDOWS} SELECT msname, split, win_start FROM w WHERE list_stddev_pop(xc) >= 0.11::DOUBLE ORDER BY md5('7|' || msname || '|' || split || '|' || win_start), msname, split, win_start LIMIT 60")
def t8_window_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded sample of the windows that vary."""
    kept = windows.drop_near_constant(hourly_windows(spark, sf_dir), [0], 0.11).select("msname", "split", "win_start")
    return windows.seeded_sample(kept, ["msname", "split", "win_start"], 60, 7)


@query(f"WITH {WINDOWS} SELECT msname, split, win_start, flatten([[{_smooth('xc')}, {_smooth('xm')}] for i in range(1, {L + 1})]) AS x FROM w WHERE list_stddev_pop(xc) >= 1e-12")
def d10_j11_smoothed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoothed windows whose raw ones vary."""
    w = hourly_windows(spark, sf_dir)
    return windows.matching(windows.smooth_windows(w, 5, 2), windows.drop_near_constant(w, [0])).select("msname", "split", "win_start", F.flatten("x").alias("x"))


@query(f"WITH {WINDOWS} SELECT msname, split, win_start, R(xc[{L}] - (xc[{L - 2}] + xc[{L - 1}] + xc[{L}] + xc[{L}] + xc[{L}]) / 5.0;R) AS seasonal_end FROM w")
def w11_trend_seasonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = hourly_windows(spark, sf_dir).select("msname", "split", "win_start", *windows.trend_seasonal(windows.channel(F.col("x"), 0), 5))
    return w.select("msname", "split", "win_start", F.element_at("seasonal", -1).alias("seasonal_end"))


@query(f"SELECT msname, count(*) - {L} + 1 AS n FROM series_hourly GROUP BY msname HAVING count(*) >= {L}")
def d12_inference_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.inference_windows(views.series_hourly(spark, sf_dir), L, ["cpu", "mem"]).groupBy("msname").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {WINDOWS}, o AS (SELECT msname, split, win_start, row_number() OVER (PARTITION BY split ORDER BY msname, win_start) AS r, greatest(1, floor(count(*) OVER (PARTITION BY split) * 10 / 100)) AS k FROM w) SELECT msname, split, win_start FROM o WHERE r <= k")
def t6_head_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.head_slice(hourly_windows(spark, sf_dir), percent=10).select("msname", "split", "win_start")


@query(f"WITH {WINDOWS} SELECT msname, split, win_start FROM w ORDER BY msname, win_start LIMIT 40")
def t7_head_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.head_slice(hourly_windows(spark, sf_dir), most=40).select("msname", "split", "win_start")


CORR = "covar_pop(x, y) / CASE WHEN stddev_pop(x) * stddev_pop(y) > 1e-12 THEN stddev_pop(x) * stddev_pop(y) END"
INSTANCE_ROWS = "parts AS (SELECT o_orderpriority AS msname, l_suppkey AS i, CAST(floor(epoch_us(CAST(l_shipdate AS TIMESTAMP)) / 1000000) AS BIGINT) AS t, l_quantity / 50.0 AS cpu, (l_discount + 0.0) * 10.0 AS mem, l_extendedprice AS mcr FROM lineitem JOIN orders ON l_orderkey = o_orderkey), inst AS (SELECT msname, i, t, arg_max(cpu, (t, cpu)) AS cpu, arg_max(mem, (t, mem)) AS mem, arg_max(mcr, (t, mcr)) AS mcr FROM parts GROUP BY ALL)"


def instance_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(msname, msinstanceid, t, cpu, mem, mcr): the last value per service, instance and day, call rates joined on all three."""
    line, orders = (views.table(spark, sf_dir, n) for n in ("lineitem", "orders"))
    joined = line.join(orders, line["l_orderkey"] == orders["o_orderkey"])
    rows = joined.select(F.col("o_orderpriority").alias("msname"), F.col("l_suppkey").alias("msinstanceid"), epoch_seconds(F.col("l_shipdate")).alias("ts"), (F.col("l_quantity") / 50.0).alias("cpu"), ((F.col("l_discount") + 0.0) * 10.0).alias("mem"), F.col("l_extendedprice").cast("double").alias("mcr"))
    keys = ["msname", "msinstanceid"]
    return series.bucket(rows.drop("mcr"), keys, "1d").join(series.bucket(rows.drop("cpu", "mem"), keys, "1d"), ["t", *keys])


def _instance_sql() -> str:
    cells = " UNION ALL ".join(f"SELECT msname, i, n, '{x}->{y}' AS pair, {h} AS h, {x} AS x, lead({y}, {h}) OVER (PARTITION BY msname, i ORDER BY t) AS y FROM sized" for x, y in dependence.INSTANCE_PAIRS for h in dependence.HORIZONS)
    return f"WITH {INSTANCE_ROWS}, sized AS (SELECT *, count(*) OVER (PARTITION BY msname, i) AS n, count(*) OVER (PARTITION BY msname) AS n_samples FROM inst), l AS ({cells}), r AS (SELECT msname, i, pair, h, {CORR} AS r FROM l WHERE n >= 15 AND y IS NOT NULL GROUP BY ALL), o AS (SELECT msname, i, h FROM r WHERE pair = 'cpu->cpu' AND r IS NOT NULL), s AS (SELECT msname, count(*) AS n_samples FROM inst GROUP BY msname HAVING count(*) >= 100) SELECT msname, pair, CAST(h AS INTEGER) AS h, R(CASE WHEN count(r) = count(*) THEN avg(r) END;R) AS r, count(*) AS n_instances, max(n_samples) AS n_samples FROM r JOIN o USING (msname, i, h) JOIN s USING (msname) GROUP BY ALL"


@query(_instance_sql(), digits=8)
def c1_c5_instance_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dependence.instance_correlation(instance_days(spark, sf_dir))


FRONT = ["click", "view"]
SERVICE_ROWS = "calls AS (SELECT msname, ts - ts % 3600 AS t, sum(http_mcr) AS http, sum(providerrpc_mcr) AS rpc FROM calls_hourly GROUP BY ALL), svc AS (SELECT s.msname, s.t, s.n, cpu, mem, replicas, CASE WHEN s.msname IN ('click', 'view') THEN http ELSE rpc END AS mcr FROM scaler_log s JOIN calls USING (msname, t))"


def service_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scaler's log with the call rate that its service goes by."""
    calls = series.bucket(views.calls_hourly(spark, sf_dir), ["msname"], "1h", {"http_mcr": F.sum("http_mcr"), "providerrpc_mcr": F.sum("providerrpc_mcr")})
    rows = views.scaler_log(spark, sf_dir).join(calls, ["msname", "t"])
    return rows.select("msname", "t", "cpu", "mem", "replicas", series.rate_column(rows, FRONT).alias("mcr"))


def _service_sql(then: str) -> str:
    cells = " UNION ALL ".join(f"SELECT msname, '{x}->{y}' AS pair, {h} AS h, pos, {x}::DOUBLE AS x, lead({y}::DOUBLE, {h}) OVER (PARTITION BY msname ORDER BY t) AS y FROM ranked" for x, y in dependence.SERVICE_PAIRS for h in dependence.HORIZONS)
    return f"WITH {SERVICE_ROWS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY msname ORDER BY t) AS pos, count(*) OVER (PARTITION BY msname) AS k FROM svc QUALIFY k >= 25), l AS (SELECT * FROM ({cells}) WHERE y IS NOT NULL), {then}"


PEARSON = f"each AS (SELECT msname, pair, CAST(h AS INTEGER) AS h, count(*) AS n, coalesce({CORR}, 0) AS r FROM l GROUP BY ALL)"
DCOR = "p AS (SELECT u.msname, u.pair, u.h, u.pos, avg(abs(u.x - v.x)) AS ra, avg(abs(u.y - v.y)) AS rb, avg(abs(u.x - v.x) * abs(u.y - v.y)) AS ab, avg((u.x - v.x) ** 2) AS aa, avg((u.y - v.y) ** 2) AS bb FROM l u JOIN l v USING (msname, pair, h) GROUP BY ALL), m AS (SELECT msname, pair, h, avg(ab) - 2 * avg(ra * rb) + avg(ra) * avg(rb) AS c, avg(aa) - 2 * avg(ra * ra) + avg(ra) ** 2 AS vx, avg(bb) - 2 * avg(rb * rb) + avg(rb) ** 2 AS vy FROM p GROUP BY ALL), each AS (SELECT msname, pair, CAST(h AS INTEGER) AS h, CASE WHEN sqrt(greatest(vx, 0) * greatest(vy, 0)) < 1e-12 THEN 0 ELSE sqrt(greatest(c, 0) / sqrt(vx * vy)) END AS r FROM m)"
AVERAGE = "SELECT pair, h, R(avg(r);R) AS mean, R(stddev_pop(r);R) AS std, R(min(r);R) AS min, R(max(r);R) AS max, count(r) AS n FROM each GROUP BY ALL"


def service_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dependence.lagged_correlation(service_hours(spark, sf_dir), dependence.SERVICE_PAIRS, dependence.HORIZONS, ["msname"], extra=20, fill=0.0)


def service_distance_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dependence.lagged_pairs(service_hours(spark, sf_dir), dependence.SERVICE_PAIRS, dependence.HORIZONS)
    return dependence.distance_correlation(rows, "x", "y", ["msname", "pair", "h"])


@query(_service_sql(f"{PEARSON} SELECT msname, pair, h, n, R(r;R) AS r FROM each"), digits=8)
def c2_c5_lagged_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return service_correlation(spark, sf_dir)


@query(_service_sql(f"{DCOR} SELECT msname, pair, h, R(r;R) AS dcor FROM each"), digits=6)
def c3_j10_distance_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return service_distance_correlation(spark, sf_dir)


@query(_service_sql(f"{PEARSON} {AVERAGE}"), digits=8)
def c4_average_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dependence.average_correlation(service_correlation(spark, sf_dir), ["pair", "h"])


@query(_service_sql(f"{DCOR} {AVERAGE}"), digits=6)
def c4_average_distance_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dependence.average_correlation(service_distance_correlation(spark, sf_dir), ["pair", "h"], "dcor")


@query("WITH d AS (SELECT msname, pos, round(cpu, 9) AS v, row_number() OVER (PARTITION BY msname ORDER BY md5('42|' || msname || '|' || pos), pos) AS k FROM series_hourly), s AS (SELECT msname, row_number() OVER w AS pos, v, lead(v, 1) OVER w AS v1, lead(v, 2) OVER w AS v2, count(*) OVER (PARTITION BY msname) AS n FROM d WHERE k <= 1000 WINDOW w AS (PARTITION BY msname ORDER BY pos)), r AS (SELECT msname, stddev_samp(v) * 0.2::DOUBLE AS r FROM s GROUP BY msname), p AS (SELECT a.msname, count(*) AS b, count(CASE WHEN abs(a.v2 - b.v2) <= r THEN 1 END) AS a FROM s a JOIN s b ON a.msname = b.msname AND a.pos < b.pos JOIN r ON r.msname = a.msname WHERE a.n >= 8 AND r > 0 AND a.v2 IS NOT NULL AND b.v2 IS NOT NULL AND abs(a.v - b.v) <= r AND abs(a.v1 - b.v1) <= r GROUP BY ALL) SELECT msname, R(CASE WHEN a > 0 THEN -ln(a / b) END;R) AS entropy FROM (SELECT DISTINCT msname FROM series_hourly) LEFT JOIN p USING (msname)")
def g3_sample_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dependence.sample_entropy(views.series_hourly(spark, sf_dir).withColumn("cpu", F.round("cpu", 9)), "cpu")


@query()
def g4_entropy_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = series.with_positions(views.load_hourly(spark, sf_dir))
    return dependence.entropy_groups(rows, dependence.sample_entropy(rows, "load"))


@query()
def g1_g2_wavelet_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = signal.decompose(hourly_windows(spark, sf_dir).select("msname", "split", "win_start", "x"), level=2)
    return made.where("channels is not null").select("msname", "split", "win_start", F.flatten("channels").alias("channels"))


HAAR = "0.7071067811865476::DOUBLE"


def _haar(c: str, sign: str) -> str:
    raw = f"{c}[i]" if sign == "+" else "0.0::DOUBLE"
    return f"CASE WHEN list_stddev_pop({c}) >= 1e-12 THEN {HAAR} * {c}[i] {sign} {HAAR} * {c}[i % {L} + 1] ELSE {raw} END"


APPROACHES = {"none": "[[xc[i], xm[i]]", "smoothing": f"[[{_smooth('xc')}, {_smooth('xm')}]", "wavelet": "[[" + ", ".join(_haar(c, s) for c in ("xc", "xm") for s in "+-") + "]"}


@query(f"WITH {WINDOWS} " + " UNION ALL ".join(f"SELECT '{name}' AS approach, msname, split, win_start, list_transform(flatten({x} for i in range(1, {L + 1})]), lambda v: round(v, 11) + 0.0::DOUBLE) AS x FROM w" for name, x in APPROACHES.items()))
def x3_g2_approaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same windows prepared by each approach, kept under a key that holds its parameters."""
    source, folder = views.table(spark, sf_dir, "events"), scratch(spark, "approaches")
    made = None
    for name, parameters in {"none": {}, "smoothing": {"width": 5}, "wavelet": {"level": 1, "wavelet": "haar"}}.items():
        one = approaches.prepared(spark, folder, source, lambda: hourly_windows(spark, sf_dir), name, 2, **parameters)
        one = one.select(F.lit(name).alias("approach"), "msname", "split", "win_start", F.transform(F.flatten("x"), lambda v: F.round(v, 11) + F.lit(0.0)).alias("x"))
        made = one if made is None else made.unionByName(one)
    return made


@query(f"WITH {WINDOWS} SELECT msname, split, win_start, list_concat([round({HAAR} * xc[i] + {HAAR} * xc[i % {L} + 1], 7) for i in range(1, {L + 1})], [round({HAAR} * xc[i] - {HAAR} * xc[i % {L} + 1], 7) + 0.0::DOUBLE for i in range(1, {L + 1})]) AS channels FROM w WHERE list_stddev_pop(xc) >= 1e-12")
def g1_haar_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = signal.decompose(hourly_windows(spark, sf_dir).select("msname", "split", "win_start", "x"), level=1, wavelet="haar")
    return made.where("channels is not null").select("msname", "split", "win_start", F.transform(F.flatten("channels"), lambda v: F.round(v, 7) + F.lit(0.0)).alias("channels"))
