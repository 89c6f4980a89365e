"""Dependence: lagged Pearson, distance correlation, sample entropy, entropy groups."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tracelens.functions.scalars import corr_guarded
from tracelens.operators.quantiles import join_on
from tracelens.session import materialise


#: What is compared, now with later: utilisation with itself and with the call rate, both ways.
INSTANCE_PAIRS = (("cpu", "cpu"), ("mem", "mem"), ("mcr", "cpu"), ("mcr", "mem"), ("cpu", "mcr"), ("mem", "mcr"))
SERVICE_PAIRS = (("cpu", "cpu"), ("mem", "mem"), ("mcr", "cpu"), ("mcr", "mem"), ("replicas", "cpu"), ("replicas", "mem"))
HORIZONS = (1, 2, 3, 4, 5)
#: Rows of a series whose distance correlation one task takes in arrays.
SERIES = 500_000


def lagged_correlation(df: DataFrame, pairs: Sequence[tuple[str, str]], horizons: Sequence[int], keys: list[str], order: str = "t", extra: int = 10, fill: float | None = None) -> DataFrame:
    """(keys, pair, h, n, r): correlation of x(t) with y(t + h rows) over n rows, for keys with at least max(horizons) + extra rows.

    Undefined ones, where either side is constant, are null or `fill`.
    """
    w, of = Window.partitionBy(*keys).orderBy(order), Window.partitionBy(*keys)
    xs, ys = ({side[i]: None for side in pairs} for i in (0, 1))
    later = F.array(*[F.struct(F.lit(h).alias("h"), *[F.lead(y, h).over(w).alias(f"_{y}") for y in ys]) for h in horizons])
    wide = df.select(*keys, *xs, later.alias("_later"), F.count(F.lit(1)).over(of).alias("_n")).where(F.col("_n") >= max(horizons) + extra)
    steps = wide.select(*keys, *xs, F.explode("_later").alias("_s")).select(*keys, *xs, "_s.*")  # a row for each step keeps the aggregate narrow

    def r(x: str, y: str):
        both = F.col(x).isNotNull() & F.col(f"_{y}").isNotNull()
        value = corr_guarded(F.when(both, F.col(x)), F.when(both, F.col(f"_{y}")))
        return F.struct(F.lit(f"{x}->{y}").alias("pair"), F.count_if(both).alias("n"), (value if fill is None else F.coalesce(value, F.lit(fill))).alias("r"))

    grouped = steps.groupBy(*keys, "h").agg(F.array(*[r(x, y) for x, y in pairs]).alias("cells"))
    return grouped.select(*keys, "h", F.explode("cells").alias("c")).select(*keys, "c.pair", "h", "c.n", "c.r")


def instance_correlation(df: DataFrame, least: int = 100, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """(msname, pair, h, r, n_instances, n_samples): the average over instances of (msname, msinstanceid, t, cpu, mem, mcr).

    Services with fewer than `least` rows go, and instances with fewer than the longest horizon and 10. An instance counts
    for a horizon if its cpu correlates with itself; an undefined correlation of another pair makes the average null.
    """
    sizes = df.groupBy("msname").agg(F.count(F.lit(1)).alias("n_samples")).where(F.col("n_samples") >= least)
    each = lagged_correlation(df, INSTANCE_PAIRS, horizons, ["msname", "msinstanceid"])
    own = F.max(F.when(F.col("pair") == "cpu->cpu", F.col("r"))).over(Window.partitionBy("msname", "msinstanceid", "h"))
    valid = each.withColumn("_own", own).where("_own is not null")
    whole = F.when(F.count("r") == F.count(F.lit(1)), F.avg("r"))
    averaged = valid.groupBy("msname", "pair", "h").agg(whole.alias("r"), F.count(F.lit(1)).alias("n_instances"))
    return averaged.join(sizes, "msname")


def average_correlation(each: DataFrame, by: list[str], value: str = "r") -> DataFrame:
    return each.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"), F.count(value).alias("n"))


def lagged_pairs(df: DataFrame, pairs: Sequence[tuple[str, str]], horizons: Sequence[int], key: str = "msname", order: str = "t", extra: int = 20) -> DataFrame:
    """(key, pair, h, x, y): x(t) beside y(t + h rows), for keys with at least max(horizons) + extra rows."""
    w, of = Window.partitionBy(key).orderBy(order), Window.partitionBy(key)
    cells = [F.struct(F.lit(f"{x}->{y}").alias("pair"), F.lit(h).alias("h"), F.col(x).cast("double").alias("x"), F.lead(y, h).over(w).cast("double").alias("y")) for x, y in pairs for h in horizons]
    rows = df.select(key, F.count(F.lit(1)).over(of).alias("_n"), F.array(*cells).alias("cells")).where(F.col("_n") >= max(horizons) + extra)
    return rows.select(key, F.explode("cells").alias("c")).select(key, "c.*").where("x is not null and y is not null")


def distance_correlation(df: DataFrame, x: str, y: str, keys: Sequence[str] = ("msname",)) -> DataFrame:
    """(keys, dcor) over all rows of each key, without pairs; 0 for fewer than two rows or without variance.

    dCov2 = mean(|dx| |dy|) - 2 mean_i(a_i b_i) + mean(a) mean(b), with a_i and b_i the mean distances of row i, which
    running sums give in order of x or y. The mean over pairs is taken so: rows are ranked by x and by y; at each level, rows
    in the right half of a block of x ranks meet the sums of the left half's rows, below and above them in y. A pair is on
    either side of exactly one block's middle. Values are taken from their key's mean first, as the sums would cancel for
    values that are large beside their spread; the result is between 0 and 1. Rows with a null or NaN on either side are
    passed over; null keys are a key like any other.

    A key of up to SERIES rows is one task's, in arrays; a longer one goes through windows, which spill.
    """
    keys = list(keys)
    both = df.select(*keys, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    rows = materialise(both.where("x is not null and y is not null and not isnan(x) and not isnan(y)"), "pairs")
    key = F.struct(*keys)
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    long = materialise(sizes.where(F.col("_n") > SERIES).select(key.alias("_long")), "long")
    if long.isEmpty():
        return _distance_in_arrays(rows, keys)
    whole = _distance_in_arrays(rows.join(long, key == F.col("_long"), "left_anti"), keys)
    return whole.unionByName(_distance_in_windows(rows.join(long, key == F.col("_long"), "left_semi"), keys))


def _distance_in_arrays(rows: DataFrame, keys: list[str]) -> DataFrame:
    def one(table: pa.Table) -> pa.Table:
        value = _distance_of(table["x"].to_numpy(), table["y"].to_numpy())
        return table.select(keys).slice(0, 1).append_column("dcor", pa.array([value], pa.float64()))

    schema = StructType([*rows.select(*keys).schema.fields, StructField("dcor", DoubleType())])
    return rows.groupBy(*keys).applyInArrow(one, schema)


def _distance_of(x: np.ndarray, y: np.ndarray) -> float:
    """The distance correlation of two arrays in n log n: blocks of x ranks are halved level by level, each kept in order of y."""
    n = len(x)
    if n < 2:
        return 0.0
    x, y = x - x.mean(), y - y.mean()
    by_x = np.lexsort((y, x))
    x, y = x[by_x], y[by_x]
    order = np.lexsort((x, y))
    place = np.arange(n)

    def mean_distances(v: np.ndarray) -> np.ndarray:
        return (v * (2 * place - n) + v.sum() - 2 * (np.cumsum(v) - v)) / n

    a, b = mean_distances(x), np.empty(n)
    b[order] = mean_distances(y[order])
    upto = lambda v: np.concatenate(([0], np.cumsum(v)))
    pairs = 0.0
    for level in range(max(n - 1, 1).bit_length() - 1, -1, -1):
        start = order >> (level + 1) << (level + 1)  # a block's rows take up its ranks' places
        end = np.minimum(start + (2 << level), n)
        left = (order >> level) % 2 == 0
        right, u, v = ~left, x[order], y[order]
        across = np.zeros(np.count_nonzero(right))
        for weight, times in ((left, u * v), (left * u, -v), (left * v, -u), (left * u * v, 1.0)):
            sums = upto(weight)
            both = 2 * (sums[:-1] - sums[start]) - (sums[end] - sums[start])
            across += (both * times)[right]
        pairs += across.sum()
        lefts = upto(left)
        before = lefts[:-1] - lefts[start]
        to = np.where(left, start + before, start + (lefts[end] - lefts[start]) + (place - start - before))
        moved = np.empty_like(order)
        moved[to] = order
        order = moved
    cov = 2 * pairs / n / n - 2 * (a * b).mean() + a.mean() * b.mean()
    own = [max(2 * (v * v).mean() - 2 * (d * d).mean() + d.mean() ** 2, 0.0) for v, d in ((x, a), (y, b))]
    spread = math.sqrt(own[0] * own[1])
    return 0.0 if spread < 1e-12 else min(math.sqrt(max(cov, 0.0) / spread), 1.0)


def _distance_in_windows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """As `distance_correlation`, for keys of at least two rows, in n log(n)^2 steps of running sums."""
    of = Window.partitionBy(*keys)
    up_to = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({c: F.col(c) - F.avg(c).over(of) for c in ("x", "y")})
    by_x, by_y = of.orderBy("x", "y"), of.orderBy("y", "x")
    n = F.count(F.lit(1)).over(of)
    rows = rows.select("*", n.alias("n"), (F.row_number().over(by_x) - 1).alias("i"), F.coalesce(F.sum("x").over(up_to(by_x)), F.lit(0.0)).alias("sx"), F.sum("x").over(of).alias("tx"))
    rows = rows.select("*", (F.row_number().over(by_y) - 1).alias("j"), F.coalesce(F.sum("y").over(up_to(by_y)), F.lit(0.0)).alias("sy"), F.sum("y").over(of).alias("ty"))
    mean_distance = lambda v, rank, below, total: (v * (2 * rank - F.col("n")) + total - 2 * below) / F.col("n")
    rows = rows.withColumns({"a": mean_distance(F.col("x"), F.col("i"), F.col("sx"), F.col("tx")), "b": mean_distance(F.col("y"), F.col("j"), F.col("sy"), F.col("ty"))})

    levels = F.sequence(F.lit(0), F.greatest(F.ceil(F.log2(F.col("n").cast("double"))).cast("int") - 1, F.lit(0)))
    placed = rows.select(*keys, "x", "y", "i", "j", F.explode(levels).alias("level"))
    shifted = lambda by: F.expr(f"shiftright(i, level + {by})")
    placed = placed.withColumns({"block": shifted(1), "left": (shifted(0) % 2 == 0).cast("double")})
    block = Window.partitionBy(*keys, "level", "block")
    below = up_to(block.orderBy("j"))
    parts = {"c": F.col("left"), "x": F.col("left") * F.col("x"), "y": F.col("left") * F.col("y"), "xy": F.col("left") * F.col("x") * F.col("y")}
    sums = placed.select("*", *[F.coalesce(F.sum(v).over(below), F.lit(0.0)).alias(f"low_{k}") for k, v in parts.items()], *[F.sum(v).over(block).alias(f"all_{k}") for k, v in parts.items()])
    area = lambda c: F.col("x") * F.col("y") * c("c") - F.col("x") * c("y") - F.col("y") * c("x") + c("xy")
    across = 2 * area(lambda k: F.col(f"low_{k}")) - area(lambda k: F.col(f"all_{k}"))
    pairs = sums.where("left = 0").groupBy(*keys).agg(F.sum(across).alias("s"))

    m = rows.groupBy(*keys).agg(
        F.max("n").alias("n"), F.avg("a").alias("ra"), F.avg("b").alias("rb"), F.avg(F.col("a") * F.col("b")).alias("rab"), F.avg(F.col("a") * F.col("a")).alias("raa"), F.avg(F.col("b") * F.col("b")).alias("rbb"),
        (2 * F.var_pop("x")).alias("aa"), (2 * F.var_pop("y")).alias("bb"),
    )
    m = join_on(m, pairs, keys).withColumn("ab", 2 * F.col("s") / F.col("n") / F.col("n"))
    cov = F.greatest(F.col("ab") - 2 * F.col("rab") + F.col("ra") * F.col("rb"), F.lit(0.0))
    va, vb = F.col("aa") - 2 * F.col("raa") + F.col("ra") * F.col("ra"), F.col("bb") - 2 * F.col("rbb") + F.col("rb") * F.col("rb")
    spread = F.sqrt(F.greatest(va, F.lit(0.0)) * F.greatest(vb, F.lit(0.0)))
    return m.select(*keys, F.when((F.col("n") < 2) | (spread < 1e-12), 0.0).otherwise(F.least(F.sqrt(cov / F.when(spread >= 1e-12, spread)), F.lit(1.0))).alias("dcor"))


def sample_entropy(df: DataFrame, value: str, key: str = "msname", order: str = "pos", m: int = 2, r_frac: float = 0.2, sample: int = 1000, seed: int = 42) -> DataFrame:
    """(key, entropy): -ln(A / B), A and B the pairs of templates of m + 1 and m rows within r_frac of the std.

    Of a series with more than `sample` rows a seeded sample of as many, over the whole of it, is taken, in order; so the
    cost of a series is bounded. Null for fewer than 2 (m + 1) + 2 rows, flat series, or without matches.
    """
    drawn = Window.partitionBy(key).orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string"), F.col(order).cast("string"))), order)
    rows = df.where(F.col(value).isNotNull()).withColumn("_drawn", F.row_number().over(drawn)).where(F.col("_drawn") <= sample)
    series = rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda s: s[value]).alias("v"), (F.stddev_samp(value) * r_frac).alias("r"))
    series = series.where((F.size("v") >= 2 * (m + 1) + 2) & (F.col("r") > 0))
    starts = series.select(key, "v", "r", F.posexplode(F.slice("v", 1, F.size("v") - m)).alias("i", "_first"))
    at = lambda j: F.element_at("v", j + 1)

    def near(j, k):
        return F.abs(at(F.col("i") + k) - at(j + k)) <= F.col("r")

    later = F.sequence(F.col("i") + 1, F.size("v") - m - 1)
    matched = F.filter(F.when(F.col("i") + 1 <= F.size("v") - m - 1, later).otherwise(F.array().cast("array<int>")), lambda j: near(j, 0) & near(j, 1) if m == 2 else near(j, 0))
    longer = F.filter("_b", lambda j: near(j, m))
    counts = starts.withColumn("_b", matched).select(key, F.size("_b").alias("b"), F.size(longer).alias("a")).groupBy(key).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    found = counts.select(key, F.when((F.col("a") > 0) & (F.col("b") > 0), -F.log(F.col("a") / F.col("b"))).alias("entropy"))
    return df.select(key).distinct().join(found, key, "left")


def entropy_groups(df: DataFrame, entropy: DataFrame, value: str = "load", clusters: int = 3, seed: int = 7) -> DataFrame:
    """(cluster, t, value): series summed within clusters of like entropy, cluster 0 the most irregular."""
    known = entropy.where("entropy is not null")
    k = min(clusters, known.select("entropy").distinct().limit(clusters).count())
    if k < 2:
        placed = known.select("msname", F.lit(0).alias("cluster"))
    else:
        ready = VectorAssembler(inputCols=["entropy"], outputCol="_v").transform(known)
        model = KMeans(featuresCol="_v", predictionCol="_c", k=k, seed=seed).fit(ready)
        order = sorted(range(k), key=lambda c: -float(model.clusterCenters()[c][0]))
        rank = F.create_map(*[F.lit(v) for c in range(k) for v in (c, order.index(c))])
        placed = model.transform(ready).select("msname", F.element_at(rank, F.col("_c")).alias("cluster"))
    return df.join(placed, "msname").groupBy("cluster", "t").agg(F.sum(value).alias(value))
