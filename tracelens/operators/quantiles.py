"""Exact quantiles of groups of any size, and stored sketches of parts that are folded as parts arrive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelens.session import materialise
from tracelens.sources.tables import exists

#: Values that one task may sort, bins of a pass, and ranges that are broadcast.
FEW, BINS, FEW_RANGES = 500_000, 2_048, 100_000
#: Infinite values count as these.
LARGEST = 1.7976931348623157e308


def quantiles(df: DataFrame, value: str, levels: dict[str, float], by: list[str], higher: bool = False) -> DataFrame:
    """(by, a column for each level): quantiles with linear interpolation or, with `higher`, the value at ceil((n - 1) q).

    Where a group has more than FEW values, the ranks asked for are found by histograms: each pass counts a range's values in
    bins, whose counts are summed before the shuffle, and goes on in the bin that holds the rank, until a bin has few values
    or one. So no task holds a group, however large it is and however many distinct values it has. Nulls and NaN are skipped,
    infinite values count as the largest double; a group without values has no row.
    """
    inner = F.col(value).cast("double")
    clean = F.greatest(F.least(inner, F.lit(LARGEST)), F.lit(-LARGEST))
    rows = materialise(df.where(inner.isNotNull() & ~F.isnan(inner)).select(*by, clean.alias("_v")), "values")
    sizes = materialise(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")).where("_n > 0"), "sizes")
    if sizes.where(F.col("_n") > FEW).isEmpty():
        if not higher:
            return rows.groupBy(*by).agg(*[F.percentile("_v", F.lit(q)).alias(name) for name, q in levels.items()]).where(F.lit(True) if by else F.col(next(iter(levels))).isNotNull())
        found = _by_rank(rows, sizes.select(*by, F.explode(F.array_distinct(F.array(*[_rank(q, True) for q in levels.values()]))).alias("_k"), "_lo", "_hi", F.lit(0).cast("long").alias("_below")), by)
    else:
        ranks = F.array_distinct(F.array(*[_rank(q, up) for q in levels.values() for up in ((True,) if higher else (False, True))]))
        found = _narrowed(rows, sizes.select(*by, F.explode(ranks).alias("_k"), "_lo", "_hi", F.lit(0).cast("long").alias("_below"), "_n"), by)
    listed = found.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("_k", "_v"))).alias("_at"))  # two entries a level at most
    both = join_on(sizes, listed, by)

    def level(q: float) -> Column:
        place = F.lit(float(q)) * (F.col("_n") - 1)
        low, high = F.element_at("_at", _rank(q, False)), F.element_at("_at", _rank(q, True))
        if higher:
            return high
        return F.when(F.floor(place) == F.ceil(place), high).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high)

    return both.select(*by, *[level(q).alias(name) for name, q in levels.items()])


def _rank(q: float, up: bool) -> Column:
    place = F.lit(float(q)) * (F.col("_n") - 1)
    return (F.ceil(place) if up else F.floor(place)).cast("long")


def join_on(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """An equi-join in which nulls are equal, or a join of single rows if there are no keys; keys are kept once."""
    if not by:
        return left.join(right)
    renamed = right.select(*[F.col(b).alias(f"_r_{b}") for b in by], *[c for c in right.columns if c not in by])
    on = None
    for b in by:
        one = F.col(b).eqNullSafe(F.col(f"_r_{b}"))
        on = one if on is None else on & one
    return left.join(renamed, on).drop(*[f"_r_{b}" for b in by])


def _within(rows: DataFrame, targets: DataFrame, by: list[str]) -> DataFrame:
    """Rows with each range (by, _lo, _hi) of their group that holds them; a group has two ranges a level at most."""
    ranges = targets.select(*by, "_lo", "_hi").distinct()
    return join_on(rows, F.broadcast(ranges) if ranges.count() <= FEW_RANGES else ranges, by).where("_v >= _lo and _v <= _hi")


def _narrowed(rows: DataFrame, targets: DataFrame, by: list[str]) -> DataFrame:
    """(by, _k, _v) of targets (by, _k, _lo, _hi, _below, _n): the rank looked for, the range that holds it, values below and in it."""
    targets, done = materialise(targets, "targets"), []
    while True:
        wide = targets.where((F.col("_n") > FEW) & (F.col("_lo") < F.col("_hi")))
        done.append(targets.where(~((F.col("_n") > FEW) & (F.col("_lo") < F.col("_hi")))))
        if wide.isEmpty():
            break
        half = lambda c: F.col(c) / 2  # noqa: E731  a difference of halves doesn't overflow
        place = F.least(F.floor((half("_v") - half("_lo")) / (half("_hi") - half("_lo")) * BINS), F.lit(BINS - 1)).cast("int")
        bins = _within(rows, wide, by).groupBy(*by, "_lo", "_hi", place.alias("_bin")).agg(F.count(F.lit(1)).alias("_in"), F.min("_v").alias("_from"), F.max("_v").alias("_to"))
        before = Window.partitionBy(*by, "_lo", "_hi").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)  # at most BINS rows
        bins = bins.withColumn("_before", F.coalesce(F.sum("_in").over(before), F.lit(0)))
        met = join_on(wide.drop("_n"), bins, [*by, "_lo", "_hi"])
        inside = (F.col("_k") >= F.col("_below") + F.col("_before")) & (F.col("_k") < F.col("_below") + F.col("_before") + F.col("_in"))
        targets = materialise(met.where(inside).select(*by, "_k", F.col("_from").alias("_lo"), F.col("_to").alias("_hi"), (F.col("_below") + F.col("_before")).alias("_below"), F.col("_in").alias("_n")), "targets")
    every = done[0]
    for d in done[1:]:
        every = every.unionByName(d)
    every = materialise(every, "narrow")
    single = every.where("_lo = _hi").select(*by, "_k", F.col("_lo").alias("_v"))
    return single.unionByName(_by_rank(rows, every.where("_lo < _hi"), by))


def _by_rank(rows: DataFrame, targets: DataFrame, by: list[str]) -> DataFrame:
    """(by, _k, _v): the values of each range in order; a range has at most FEW."""
    order = Window.partitionBy(*by, "_lo", "_hi").orderBy("_v")
    numbered = _within(rows, targets, by).withColumn("_place", F.row_number().over(order) - 1)
    met = join_on(targets.select(*by, "_k", "_lo", "_hi", "_below"), numbered, [*by, "_lo", "_hi"])
    return met.where("_below + _place = _k").select(*by, "_k", "_v")


def part_sketches(df: DataFrame, part: str, by: list[str], distinct: str, value: str, lg_k: int = 12, k: int = 400) -> DataFrame:
    """(part, by, n, sum, distinct_sketch, value_sketch): what is kept of a part, a few kilobytes a group.

    Distinct values are sketched by HyperLogLog (relative error about 1 / sqrt(2 ** lg_k)), the distribution by KLL (rank
    error about 1.65 / k). Nulls are skipped.
    """
    return df.groupBy(part, *by).agg(
        F.count(value).alias("n"), F.sum(F.col(value).cast("double")).alias("sum"), F.hll_sketch_agg(distinct, F.lit(lg_k)).alias("distinct_sketch"), F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias("value_sketch")
    )


def add_parts(df: DataFrame, path: str, part: str, by: list[str], distinct: str, value: str) -> list:
    """Sketches the parts of df that the table at `path` doesn't have yet, and appends them; which ones. A part costs only itself."""
    spark = df.sparkSession
    todo = df.select(part).distinct()
    if exists(spark, path):
        todo = todo.join(spark.read.parquet(path).select(part).distinct(), part, "left_anti")
    new = [r[0] for r in todo.collect()]
    if new:
        part_sketches(df.where(F.col(part).isin(new)), part, by, distinct, value).write.mode("append").parquet(path)
    return sorted(new)


def fold(sketches: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, sum, distinct_sketch, value_sketch) of all parts together; sketches are united, nothing is read again."""
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("sum").alias("sum"), F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.kll_merge_agg_double("value_sketch").alias("value_sketch"))


def estimates(folded: DataFrame, by: list[str], levels: dict[str, float]) -> DataFrame:
    """(by, n, mean, distinct, a column for each level)."""
    cut = [F.kll_sketch_get_quantile_double("value_sketch", F.lit(float(q))).alias(name) for name, q in levels.items()]
    return folded.select(*by, "n", (F.col("sum") / F.col("n")).alias("mean"), F.hll_sketch_estimate("distinct_sketch").alias("distinct"), *cut)
