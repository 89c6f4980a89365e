"""From raw samples to per-service series: filters, bucket aggregates, feature joins, positions, gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelens.functions.scalars import duration_seconds, floor_to


def valid_range(df: DataFrame, columns: tuple[str, ...] = ("cpu", "mem"), low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Rows whose utilisation columns are all within [low, high]; reaches the scan as a pushed filter."""
    for c in columns:
        df = df.where(F.col(c).between(low, high))
    return df


def only_services(df: DataFrame, services: DataFrame, key: str = "msname") -> DataFrame:
    """Rows of the listed services: a semi join, which Spark broadcasts if it is small."""
    return df.join(services.select(key).distinct(), key, "left_semi")


def between_times(df: DataFrame, start: int, end: int, time: str = "ts", closed: bool = False) -> DataFrame:
    """[start, end), or [start, end] if closed."""
    upper = F.col(time) <= end if closed else F.col(time) < end
    return df.where((F.col(time) >= start) & upper)


def bucket(df: DataFrame, keys: list[str], freq: str, aggs: dict[str, Column] | None = None, time: str = "ts") -> DataFrame:
    """Truncates time to `freq` and aggregates by (t, keys). Without `aggs`: the last value of every other column by time.

    Spark sums partially before the shuffle, so only one row per task and group moves.
    """
    if aggs is None:
        others = [c for c in df.columns if c not in (*keys, time)]
        aggs = {c: last_by(F.col(c), F.col(time)) for c in others}
    return df.groupBy(floor_to(F.col(time), freq).alias("t"), *keys).agg(*[a.alias(n) for n, a in aggs.items()])


def last_by(value: Column, time: Column) -> Column:
    """The value at the largest time; ties go to the largest value, so reruns agree."""
    return F.max_by(value, F.struct(time, value))


def build_series(tables: list[DataFrame], keys: list[str]) -> DataFrame:
    """Left equi-join of bucketed feature tables on (t, keys), then rows with any null feature go."""
    out = tables[0]
    for t in tables[1:]:
        out = out.join(t, ["t", *keys], "left")
    return out.dropna()


def with_positions(df: DataFrame, key: str = "msname", time: str = "t") -> DataFrame:
    """Adds pos from 0 and the series length n. A series has at most one row per time step, so its window stays small."""
    of = Window.partitionBy(key)
    return df.withColumn("pos", F.row_number().over(of.orderBy(time)) - 1).withColumn("n", F.count(F.lit(1)).over(of))


def bad_services(df: DataFrame, key: str = "msname", time: str = "t", freq: str | None = None, least: int = 1) -> DataFrame:
    """Services with gaps or duplicates (a step other than freq; without freq, one of 0), or fewer than `least` rows."""
    step = F.col(time) - F.lag(time).over(Window.partitionBy(key).orderBy(time))
    odd = (step != duration_seconds(freq)) if freq else (step <= 0)
    marked = df.withColumn("_odd", F.coalesce(odd, F.lit(False)))
    counted = marked.groupBy(key).agg(F.bool_or("_odd").alias("gap"), F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("gap") | (F.col("n") < least)).select(key, "gap", "n")


def without_bad(df: DataFrame, bad: DataFrame, key: str = "msname") -> DataFrame:
    return df.join(bad, key, "left_anti")


def total_mcr(df: DataFrame) -> DataFrame:
    return df.withColumn("total_mcr", F.col("http_mcr") + F.col("providerrpc_mcr") + F.col("providermq_mcr"))


def min_max_global(df: DataFrame, columns: list[str]) -> DataFrame:
    """Scales columns by the minimum and maximum over all services; a span under 1e-12 gives 0. The bounds are one row."""
    bounds = df.agg(*[F.min(c).alias(f"_lo_{c}") for c in columns], *[F.max(c).alias(f"_hi_{c}") for c in columns])
    out = df.join(F.broadcast(bounds))  # one row
    for c in columns:
        span = F.col(f"_hi_{c}") - F.col(f"_lo_{c}")
        out = out.withColumn(c, F.when(span < 1e-12, 0.0).otherwise((F.col(c) - F.col(f"_lo_{c}")) / span))
    return out.select(df.columns)


def min_max_within(df: DataFrame, column: str, key: str) -> Column:
    """Scaled to [0, 1] within each key; a flat one is 0.5."""
    of = Window.partitionBy(key)
    low, high = F.min(column).over(of), F.max(column).over(of)
    return F.when(high == low, 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(column) - low) / (high - low))))


def rate_column(df: DataFrame, front: list[str], key: str = "msname") -> Column:
    """http_mcr for services at the front, providerrpc_mcr for others."""
    return F.when(F.col(key).isin(front), F.col("http_mcr")).otherwise(F.col("providerrpc_mcr"))


def assign_split(df: DataFrame, train: float = 0.7, val: float = 0.1, hours: tuple[float, float, float | None] | None = None, freq: str = "1h") -> DataFrame:
    """Adds `split` from pos and n, before any windowing.

    Fractions: floor(n * train) and floor(n * (train + val)) in doubles. Hours: each rounded half to even to rows; with
    test hours unset the rest is test, else rows beyond are left out.
    """
    if hours is None:
        first = F.floor(F.col("n") * F.lit(train))
        second = F.floor(F.col("n") * (F.lit(train) + F.lit(val)))
        return df.withColumn("split", F.when(F.col("pos") < first, "train").when(F.col("pos") < second, "val").otherwise("test"))
    per_hour = 3600 / duration_seconds(freq)
    rows = [None if h is None else round(h * per_hour) for h in hours]
    a, b = rows[0], rows[0] + rows[1]
    out = df.withColumn("split", F.when(F.col("pos") < a, "train").when(F.col("pos") < b, "val").otherwise("test"))
    return out if rows[2] is None else out.where(F.col("pos") < b + rows[2])
