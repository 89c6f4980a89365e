"""Where queries and their SQL twins are kept by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelens.plans.views import with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, digits: int = 9) -> Callable[[Query], Query]:
    """Registers a query under its function's name. Doubles are rounded; in the SQL those written as `R(x;R)`."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir), digits)
        if sql:
            SQL[f.__name__] = with_views(sql).replace("R(", "0.0::DOUBLE + round(").replace(";R)", f", {digits})")
        return f

    return add


def rounded(df: DataFrame, digits: int) -> DataFrame:
    """-0.0 becomes 0.0."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
