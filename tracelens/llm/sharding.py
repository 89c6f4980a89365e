"""Sharding by jump consistent hashing: a stable key and the shard count decide the shard; no ring table is kept.

When a shard is appended, a row either stays or moves into the new shard (Lamping and Veach, 2014).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelens.llm.common import materialise, spare_names

#: Fixed values of the published algorithm: multiplier of the linear congruential step, and its bit shift.
JUMP_MULTIPLIER = 2862933555777941757
JUMP_SHIFT = 33
#: The key of rows whose key is null.
NULL_KEY = -1
#: Rows for which one cell of all shards is made.
CELL_ROWS = 100_000


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key; all keys step together, and those that have landed drop out."""
    state = keys.astype(np.int64).view(np.uint64).copy()
    at, ahead = np.full(len(state), -1, np.int64), np.zeros(len(state), np.int64)
    going = np.arange(len(state))
    while len(going):
        at[going] = ahead[going]
        with np.errstate(over="ignore"):
            state[going] = state[going] * np.uint64(JUMP_MULTIPLIER) + np.uint64(1)
        span = float(1 << 31) / ((state[going] >> np.uint64(JUMP_SHIFT)).astype(np.float64) + 1.0)
        ahead[going] = ((at[going] + 1) * span).astype(np.int64)
        going = going[ahead[going] < shards]
    return at


def jump_shard(key: Column, shards: int) -> Column:
    """The shard of a long key as a Column; a null key counts as NULL_KEY."""
    if shards < 1:
        raise ValueError("shards must be at least 1")

    @F.pandas_udf("int")
    def shard_of(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(keys.to_numpy(np.int64), shards), dtype="int32")

    return shard_of(F.coalesce(key.cast("long"), F.lit(NULL_KEY).cast("long")))


def assign_shards(docs: DataFrame, shards: int, key: str = "doc_id", grown: int | None = None) -> DataFrame:
    """Adds `shard`, and `grown_shard` if `grown` names a larger shard count; columns of these names are replaced.

    Any column may be null or repeated; a null key is NULL_KEY.
    """
    out = docs.withColumn("shard", jump_shard(F.col(key), shards))
    return out.withColumn("grown_shard", jump_shard(F.col(key), grown)) if grown else out


def with_slots(sharded: DataFrame, key: str = "doc_id", ties: tuple[str, ...] = ()) -> DataFrame:
    """Adds `slot`: gapless places from 0 in each shard, in the order of a hash of key and ties, then of these themselves.

    Each shard is cut into cells by the beginning of the hash, as many as the number of rows asks for; a small table of
    cell counts gives where a cell begins, and only inside a cell rows are numbered, so that no task sees a whole shard,
    and rows that share a key are spread by their ties. Rows equal in all of these are interchangeable; a cell that these
    make large is numbered by hash and by task, so that no task holds all of them. A column `slot` is replaced, others stay.
    """
    cell, order, count, start, row, task = spare_names(sharded, "cell", "order", "count", "start", "row", "task")
    rows = sharded.drop("slot").withColumn(order, F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (key, *ties)])))
    digits = max(3, math.ceil(math.log(max(sharded.select(key).count(), 1) / CELL_ROWS, 16)))
    rows = rows.withColumn(cell, F.substring(order, 1, digits))
    before = Window.partitionBy("shard").orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("shard", cell).agg(F.count(F.lit(1)).alias(count))
    starts = materialise(counts.withColumn(start, F.coalesce(F.sum(count).over(before), F.lit(0))), "cells")
    large = starts.where(F.col(count) > 4 * CELL_ROWS).select("shard", cell, start)  # one for 4 * CELL_ROWS rows at most
    inside = Window.partitionBy("shard", cell).orderBy(order, F.col(key), *[F.col(c) for c in ties])
    columns = [c for c in sharded.columns if c != "slot"]
    slot = (F.col(start) + F.col(row) - F.lit(1).cast("long")).alias("slot")
    if large.isEmpty():
        return rows.withColumn(row, F.row_number().over(inside)).join(starts, ["shard", cell]).select(*columns, slot)
    few = rows.join(F.broadcast(large.drop(start)), ["shard", cell], "left_anti")
    out = few.withColumn(row, F.row_number().over(inside)).join(starts, ["shard", cell]).select(*columns, slot)
    many = materialise(rows.join(F.broadcast(large), ["shard", cell]).withColumn(task, F.spark_partition_id()), "large")
    each = many.groupBy("shard", cell, start, order, task).agg(F.count(F.lit(1)).alias(count))
    ahead = F.coalesce(F.sum(count).over(Window.partitionBy("shard", cell).orderBy(order, task).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = each.select("shard", order, task, (F.col(start) + ahead).alias(start))
    alike = many.drop(start).withColumn(row, F.row_number().over(Window.partitionBy("shard", order, task).orderBy(F.col(key), *[F.col(c) for c in ties])))
    return out.unionByName(alike.join(each, ["shard", order, task]).select(*columns, slot))


def write_shards(sharded: DataFrame, path: str) -> None:
    """Writes one folder per shard; rows of a shard may come from several tasks, so that no task holds a whole shard."""
    sharded.write.partitionBy("shard").mode("overwrite").parquet(path)


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document.

    Null text: no bytes, so size 16 and checksum 0. A null doc_id has a key of its own. Repeated rows share their
    shard and get different slots. Very long texts are only measured. An empty table gives no rows; other columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = with_slots(assign_shards(rows, shards, grown=shards + 1), ties=("text_crc32", "size"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
