"""Helpers of the training-data operators: tokens as Columns, tables in the shared folder, text batches as bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelens.session import materialise, scratch

__all__ = ["ALNUM_WORD", "BLANK_WORD", "ascii_lower", "in_chunks", "materialise", "n_words_of", "read_table", "running", "scratch", "spare_names", "text_bytes", "text_tag", "words_of"]

#: A word: a run without the six ASCII blanks.
BLANK_WORD = r"[^\x20\x09-\x0D]+"
#: A word of a lower-cased text: a run of ASCII letters and digits and of everything beyond ASCII. As a class of what is left out
#: the same takes Java about four times as long.
ALNUM_WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spare_names(df: DataFrame, *stems: str) -> list[str]:
    """For each stem a column name that `df` doesn't have, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for stem in stems:
        name = f"_{stem}"
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def text_tag(text: Column | None = None) -> Column:
    """A 64-bit hash that tells texts apart where ids are equal or null; null counts as empty."""
    return F.xxhash64(F.coalesce(F.col("text") if text is None else text, F.lit("")))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. A text of single-byte characters takes the quick built-in; others go character by character."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column, pattern: str) -> Column:
    """All words as an array; null text: no words."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))


def n_words_of(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("long")


def running(rows: DataFrame, group: str, order: list[str], value: Column, name: str) -> DataFrame:
    """Adds the sum of `value` over the rows before each one in its group, in order, null first; equal rows in any order.

    No task holds a large group: rows are range-sharded, summed in each shard, and of the groups that a shard goes on with,
    one a shard at most, the sums before are broadcast.
    """
    tie, part, own, before = spare_names(rows, "tie", "part", "own", "before")
    ranged = rows.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(group, *order, tie)
    ranged = materialise(ranged.withColumn(part, F.spark_partition_id()).withColumn(own, value.cast("long")), "ranged")
    earlier = Window.rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy(group, part).agg(F.sum(own).alias(before))
    later = sums.withColumn(before, F.sum(before).over(earlier.partitionBy(group).orderBy(part))).where(F.col(before).isNotNull())
    inside = F.coalesce(F.sum(own).over(earlier.partitionBy(group, part).orderBy(*order, tie)), F.lit(0).cast("long"))
    out = ranged.join(F.broadcast(later), [group, part], "left")
    return out.withColumn(name, inside + F.coalesce(before, F.lit(0))).drop(tie, part, own, before)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, end to end, and the n+1 offsets into them; a null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def in_chunks(batch: pa.RecordBatch, text: str, most: int = 4 << 20, rows: int = 1 << 30) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cuts a batch into runs of up to `rows` rows with about `most` bytes of text, so that work arrays stay small; a longer text stays whole."""
    data, bounds = text_bytes(batch.column(batch.schema.get_field_index(text)))
    start, n = 0, batch.num_rows
    while start < n:
        end = int(np.searchsorted(bounds, bounds[start] + most, side="right")) - 1
        end = min(n, max(end, start + 1), start + rows)
        yield batch.slice(start, end - start), data[bounds[start] : bounds[end]], bounds[start : end + 1] - bounds[start]
        start = end
