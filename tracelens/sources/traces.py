"""Raw traces: CSV ingest with pruning, part ranges, micro-batch ingest, Parquet and SQL scans."""

from __future__ import annotations

import csv
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tracelens.functions.scalars import duration_seconds
from tracelens.sources.files import filesystem

NUMERIC = T.DoubleType()


def headers(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """The columns of each CSV file under a path or pattern; of each file only the beginning is read, all in one job.

    Names and headers come to the driver, no rows.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    where = hadoop.Path(path)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where) or []
    files = []
    for status in found:
        inner = [f.getPath() for f in status.getPath().getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(status.getPath()) if f.isFile()] if status.isDirectory() else [status.getPath()]
        files += [f.toString() for f in inner if not f.getName().startswith(("_", "."))]
    named = spark.createDataFrame([(f,) for f in files], "file string").repartition(max(1, len(files) // 50))
    return {r.file: r.columns for r in named.mapInPandas(_first_lines, "file string, columns array<string>").collect()}


def _first_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The columns that each file's first line names; none for an empty file."""
    for batch in batches:
        found = []
        for name in batch["file"]:
            system, path = filesystem(name)
            with system.open_input_stream(path) as source:
                line = b""
                while b"\n" not in line and (more := source.read(1 << 16)):
                    line += more
            found.append(next(csv.reader([line.split(b"\n", 1)[0].decode("utf-8-sig").rstrip("\r")]), []))
        yield pd.DataFrame({"file": batch["file"], "columns": found})


def valid_files(spark: SparkSession, path: str, needed: list[str]) -> tuple[dict[str, list[str]], DataFrame]:
    """(header of each file that holds all needed columns, table of skipped files with what they lack)."""
    heads = headers(spark, path)
    lacks = {f: [c for c in needed if c not in columns] for f, columns in heads.items()}
    skipped = spark.createDataFrame([(f, gone) for f, gone in lacks.items() if gone], "file string, lacks array<string>")
    return {f: columns for f, columns in heads.items() if not lacks[f]}, skipped


def read_csv_trace(spark: SparkSession, path: str, strings: list[str], numbers: list[str], keep: list[str] | None = None) -> DataFrame:
    """CSV or CSV.GZ to (timestamp ms, timestamp_dt, keys, features): needed columns only, rows with a null in them go.

    Files that lack a needed column are skipped. The schema is explicit: files with one header are read as one table.
    """
    heads, _ = valid_files(spark, path, ["timestamp", *strings, *numbers])
    groups: dict[tuple[str, ...], list[str]] = {}
    for file, columns in heads.items():
        groups.setdefault(tuple(columns), []).append(file)
    if not groups:
        schema = T.StructType([T.StructField("timestamp", T.LongType()), T.StructField("timestamp_dt", T.TimestampType()), *[T.StructField(c, T.StringType()) for c in strings], *[T.StructField(c, NUMERIC) for c in numbers]])
        return spark.createDataFrame([], schema)
    frames: DataFrame | None = None
    for columns, files in groups.items():
        schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
        one = spark.read.schema(schema).option("header", True).csv(files)
        one = one.select(F.col("timestamp").try_cast("long").alias("timestamp"), *strings, *[F.col(c).try_cast("double").alias(c) for c in numbers])
        frames = one if frames is None else frames.unionByName(one)
    out = frames.dropna().withColumn("timestamp_dt", F.timestamp_millis("timestamp"))
    return out.select("timestamp", "timestamp_dt", *strings, *(keep or numbers))


def write_parts(df: DataFrame, path: str, parts: int, order: list[str]) -> None:
    """zstd Parquet in about `parts` files, each sorted."""
    df.repartitionByRange(parts, *order).sortWithinPartitions(*order).write.option("compression", "zstd").mode("overwrite").parquet(path)


def part_range(start: str, end: str, minutes: int) -> tuple[int, int]:
    """First and last index of source files that cover [start, end), given as '0d0'."""
    cadence = minutes * 60
    return duration_seconds(start) // cadence, duration_seconds(end) // cadence - 1


def in_part_range(file: Column, start: str, end: str, minutes: int) -> Column:
    first, last = part_range(start, end, minutes)
    return F.regexp_extract(file, r"_(\d+)\.[^/]*$", 1).try_cast("int").between(first, last)


def scan_parts(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Parquet parts, only the columns asked for."""
    return spark.read.parquet(path).select(*columns)


def ingest_stream(spark: SparkSession, source: str, target: str, checkpoint: str, schema: T.StructType, files_per_batch: int = 100) -> StreamingQuery:
    """Files that have newly arrived, appended to a Parquet table; rows that don't parse go to `bad=true`.

    The checkpoint makes a crashed run pick up where it stood, each file once.
    """
    full = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    rows = spark.readStream.schema(full).option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("maxFilesPerTrigger", files_per_batch).csv(source)
    marked = rows.withColumn("bad", F.col("_corrupt").isNotNull())
    return marked.writeStream.format("parquet").option("checkpointLocation", checkpoint).partitionBy("bad").trigger(availableNow=True).start(target)
