"""Trace files chosen before they are read, and files that arrive: each taken once, unreadable ones set apart."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.streaming import StreamingQuery

from tracelens.functions.scalars import duration_seconds
from tracelens.sources.tables import exists

#: A part file's index, between the last underscore and the extension.
INDEX = re.compile(r"_(\d+)\.(?:csv|csv\.gz|parquet)$")
#: Bytes of files that one task reads.
TASK_BYTES = 64 << 20
#: What comes after bad files' names.
BAD = ".bad"


def filesystem(path: str):
    """(pyarrow file system, path within it) of a path as Hadoop writes it."""
    from pyarrow import fs

    if path.startswith("file:") or "://" not in path:
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


class PartFiles(InputPartition):
    def __init__(self, files: list[str]) -> None:
        super().__init__(files)
        self.files = files


class PartReader(DataSourceReader):
    """Files whose index covers the times asked for; the index range narrows with each pushed comparison of the time column."""

    def __init__(self, options: dict, schema: T.StructType) -> None:
        self.path, self.time, self.schema = options["path"], options.get("time", "timestamp"), schema
        self.step = int(options["minutes"]) * 60_000
        self.begin = int(options.get("begin", "0"))
        self.first, self.last = 0, None
        if "start" in options:
            self.narrow(self.begin + 1000 * duration_seconds(options["start"]), None)
        if "end" in options:
            self.narrow(None, self.begin + 1000 * duration_seconds(options["end"]) - 1)

    def narrow(self, low: int | None, high: int | None) -> None:
        """Only files with times from low to high, both included."""
        if low is not None:
            self.first = max(self.first, (low - self.begin) // self.step)
        if high is not None:
            last = (high - self.begin) // self.step
            self.last = last if self.last is None else min(self.last, last)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if getattr(f, "attribute", None) == (self.time,):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.narrow(int(f.value) + isinstance(f, GreaterThan), None)
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.narrow(None, int(f.value) - isinstance(f, LessThan))
            yield f  # rows of the files that are read are still compared

    def partitions(self) -> list[PartFiles]:
        from pyarrow import fs

        files, root = filesystem(self.path)
        found = []
        for info in files.get_file_info(fs.FileSelector(root)):
            match = INDEX.search(info.base_name)
            if info.is_file and match and self.first <= int(match[1]) and (self.last is None or int(match[1]) <= self.last):
                found.append((int(match[1]), info.size, f"{self.path.rstrip('/')}/{info.base_name}"))
        groups, held = [], TASK_BYTES
        for _, size, name in sorted(found):
            if held + size > TASK_BYTES:
                groups.append([])
                held = 0
            groups[-1].append(name)
            held += size
        return [PartFiles(g) for g in groups] or [PartFiles([])]

    def read(self, partition: PartFiles) -> Iterator[pa.RecordBatch]:
        import pyarrow.csv as csv
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.schema)
        for name in partition.files:
            files, path = filesystem(name)
            if path.endswith(".parquet"):
                with files.open_input_file(path) as source:
                    for batch in pq.ParquetFile(source).iter_batches(columns=schema.names):
                        yield batch.select(schema.names).cast(schema)
            else:
                with files.open_input_stream(path) as source:  # unpacked by its extension
                    for batch in csv.open_csv(source, convert_options=csv.ConvertOptions(include_columns=schema.names, column_types=schema)):
                        yield batch


class TraceParts(DataSource):
    """Format `trace_parts`: a folder of `<name>_<index>.csv`, `.csv.gz` or `.parquet`, each of `minutes` minutes from `begin` (ms) on.

    `start` and `end`, as in '1d12', and comparisons of the column `time` (timestamp, in ms) choose files by their index
    before any is opened. The schema names the columns to be read.
    """

    @classmethod
    def name(cls) -> str:
        return "trace_parts"

    def schema(self) -> T.StructType:
        raise ValueError("name the columns to be read: spark.read.format('trace_parts').schema(...)")

    def reader(self, schema: T.StructType) -> PartReader:
        return PartReader(dict(self.options), schema)


def read_parts(spark: SparkSession, path: str, schema: str, minutes: int, **options: str) -> DataFrame:
    """Part files with pushed time filters; see `TraceParts`."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TraceParts)
    return spark.read.format("trace_parts").schema(schema).options(path=path, minutes=minutes, **options).load()


def write_part_files(df: DataFrame, path: str, name: str, part: str) -> None:
    """A Parquet file `<name>_<part>.parquet` for the rows of each value of the column `part`; a task writes a part as a whole."""
    columns = [c for c in df.columns if c != part]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        files, root = filesystem(path)
        files.create_dir(root, recursive=True)
        out, at, done = None, None, []

        def close() -> None:
            out.close()
            files.move(f"{root}/.{name}_{at}.tmp", f"{root}/{name}_{at}.parquet")  # seen when it is whole
            done.append(at)

        for batch in batches:
            values, rows = batch.column(0).to_pylist(), batch.select(columns)
            starts = [i for i, v in enumerate(values) if i == 0 or v != values[i - 1]]
            for i, j in zip(starts, [*starts[1:], len(values)], strict=True):
                if values[i] != at:
                    if out is not None:
                        close()
                    at, out = values[i], pq.ParquetWriter(files.open_output_stream(f"{root}/.{name}_{values[i]}.tmp"), rows.schema)
                out.write_batch(rows.slice(i, j - i))
        if out is not None:
            close()
        yield pa.record_batch([pa.array(done, pa.int64())], names=["part"])

    dealt = df.select(F.col(part).cast("long").alias(part), *columns).repartition(part).sortWithinPartitions(part)
    dealt.mapInArrow(work, "part long").write.format("noop").mode("overwrite").save()


def _probe(needed: list[str]):
    """For rows (path, ...): whether each file can be read to its end and has the needed columns."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name in batch.column(0).to_pylist():
                reason = None
                try:
                    files, path = filesystem(name)
                    with files.open_input_stream(path) as source:
                        first = source.read(1 << 20)
                        lacks = [c for c in needed if c not in first.split(b"\n", 1)[0].decode().rstrip("\r").split(",")]
                        reason = f"lacks {', '.join(lacks)}" if lacks else None
                        while reason is None and source.read(1 << 20):
                            pass
                except (OSError, ValueError) as e:
                    reason = f"unreadable: {type(e).__name__}"
                out.append(reason)
            yield pa.record_batch([batch.column(0), pa.array(out, pa.string())], names=["file", "reason"])

    return work


def _move(spark: SparkSession, file: str, folder: str, ending: str = "") -> None:
    """Moves a file that is still there."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    source, target = hadoop.Path(spark._jvm.java.net.URI(file)), hadoop.Path(folder)
    files = source.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(source):
        files.mkdirs(target)
        files.rename(source, hadoop.Path(f"{folder}/{source.getName()}{ending}"))


def ingest_files(spark: SparkSession, source: str, target: str, state: str, schema: T.StructType, needed: list[str], files_per_batch: int = 100) -> StreamingQuery:
    """CSV files that have arrived in `source`, each taken once: rows to target/rows, what became of each file to target/files.

    A file that can't be read to its end, or lacks a column, adds no row and stops nothing: it goes to target/bad, its name
    ended by `.bad`. Others go to target/archive. Rows that don't parse are marked `bad`. A batch is committed by its table of
    files: a run that is killed before is repeated whole and replaces its own rows, one that is killed after only moves
    files. Each file is read once to see that it is whole, and once for its rows. A file without a byte is left where it is.
    """
    full = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])

    def take(batch: DataFrame, number: int) -> None:
        at = f"{target}/files/batch={number}"
        if not exists(spark, at):
            probed = batch.select("path").repartition(min(files_per_batch, 64)).mapInArrow(_probe(needed), "file string, reason string")
            probed.write.mode("overwrite").parquet(f"{target}/_probed/batch={number}")
            seen = spark.read.schema("file string, reason string").parquet(f"{target}/_probed/batch={number}")
            good = [r.file for r in seen.where("reason is null").collect()]  # at most files_per_batch
            if good:
                rows = spark.read.schema(full).option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").csv(good)
                rows.withColumns({"file": F.col("_metadata.file_name"), "bad": F.col("_corrupt").isNotNull()}).write.mode("overwrite").parquet(f"{target}/rows/batch={number}")
            seen.write.mode("overwrite").parquet(at)
        for r in spark.read.schema("file string, reason string").parquet(at).collect():
            _move(spark, r.file, f"{target}/bad" if r.reason else f"{target}/archive", BAD if r.reason else "")

    names = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", files_per_batch).option("ignoreMissingFiles", True).load(source).select("path")
    return names.writeStream.foreachBatch(take).option("checkpointLocation", state).trigger(availableNow=True).start()
