"""Sources and sinks on files that the tests write."""

from __future__ import annotations


import gzip
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelens.sources import files, tables, traces


def test_a_rewritten_file_makes_caches_anew(spark, tmp_path):
    source, folder = f"{tmp_path}/source with blank", f"{tmp_path}/cache"
    write = lambda names: spark.createDataFrame([(n, i) for i, n in enumerate(names)], "msname string, v long").coalesce(1).write.mode("overwrite").parquet(source)
    read = lambda: spark.read.parquet(source)
    write("ab")
    assert [r.msname for r in tables.distinct_services(spark, folder, read()).collect()] == ["a", "b"]
    made = []

    def make():
        made.append(1)
        return read().groupBy("msname").count()

    for _ in range(2):
        assert tables.cached(spark, folder, "counts", read(), {"p": 1}, make).count() == 2
    assert len(made) == 1
    name = next(f for f in (tmp_path / "source with blank").iterdir() if f.suffix == ".parquet")
    write("xyz")
    next(f for f in (tmp_path / "source with blank").iterdir() if f.suffix == ".parquet").rename(name)  # the same name as before
    spark.catalog.refreshByPath(source)
    assert [r.msname for r in tables.distinct_services(spark, folder, read()).collect()] == ["x", "y", "z"]
    assert tables.cached(spark, folder, "counts", read(), {"p": 1}, make).count() == 3 and len(made) == 2
    assert tables.fingerprint(read(), {"p": 1}) != tables.fingerprint(read(), {"p": 2})
    assert tables.clear_cache(spark, folder) and not tables.clear_cache(spark, folder)


def _parts(spark, folder, n=10, rows=100):
    df = spark.range(n * rows).select((F.col("id") * 60_000 * 30 / rows).cast("long").alias("timestamp"), F.concat(F.lit("s"), F.col("id") % 3).alias("msname"), (F.col("id") % 10 / 10).alias("cpu"), F.expr(f"id div {rows}").alias("part"))
    files.write_part_files(df, folder, "MSResource", "part")


def test_files_outside_the_times_asked_for_are_never_opened(spark, tmp_path):
    folder = f"{tmp_path}/parts"
    _parts(spark, folder)
    assert sorted(os.listdir(folder)) == sorted(f"MSResource_{i}.parquet" for i in range(10))
    half = 30 * 60_000
    whole = files.read_parts(spark, folder, "timestamp long, cpu double", 30)
    assert whole.count() == 1000 and whole.columns == ["timestamp", "cpu"]
    for i in (0, 1, 2, 6, 7, 8, 9):  # any attempt to open these fails
        with open(f"{folder}/MSResource_{i}.parquet", "wb") as out:
            out.write(b"broken")
    with pytest.raises(Exception, match="parquet|Parquet"):
        whole.count()
    t = F.col("timestamp")
    for some, n in (((t >= 3 * half) & (t < 6 * half), 300), ((t > 3 * half) & (t <= 5 * half), 200), (t == 4 * half, 1), ((t >= 4 * half) & (t < 4 * half), 0), ((t >= 3 * half) & (t < 6 * half) & (F.col("cpu") > 0.85), 30)):
        assert whole.where(some).count() == n
    named = files.read_parts(spark, folder, "timestamp long", 30, start="0d2", end="0d3")
    assert named.agg(F.min("timestamp"), F.max("timestamp"), F.count("timestamp")).first()[2] == 200
    later = files.read_parts(spark, folder, "timestamp long", 30, start="1d0", end="2d0")
    assert later.count() == 0


def test_parts_of_each_format_are_read_alike(spark, tmp_path):
    folder = tmp_path / "parts"
    folder.mkdir()
    text = "msname,timestamp,cpu\na,5,0.25\nb,6,\n"
    (folder / "T_0.csv").write_text(text)
    with gzip.open(folder / "T_1.csv.gz", "wt") as out:
        out.write(text)
    (folder / "other.txt").write_text("no part")
    rows = files.read_parts(spark, str(folder), "timestamp long, cpu double", 30)
    assert sorted(map(tuple, rows.collect()), key=str) == sorted([(5, 0.25), (6, None)] * 2, key=str)


SCHEMA = T.StructType([T.StructField("timestamp", T.LongType()), T.StructField("msname", T.StringType()), T.StructField("cpu", T.DoubleType())])


def _ingest(spark, tmp_path):
    files.ingest_files(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state", SCHEMA, SCHEMA.names, files_per_batch=2).awaitTermination()
    rows = spark.read.parquet(f"{tmp_path}/out/rows")
    return sorted((r.timestamp, r.file.split(".")[0]) for r in rows.where("not bad").collect())


def test_a_bad_file_stops_nothing_and_each_file_is_taken_once(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    put = lambda name, *times: (tmp_path / "in" / f"{name}.csv").write_text("timestamp,msname,cpu\n" + "".join(f"{t},a,0.5\n" for t in times))
    put("one", 1, 2)
    put("two", 3)
    (tmp_path / "in" / "broken.csv.gz").write_bytes(gzip.compress(os.urandom(3_000_000))[:2_000_000])
    (tmp_path / "in" / "lacking.csv").write_text("timestamp,msname\n9,a\n")
    (tmp_path / "in" / "empty.csv").write_text("")
    want = [(1, "one"), (2, "one"), (3, "two")]
    assert _ingest(spark, tmp_path) == want and _ingest(spark, tmp_path) == want
    assert sorted(f for f in os.listdir(tmp_path / "out" / "bad") if not f.startswith(".")) == ["broken.csv.gz.bad", "lacking.csv.bad"]
    assert sorted(f for f in os.listdir(tmp_path / "out" / "archive") if not f.startswith(".")) == ["one.csv", "two.csv"]
    assert [f for f in os.listdir(tmp_path / "in") if not f.startswith(".")] == ["empty.csv"]
    put("three", 4)
    moved = files._move
    with monkeypatch.context() as m:  # killed when the batch is committed but its files aren't moved

        def killed(*_):
            raise RuntimeError("killed")

        m.setattr(files, "_move", killed)
        with pytest.raises(Exception, match="killed"):
            _ingest(spark, tmp_path)
    assert _ingest(spark, tmp_path) == [*want, (4, "three")] and os.listdir(tmp_path / "out" / "archive").count("three.csv") == 1
    put("four", 5, 6)
    real = files.exists
    with monkeypatch.context() as m:  # killed between the rows and the commit: the batch is repeated whole
        m.setattr(files, "exists", lambda spark, path: real(spark, path))

        def half_way(self, path, **options):
            if "/files/batch=" in path:
                raise RuntimeError("killed")
            return write(self, path, **options)

        from pyspark.sql import DataFrameWriter

        write = DataFrameWriter.parquet
        m.setattr(DataFrameWriter, "parquet", half_way)
        with pytest.raises(Exception, match="killed"):
            _ingest(spark, tmp_path)
    assert files._move is moved
    assert _ingest(spark, tmp_path) == [*want, (4, "three"), (5, "four"), (6, "four")]


def test_a_group_written_again_leaves_the_others_alone(spark, tmp_path):
    path = f"{tmp_path}/windows"
    rows = spark.range(400).select(F.concat(F.lit("s"), F.col("id") % 20).alias("msname"), F.when(F.col("id") % 4 == 0, "test").otherwise("train").alias("split"), F.col("id").alias("win_start"))
    stamps = lambda: {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}
    assert tables.write_window_groups(rows, path, 4) == [0, 1, 2, 3]
    before = stamps()
    assert tables.write_window_groups(rows, path, 4) == [] and stamps() == before
    only_train = rows.where("split = 'train'")
    assert tables.write_window_groups(only_train, path, 4, again=(2,)) == [2]
    after = stamps()
    assert {f: t for f, t in before.items() if "/grp=2/" not in f} == {f: t for f, t in after.items() if "/grp=2/" not in f}
    assert not any("split=test/grp=2/" in f for f in after) and any("split=train/grp=2/" in f for f in after)
    os.remove(f"{path}/_done/1")  # a run that was killed before its marker
    assert tables.write_window_groups(rows, path, 4) == [1]
    got = spark.read.parquet(path)
    want = rows.withColumn("grp", F.pmod(F.xxhash64("msname"), F.lit(4)).cast("int")).where("not (grp = 2 and split = 'test')")
    assert sorted(map(tuple, got.select("msname", "split", "win_start", "grp").collect())) == sorted(map(tuple, want.select("msname", "split", "win_start", "grp").collect()))


def test_headers_of_many_files_take_one_job(spark, tmp_path):
    folder = tmp_path / "csv"
    folder.mkdir()
    for i in range(120):
        (folder / f"f{i}.csv").write_text('timestamp,"ms,name",cpu\r\n1,a,2\n' if i % 2 else "timestamp,msname\n")
    found = traces.headers(spark, f"{folder}/*.csv")
    assert len(found) == 120 and {tuple(c) for c in found.values()} == {("timestamp", "ms,name", "cpu"), ("timestamp", "msname")}
