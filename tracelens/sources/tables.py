"""Written tables: windows by split, caches keyed by what they were made from, result files."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_windows(windows: DataFrame, path: str) -> None:
    """One folder per split; only the splits in `windows` are replaced, each as a whole."""
    windows.write.partitionBy("split").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def read_windows(spark: SparkSession, path: str, split: str) -> DataFrame:
    """The windows of one split: the others' files aren't opened."""
    return spark.read.parquet(path).where(F.col("split") == split)


def write_window_groups(windows: DataFrame, path: str, groups: int, again: tuple[int, ...] = ()) -> list[int]:
    """Windows in a folder for each split and group of services, a service's group by its hash; which groups were written.

    A group is written once: when its splits are there its marker follows, and a later call leaves it alone, unless `again`
    names it. Then its folders are replaced, those of splits that have no rows any more are deleted, and no other group's
    files are touched. A group without its marker, from a run that was killed, is written anew.
    """
    spark = windows.sparkSession
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    files = path_of(path).getFileSystem(spark._jsc.hadoopConfiguration())
    todo = [g for g in range(groups) if g in again or not files.exists(path_of(f"{path}/_done/{g}"))]
    if not todo:
        return []
    for g in todo:
        files.delete(path_of(f"{path}/_done/{g}"), False)
    rows = windows.withColumn("grp", F.pmod(F.xxhash64("msname"), F.lit(groups)).cast("int")).where(F.col("grp").isin(todo))
    rows.write.partitionBy("split", "grp").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    there = {(r.split, r.grp) for r in rows.select("split", "grp").distinct().collect()}  # splits times groups at most
    for split in files.listStatus(path_of(path)):
        name = split.getPath().getName()
        for g in todo:
            if name.startswith("split=") and (name.removeprefix("split="), g) not in there:
                files.delete(path_of(f"{path}/{name}/grp={g}"), True)
    for g in todo:
        files.create(path_of(f"{path}/_done/{g}"), True).close()
    return todo


def file_stamps(df: DataFrame) -> list[tuple[str, int, int]]:
    """(name, size, time of change) of the files behind df, from the file system; each folder is listed once."""
    spark = df.sparkSession
    path = lambda name: spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(name))  # noqa: E731  names are encoded
    names, folders = sorted(df.inputFiles()), {}
    for name in names:
        parent = path(name).getParent()
        if parent.toString() not in folders:
            listed = parent.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(parent)
            folders[parent.toString()] = {f.getPath().getName(): (f.getLen(), f.getModificationTime()) for f in listed}
    return [(n, *folders[path(n).getParent().toString()].get(path(n).getName(), (-1, -1))) for n in names]


def fingerprint(df: DataFrame, parameters: dict) -> str:
    """A key of the parameters and of the input's files with their sizes and times: a file rewritten under its name is another input."""
    text = json.dumps({"parameters": parameters, "files": file_stamps(df)}, sort_keys=True, default=str)
    return hashlib.md5(text.encode()).hexdigest()


def exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark's own file system has a finished table there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def cached(spark: SparkSession, folder: str, name: str, source: DataFrame, parameters: dict, make: Callable[[], DataFrame], refresh: bool = False, disabled: bool = False) -> DataFrame:
    """A table under folder/name/<fingerprint>: read if it is there, else made and written; not looked at if `disabled`."""
    if disabled:
        return make()
    path = f"{folder}/{name}/{fingerprint(source, parameters)}"
    if refresh or not exists(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def clear_cache(spark: SparkSession, folder: str, name: str | None = None) -> bool:
    """Deletes a cache's tables of one name, or all; whether there were any."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}" if name else folder)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def distinct_services(spark: SparkSession, folder: str, source: DataFrame, column: str = "msname") -> DataFrame:
    """The sorted distinct values of a column, kept for as long as the source's files stay the same."""
    return cached(spark, folder, f"distinct-{column}", source, {"column": column}, lambda: source.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column))


def read_series(cache: DataFrame, features: list[str], replicas: DataFrame | None = None) -> DataFrame:
    """A cached series with only these features, and each service's base replicas: its first count, 1 at least."""
    missing = [f for f in features if f not in cache.columns]
    if missing:
        raise ValueError(f"the cache has no {missing}")
    rows = cache.select("msname", "t", "pos", *features)
    if replicas is None:
        return rows.withColumn("base_replicas", F.lit(1))
    first = replicas.groupBy("msname").agg(F.greatest(F.lit(1), F.min_by("replicas", "pos")).alias("base_replicas"))
    return rows.join(first, "msname", "left").withColumn("base_replicas", F.coalesce("base_replicas", F.lit(1)))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).mode("overwrite").csv(path)


def write_one_csv(df: DataFrame, path: str) -> None:
    """One CSV file of that name, for results small enough for one task; written beside it first, then renamed."""
    write_csv(df.coalesce(1), f"{path}.parts")
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    folder, target = hadoop.Path(f"{path}.parts"), hadoop.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    part = next(f.getPath() for f in files.listStatus(folder) if f.getPath().getName().startswith("part-"))
    files.rename(part, target)
    files.delete(folder, True)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
