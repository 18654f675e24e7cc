"""Daily Parquet files: ranged load, full refresh, load manifest.

``load_new`` and ``refresh`` can be repeated and cut short at any point.  Both write to a folder of
their own first and name it last, in one small file, so readers see all of a load or nothing.
One load or refresh runs at a time.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockscope.functions.scalars import days_between
from blockscope.sources.files import exists, remove, written_folders

DAY_FILE = "{root}/{year}/{month}/{day}.parquet"


def day_paths(root: str, start: str, end: str, template: str = DAY_FILE) -> list[str]:
    """One path per day from start to end, both included."""
    return [
        template.format(root=root, year=d.year, month=d.month, day=d.day, date=d.isoformat())
        for d in days_between(start, end)
    ]


def load_day_range(
    spark: SparkSession, root: str, start: str, end: str, template: str = DAY_FILE
) -> DataFrame:
    """All rows of the days' files, read as one frame."""
    return spark.read.parquet(*day_paths(root, start, end, template))


def load_manifest(loaded: DataFrame) -> DataFrame:
    """(file, rows) of a frame just read from files."""
    return loaded.groupBy(F.col("_metadata.file_path").alias("file")).agg(
        F.count(F.lit(1)).alias("rows")
    )


def log_load(loaded: DataFrame, table: str, log: str) -> DataFrame:
    """Append (table, file, rows) of a load to the Parquet log at ``log``; returns the whole log."""
    lines = load_manifest(loaded).select(F.lit(table).alias("table"), "file", "rows")
    lines.write.mode("append").parquet(log)
    return loaded.sparkSession.read.schema(lines.schema).parquet(log)


def full_refresh(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Replace what ``path`` holds; with ``by``, only the partitions that ``df`` brings."""
    writer = df.write.mode("overwrite")
    if by:
        writer = writer.partitionBy(*by).option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


# --- loads that can be repeated ----------------------------------------------------------------
_LOG = "load long, source string, file string, size long, changed timestamp, rows long"


def _bare(path: Column) -> Column:
    """A path without its scheme, which a listing and a reader may write differently."""
    return F.regexp_replace(path, "^[a-zA-Z0-9]+:/+", "/")


def _source(file: Column, paths: list[str]) -> Column:
    """The path among ``paths`` that brings a file: itself, or else its folder."""
    asked = [re.sub("^[a-zA-Z0-9]+:/+", "/", p.rstrip("/")) for p in paths]
    return F.when(file.isin(asked), file).otherwise(F.regexp_extract(file, "^(.*)/[^/]*$", 1))


def load_log(spark: SparkSession, root: str) -> DataFrame:
    """(load, source, file, size, changed, rows): a line per file of each load that came to its end."""
    if not exists(spark, f"{root}/log"):
        return spark.createDataFrame([], _LOG)
    return spark.read.schema(_LOG).parquet(f"{root}/log")


def new_files(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    """(source, file, size, changed) of the sources that hold a file no load has brought as it is now.

    A source is one of ``paths``, a file or a folder of files.  Contents are not read.
    """
    listed = spark.read.format("binaryFile").load(paths).select(
        _bare(F.col("path")).alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("changed")
    )
    listed = listed.select(_source(F.col("file"), paths).alias("source"), "file", "size", "changed")
    known = load_log(spark, root).select("file", "size", "changed")
    new = listed.join(known, ["file", "size", "changed"], "left_anti").select("source").distinct()
    return listed.join(new, "source", "left_semi")


def load_new(spark: SparkSession, root: str, paths: list[str]) -> int:
    """Load the sources among ``paths`` that the log of ``root`` does not know as they are; how many files.

    Rows go to ``rows/load=<number>``, then the log gets its lines.  A load that was cut short left no
    line: the next one takes its number and overwrites what it wrote.  A source delivered anew, with a file
    of another name, size or time, is loaded again and takes the place of its earlier rows (``loaded``).
    """
    files = new_files(spark, root, paths).collect()  # a line per new file, as the reader needs them
    if not files:
        return 0
    number = (load_log(spark, root).agg(F.max("load")).first()[0] or 0) + 1
    folder = f"{root}/rows/load={number}"
    file = _bare(F.col("_metadata.file_path"))
    read = spark.read.parquet(*[r.file for r in files]).withColumn("source_file", file)
    read = read.withColumn("source", _source(F.col("source_file"), paths))
    read.write.mode("overwrite").parquet(folder)
    counts = spark.read.parquet(folder).groupBy(F.col("source_file").alias("file")).agg(F.count(F.lit(1)).alias("rows"))
    listed = spark.createDataFrame([(number, *r) for r in files], _LOG.rpartition(",")[0])
    lines = listed.join(counts, "file", "left").fillna(0, ["rows"])
    lines = lines.select("load", "source", "file", "size", "changed", "rows")
    lines.coalesce(1).write.mode("append").parquet(f"{root}/log")  # one file: all lines or none
    return len(files)


def loaded(spark: SparkSession, root: str) -> DataFrame:
    """All rows of finished loads; of a source that was loaded again those of its last load."""
    live = load_log(spark, root).groupBy("source").agg(F.max("load").alias("load"))
    rows = spark.read.option("basePath", f"{root}/rows").parquet(f"{root}/rows")
    return rows.join(live, ["load", "source"], "left_semi").drop("load", "source", "source_file")


# --- refreshes under readers -------------------------------------------------------------------
def _versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the versions that were named, ascending."""
    if not exists(spark, f"{root}/current"):
        return []
    return sorted(r.version for r in spark.read.schema("version long").parquet(f"{root}/current").collect())


def refresh(df: DataFrame, root: str, keep: int = 2) -> int:
    """Write ``df`` as the next version below ``root``, name it the current one, and return its number.

    Readers of ``current`` keep the version they began with.  The last ``keep`` versions stay, others
    and what a refresh cut short left behind are removed.
    """
    spark = df.sparkSession
    number = max(_versions(spark, root), default=0) + 1
    df.write.mode("overwrite").parquet(f"{root}/version={number}")
    named = spark.createDataFrame([(number,)], "version long").coalesce(1)
    named.write.mode("append").parquet(f"{root}/current")
    for name, folder in written_folders(spark, root).items():
        kind, _, version = name.partition("=")
        if kind == "version" and not number - keep < int(version) <= number:
            remove(spark, folder)
    return number


def current(spark: SparkSession, root: str) -> DataFrame:
    """The rows of the version named last."""
    versions = _versions(spark, root)
    if not versions:
        raise ValueError(f"nothing was written to {root}")
    return spark.read.parquet(f"{root}/version={versions[-1]}")
