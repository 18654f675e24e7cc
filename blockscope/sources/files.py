"""Folders of the shared store, reached as Spark reaches them."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    files, place = _at(spark, path)
    return files.exists(place)


def written_folders(spark: SparkSession, path: str) -> dict[str, str]:
    """Name and path of the folders below ``path`` that a job has written to its end."""
    files, place = _at(spark, path)
    if not files.exists(place):
        return {}
    folders = [status.getPath() for status in files.listStatus(place)]
    return {f.getName(): f.toString() for f in folders if files.exists(f.suffix("/_SUCCESS"))}


def remove(spark: SparkSession, path: str) -> None:
    files, place = _at(spark, path)
    files.delete(place, True)
