"""Which keys to fetch, and which are left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockscope.functions.scalars import int_to_hex


def work_list(df: DataFrame, key: str, where: Column | None = None) -> DataFrame:
    """Distinct keys of the rows that pass the predicate."""
    return (df if where is None else df.where(where)).select(key).distinct()


def number_work_list(spark: SparkSession, start: int, end: int) -> DataFrame:
    """(number, parameter) for start <= number < end, the parameter in hex text."""
    return spark.range(start, end).select(
        F.col("id").alias("number"), int_to_hex(F.col("id")).alias("parameter")
    )


def remaining(work: DataFrame, landed: DataFrame, key: str) -> DataFrame:
    """Keys not landed yet."""
    return work.join(landed.select(key), key, "left_anti")


def low_water_mark(df: DataFrame, column: str) -> DataFrame:
    """One row: the number before the lowest one seen, where a downward walk goes on."""
    return df.agg((F.min(column) - 1).alias(column))
