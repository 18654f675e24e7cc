"""Selecting, faceting and stacking frames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockscope.functions import scalars


def scan(
    df: DataFrame, columns: Sequence[str], where: Column | None = None, names: Sequence[str] | None = None
) -> DataFrame:
    """Column list plus predicate, optionally renamed by position."""
    rows = (df if where is None else df.where(where)).select(*columns)
    return rows if names is None else rows.toDF(*names)


def time_range(df: DataFrame, column: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows with ``start <= column < end``; an open side is not tested."""
    if start is not None:
        df = df.where(F.col(column) >= F.lit(start).cast("timestamp"))
    if end is not None:
        df = df.where(F.col(column) < F.lit(end).cast("timestamp"))
    return df


def at_most(df: DataFrame, column: str, bound: float) -> DataFrame:
    return df.where(F.col(column) <= F.lit(bound))


def facet(df: DataFrame, column: str, value: object) -> DataFrame:
    """One facet of a frame that is kept whole, with the category as a column."""
    return df.where(F.col(column) == F.lit(value))


def stack_series(series: Mapping[str, DataFrame], out: str = "series") -> DataFrame:
    """Rows of several frames under each other, labelled by their name."""
    labelled = [df.withColumn(out, F.lit(name)) for name, df in series.items()]
    return reduce(lambda a, b: a.unionByName(b), labelled)


def finite_pairs(df: DataFrame, x: str, y: str) -> DataFrame:
    """Both columns as numbers; rows where either is missing, no number or not finite are dropped."""
    numbers = df.withColumns(
        {c: scalars.to_number(F.col(c).cast("string")) for c in (x, y)}
    )
    return numbers.na.drop(subset=[x, y]).where(
        scalars.is_finite(F.col(x)) & scalars.is_finite(F.col(y))
    )
