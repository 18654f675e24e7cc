"""Reads stored tables under their short column names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockscope.functions.scalars import bytes_to_text
from blockscope.plans.tables import ChainTables
from blockscope.schemas import TABLES
from blockscope.session import prepare_session


def short_columns(df: DataFrame, name: str) -> DataFrame:
    """A stored table's columns in their short form; fixed-width byte columns become text."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    picked = []
    for short, stored in TABLES[name].columns.items():
        column = F.col(f"`{stored}`")
        if isinstance(kinds[stored], T.BinaryType):
            column = bytes_to_text(column)
        picked.append(column.alias(short))
    return df.select(*picked)


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return short_columns(spark.read.parquet(f"{root}/{TABLES[name].stored}"), name)


def read_chain_tables(spark: SparkSession, root: str) -> ChainTables:
    """All tables of an analysis from one folder with a Parquet folder per stored table."""
    prepare_session(spark)
    return ChainTables(**{name: read_table(spark, root, name) for name in TABLES})
