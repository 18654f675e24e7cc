"""What several operators share: tables, stored frames, rows kept by id."""

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockscope.session import prepare_session, shared_dir

#: Ids broadcast at most when rows are kept by id: 8 MB of longs.
MOST_IDS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare_session(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(text: str) -> Column:
    """A text column as UTF-8 bytes, which Python workers get without decoding."""
    return F.col(text).cast("binary")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame written as Parquet below the shared folder and read again.

    Computed once whatever reads it, and safe against lost executors.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _few(ids: DataFrame) -> DataFrame:
    """The ids, marked for broadcast if they are counted and no more than ``MOST_IDS``."""
    return F.broadcast(ids) if ids.limit(MOST_IDS + 1).count() <= MOST_IDS else ids


def without_ids(df: DataFrame, id_col: str, dropped: DataFrame) -> DataFrame:
    """Rows whose id is not among ``dropped`` (one column of that name); rows with a null id stay.

    Few ids are broadcast, so that the rows do not move; more are met by a shuffled join.
    """
    return df.join(_few(dropped.where(F.col(id_col).isNotNull()).distinct()), id_col, "left_anti")


def with_ids(df: DataFrame, id_col: str, wanted: DataFrame) -> DataFrame:
    """Rows whose id is among ``wanted``; a null id is in no list."""
    return df.join(_few(wanted.where(F.col(id_col).isNotNull()).distinct()), id_col, "left_semi")
