"""Typed appends and sorted table layouts."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockscope.plans.tables import ChainTables
from blockscope.schemas import DECLARED
from blockscope.session import run_dir

#: Bytes of rows, as ``row_bytes`` counts them, that a bucket is cut for.
BUCKET_BYTES = 128 << 20


def as_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of ``schema`` in its order and types; a value that does not fit is an error."""
    return df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields])


def typed_append(df: DataFrame, schema: T.StructType, path: str) -> None:
    as_schema(df, schema).write.mode("append").parquet(path)


def sorted_layout(df: DataFrame, path: str, key: Sequence[str], spread: Sequence[str] = ()) -> None:
    """Files cut and sorted by key, so that readers skip by the key's min and max.

    ``spread`` columns follow the key in the cut, which splits a key with very many rows.
    """
    columns = [*key, *spread]
    df.repartitionByRange(*columns).sortWithinPartitions(*columns).write.mode("overwrite").parquet(path)


def write_table(df: DataFrame, root: str, name: str) -> None:
    """A landed table in its declared schema, sorted by its declared key."""
    table = DECLARED[name]
    sorted_layout(as_schema(df, table.schema), f"{root}/{name}", table.sort_key)


def alternate_layout(
    df: DataFrame, path: str, category: str, order: Sequence[str], spread: Sequence[str] = ()
) -> None:
    """A second copy with a folder per category, each sorted by ``order``.

    Cut by category and order together: a category with most of the rows is
    written by many tasks, each of which writes to few folders.
    """
    columns = [category, *order, *spread]
    (
        df.repartitionByRange(*columns)
        .sortWithinPartitions(*columns)
        .write.mode("overwrite")
        .partitionBy(category)
        .parquet(path)
    )


def bucketed(df: DataFrame, name: str, key: Sequence[str], buckets: int) -> DataFrame:
    """A copy as a table cut by a hash of ``key`` and sorted by it, a file per bucket.

    Tables with equally many buckets meet in joins and aggregates by the key without a shuffle.
    A bucket is one task's work, so keys should repeat little and ``buckets`` grow with the data, see
    ``buckets_for``.
    """
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    writer = df.repartition(buckets, *key).write.bucketBy(buckets, *key).sortBy(*key)
    writer.option("path", run_dir(spark, name)).saveAsTable(table, format="parquet")
    return spark.table(table)


def row_bytes(df: DataFrame) -> Column:
    """Bytes of a row: the lengths of its strings and binaries, and eight for every other column."""
    total = F.lit(0).cast("long")
    for f in df.schema.fields:
        text = isinstance(f.dataType, (T.StringType, T.BinaryType))
        total += F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0)) if text else F.lit(8)
    return total


def buckets_for(frames: Sequence[DataFrame], least: int) -> int:
    """As many buckets as the largest frame has ``BUCKET_BYTES``, ``least`` or more; one pass over each frame."""
    sizes = [df.agg(F.sum(row_bytes(df))).first()[0] or 0 for df in frames]
    return max(least, *(-(-size // BUCKET_BYTES) for size in sizes))


def bucketed_chain(t: ChainTables, least: int) -> ChainTables:
    """The tables of the chain root, hash, details as bucketed copies; the other ones as they are.

    Transactions and roots lie by root, so blobs are added up and get their hash without a shuffle;
    only those sums move to the details, which lie by hash.  All three have ``least`` buckets, or as
    many as the largest of them needs.
    """
    frames = {name: getattr(t, name) for name in ChainTables.__dataclass_fields__}
    keys = {"transactions": "block_root", "block_roots": "block_root", "block_details": "hash"}
    buckets = buckets_for([frames[name] for name in keys], least)
    for name, key in keys.items():
        frames[name] = bucketed(frames[name], name, [key], buckets)
    return ChainTables(**frames)
