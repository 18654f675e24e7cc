"""Which blocks are non-MEV, stored once and refreshed by what each load brings.

A builder tag is delivered once any of its blocks is, so a load can change blocks of earlier
loads: those whose tag it is the first to deliver.  They are found by the few new tags.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockscope.operators import joins
from blockscope.sources.files import remove, written_folders


def _loads(spark: SparkSession, path: str, kind: str, before: int | None = None) -> list[str]:
    """Folders of the loads of one kind that were written to their end, oldest first."""
    found = {int(name.partition("=")[2]): folder for name, folder in written_folders(spark, f"{path}/{kind}").items()}
    return [folder for number, folder in sorted(found.items()) if before is None or number < before]


def _write(df: DataFrame, path: str, kind: str, load: int) -> DataFrame:
    """The frame written as the load's folder of that kind, and read back."""
    folder = f"{path}/{kind}/load={load}"
    df.write.mode("overwrite").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def _read(like: DataFrame, folders: list[str]) -> DataFrame:
    return like.sparkSession.read.schema(like.schema).parquet(*folders) if folders else like.limit(0)


def classify_load(path: str, load: int, details: DataFrame, payloads: DataFrame, keep: int = 2) -> None:
    """Bring the classes below ``path`` up to date with new block details and new payloads.

    Loads are numbered upwards; one that is run again replaces itself.  New blocks are matched with
    all payloads, new payloads with all blocks, and of the earlier non-MEV blocks those go whose tag
    is new among the delivered ones.  Readers keep the classes they began with for ``keep`` loads.
    """
    spark = details.sparkSession
    blocks = _write(details.select("hash", "extra_data").where(F.col("extra_data").isNotNull()), path, "blocks", load)
    paid = _write(payloads.select(F.col("block_hash").alias("hash")).distinct(), path, "paid", load)
    old_blocks, old_paid = (_read(df, _loads(spark, path, kind, load)) for df, kind in ((blocks, "blocks"), (paid, "paid")))
    tags = joins.member_tags(blocks, old_paid.unionByName(paid), "hash", "extra_data").unionByName(
        joins.member_tags(old_blocks, paid, "hash", "extra_data")
    )
    old_tags = _read(tags, _loads(spark, path, "tags", load))
    new_tags = _write(joins.not_in(tags.distinct(), old_tags, ["extra_data"]), path, "tags", load)
    # the classes before this load, less what its tags change, and its own blocks
    before = _read(blocks, _loads(spark, path, "other", load)[-1:])
    kept = joins.items_left(before, new_tags, "extra_data")
    own = joins.items_left(blocks, old_tags.unionByName(new_tags), "extra_data")
    _write(kept.unionByName(own), path, "other", load)
    for folder in _loads(spark, path, "other")[:-keep]:
        remove(spark, folder)


def non_mev_kept(spark: SparkSession, path: str) -> DataFrame:
    """(hash) of the non-MEV blocks as of the last load; give it to a plan as ``ChainTables.non_mev``."""
    return spark.read.parquet(_loads(spark, path, "other")[-1]).select("hash").distinct()
