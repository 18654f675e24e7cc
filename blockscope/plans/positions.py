"""Where blob transactions sit in their block."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockscope.functions import scalars
from blockscope.operators.joins import skew_join
from blockscope.operators.summaries import histogram
from blockscope.plans.blobs import blob_transactions
from blockscope.plans.tables import ChainTables, Settings
from blockscope.session import settled


def blob_position(t: ChainTables, s: Settings = Settings()) -> DataFrame:
    return blob_transactions(t, s).select("block_root", "position")


def relative_position(t: ChainTables, s: Settings = Settings()) -> DataFrame:
    """Position over the block's last position; NULL in a block with one transaction."""
    last = t.transactions.groupBy("block_root").agg(F.max("position").alias("max_position"))
    rows = blob_transactions(t, s).select("block_root", "position")
    placed = skew_join(rows, last, ["block_root"], how="left", one_row_per_key=True)
    return placed.select(
        "block_root",
        scalars.safe_ratio(F.col("position"), F.col("max_position")).alias("rel_position"),
    )


def relative_position_histogram(t: ChainTables, s: Settings = Settings(), bins: int = 50) -> DataFrame:
    return histogram(settled(relative_position(t, s).select("rel_position")), "rel_position", bins)


def blob_position_histogram(t: ChainTables, s: Settings = Settings(), bins: int = 50) -> DataFrame:
    return histogram(blob_position(t, s), "position", bins)
