"""Tips and builder payments against blobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockscope.functions import scalars
from blockscope.operators import joins
from blockscope.operators.quantiles import trim_quantile
from blockscope.operators.summaries import box_stats
from blockscope.plans.blobs import blobs_per
from blockscope.plans.tables import ChainTables, Settings


def miner_tip(
    t: ChainTables, s: Settings = Settings(), q: float = 0.95, hot: DataFrame | None = None
) -> DataFrame:
    """(num_blobs, miner_tip) per transaction, the largest tips trimmed.

    A transaction of an unknown block pays no base fee; one without blobs counts 0.
    """
    fees = t.block_details.select(F.col("hash").alias("block_hash"), "base_fee")
    priced = joins.skew_join(t.tx_details, fees, ["block_hash"], how="left", hot=hot)
    tips = priced.select(
        "hash",
        scalars.effective_tip(
            F.col("max_fee"), F.col("max_priority_fee"), F.col("base_fee")
        ).alias("miner_tip"),
    )
    rows = joins.left_join_fill(tips, blobs_per(t, "hash", s), ["hash"], fill={"num_blobs": 0.0})
    return trim_quantile(rows.select("num_blobs", "miner_tip"), "miner_tip", q, settle=True)


def tip_box(t: ChainTables, s: Settings = Settings(), q: float = 0.95) -> DataFrame:
    return box_stats(miner_tip(t, s, q), "num_blobs", "miner_tip")


def payment_by_blobs(t: ChainTables, s: Settings = Settings(), q: float = 0.95) -> DataFrame:
    """(num_blobs, mev_extracted): builder payment in ETH per delivered block, the largest trimmed."""
    blocks = blobs_per(t, "block_root", s).join(t.block_roots, "block_root")
    paid = t.payloads.select("block_hash", "value")
    rows = joins.skew_join(paid, blocks, ["block_hash"])
    return trim_quantile(rows.select("num_blobs", "value"), "value", q, settle=True).select(
        "num_blobs", scalars.wei_to_eth(F.col("value")).alias("mev_extracted")
    )


def payment_box(t: ChainTables, s: Settings = Settings(), q: float = 0.95) -> DataFrame:
    return box_stats(payment_by_blobs(t, s, q), "num_blobs", "mev_extracted")
