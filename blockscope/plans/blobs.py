"""Blob counts per block and transaction, and what they do to gas use, block size and fill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockscope.functions import scalars
from blockscope.operators import joins
from blockscope.operators.quantiles import grouped_quantiles, trim_quantile
from blockscope.operators.summaries import box_stats
from blockscope.plans.tables import ChainTables, Settings
from blockscope.session import settled


def blob_transactions(t: ChainTables, s: Settings = Settings()) -> DataFrame:
    return t.transactions.where(F.col("type") == s.blob_type)


def _blob_sum() -> Column:
    return F.sum(scalars.blobs(F.col("blob_gas"))).alias("num_blobs")


def _last_position() -> Column:
    """Position of the block's last blob transaction plus one, not its transaction count."""
    return (F.max("position") + 1).cast("int").alias("num_of_txns")


def blobs_per(t: ChainTables, key: str, s: Settings = Settings()) -> DataFrame:
    """(key, num_blobs) for blocks, slots or transactions that carry blobs."""
    return blob_transactions(t, s).groupBy(key).agg(_blob_sum())


def transactions_by_blobs(t: ChainTables, s: Settings = Settings(), key: str = "block_root") -> DataFrame:
    return blob_transactions(t, s).groupBy(key).agg(_last_position(), _blob_sum())


def trimmed_transactions_by_blobs(t: ChainTables, s: Settings = Settings(), q: float = 0.99) -> DataFrame:
    return trim_quantile(transactions_by_blobs(t, s), "num_of_txns", q, settle=True)


def block_transaction_stats(t: ChainTables, s: Settings = Settings(), q: float = 0.99) -> DataFrame:
    """Total size, last position and blobs per block, the busiest blocks trimmed."""
    stats = blob_transactions(t, s).groupBy("block_root").agg(
        F.sum("size").alias("total_txn_size"), _last_position(), _blob_sum()
    )
    return trim_quantile(stats, "num_of_txns", q, settle=True)


def non_mev_blocks(t: ChainTables, hot: DataFrame | None = None) -> DataFrame:
    """Hashes of blocks whose builder tag never occurs on a relay-delivered block."""
    if t.non_mev is not None:
        return t.non_mev
    delivered = t.payloads.select(F.col("block_hash").alias("hash"))
    tags = joins.member_tags(t.block_details, delivered, "hash", "extra_data")
    return joins.items_without_tags(t.block_details, tags, "hash", "extra_data", hot)


def gas_rows(t: ChainTables, s: Settings = Settings(), mev: bool | None = None) -> DataFrame:
    """(num_blobs, gas_used) per block; ``mev`` keeps only MEV or only non-MEV blocks.

    MEV is the complement of ``non_mev_blocks``.
    """
    blocks = blobs_per(t, "block_root", s).join(t.block_roots, "block_root")
    if mev is not None:
        other = non_mev_blocks(t).withColumnRenamed("hash", "block_hash")
        pick = joins.not_in if mev else joins.only_in
        blocks = pick(blocks, other, ["block_hash"])
    gas = t.block_details.select(F.col("hash").alias("block_hash"), "gas_used")
    return blocks.join(gas, "block_hash").select("num_blobs", "gas_used")


def gas_summary(
    t: ChainTables, s: Settings = Settings(), mev: bool | None = None, statistic: str = "mean"
) -> DataFrame:
    """Mean or median gas used per blob count."""
    rows = gas_rows(t, s, mev)
    if statistic == "mean":
        return rows.groupBy("num_blobs").agg(F.avg("gas_used").alias("gas_used"))
    if statistic == "median":
        return grouped_quantiles(rows, ["num_blobs"], "gas_used", {"gas_used": 0.5})
    raise ValueError(f"unknown statistic {statistic}")


def gas_box(t: ChainTables, s: Settings = Settings(), mev: bool | None = None) -> DataFrame:
    """Box summary of gas used per number of blobs."""
    return box_stats(gas_rows(t, s, mev), "num_blobs", "gas_used")


def size_box(t: ChainTables, s: Settings = Settings(), q: float = 0.99) -> DataFrame:
    return box_stats(size_by_blobs(t, s, q), "num_blobs", "size")


def gas_series(t: ChainTables, s: Settings = Settings()) -> DataFrame:
    """The three gas series under one label column: mean, mean, median.

    Blocks are told MEV or not once, for all series.
    """
    other = non_mev_blocks(t).select(F.col("hash").alias("block_hash"), F.lit(False).alias("mev"))
    gas = t.block_details.select(F.col("hash").alias("block_hash"), "gas_used")
    blocks = blobs_per(t, "block_root", s).join(t.block_roots, "block_root").join(gas, "block_hash")
    marked = settled(
        joins.left_join_fill(blocks, other, ["block_hash"], fill={"mev": True}).select(
            "num_blobs", "gas_used", "mev"
        )
    )

    other = F.when(~F.col("mev"), F.col("gas_used"))
    means = marked.groupBy("num_blobs").agg(
        F.avg("gas_used").alias("all"),
        F.avg(other).alias("other"),
        F.count_if(~F.col("mev")).alias("others"),
    )
    def entry(series: str, value: str, there: Column) -> Column:
        return F.struct(F.lit(series).alias("series"), F.col(value).alias("gas_used"), there.alias("there"))

    both = F.array(entry("All", "all", F.lit(True)), entry("Non-MEV", "other", F.col("others") > 0))
    means = means.select("num_blobs", F.inline(both)).where("there")
    medians = grouped_quantiles(marked.where("mev"), ["num_blobs"], "gas_used", {"gas_used": 0.5})
    return means.select("num_blobs", "gas_used", "series").unionByName(
        medians.withColumn("series", F.lit("MEV"))
    )


def size_by_blobs(t: ChainTables, s: Settings = Settings(), q: float = 0.99) -> DataFrame:
    """(num_blobs, size) per block, largest blocks trimmed; a block without details has size 0."""
    sizes = t.block_details.select(F.col("hash").alias("block_hash"), "size")
    hashed = joins.left_join_fill(blobs_per(t, "block_root", s), t.block_roots, ["block_root"])
    rows = joins.left_join_fill(hashed, sizes, ["block_hash"], fill={"size": 0}, null_keys=True)
    return trim_quantile(rows.select("num_blobs", "size"), "size", q, settle=True)


def _of_sender(df: DataFrame, address: str | None) -> DataFrame:
    if address is None:
        return df
    return df.where(scalars.normal_address(F.col("to_addr")) == address.lower())


def _per_sender(df: DataFrame, senders: DataFrame | None) -> tuple[DataFrame, list[str]]:
    if senders is None:
        return df, []
    return with_sender_label(df, senders), ["label"]


def with_sender_label(df: DataFrame, senders: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """Rows sent to a listed address, with ``address`` and ``label``.

    One join for all senders; a sender with a large share of the rows stays where it is.
    """
    addressed = df.withColumn("address", scalars.normal_address(F.col("to_addr")))
    book = senders.select(scalars.normal_address(F.col("address")).alias("address"), "label")
    return joins.skew_join(addressed, book, ["address"], hot=hot)


def half_empty_blobs(
    t: ChainTables,
    s: Settings = Settings(),
    address: str | None = None,
    senders: DataFrame | None = None,
) -> DataFrame:
    """Blobs per block and how many of its blob transactions are more than half empty.

    ``address`` keeps one sender, ``senders`` gives every listed sender its own rows.
    """
    rows, keys = _per_sender(_of_sender(blob_transactions(t, s), address), senders)
    half = scalars.over_half(F.col("empty_size"), F.col("full_size"))
    return rows.groupBy(*keys, "block_root").agg(
        _blob_sum(), F.sum(F.when(half, 1).otherwise(0)).alias("num_half_empty")
    )


def empty_ratio_by_blobs(
    t: ChainTables,
    s: Settings = Settings(),
    address: str | None = None,
    senders: DataFrame | None = None,
) -> DataFrame:
    """Blobs per block and empty share; transactions without sidecar bytes form one NULL group."""
    rows, keys = _per_sender(_of_sender(blob_transactions(t, s), address), senders)
    ratio = scalars.safe_ratio(F.col("empty_size"), F.col("full_size")).alias("empty_ratio")
    return rows.groupBy(*keys, "block_root", ratio).agg(_blob_sum())
