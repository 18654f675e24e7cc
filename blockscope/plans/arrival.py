"""How long a block and its blobs take to reach the observing clients.

The observation tables are the largest.  Each is reduced to one row per (item,
client) first; the joins then see unique keys, partitioned as the aggregates left them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockscope.functions import scalars
from blockscope.operators import joins
from blockscope.operators.quantiles import grouped_median, grouped_quantiles, trim_quantile
from blockscope.operators.shaping import at_most, stack_series, time_range
from blockscope.operators.summaries import (
    binned_median,
    box_stats,
    histogram,
    histogram_by,
    kde_grid,
    regression_line,
)
from blockscope.plans.blobs import blobs_per, non_mev_blocks, transactions_by_blobs
from blockscope.plans.tables import ChainTables, Settings
from blockscope.session import settled


def _latest(out: str) -> Column:
    return scalars.seconds(F.max("diff_ms")).alias(out)


def client_arrival(
    sidecars: DataFrame, keys: list[str], bound_ms: float | None, impl: str | None = None
) -> DataFrame:
    """When a client had the last blob of an item, and how many blobs it saw by then."""
    seen = sidecars if bound_ms is None else at_most(sidecars, "diff_ms", bound_ms)
    if impl is not None:
        seen = seen.where(F.col("impl") == impl)
    return seen.groupBy(*keys).agg(
        _latest("blob_prop_time"), (F.max("blob_index") + 1).alias("num_of_blobs")
    )


def block_arrival(
    events: DataFrame, keys: list[str], since: str, bound_ms: float | None, impl: str | None = None
) -> DataFrame:
    """When a client had the block itself, for blocks since the fork."""
    seen = time_range(events, "slot_start", start=since)
    if bound_ms is not None:
        seen = at_most(seen, "diff_ms", bound_ms)
    if impl is not None:
        seen = seen.where(F.col("impl") == impl)
    return seen.groupBy(*keys).agg(_latest("block_prop_time"))


def _last_part() -> Column:
    """The later of block and last blob; a side the client never saw does not count."""
    return F.greatest("blob_prop_time", "block_prop_time")


def _block_side(t: ChainTables, s: Settings, impl: str | None = None, by_impl: bool = False) -> DataFrame:
    keys = ["block", "client"] + (["impl"] if by_impl else [])
    arrived = block_arrival(t.block_events, keys, s.fork, s.arrival_ms, impl)
    return arrived.withColumnRenamed("block", "block_root").drop("impl")


def _pairs(t: ChainTables, s: Settings) -> DataFrame:
    """(block, client) of one implementation where both the block and blobs arrived."""
    blobs = client_arrival(t.sidecars, ["block_root", "client"], s.arrival_ms, s.impl)
    return blobs.join(_block_side(t, s, s.impl), ["block_root", "client"])


def arrival_series(t: ChainTables, s: Settings = Settings()) -> DataFrame:
    """``arrival_by_blobs`` for all, MEV and non-MEV blocks under one label column, told apart once."""
    other = non_mev_blocks(t).select(F.col("hash").alias("block_hash"), F.lit(False).alias("mev"))
    hashed = joins.left_join_fill(_pairs(t, s), t.block_roots, ["block_root"])
    marked = settled(
        joins.left_join_fill(hashed, other, ["block_hash"], fill={"mev": True}, null_keys=True).select(
            F.col("num_of_blobs").alias("num_blobs"), _last_part().alias("seconds"), "mev"
        )
    )
    kept = {"All": marked, "MEV": marked.where("mev"), "Non-MEV": marked.where(~F.col("mev"))}
    return stack_series(
        {
            name: rows.groupBy("num_blobs").agg(F.avg("seconds").alias("propagation_sec"))
            for name, rows in kept.items()
        }
    )


def arrival_by_blobs(t: ChainTables, s: Settings = Settings(), mev: bool | None = None) -> DataFrame:
    """Mean seconds until block and blobs are there, per number of blobs, for one implementation.

    A block without a known hash cannot be told non-MEV, so it stays in under ``mev=True``.
    """
    pairs = _pairs(t, s)
    if mev is not None:
        other = non_mev_blocks(t).withColumnRenamed("hash", "block_hash")
        hashed = joins.left_join_fill(pairs, t.block_roots, ["block_root"])
        pairs = (joins.not_in if mev else joins.only_in)(hashed, other, ["block_hash"])
    return (
        pairs.groupBy(F.col("num_of_blobs").alias("num_blobs"))
        .agg(F.avg(_last_part()).alias("propagation_sec"))
        .orderBy("num_blobs")
    )


def arrival_by_blobs_all_blocks(t: ChainTables, s: Settings = Settings()) -> DataFrame:
    """As above over all implementations, with blocks seen without blobs counted under 0."""
    blobs = client_arrival(t.sidecars, ["block_root", "client"], s.arrival_ms)
    pairs = _block_side(t, s).join(blobs, ["block_root", "client"], "left")
    return (
        pairs.groupBy(F.coalesce("num_of_blobs", F.lit(0)).alias("num_blobs"))
        .agg(F.avg(_last_part()).alias("propagation_sec"))
        .orderBy("num_blobs")
    )


def mean_arrival(
    t: ChainTables, s: Settings = Settings(), key: str = "block_root", bound_ms: float | None = None
) -> DataFrame:
    """(key, propagation_sec): mean over the clients of one implementation that saw blobs of it."""
    bound = s.arrival_ms if bound_ms is None else bound_ms
    blobs = client_arrival(t.sidecars, [key, "client", "impl"], bound, s.impl)
    block_key = "block" if key == "block_root" else key
    blocks = (
        block_arrival(t.block_events, [block_key, "client", "impl"], s.fork, bound)
        .withColumnRenamed(block_key, key)
        .drop("impl")
    )
    return (
        blobs.join(blocks, [key, "client"], "left")
        .groupBy(key)
        .agg(F.avg(_last_part()).alias("propagation_sec"))
    )


def block_arrival_with_blobs(
    t: ChainTables, s: Settings = Settings(), mev: bool | None = None, q: float | None = None
) -> DataFrame:
    """(block_root, propagation_sec, num_blobs); blocks without blob transactions count 0 blobs."""
    blocks = mean_arrival(t, s)
    if mev is not None:
        other = non_mev_blocks(t).withColumnRenamed("hash", "block_hash")
        hashed = joins.left_join_fill(blocks, t.block_roots, ["block_root"])
        blocks = (joins.not_in if mev else joins.only_in)(hashed, other, ["block_hash"])
    rows = joins.left_join_fill(
        blocks, blobs_per(t, "block_root", s), ["block_root"], fill={"num_blobs": 0.0}
    ).select("block_root", "propagation_sec", "num_blobs")
    return rows if q is None else trim_quantile(rows, "propagation_sec", q, settle=True)


def arrival_over_time(t: ChainTables, s: Settings = Settings()) -> DataFrame:
    """Seconds per slot time: median over (block, client) where blobs exist, mean of blocks before."""
    blobs = client_arrival(t.sidecars, ["block_root", "client", "slot_start"], None)
    blocks = block_arrival(t.block_events, ["block", "client"], s.fork, None)
    pairs = joins.left_join_fill(
        blobs, blocks.withColumnRenamed("block", "block_root"), ["block_root", "client"]
    ).select("slot_start", _last_part().alias("propagation_sec"))
    after = grouped_median(pairs, ["slot_start"], "propagation_sec", "propagation_sec")
    before = (
        time_range(t.block_events, "slot_start", end=s.before_fork_end)
        .groupBy("slot_start")
        .agg(F.avg(scalars.seconds(F.col("diff_ms"))).alias("propagation_sec"))
    )
    return after.unionByName(before).orderBy("slot_start")


def slot_arrival_transactions_payments(t: ChainTables, s: Settings = Settings()) -> DataFrame:
    """(slot, num_of_txns, value, propagation_sec); a slot paid twice has two rows."""
    slots = mean_arrival(t, s, key="slot").join(
        transactions_by_blobs(t, s, key="slot").drop("num_blobs"), "slot"
    )
    paid = t.payloads.select("slot", "value")
    return joins.skew_join(paid, slots, ["slot"], one_row_per_key=True).select(
        "slot", "num_of_txns", "value", "propagation_sec"
    )


def payment_by_arrival(t: ChainTables, s: Settings = Settings(), q: float = 0.95) -> DataFrame:
    """(propagation_sec, value) for early arrivals, the largest payments trimmed."""
    blocks = mean_arrival(t, s, bound_ms=s.tight_arrival_ms).join(t.block_roots, "block_root")
    paid = t.payloads.select("block_hash", "value")
    rows = joins.skew_join(paid, blocks, ["block_hash"])
    return trim_quantile(rows.select("propagation_sec", "value"), "value", q, settle=True)


def payment_arrival_bins(t: ChainTables, s: Settings = Settings(), bins: int = 100) -> DataFrame:
    """Median payment in equal bins of arrival over the first four seconds."""
    return binned_median(payment_by_arrival(t, s), "propagation_sec", "value", 0, 4, bins)


def payment_arrival_line(t: ChainTables, s: Settings = Settings()) -> DataFrame:
    return regression_line(payment_by_arrival(t, s), "propagation_sec", "value")


def last_arrivals(t: ChainTables, s: Settings = Settings()) -> DataFrame:
    """(num_blobs, seconds): arrival of the last of a block and its k blobs, per block and client."""
    blobs = client_arrival(t.sidecars, ["block_root", "client"], s.arrival_ms)
    pairs = _block_side(t, s).join(blobs, ["block_root", "client"], "left")
    return pairs.select(
        F.coalesce("num_of_blobs", F.lit(0)).alias("num_blobs"), _last_part().alias("seconds")
    )


def last_arrival_summary(t: ChainTables, s: Settings = Settings()) -> DataFrame:
    """Mean, median and row count of ``last_arrivals`` per number of blobs."""
    rows = last_arrivals(t, s)
    means = rows.groupBy("num_blobs").agg(F.avg("seconds").alias("mean"), F.count("seconds").alias("n"))
    medians = grouped_quantiles(rows, ["num_blobs"], "seconds", {"median": 0.5})
    return means.join(medians, "num_blobs")


def last_arrival_box(t: ChainTables, s: Settings = Settings()) -> DataFrame:
    return box_stats(last_arrivals(t, s), "num_blobs", "seconds")


def last_arrival_density(t: ChainTables, s: Settings = Settings(), bins: int = 1000) -> DataFrame:
    """Density histogram of ``last_arrivals`` per number of blobs."""
    return histogram_by(last_arrivals(t, s), "num_blobs", "seconds", bins)


def payment_medians(t: ChainTables, s: Settings = Settings()) -> DataFrame:
    """Median payment per arrival time.

    Times are means, whose last bits depend on row order; to the nanosecond they do not.
    """
    paid = payment_by_arrival(t, s).withColumn("propagation_sec", F.round("propagation_sec", 9))
    return grouped_median(paid, ["propagation_sec"], "value", "median_value")


def payment_median_histogram(t: ChainTables, s: Settings = Settings(), bins: int = 50) -> DataFrame:
    """Histogram of the median payment per arrival time."""
    return histogram(settled(payment_medians(t, s).select("median_value")), "median_value", bins)


def payment_median_density(t: ChainTables, s: Settings = Settings()) -> DataFrame:
    """The smooth curve over ``payment_median_histogram``."""
    return kde_grid(payment_medians(t, s), "median_value")
