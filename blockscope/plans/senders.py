"""Who posts blobs, how many, and how often."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockscope.functions import scalars
from blockscope.operators import joins
from blockscope.operators.quantiles import grouped_median
from blockscope.operators.summaries import histogram_edges
from blockscope.operators.windows import gaps_within, top_k
from blockscope.plans.blobs import blob_transactions, with_sender_label
from blockscope.plans.tables import TRACKED_SENDERS, ChainTables, Settings


def address_book(spark: SparkSession, senders: Mapping[str, str] = TRACKED_SENDERS) -> DataFrame:
    """A label -> address mapping as the (address, label) frame the sender plans take."""
    return spark.createDataFrame(
        [(a.lower(), label) for label, a in senders.items()], "address string, label string"
    )


def sender_blobs(
    t: ChainTables, senders: DataFrame, s: Settings = Settings(), hot: DataFrame | None = None
) -> DataFrame:
    """(label, address, slot, num_blobs, num_blob_txns) for all listed senders in one pass."""
    rows = with_sender_label(blob_transactions(t, s), senders, hot)
    return rows.groupBy("label", "address", "slot").agg(
        F.sum(scalars.blobs(F.col("blob_gas"))).alias("num_blobs"),
        F.count(F.lit(1)).alias("num_blob_txns"),
    )


def posting_gap(t: ChainTables, senders: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Slots since the sender's previous blobs, up to the largest gap of interest.

    A sender's first slot has no gap and drops out.
    """
    posts = sender_blobs(t, senders, s).drop("num_blob_txns")
    return gaps_within(posts, ["label", "address"], "slot", "slot_increment", s.max_slot_gap)


def posting_gap_histogram(t: ChainTables, senders: DataFrame, s: Settings = Settings()) -> DataFrame:
    edges = list(range(1, s.max_slot_gap + 1))
    return histogram_edges(posting_gap(t, senders, s), "slot_increment", edges, "label")


def blobs_per_post_histogram(t: ChainTables, senders: DataFrame, s: Settings = Settings()) -> DataFrame:
    return histogram_edges(sender_blobs(t, senders, s), "num_blobs", [1, 2, 3, 4, 5, 6], "label")


def top_senders(t: ChainTables, s: Settings = Settings()) -> DataFrame:
    """The receivers of most blobs, as written in the transactions; ties by address."""
    totals = (
        blob_transactions(t, s)
        .groupBy("to_addr")
        .agg(F.sum(scalars.blobs(F.col("blob_gas"))).alias("num_blobs"))
    )
    return top_k(totals, s.top_senders, "num_blobs", ["to_addr"])


def top_sender_behaviour(t: ChainTables, s: Settings = Settings()) -> DataFrame:
    """Median blobs per transaction over the slots of each top sender, with its label ('' if none)."""
    # Bounded broadcast: at most s.top_senders rows.
    top = F.broadcast(top_senders(t, s).select("to_addr"))
    per_slot = (
        blob_transactions(t, s)
        .join(top, "to_addr", "left_semi")
        .groupBy("slot", scalars.normal_address(F.col("to_addr")).alias("address"))
        .agg(
            F.sum(scalars.blobs(F.col("blob_gas"))).alias("__blobs"),
            F.count(F.lit(1)).alias("__txns"),
        )
        .select("address", F.try_divide("__blobs", "__txns").alias("__rate"))
    )
    # Label after the median: at most s.top_senders addresses are left to look up.
    medians = grouped_median(per_slot, ["address"], "__rate", "num_blob_per_txn")
    labelled = joins.left_join_fill(medians, t.address_labels, ["address"], fill={"label": ""})
    return labelled.select("address", "label", "num_blob_per_txn")
