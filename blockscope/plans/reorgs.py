"""Reorg events by day, implementation and country, and against blobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockscope.operators import joins
from blockscope.operators.shaping import time_range
from blockscope.operators.summaries import box_stats, line_series
from blockscope.plans.blobs import blobs_per
from blockscope.plans.tables import ChainTables, Settings


def _per_day(events: DataFrame) -> DataFrame:
    return events.groupBy(F.to_date("slot_start").alias("date"), "impl", "country").agg(
        F.count(F.lit(1)).alias("num_of_reorg_events")
    )


def reorgs_mean_country(t: ChainTables, s: Settings = Settings()) -> DataFrame:
    """Events per day and implementation, averaged over the countries that saw any."""
    counted = _per_day(t.reorgs.where(~F.col("country").isin(*s.sparse_countries)))
    return counted.groupBy("date", "impl").agg(
        F.avg("num_of_reorg_events").alias("num_of_reorg_events")
    )


def reorgs_by_country(t: ChainTables, s: Settings = Settings()) -> DataFrame:
    """Events per day, implementation and country since the fork."""
    events = time_range(t.reorgs, "slot_start", start=s.fork)
    return _per_day(events.where(F.col("country") != s.sparse_after_fork))


def reorg_line(t: ChainTables, s: Settings = Settings()) -> DataFrame:
    """Mean events per day and implementation, marked before or after the fork."""
    daily = _per_day(t.reorgs.where(F.col("country") != s.sparse_after_fork))
    return line_series(daily, "date", "num_of_reorg_events", series="impl", reference=s.fork)


def reorgs_vs_blobs(t: ChainTables, s: Settings = Settings()) -> DataFrame:
    """(slot, num_blobs, num_of_reorg_events): one row per country that saw a reorg of the slot."""
    events = (
        t.reorgs.where(F.col("impl") == s.impl)
        .groupBy("slot", "country")
        .agg(F.count(F.lit(1)).alias("num_of_reorg_events"))
        .drop("country")
    )
    return joins.left_join_fill(
        blobs_per(t, "slot", s), events, ["slot"], fill={"num_of_reorg_events": 0}
    ).select("slot", "num_blobs", "num_of_reorg_events")


def reorg_box(t: ChainTables, s: Settings = Settings()) -> DataFrame:
    return box_stats(reorgs_vs_blobs(t, s), "num_blobs", "num_of_reorg_events")
