"""Arrival by blobs kept up to date from partial results per period, without reading old observations again.

A period's observations are reduced once to one row per (item, client); rows of an item seen in
several periods merge, because a latest arrival and a highest index do.  Quantiles of a period are
kept as sketches, which merge over any periods.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockscope.operators.shaping import time_range
from blockscope.plans.arrival import _last_part, block_arrival, client_arrival
from blockscope.plans.tables import ChainTables, Settings
from blockscope.sources.files import written_folders

KEYS = ["block_root", "client"]
#: The sketch's accuracy parameter; a rank is off by less than about 0.7 % of the values in 99 of 100 cases.
SKETCH_ITEMS = 400


def add_period(t: ChainTables, path: str, start: str, end: str | None = None, s: Settings = Settings()) -> None:
    """Reduce the observations of ``start <= slot start < end`` and keep them as the period ``start``.

    A period that is added again replaces itself, whether its first run ended or not.
    """
    seen = time_range(t.sidecars, "slot_start", start=start, end=end)
    events = time_range(t.block_events, "slot_start", start=start, end=end)
    blobs = client_arrival(seen, KEYS, s.arrival_ms, s.impl)
    blocks = block_arrival(events, ["block", "client"], s.fork, s.arrival_ms, s.impl)
    blobs.write.mode("overwrite").parquet(f"{path}/blobs/from={start}")
    blocks.withColumnRenamed("block", "block_root").write.mode("overwrite").parquet(f"{path}/blocks/from={start}")


def _side(spark: SparkSession, path: str, *latest: str) -> DataFrame:
    folders = sorted(written_folders(spark, path).values())
    return spark.read.parquet(*folders).groupBy(*KEYS).agg(*[F.max(c).alias(c) for c in latest])


def arrival_by_blobs_kept(spark: SparkSession, path: str) -> DataFrame:
    """``arrival.arrival_by_blobs`` over all periods added, from their reduced rows alone."""
    blobs = _side(spark, f"{path}/blobs", "blob_prop_time", "num_of_blobs")
    pairs = blobs.join(_side(spark, f"{path}/blocks", "block_prop_time"), KEYS)
    return pairs.groupBy(F.col("num_of_blobs").alias("num_blobs")).agg(F.avg(_last_part()).alias("propagation_sec"))


def period_sketches(df: DataFrame, period: str, by: list[str], value: str, items: int = SKETCH_ITEMS) -> DataFrame:
    """(period, by, sketch): one mergeable quantile sketch per period and group, merged on the map side.

    NULL and NaN values are left out; a group without a value has no row.
    """
    number = F.col(value).cast("double")
    known = df.where(number.isNotNull() & ~F.isnan(number))
    return known.groupBy(period, *by).agg(F.kll_sketch_agg_double(number, items).alias("sketch"))


def merged_quantiles(sketches: DataFrame, by: list[str], wanted: dict[str, float], items: int = SKETCH_ITEMS) -> DataFrame:
    """Approximate quantiles per group over all the sketches given, with ``n``, the values they have seen."""
    merged = sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch", items).alias("__all"))
    return merged.select(
        *by,
        F.kll_sketch_get_n_double("__all").alias("n"),
        *[F.kll_sketch_get_quantile_double("__all", F.lit(q)).alias(name) for name, q in wanted.items()],
    )
