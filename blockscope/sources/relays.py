"""Delivered payloads as reported by several relays."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockscope.operators.intervals import uncovered
from blockscope.operators.windows import keep_first
from blockscope.schemas import PAYLOADS
from blockscope.session import settled
from blockscope.sources.layouts import as_schema

# Relays in order of preference.
RELAY_ORDER = (
    "ultrasound",
    "bloxroute-max-profit",
    "bloxroute-regulated",
    "agnostic-relay",
    "boost-relay",
    "titanrelay",
    "aestus",
    "mainnet-relay",
)


_CORRUPT = "_corrupt"


@dataclass(frozen=True)
class RelayPages:
    """Typed bids, and the (relay, reason, raw) of pages and bids that gave none."""

    good: DataFrame
    rejects: DataFrame


def _classified(
    spark: SparkSession, root: str, schema: T.StructType, page_per_line: bool
) -> DataFrame:
    """A row per bid, and per page that is no JSON: relay, reason, raw, typed columns."""
    texts = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    texts = texts.add(_CORRUPT, T.StringType())
    pages = (
        spark.read.schema(texts)
        .option("multiLine", not page_per_line)
        .option("columnNameOfCorruptRecord", _CORRUPT)
        .json(root)
    )
    named = {f.name: F.col(f"`{f.name}`") for f in schema.fields}
    unread = [
        named[f.name].isNotNull() & named[f.name].try_cast(f.dataType).isNull()
        for f in schema.fields
        if not isinstance(f.dataType, T.StringType)
    ]
    absent = [c.isNull() for c in named.values()]
    reason = (
        F.when(F.col(_CORRUPT).isNotNull() | reduce(and_, absent), "malformed")
        .when(reduce(or_, unread, F.lit(False)), "bad_number")
    )
    raw = F.coalesce(F.col(_CORRUPT), F.to_json(F.struct(*[c.alias(n) for n, c in named.items()])))
    typed = [named[f.name].try_cast(f.dataType).alias(f.name) for f in schema.fields]
    return pages.select("relay", reason.alias("reason"), F.when(reason.isNotNull(), raw).alias("raw"), *typed)


def land_relay_pages(
    spark: SparkSession, root: str, schema: T.StructType = PAYLOADS, page_per_line: bool = False
) -> RelayPages:
    """All landed pages below ``root/relay=<name>/``, each a JSON array of flat objects.

    A file holds one page, or with ``page_per_line`` a page per line, which Spark can
    split.  Numbers arrive as digit text.  Empty pages and relays without pages add no rows.
    A page that is no JSON, an object without a known field and a number that cannot be read
    are rejects; all else goes on.  Settled first, as both sides are read.
    """
    rows = settled(_classified(spark, root, schema, page_per_line))
    names = [f"`{f.name}`" for f in schema.fields]
    return RelayPages(
        good=rows.where(F.col("reason").isNull()).select("relay", *names),
        rejects=rows.where(F.col("reason").isNotNull()).select("relay", "reason", "raw"),
    )


def read_relay_pages(
    spark: SparkSession, root: str, schema: T.StructType = PAYLOADS, page_per_line: bool = False
) -> DataFrame:
    """The good bids of ``land_relay_pages``, where nobody asks for the rejects."""
    rows = _classified(spark, root, schema, page_per_line)
    return rows.where(F.col("reason").isNull()).drop("reason", "raw")


def page_spans(pages: DataFrame) -> DataFrame:
    """(relay, low, high): the slots that each page of a downward walk answers for.

    ``pages`` has relay, ``cursor`` (the slot asked for), ``status`` and ``text`` (the body).  A page with
    bids answers from its cursor down to its lowest slot.  One that failed, is no JSON array,
    or is empty answers for nothing: a walk goes on below it without having seen a bid.
    """
    bids = F.from_json("text", "array<struct<slot: string>>")
    lowest = F.array_min(F.transform(bids, lambda bid: bid["slot"].try_cast("bigint")))
    spans = pages.where(F.col("status") == 200).select("relay", lowest.alias("low"), F.col("cursor").cast("bigint").alias("high"))
    return spans.where(F.col("low").isNotNull())


def unseen_slots(pages: DataFrame, walks: DataFrame) -> DataFrame:
    """(relay, low, high): longest ranges of slots that no page of a relay answers for.

    ``walks`` has relay, low and high of what was to be walked, one row per relay; relays without any
    page are wholly unseen.  These ranges are the work list of the next walk.
    """
    return uncovered(page_spans(pages), walks, ["relay"])


def relay_rank(order: Sequence[str] = RELAY_ORDER) -> Column:
    """Place of the row's relay in the order; unknown relays come last."""
    place = F.array_position(F.array(*[F.lit(r) for r in order]), F.col("relay"))
    return F.when(place == 0, F.lit(len(order) + 1)).otherwise(place)


def preference(order: Sequence[str] = RELAY_ORDER) -> list[Column]:
    """Relay order first, then newest slot first, as the pages come."""
    return [relay_rank(order), -F.col("slot")]


def first_reports(bids: DataFrame, order: Sequence[str] = RELAY_ORDER) -> DataFrame:
    """One row per block hash, from the most preferred relay that reported it."""
    return keep_first(bids, ["block_hash"], preference(order))


def payload_table(bids: DataFrame) -> DataFrame:
    """The stored form: first reports without the relay."""
    return as_schema(first_reports(bids), PAYLOADS)
