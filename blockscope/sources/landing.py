"""Landed node responses to typed rows and rejects.

A fetcher leaves one JSON line per response: the key it asked for, which attempt
it was, the HTTP status and the body as text.  Everything here is one pass over
those lines; the requests themselves are made elsewhere.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockscope.functions.scalars import hex_to_int
from blockscope.operators.windows import keep_first
from blockscope.schemas import BLOCK_ROOTS
from blockscope.session import settled

LANDED_LINE = "key string, attempt int, status int, body string"
MAX_TRIES = 6
HTTP_OK = 200
_CORRUPT = "_corrupt"

# Where a blinded block keeps its execution header.
HEADER_PATH = ("data", "message", "body", "execution_payload_header")


@dataclass(frozen=True)
class Landed:
    """Typed rows with their key and attempt, and the responses that gave none."""

    good: DataFrame
    rejects: DataFrame


def read_landed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LANDED_LINE).json(path)


def _texts(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])


def _nested(path: tuple[str, ...], inner: T.StructType) -> T.StructType:
    for name in reversed(path):
        inner = T.StructType([T.StructField(name, inner)])
    return inner


def classify(raw: DataFrame, schema: T.StructType, path: tuple[str, ...] = ("result",)) -> DataFrame:
    """key, attempt, reason, body and the typed columns of ``schema``; reason and body are NULL for good rows.

    A number that cannot be read, or does not fit its column, rejects the response;
    an absent field is NULL.  Works on batch and streaming frames alike.
    """
    envelope = _nested(path, _texts(schema)).add(_CORRUPT, T.StringType())
    parsed = raw.select(
        F.struct(*raw.columns).alias("line"),
        F.from_json("body", envelope, {"columnNameOfCorruptRecord": _CORRUPT}).alias("parsed"),
    )
    found = F.col("parsed." + ".".join(path))

    numbers = [f for f in schema.fields if not isinstance(f.dataType, T.StringType)]
    # One conversion over an array: written out per column it outgrows what the JVM compiles.
    values = F.transform(F.array(*[found.getField(f.name) for f in numbers]), hex_to_int)
    rows = parsed.withColumn("values", values)

    def typed(f: T.StructField) -> Column:
        if f not in numbers:
            return found.getField(f.name)
        return F.get("values", F.lit(numbers.index(f))).try_cast(f.dataType)

    unread = [found.getField(f.name).isNotNull() & typed(f).isNull() for f in numbers]
    reason = (
        F.when(F.col("line.status") != HTTP_OK, "http_status")
        .when(F.col("line.body").isNull() | F.col(f"parsed.{_CORRUPT}").isNotNull(), "malformed")
        .when(found.isNull(), "no_result")
        .when(reduce(or_, unread, F.lit(False)), "bad_number")
    )
    return rows.select(
        "line.key",
        "line.attempt",
        reason.alias("reason"),
        # Only rejects show their body; that of a good row is in its columns.
        F.when(reason.isNotNull(), F.col("line.body")).alias("body"),
        *[typed(f).alias(f.name) for f in schema.fields],
    )


def split(classified: DataFrame, schema: T.StructType) -> Landed:
    """Good rows and rejects of one classified frame, which is parsed once for both.

    Settled first: a filter on the reason would otherwise be pushed below the parsing
    and repeat it.
    """
    rows = settled(classified)
    names = [f"`{f.name}`" for f in schema.fields]
    return Landed(
        good=rows.where(F.col("reason").isNull()).select("key", "attempt", *names),
        rejects=rows.where(F.col("reason").isNotNull()).select(
            "key", "attempt", "reason", F.col("body").alias("raw")
        ),
    )


def land_rpc(raw: DataFrame, schema: T.StructType) -> Landed:
    """``{"result": {...}}`` responses with hex numbers to the columns of ``schema``."""
    return split(classify(raw, schema), schema)


def payload_defaults(headers: DataFrame, schema: T.StructType = BLOCK_ROOTS) -> DataFrame:
    """Absent fields of required columns become '' or 0; nullable columns keep NULL.

    The target type decides: digits in a text column stay text.
    """
    filled = headers
    for f in schema.fields:
        if not f.nullable and f.name in headers.columns:
            default = F.lit("") if isinstance(f.dataType, T.StringType) else F.lit(0).cast(f.dataType)
            filled = filled.withColumn(f.name, F.coalesce(f.name, default))
    return filled


def land_headers(raw: DataFrame) -> Landed:
    """Execution headers out of blinded blocks, keyed by the block root that was asked for."""
    inner = T.StructType([f for f in BLOCK_ROOTS.fields if f.name != "block_root"])
    landed = split(classify(raw, inner, HEADER_PATH), inner)
    good = payload_defaults(landed.good).withColumn("block_root", F.col("key"))
    return Landed(good, landed.rejects)


def first_success(landed: Landed) -> DataFrame:
    """One row per key: the earliest attempt that gave a result."""
    return keep_first(landed.good, ["key"], [F.col("attempt")]).drop("attempt")


def retry_list(landed: Landed, max_tries: int = MAX_TRIES) -> DataFrame:
    """Keys still without a result that have tries left, with the tries made so far."""
    tried = landed.rejects.groupBy("key").agg(F.count(F.lit(1)).alias("tries"))
    done = landed.good.select("key").distinct()
    return tried.where(F.col("tries") < max_tries).join(done, "key", "left_anti")
