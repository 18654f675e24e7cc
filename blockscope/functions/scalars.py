"""Column functions: hex and byte decoding, units, safe ratios, the effective tip.

All are built from JVM-side expressions, so they stay inside generated code.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

# Protocol and unit constants that results depend on.
GAS_PER_BLOB = 131072
MS_PER_SECOND = 1000
WEI_PER_ETH = 1e18
GENESIS_SECONDS = 1606824023
SECONDS_PER_SLOT = 12

WIDE = "decimal(38,0)"
_HEX = r"\A0x0*[0-9a-fA-F]{1,32}\z"
_DECIMAL = r"\A[+-]?[0-9]+\z"
_AROUND = r"\A\s+|\s+\z"
_TWO_POW_64 = "18446744073709551616"


def hex_to_int(text: Column) -> Column:
    """``0x…`` or decimal text to a whole number; anything else, or beyond 38 digits, is NULL.

    White space around it, line ends too, does not count.  The last 32 hex digits are cut into two 64-bit halves, which ``conv`` reads exactly.
    """
    text = F.regexp_replace(text, _AROUND, "")
    digits = F.right(F.concat(F.lit("0" * 32), F.substr(text, F.lit(3))), F.lit(32))
    high = F.conv(F.substring(digits, 1, 16), 16, 10).cast(WIDE)
    low = F.conv(F.substring(digits, 17, 16), 16, 10).cast(WIDE)
    wide = F.try_add(F.try_multiply(high, F.lit(_TWO_POW_64).cast(WIDE)), low)
    return (
        F.when(text.rlike(_HEX), wide.cast(WIDE))
        .when(text.rlike(_DECIMAL), text.try_cast(WIDE))
    )


def int_to_hex(number: Column) -> Column:
    """Whole number to the ``0x`` text form of request parameters."""
    return F.concat(F.lit("0x"), F.lower(F.hex(number)))


def bytes_to_text(value: Column) -> Column:
    """UTF-8 bytes to text (a no-op on text)."""
    return value.cast("string")


def normal_address(value: Column) -> Column:
    """Addresses compare without regard to case."""
    return F.lower(bytes_to_text(value))


def blobs(gas: Column) -> Column:
    """Number of blobs paid for by an amount of blob gas."""
    return gas / F.lit(GAS_PER_BLOB)


def seconds(milliseconds: Column) -> Column:
    return milliseconds / F.lit(MS_PER_SECOND)


def slot_time(slot: Column) -> Column:
    """When a slot starts, from its number."""
    return F.timestamp_seconds(slot * F.lit(SECONDS_PER_SLOT) + F.lit(GENESIS_SECONDS))


def wei_to_eth(wei: Column) -> Column:
    return wei.cast("double") / F.lit(WEI_PER_ETH)


def safe_ratio(part: Column, whole: Column) -> Column:
    """``part / whole``, NULL where ``whole`` is 0."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def over_half(part: Column, whole: Column) -> Column:
    """Is ``part / whole > 0.5``?  A positive part of nothing counts as yes, 0 of 0 as no."""
    return F.when(whole == 0, part > 0).otherwise(safe_ratio(part, whole) > 0.5)


def effective_tip(max_fee: Column, max_priority_fee: Column, base_fee: Column) -> Column:
    """What the proposer earns per gas: the fee cap left over the base fee, at most the priority fee.

    A missing base fee counts as 0, so the subtraction is signed and 38 digits wide.
    """
    base = F.coalesce(base_fee.cast(WIDE), F.lit(0).cast(WIDE))
    left_over = F.greatest(max_fee.cast(WIDE) - base, F.lit(0).cast(WIDE))
    return F.least(left_over.cast(WIDE), max_priority_fee.cast(WIDE))


def to_number(text: Column) -> Column:
    """Text to double; text that is no number becomes NULL."""
    return text.try_cast("double")


def is_finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def days_between(start: str, end: str) -> list[date]:
    """Every day from start to end, both included, over month and year ends."""
    first, last = date.fromisoformat(start), date.fromisoformat(end)
    return [first + timedelta(days=i) for i in range((last - first).days + 1)]
