from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from blockscope.functions import scalars


@pytest.mark.parametrize(
    "text, number",
    [
        ("0x0", 0),
        ("0x1f", 31),
        ("0xABC", 0xABC),
        ("0xabc", 0xABC),
        ("0x000000000000000000000000000000000000000001", 1),
        (hex(2**63), 2**63),
        (hex(2**64), 2**64),
        (hex(2**64 - 1), 2**64 - 1),
        (hex(10**31), 10**31),
        (hex(10**38 - 1), 10**38 - 1),
        (hex(10**38), None),
        ("0x" + "f" * 32, None),
        ("0x1" + "0" * 40, None),
        ("0x", None),
        ("0xzz", None),
        ("", None),
        ("n/a", None),
        ("12", 12),
        (" 12 ", 12),
        ("-5", -5),
        ("1.5", None),
        (None, None),
    ],
)
def test_hex_to_int(values, text, number):
    got = values(scalars.hex_to_int(F.lit(text).cast("string")))[0]
    assert got == (None if number is None else Decimal(number))


def test_int_to_hex_is_the_request_form(values):
    assert values(scalars.int_to_hex(F.lit(19422000)), scalars.int_to_hex(F.lit(0))) == (
        hex(19422000),
        "0x0",
    )


def test_bytes_and_addresses(values):
    raw = F.lit(bytearray(b"0xAbC"))
    assert values(scalars.bytes_to_text(raw), scalars.normal_address(raw)) == ("0xAbC", "0xabc")


@pytest.mark.parametrize(
    "max_fee, priority, base, tip",
    [
        (100, 10, 95, 5),
        (100, 10, 50, 10),
        (100, 10, 200, 0),
        (100, 10, None, 10),
        (5, 10, None, 5),
        (10**37, 10**36, 10**37 - 7, 7),
    ],
)
def test_effective_tip(values, max_fee, priority, base, tip):
    cols = [F.lit(None if v is None else str(v)).cast("decimal(38,0)") for v in (max_fee, priority, base)]
    assert values(scalars.effective_tip(*cols))[0] == Decimal(tip)


def test_ratios_with_nothing_below(values):
    lit = F.lit
    assert values(
        scalars.safe_ratio(lit(1), lit(0)),
        scalars.safe_ratio(lit(0), lit(0)),
        scalars.safe_ratio(lit(1), lit(4)),
        scalars.over_half(lit(1), lit(0)),
        scalars.over_half(lit(0), lit(0)),
        scalars.over_half(lit(1), lit(2)),
        scalars.over_half(lit(3), lit(4)),
    ) == (None, None, 0.25, True, False, False, True)


def test_numbers_and_finiteness(values):
    assert values(
        scalars.to_number(F.lit("2.5")),
        scalars.to_number(F.lit("bad")),
        scalars.is_finite(F.lit(float("inf"))),
        scalars.is_finite(F.lit(float("nan"))),
        scalars.is_finite(F.lit(None).cast("double")),
        scalars.is_finite(F.lit(-1.0)),
    ) == (2.5, None, False, False, False, True)


def test_days_stop_at_the_end_date_within_a_month_and_over_years():
    assert scalars.days_between("2024-02-28", "2024-03-01") == [
        date(2024, 2, 28),
        date(2024, 2, 29),
        date(2024, 3, 1),
    ]
    assert len(scalars.days_between("2024-05-03", "2024-05-05")) == 3
    assert len(scalars.days_between("2023-12-31", "2024-01-01")) == 2
    assert len(scalars.days_between("2024-03-01", "2024-05-20")) == 81
