"""The frames an analysis reads, and the constants it can be run with."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class ChainTables:
    """Input frames under their short column names (``schemas.TABLES``)."""

    transactions: DataFrame
    block_roots: DataFrame
    block_details: DataFrame
    tx_details: DataFrame
    payloads: DataFrame
    sidecars: DataFrame
    block_events: DataFrame
    reorgs: DataFrame
    address_labels: DataFrame
    #: hashes of the non-MEV blocks where they are stored (``plans.classified``); else they are found
    non_mev: DataFrame | None = None


# The dates, bounds, countries and senders the analyses are defined with.
@dataclass(frozen=True)
class Settings:
    fork: str = "2024-03-13"
    before_fork_end: str = "2024-03-01"
    impl: str = "lighthouse"
    blob_type: int = 3
    arrival_ms: int = 24000
    tight_arrival_ms: int = 4000
    max_slot_gap: int = 96
    top_senders: int = 10
    sparse_countries: tuple[str, ...] = ("FI", "IN")
    sparse_after_fork: str = "IN"


TRACKED_SENDERS: dict[str, str] = {
    "Base": "0xff00000000000000000000000000000000008453",
    "Arbitrum": "0x1c479675ad559dc151f6ec7ed3fbf8cee79582b6",
    "Optimism": "0xff00000000000000000000000000000000000010",
    "Linea": "0xd19d4b5d358258f05d7b411e21a1460d11b0876f",
    "ZKsync": "0xa8cb082a5a689e0d594d7da1e2d72a3d63adc1bd",
    "Scroll": "0xa13baf47339d63b743e7da8741db5456dac1e556",
    "Starknet": "0xc662c410c0ecf747543f5ba90660f6abebd9c8c4",
    "Zora": "0x6f54ca6f6ede96662024ffd61bfd18f3f4e34dff",
    "Mode": "0x24e59d9d3bd73ccc28dc54062af7ef7bff58bd67",
}
