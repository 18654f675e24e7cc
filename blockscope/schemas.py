"""Table layouts: column names and types as landed, sort keys, and the short names used inside.

Unsigned source types are widened one step; 128- and 256-bit numbers become
``decimal(38,0)``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

WIDE = T.DecimalType(38, 0)
TEXT, LONG, INT = T.StringType(), T.LongType(), T.IntegerType()

# The landed tables in their declared column order.  Nullable are the columns declared
# so, and those that a response may leave out and that get no default.
RELAY_PAYLOADS = T.StructType(
    [
        T.StructField("slot", LONG, False),
        T.StructField("parent_hash", TEXT, False),
        T.StructField("block_hash", TEXT, False),
        T.StructField("builder_pubkey", TEXT, False),
        T.StructField("proposer_pubkey", TEXT, False),
        T.StructField("proposer_fee_recipient", TEXT, False),
        T.StructField("gas_limit", LONG, False),
        T.StructField("gas_used", LONG, False),
        T.StructField("value", WIDE, False),
        T.StructField("block_number", LONG, False),
        T.StructField("num_tx", LONG, False),
        T.StructField("relay_name", TEXT, False),
    ]
)
RECEIPTS = T.StructType(
    [
        T.StructField("blockHash", TEXT, False),
        T.StructField("blockNumber", WIDE, False),
        T.StructField("contractAddress", TEXT, True),
        T.StructField("cumulativeGasUsed", WIDE, False),
        T.StructField("effectiveGasPrice", WIDE, False),
        T.StructField("from", TEXT, True),
        T.StructField("gasUsed", WIDE, False),
        T.StructField("status", INT, False),
        T.StructField("to", TEXT, True),
        T.StructField("transactionHash", TEXT, False),
        T.StructField("transactionIndex", LONG, False),
        T.StructField("type", INT, False),
    ]
)
BLOCK_DETAILS = T.StructType(
    [
        T.StructField("baseFeePerGas", WIDE, True),
        T.StructField("blobGasUsed", WIDE, True),
        T.StructField("excessBlobGas", WIDE, True),
        T.StructField("extraData", TEXT, True),
        T.StructField("gasLimit", WIDE, True),
        T.StructField("gasUsed", WIDE, True),
        T.StructField("hash", TEXT, False),
        T.StructField("miner", TEXT, True),
        T.StructField("number", WIDE, False),
        T.StructField("receiptsRoot", TEXT, True),
        T.StructField("size", WIDE, True),
        T.StructField("timestamp", WIDE, True),
    ]
)
TRANSACTION_DETAILS = T.StructType(
    [
        T.StructField("blockHash", TEXT, False),
        T.StructField("blockNumber", WIDE, False),
        T.StructField("chainId", WIDE, True),
        T.StructField("from", TEXT, True),
        T.StructField("gas", WIDE, True),
        T.StructField("gasPrice", WIDE, True),
        T.StructField("hash", TEXT, False),
        T.StructField("maxFeePerGas", WIDE, True),
        T.StructField("maxPriorityFeePerGas", WIDE, True),
        T.StructField("nonce", LONG, True),
        T.StructField("to", TEXT, True),
        T.StructField("transactionIndex", LONG, True),
        T.StructField("type", LONG, True),
        T.StructField("value", WIDE, True),
    ]
)
PAYLOADS = T.StructType(
    [
        T.StructField("slot", LONG, False),
        T.StructField("parent_hash", TEXT, False),
        T.StructField("block_hash", TEXT, False),
        T.StructField("builder_pubkey", TEXT, False),
        T.StructField("proposer_pubkey", TEXT, False),
        T.StructField("proposer_fee_recipient", TEXT, False),
        T.StructField("gas_limit", LONG, False),
        T.StructField("gas_used", LONG, False),
        T.StructField("value", WIDE, False),
        T.StructField("num_tx", LONG, False),
        T.StructField("block_number", LONG, False),
    ]
)
BLOCK_ROOTS = T.StructType(
    [
        T.StructField("parent_hash", TEXT, False),
        T.StructField("fee_recipient", TEXT, False),
        T.StructField("state_root", TEXT, False),
        T.StructField("receipts_root", TEXT, False),
        T.StructField("logs_bloom", TEXT, False),
        T.StructField("prev_randao", TEXT, False),
        T.StructField("block_number", WIDE, False),
        T.StructField("gas_limit", WIDE, False),
        T.StructField("gas_used", WIDE, False),
        T.StructField("timestamp", WIDE, False),
        T.StructField("extra_data", TEXT, False),
        T.StructField("base_fee_per_gas", WIDE, False),
        T.StructField("block_hash", TEXT, False),
        T.StructField("transactions_root", TEXT, False),
        T.StructField("withdrawals_root", TEXT, False),
        T.StructField("blob_gas_used", WIDE, True),
        T.StructField("excess_blob_gas", WIDE, True),
        T.StructField("block_root", TEXT, False),
    ]
)


@dataclass(frozen=True)
class TableSpec:
    """Stored name, and stored column per short column name."""

    stored: str
    columns: dict[str, str]


@dataclass(frozen=True)
class Declared:
    """Schema and sort key of a table this library lands."""

    schema: T.StructType
    sort_key: tuple[str, ...]


# The landed tables with their sort keys.
DECLARED: dict[str, Declared] = {
    "relay_proposer_payload_delivered": Declared(RELAY_PAYLOADS, ("slot", "block_hash")),
    "canonical_beacon_transaction_receipts_blob_sidecars": Declared(
        RECEIPTS, ("blockHash", "transactionHash")
    ),
    "canonical_block_details": Declared(BLOCK_DETAILS, ("number", "hash")),
    "canonical_transaction_details": Declared(TRANSACTION_DETAILS, ("blockHash", "hash")),
    "mev_block_details": Declared(PAYLOADS, ("slot", "block_hash")),
    "canonical_block_root": Declared(BLOCK_ROOTS, ("block_root",)),
}

# Stored table and column names behind each short name.
TABLES: dict[str, TableSpec] = {
    "transactions": TableSpec(
        "canonical_beacon_block_execution_transaction",
        {"slot": "slot", "block_root": "block_root", "hash": "hash", "to_addr": "to", "type": "type",
         "position": "position", "blob_gas": "blob_gas", "size": "size",
         "full_size": "blob_sidecars_size", "empty_size": "blob_sidecars_empty_size",
         "epoch_start": "epoch_start_date_time"},
    ),
    "block_roots": TableSpec(
        "canonical_block_root",
        {"block_root": "block_root", "block_hash": "block_hash"},
    ),
    "block_details": TableSpec(
        "canonical_block_details",
        {"hash": "hash", "gas_used": "gasUsed", "extra_data": "extraData", "size": "size",
         "base_fee": "baseFeePerGas"},
    ),
    "tx_details": TableSpec(
        "canonical_transaction_details",
        {"hash": "hash", "block_hash": "blockHash", "max_fee": "maxFeePerGas",
         "max_priority_fee": "maxPriorityFeePerGas"},
    ),
    "payloads": TableSpec(
        "mev_block_details",
        {"slot": "slot", "block_hash": "block_hash", "value": "value"},
    ),
    "sidecars": TableSpec(
        "beacon_api_eth_v1_events_blob_sidecar",
        {"block_root": "block_root", "slot": "slot", "client": "meta_client_id",
         "impl": "meta_consensus_implementation", "blob_index": "blob_index",
         "diff_ms": "propagation_slot_start_diff", "slot_start": "slot_start_date_time"},
    ),
    "block_events": TableSpec(
        "beacon_api_eth_v1_events_block",
        {"block": "block", "slot": "slot", "client": "meta_client_id",
         "impl": "meta_consensus_implementation", "diff_ms": "propagation_slot_start_diff",
         "slot_start": "slot_start_date_time"},
    ),
    "reorgs": TableSpec(
        "beacon_api_eth_v1_events_chain_reorg",
        {"slot": "slot", "slot_start": "slot_start_date_time",
         "impl": "meta_consensus_implementation", "country": "meta_client_geo_country_code"},
    ),
    "address_labels": TableSpec("labels", {"address": "address", "label": "label"}),
}
