"""A hand-made chain of a few blocks, with the rows that decide each join and ratio rule."""

from pyspark.sql import SparkSession

from blockscope.plans.tables import ChainTables, Settings

SETTINGS = Settings()
BLOB = 131072
AFTER = "2024-03-14 00:00:00"
BEFORE = "2024-02-01 00:00:00"

SCHEMAS = {
    "transactions": "block_root string, slot long, hash string, to_addr string, type int, position int,"
    " blob_gas long, size double, empty_size double, full_size double",
    "block_roots": "block_root string, block_hash string",
    "block_details": "hash string, gas_used long, extra_data string, size long, base_fee long",
    "tx_details": "hash string, block_hash string, max_fee decimal(38,0), max_priority_fee decimal(38,0)",
    "payloads": "slot long, block_hash string, value double",
    "sidecars": "block_root string, slot long, client string, impl string, blob_index int, diff_ms long,"
    " slot_start string",
    "block_events": "block string, slot long, client string, impl string, diff_ms long, slot_start string",
    "reorgs": "slot long, slot_start string, impl string, country string",
    "address_labels": "address string, label string",
}


def chain(spark: SparkSession, **rows: list[tuple]) -> ChainTables:
    """The given rows per table; tables not given are empty."""
    frames = {}
    for name, schema in SCHEMAS.items():
        df = spark.createDataFrame(rows.get(name, []), schema)
        if "slot_start" in df.columns:
            df = df.withColumn("slot_start", df["slot_start"].cast("timestamp"))
        frames[name] = df
    return ChainTables(**frames)


def tx(root, slot, hash_, to="0xA", type_=3, position=0, blobs=1, size=1.0, empty=0.0, full=1.0):
    return (root, slot, hash_, to, type_, position, blobs * BLOB, float(size), float(empty), float(full))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
