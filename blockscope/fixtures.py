"""Binds the driver's tables to the chain tables, for ``__spark_entry__`` and the tests.

Every view reads its whole table; a ``where`` states which rows a chain table
has by nature (relay-delivered blocks, known roots), never a share of the ids.
The text runs unchanged in Spark SQL and in the oracle's SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from blockscope.plans.tables import ChainTables, Settings
from blockscope.session import prepare_session

IMPL = """case user_id % 5 when 3 then 'teku' when 4 then 'prysm' else 'lighthouse' end"""

# name -> (driver table, text)
VIEWS: dict[str, str] = {
    "tx": """select l_orderkey as block_root, l_orderkey as slot, l_orderkey*8+l_linenumber as hash,
  l_linenumber-1 as position, case when l_returnflag='R' then 3 else 2 end as type,
  (cast(floor(l_quantity) as int)%6+1)*131072 as blob_gas,
  concat('0xAB', cast(l_suppkey as varchar(20))) as to_addr, l_extendedprice as size,
  l_discount as empty_size, l_tax as full_size, l_shipdate as epoch_start from lineitem""",
    "tx_details": """select l_orderkey*8+l_linenumber as hash, l_orderkey as block_hash,
  cast(floor(l_extendedprice*100) as bigint) as max_fee,
  cast(floor(l_quantity*100000) as bigint) as max_priority_fee from lineitem where l_returnflag <> 'N'""",
    "block_root": """select o_orderkey as block_root, o_orderkey as block_hash from orders
  where o_orderpriority <> '5-LOW'""",
    "block_details": """select o_orderkey as hash, o_totalprice as gas_used, o_custkey as extra_data,
  o_totalprice/10 as size, cast(floor(o_totalprice*10) as bigint) as base_fee, o_orderdate as block_time
  from orders where o_orderpriority <> '4-NOT SPECIFIED'""",
    "mev": """select o_orderkey as slot, o_orderkey as block_hash, o_totalprice as value from orders
  join customer on o_custkey = c_custkey
  where o_orderstatus <> 'P' and c_mktsegment in ('BUILDING', 'HOUSEHOLD', 'MACHINERY')""",
    "relay_bids": """select 'a' as relay, o_orderkey as slot, o_orderkey as block_hash,
  o_totalprice as value from orders where o_orderstatus <> 'P'
union all select 'b', o_orderkey, o_orderkey, o_totalprice+1 from orders where o_orderstatus <> 'F'
union all select 'c', o_orderkey, o_orderkey, o_totalprice+2 from orders where o_orderpriority <> '5-LOW'""",
    "sidecar": f"""select cast(floor(event_id/20) as bigint) as block_root,
  cast(floor(event_id/20) as bigint) as slot, user_id % 5 as client, {IMPL} as impl,
  cast(floor(value) as int) % 6 as blob_index, value*100 as diff_ms, date_trunc('day', ts) as slot_start
  from events where event_type in ('click','error','purchase')""",
    "block_ev": f"""select cast(floor(event_id/20) as bigint) as block,
  cast(floor(event_id/20) as bigint) as slot, user_id % 5 as client, {IMPL} as impl,
  value*100 as diff_ms, date_trunc('day', ts) as slot_start from events
  where event_type in ('signup','view')""",
    "reorg": """select cast(floor(event_id/3)*3 as bigint) as slot, ts as slot_start,
  case user_id % 4 when 0 then 'lighthouse' when 1 then 'teku' when 2 then 'prysm' else 'lodestar' end as impl,
  case user_id % 5 when 0 then 'FI' when 1 then 'IN' when 2 then 'US' when 3 then 'DE' else 'AU' end as country
  from events""",
    "address_labels": """select concat('0xab', cast(s_suppkey as varchar(20))) as address, s_name as label
  from supplier where s_acctbal > 0""",
}

DRIVER_TABLES = ("orders", "lineitem", "events", "supplier", "customer")

# The constants of the analyses on this binding.
SETTINGS = Settings(fork="2024-01-13", before_fork_end="2024-01-05")


# Schemas by path, so that the footers of a table are asked once and not for every query.
_SCHEMAS: dict[str, StructType] = {}


def driver_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    reader = prepare_session(spark).read
    if path not in _SCHEMAS:
        _SCHEMAS[path] = reader.parquet(path).schema
    return reader.schema(_SCHEMAS[path]).parquet(path)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One chain table over the driver tables of ``sf_dir``."""
    text = VIEWS[name]
    for table in DRIVER_TABLES:
        for word in ("from", "join"):
            text = text.replace(f"{word} {table}", f"{word} {{{table}}}")
    used = {t: driver_table(spark, sf_dir, t) for t in DRIVER_TABLES if f"{{{t}}}" in text}
    return spark.sql(text, **used)


# Field of ChainTables -> view.
BOUND = {
    "transactions": "tx",
    "block_roots": "block_root",
    "block_details": "block_details",
    "tx_details": "tx_details",
    "payloads": "mev",
    "sidecars": "sidecar",
    "block_events": "block_ev",
    "reorgs": "reorg",
    "address_labels": "address_labels",
}


class _OnDemand:
    """ChainTables whose frames are bound when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._from = (spark, sf_dir)
        self.non_mev = None

    def __getattr__(self, name: str) -> DataFrame:
        if name not in BOUND:
            raise AttributeError(name)
        frame = view(*self._from, BOUND[name])
        setattr(self, name, frame)
        return frame


def chain_tables(spark: SparkSession, sf_dir: str) -> ChainTables:
    return _OnDemand(spark, sf_dir)  # type: ignore[return-value]
