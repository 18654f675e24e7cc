"""

Queries read the driver's tables through ``blockscope.fixtures``; each runs over
its whole tables.  Double results are cut to four places in query and oracle.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

sys.path.insert(0, str(Path(__file__).resolve().parent))

import oracle_queries
from blockscope.fixtures import SETTINGS, chain_tables, driver_table, view
from blockscope.functions import scalars
from blockscope.operators import joins, shaping, summaries, windows
from blockscope.operators.quantiles import grouped_median, grouped_quantiles, trim_quantile
from blockscope.plans import arrival, arrival_days, blobs, classified, payments, positions, reorgs, senders
from blockscope.schemas import BLOCK_DETAILS, BLOCK_ROOTS, RECEIPTS, TRANSACTION_DETAILS
from blockscope.session import run_dir, settled
from blockscope.sources import days, landing, layouts, ledger, relays, worklists
from blockscope.streaming import dedup as stream_dedup
from blockscope.streaming import landing as stream_landing

try:
    import corpus_pipeline
    from blockscope.llm import queries as llm_queries
except ModuleNotFoundError as error:
    if not (error.name or "").startswith(("corpus_pipeline", "blockscope.llm")):
        raise
    corpus_pipeline = llm_queries = None

Query = Callable[[SparkSession, str], DataFrame]

SMOKE_DIR = "/root/testdata/sf0.001"
RELAYS = ("a", "b", "c")
WORK_SINCE = "2000-01-01"
_REGISTRY: dict[str, Query] = {}


def cut(value: Column, places: int = 4) -> Column:
    """To ``places`` decimals.  The odd offset keeps halves away from the cut: a plain round
    would let the last bit of a sum, which depends on row order, decide them."""
    scale = 10.0**places
    return F.floor(value * scale + 0.37) / scale


def cut_columns(df: DataFrame, *names: str, places: int = 4) -> DataFrame:
    return df.withColumns({n: cut(F.col(n), places) for n in names})


def query(fn: Query) -> Query:
    """Register under the function's name, less the underscore that keeps a name free."""
    _REGISTRY[fn.__name__.rstrip("_")] = fn
    return fn


def plan(name: str, build: Callable, *cut_names: str) -> None:
    """Register a named analysis over the bound chain tables."""
    _REGISTRY[name] = lambda spark, d: cut_columns(build(chain_tables(spark, d)), *cut_names)


# --- blobs, gas, size ------------------------------------------------------------------------
plan("blobs_per_block", lambda t: blobs.blobs_per(t, "block_root"))
plan("blobs_per_txn", lambda t: blobs.blobs_per(t, "hash"))
plan("block_txn_stats", blobs.block_transaction_stats, "total_txn_size")
plan("txns_by_blobs", blobs.trimmed_transactions_by_blobs)
plan("gas_by_blobs_rows", blobs.gas_rows)
plan("gas_by_blobs_mean", blobs.gas_summary, "gas_used")
LEAST_BUCKETS = 8
plan("gas_by_blobs_buckets", lambda t: blobs.gas_rows(layouts.bucketed_chain(t, LEAST_BUCKETS)))
plan("gas_by_blobs_nonmev_rows", lambda t: blobs.gas_rows(t, mev=False))
plan("gas_by_blobs_nonmev_mean", lambda t: blobs.gas_summary(t, mev=False), "gas_used")
plan("gas_by_blobs_mev_rows", lambda t: blobs.gas_rows(t, mev=True))
plan(
    "gas_by_blobs_median",
    lambda t: blobs.gas_summary(t, mev=True, statistic="median"),
    "gas_used",
)
plan("gas_by_blobs_series", blobs.gas_series, "gas_used")
plan("size_by_blobs", blobs.size_by_blobs, "size")
plan("non_mev_blocks", blobs.non_mev_blocks)
plan(
    "mev_tags",
    lambda t: joins.member_tags(
        t.block_details, t.payloads.select(F.col("block_hash").alias("hash")), "hash", "extra_data"
    ),
)
plan("half_empty_blobs", blobs.half_empty_blobs)
plan("half_empty_blobs_by_sender", lambda t: blobs.half_empty_blobs(t, senders=t.address_labels))
plan("empty_ratio_by_blobs", blobs.empty_ratio_by_blobs)
ONE_SENDER = "0xAB7"
plan("half_empty_blobs_one_sender", lambda t: blobs.half_empty_blobs(t, address=ONE_SENDER))
plan("empty_ratio_one_sender", lambda t: blobs.empty_ratio_by_blobs(t, address=ONE_SENDER))
plan(
    "empty_ratio_by_sender", lambda t: blobs.empty_ratio_by_blobs(t, senders=t.address_labels)
)

BOX = ("q1", "median", "q3", "whisker_lo", "whisker_hi")
plan("box_stats", blobs.gas_box, *BOX)
plan("gas_nonmev_box", lambda t: blobs.gas_box(t, mev=False), *BOX)
plan("gas_mev_box", lambda t: blobs.gas_box(t, mev=True), *BOX)
plan("size_box", blobs.size_box, *BOX)

# --- the ways for large groups and hot keys, forced ---------------------------------------------
plan(
    "gas_by_blobs_median_ranges",
    lambda t: grouped_quantiles(blobs.gas_rows(t, mev=True), ["num_blobs"], "gas_used", {"gas_used": 0.5}, 0),
    "gas_used",
)
plan("box_stats_ranges", lambda t: summaries.box_stats(blobs.gas_rows(t), "num_blobs", "gas_used", 0), *BOX)


def _every_repeated(df: DataFrame, *on: str) -> DataFrame:
    """Keys with more than a few of the rows, as if they were hot."""
    return joins.hot_keys(df, on, share=8000, min_rows=2, rate=1)


plan("non_mev_blocks_hot", lambda t: blobs.non_mev_blocks(t, _every_repeated(t.block_details, "extra_data")))
plan(
    "sender_blob_txns_hot",
    lambda t: senders.sender_blobs(
        t,
        t.address_labels,
        hot=_every_repeated(
            t.transactions.select(scalars.normal_address(F.col("to_addr")).alias("address")), "address"
        ),
    ),
)

# --- positions -------------------------------------------------------------------------------
plan("blob_position", positions.blob_position)
plan("blob_position_hist", positions.blob_position_histogram, "lo", "hi", "density")
plan("relative_position", positions.relative_position)
plan("relative_position_hist", positions.relative_position_histogram, "lo", "hi", "density")

# --- arrival ---------------------------------------------------------------------------------
plan(
    "client_arrival",
    lambda t: arrival.client_arrival(t.sidecars, ["block_root", "client"], SETTINGS.arrival_ms),
    "blob_prop_time",
)
plan("prop_by_blobs", lambda t: arrival.arrival_by_blobs(t, SETTINGS), "propagation_sec")
plan("prop_by_blobs_mev", lambda t: arrival.arrival_by_blobs(t, SETTINGS, mev=True), "propagation_sec")
plan(
    "prop_by_blobs_nonmev", lambda t: arrival.arrival_by_blobs(t, SETTINGS, mev=False), "propagation_sec"
)
plan("prop_by_blobs_series", lambda t: arrival.arrival_series(t, SETTINGS), "propagation_sec")
plan("prop_full", lambda t: arrival.arrival_by_blobs_all_blocks(t, SETTINGS), "propagation_sec")
plan("prop_over_time", lambda t: arrival.arrival_over_time(t, SETTINGS), "propagation_sec")
plan(
    "block_prop_all", lambda t: arrival.block_arrival_with_blobs(t, SETTINGS, q=0.99), "propagation_sec"
)
plan(
    "block_prop_nonmev",
    lambda t: arrival.block_arrival_with_blobs(t, SETTINGS, mev=False),
    "propagation_sec",
)
plan(
    "slot_prop_txns_mev",
    lambda t: arrival.slot_arrival_transactions_payments(t, SETTINGS),
    "value",
    "propagation_sec",
)
plan("mev_vs_prop", lambda t: arrival.payment_by_arrival(t, SETTINGS), "propagation_sec", "value")
plan(
    "mev_prop_bins",
    lambda t: arrival.payment_arrival_bins(t, SETTINGS),
    "bin_center",
    "median_value",
)
plan("last_arrival_summary", lambda t: arrival.last_arrival_summary(t, SETTINGS), "mean", "median")
plan("mev_prop_line", lambda t: arrival.payment_arrival_line(t, SETTINGS), "slope", "intercept", "r2")
plan(
    "mev_median_hist",
    lambda t: arrival.payment_median_histogram(t, SETTINGS).drop("density"),
    "lo",
    "hi",
)
plan("mev_median_density", lambda t: arrival.payment_median_density(t, SETTINGS), "x", "density")
plan(
    "last_arrival_density",
    lambda t: arrival.last_arrival_density(t, SETTINGS),
    "lo",
    "hi",
    "density",
)
plan(
    "last_arrival_box",
    lambda t: arrival.last_arrival_box(t, SETTINGS),
    *BOX,
)

# --- tips and payments -----------------------------------------------------------------------
_REGISTRY["miner_tip"] = lambda spark, d: payments.miner_tip(chain_tables(spark, d)).withColumn(
    "miner_tip", F.col("miner_tip").cast("bigint")
)
_REGISTRY["mev_by_blobs"] = lambda spark, d: payments.payment_by_blobs(chain_tables(spark, d))

_REGISTRY["miner_tip_hot"] = lambda spark, d: payments.miner_tip(
    chain_tables(spark, d), hot=_every_repeated(view(spark, d, "tx_details"), "block_hash")
).withColumn("miner_tip", F.col("miner_tip").cast("bigint"))
plan("miner_tip_box", payments.tip_box, *BOX)
_REGISTRY["mev_box"] = lambda spark, d: cut_columns(
    payments.payment_box(chain_tables(spark, d)), *BOX, places=18
)

# --- senders ---------------------------------------------------------------------------------
plan("posting_gap", lambda t: senders.posting_gap(t, t.address_labels))
plan("sender_blob_txns", lambda t: senders.sender_blobs(t, t.address_labels))
plan("top_senders", senders.top_senders)
plan("top_sender_behaviour", senders.top_sender_behaviour, "num_blob_per_txn")
plan("histogram_edges_by_sender", lambda t: senders.posting_gap_histogram(t, t.address_labels))
plan("blobs_per_post_hist", lambda t: senders.blobs_per_post_histogram(t, t.address_labels))

# --- reorgs ----------------------------------------------------------------------------------
plan("reorg_mean_country", lambda t: reorgs.reorgs_mean_country(t, SETTINGS), "num_of_reorg_events")
plan("reorg_by_country", lambda t: reorgs.reorgs_by_country(t, SETTINGS))
plan("reorg_vs_blobs", lambda t: reorgs.reorgs_vs_blobs(t, SETTINGS))
plan("line_series", lambda t: reorgs.reorg_line(t, SETTINGS), "mean")
plan("reorg_box", lambda t: reorgs.reorg_box(t, SETTINGS), *BOX)


# --- generic operators -----------------------------------------------------------------------
@query
def scan_project_filter(spark: SparkSession, d: str) -> DataFrame:
    return shaping.scan(
        view(spark, d, "tx"),
        ["block_root", "position", "blob_gas"],
        where=F.col("type") == 3,
    )


@query
def prop_bound(spark: SparkSession, d: str) -> DataFrame:
    bounded = shaping.at_most(view(spark, d, "sidecar"), "diff_ms", SETTINGS.tight_arrival_ms)
    return cut_columns(bounded.select("block_root", "client", "diff_ms"), "diff_ms")


@query
def time_range(spark: SparkSession, d: str) -> DataFrame:
    since = shaping.time_range(view(spark, d, "block_ev"), "slot_start", start=SETTINGS.fork)
    return cut_columns(since.select("block", "client", "diff_ms"), "diff_ms")


@query
def facet_split(spark: SparkSession, d: str) -> DataFrame:
    return shaping.facet(view(spark, d, "reorg"), "impl", SETTINGS.impl).select("slot", "impl")


@query
def trim_quantile_(spark: SparkSession, d: str) -> DataFrame:
    sizes = view(spark, d, "block_details").select("hash", "size")
    return cut_columns(trim_quantile(sizes, "size", 0.95), "size")


@query
def trim_quantile_ranges(spark: SparkSession, d: str) -> DataFrame:
    sizes = view(spark, d, "block_details").select("hash", "size")
    return cut_columns(trim_quantile(sizes, "size", 0.95, in_memory=0, settle=True), "size")


@query
def finite_pairs(spark: SparkSession, d: str) -> DataFrame:
    pairs = view(spark, d, "tx").select(
        F.when(F.col("full_size") == 0, "n/a")
        .otherwise(scalars.safe_ratio(F.col("empty_size"), F.col("full_size")).cast("string"))
        .alias("x"),
        F.when((F.col("type") == 2) & (F.col("empty_size") > 0.05), "Infinity")
        .otherwise(F.col("size").cast("string"))
        .alias("y"),
    )
    return cut_columns(shaping.finite_pairs(pairs, "x", "y"), "x", "y")


@query
def left_join_fill(spark: SparkSession, d: str) -> DataFrame:
    gas = view(spark, d, "block_details").select(F.col("hash").alias("block_hash"), "gas_used")
    joined = joins.left_join_fill(
        view(spark, d, "block_root"), gas, ["block_hash"], fill={"gas_used": 0.0}
    )
    return cut_columns(joined.select("block_root", "gas_used"), "gas_used")


@query
def full_join_fill(spark: SparkSession, d: str) -> DataFrame:
    t = chain_tables(spark, d)
    keys = ["block_root", "client"]
    blobs_seen = arrival.client_arrival(t.sidecars, keys, SETTINGS.arrival_ms)
    blocks_seen = arrival.block_arrival(
        t.block_events, ["block", "client"], SETTINGS.fork, SETTINGS.arrival_ms
    ).withColumnRenamed("block", "block_root")
    joined = joins.full_join_fill(
        blobs_seen,
        blocks_seen,
        keys,
        left_fill={"blob_prop_time": 0.0, "num_of_blobs": 0},
        right_fill={"block_prop_time": 0.0},
    )
    return cut_columns(joined.drop("in_left", "in_right"), "blob_prop_time", "block_prop_time")


@query
def gap_to_previous(spark: SparkSession, d: str) -> DataFrame:
    t = chain_tables(spark, d)
    posts = senders.sender_blobs(t, t.address_labels).select("address", "slot")
    return windows.gap_to_previous(posts, ["address"], "slot", "slot_increment")


@query
def gap_to_previous_null_group(spark: SparkSession, d: str) -> DataFrame:
    """Some senders are one NULL group; stretches are short, so most gaps cross an edge."""
    t = chain_tables(spark, d)
    posts = senders.sender_blobs(t, t.address_labels)
    known = F.when(F.length("address") > 4, F.col("address"))
    slots = posts.select(known.alias("address"), "slot").distinct()
    return windows.gap_to_previous(slots, ["address"], "slot", "slot_increment", stretch=7)


@query
def binned_median(spark: SparkSession, d: str) -> DataFrame:
    pairs = driver_table(spark, d, "events").select(
        (F.col("value") / 100).alias("x"), F.col("value").alias("y")
    )
    return cut_columns(
        summaries.binned_median(pairs, "x", "y", 0, 4, 100), "bin_center", "median_value"
    )


@query
def regression_line(spark: SparkSession, d: str) -> DataFrame:
    pairs = view(spark, d, "tx").select(scalars.blobs(F.col("blob_gas")).alias("x"), "size")
    return cut_columns(summaries.regression_line(pairs, "x", "size"), "slope", "intercept", "r2")


@query
def histogram_equal_width(spark: SparkSession, d: str) -> DataFrame:
    h = summaries.histogram(driver_table(spark, d, "events"), "value", 50)
    return cut_columns(h.drop("density"), "lo", "hi")


@query
def histogram_density(spark: SparkSession, d: str) -> DataFrame:
    h = summaries.histogram(driver_table(spark, d, "events"), "value", 1000)
    return cut_columns(cut_columns(h.drop("n"), "lo", "hi"), "density", places=8)


@query
def box_outliers(spark: SparkSession, d: str) -> DataFrame:
    rows = driver_table(spark, d, "events").select("event_id", "event_type", "value")
    return cut_columns(
        summaries.box_outliers(rows, "event_type", "value", spread=["event_id"]), "value"
    )


@query
def kde_grid(spark: SparkSession, d: str) -> DataFrame:
    medians = grouped_median(driver_table(spark, d, "events"), ["user_id"], "value", "m")
    return cut_columns(summaries.kde_grid(medians, "m"), "x", "density")


@query
def kde_binned(spark: SparkSession, d: str) -> DataFrame:
    """The density curve of all values, in parts of its peak."""
    curve = summaries.kde_binned(driver_table(spark, d, "events"), "value")
    peak = F.max("density").over(Window.partitionBy(F.lit(0)))  # over the curve's 200 points
    return curve.select("point", cut(F.col("x")).alias("x"), cut(F.col("density") / peak, 2).alias("height"))


@query
def hex_to_int(spark: SparkSession, d: str) -> DataFrame:
    orders = driver_table(spark, d, "orders")
    short = F.hex("o_orderkey")
    text = (
        F.when(F.col("o_orderpriority") == "1-URGENT", scalars.int_to_hex(F.col("o_orderkey")))
        .when(F.col("o_orderpriority") == "2-HIGH", F.concat(F.lit("0x00"), short))
        .when(F.col("o_orderpriority") == "3-MEDIUM", F.col("o_orderkey").cast("string"))
        .when(F.col("o_orderpriority") == "5-LOW", F.concat(F.lit("0x"), short, F.lit("0" * 16)))
        .otherwise("n/a")
    )
    return orders.select(
        F.col("o_orderkey").alias("key"), scalars.hex_to_int(text).cast("string").alias("value")
    )


@query
def hex_to_int_long(spark: SparkSession, d: str) -> DataFrame:
    """Runs of leading zeros as long as the order's total, and white space around every other number."""
    zeros = F.repeat(F.lit("0"), F.floor(F.col("o_totalprice") / 100).cast("int"))
    text = F.concat(F.lit("0x"), zeros, F.hex(F.col("o_orderkey").cast("bigint")))
    text = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit(" "), text, F.lit("\n"))).otherwise(text)
    return driver_table(spark, d, "orders").select(
        F.col("o_orderkey").alias("key"), scalars.hex_to_int(text).cast("string").alias("value")
    )


@query
def int_to_hex(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey")
    return driver_table(spark, d, "orders").select(
        key.alias("key"), scalars.int_to_hex(key).alias("value")
    )


@query
def bytes_to_text(spark: SparkSession, d: str) -> DataFrame:
    return driver_table(spark, d, "orders").select(
        F.col("o_orderkey").alias("key"),
        scalars.bytes_to_text(F.encode("o_orderpriority", "utf-8")).alias("value"),
    )


# --- work lists ------------------------------------------------------------------------------
@query
def work_list(spark: SparkSession, d: str) -> DataFrame:
    return worklists.work_list(view(spark, d, "tx"), "hash", F.col("type") == 3)


@query
def work_list_since(spark: SparkSession, d: str) -> DataFrame:
    recent = (F.col("type") == 3) & (F.col("epoch_start") >= F.lit(WORK_SINCE).cast("timestamp"))
    return worklists.work_list(view(spark, d, "tx"), "hash", recent)


@query
def work_list_remaining(spark: SparkSession, d: str) -> DataFrame:
    known = view(spark, d, "block_details").select(F.col("hash").alias("block_hash"))
    landed = view(spark, d, "tx_details").join(known, "block_hash", "left_semi")
    return worklists.remaining(work_list(spark, d), landed, "hash")


@query
def number_work_list(spark: SparkSession, d: str) -> DataFrame:
    """Every order number up to the largest one."""
    top = driver_table(spark, d, "orders").agg(F.max("o_orderkey")).first()[0]
    return worklists.number_work_list(spark, 0, (top or 0) + 1)


@query
def low_water_mark(spark: SparkSession, d: str) -> DataFrame:
    return worklists.low_water_mark(view(spark, d, "mev"), "slot")


# --- daily files -----------------------------------------------------------------------------
DAY_TEMPLATE = "{root}/date={date}"
MONTH = ("2024-01-01", "2024-01-30")


def _day_files(spark: SparkSession, d: str, path: str) -> DataFrame:
    """``events`` as a folder per day below ``path``; returns the rows written."""
    daily = driver_table(spark, d, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", F.to_date("ts").alias("date")
    )
    days.full_refresh(daily, path, by=["date"])
    return daily


@query
def load_day_range(spark: SparkSession, d: str) -> DataFrame:
    path = run_dir(spark, "days")
    _day_files(spark, d, path)
    return days.load_day_range(spark, path, *MONTH, DAY_TEMPLATE).select("event_id", "ts", "user_id")


@query
def load_days_over_month_end(spark: SparkSession, d: str) -> DataFrame:
    """Twenty days later the events cross a month end; the range starts and stops inside them."""
    path = run_dir(spark, "month-end")
    events = driver_table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    later = events.withColumn("ts", F.col("ts") + F.expr("interval 20 days"))
    days.full_refresh(later.withColumn("date", F.to_date("ts")), path, by=["date"])
    return days.load_day_range(spark, path, "2024-01-28", "2024-02-03", DAY_TEMPLATE).select("event_id", "ts")


def _per_day(lines: DataFrame) -> DataFrame:
    day = F.regexp_extract("file", "date=([0-9-]{10})", 1).cast("date")
    return lines.groupBy(day.alias("day")).agg(F.sum("rows").alias("rows"))


@query
def load_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Two loads, logged one after the other; the log is read back from its own files."""
    path, log = run_dir(spark, "manifest"), run_dir(spark, "load-log")
    _day_files(spark, d, path)
    for half in ((MONTH[0], "2024-01-15"), ("2024-01-16", MONTH[1])):
        lines = days.log_load(days.load_day_range(spark, path, *half, DAY_TEMPLATE), "events", log)
    return _per_day(lines)


@query
def full_refresh(spark: SparkSession, d: str) -> DataFrame:
    path = run_dir(spark, "refresh")
    daily = _day_files(spark, d, path)
    days.full_refresh(daily.where(F.col("date") >= SETTINGS.fork), path, by=["date"])
    return _per_day(days.load_manifest(spark.read.parquet(path)))


@query
def load_repeated(spark: SparkSession, d: str) -> DataFrame:
    """Rows a day after a load, the same load again, one that was cut short, and one of a changed day."""
    path, root = run_dir(spark, "deliveries"), run_dir(spark, "loads")
    daily = _day_files(spark, d, path)
    first = days.day_paths(path, MONTH[0], "2024-01-15", DAY_TEMPLATE)
    every = days.day_paths(path, *MONTH, DAY_TEMPLATE)
    for paths in (first, first):
        days.load_new(spark, root, paths)
    # rows without a line in the log, as a load leaves them that ends before its last step
    spark.read.parquet(*every).withColumns({"source_file": F.lit("f"), "source": F.lit("s")}).write.parquet(f"{root}/rows/load=2")
    days.load_new(spark, root, every)
    changed = daily.where(F.col("date") == MONTH[0])
    days.full_refresh(changed.unionByName(changed), path, by=["date"])
    days.load_new(spark, root, every)
    rows = days.loaded(spark, root)
    return rows.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("rows"))


@query
def refresh_under_readers(spark: SparkSession, d: str) -> DataFrame:
    """Orders by status as a reader sees them that began before a refresh, and one that began after it."""
    root = run_dir(spark, "versions")
    orders = driver_table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    days.refresh(orders, root)
    before = days.current(spark, root)
    days.refresh(orders.where(F.col("o_orderstatus") != "P"), root)
    seen = before.withColumn("reader", F.lit("before")).unionByName(
        days.current(spark, root).withColumn("reader", F.lit("after"))
    )
    return seen.groupBy("reader", "o_orderstatus").agg(F.count(F.lit(1)).alias("rows"))


# --- landed responses ------------------------------------------------------------------------
def _hex(column: Column) -> Column:
    return scalars.int_to_hex(column.cast("bigint"))


def _responses(orders: DataFrame, fields: dict[str, Column], path: tuple[str, ...]) -> DataFrame:
    """A response line per order.  Orders of status P fail, each priority in its own way."""
    body = F.struct(*[c.alias(n) for n, c in fields.items()])
    for name in reversed(path):
        body = F.struct(body.alias(name))
    failed = F.col("o_orderstatus") == "P"
    way = F.col("o_orderpriority")
    text = (
        F.when(failed & (way == "1-URGENT"), '{"error": {"code": -32000}}')
        .when(failed & (way == "2-HIGH"), '{"error": "busy"}')
        .when(failed & (way == "3-MEDIUM"), '{"result": ')
        .otherwise(F.to_json(body))
    )
    status = F.when(failed & (way == "2-HIGH"), 503).otherwise(200)
    return orders.select(
        F.concat(F.lit("k"), F.col("o_orderkey")).alias("key"),
        F.lit(1).alias("attempt"),
        status.alias("status"),
        text.alias("body"),
    )


def _or_bad(good: Column) -> Column:
    bad = (F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "4-NOT SPECIFIED")
    return F.when(bad, F.lit("0xzz")).otherwise(good)


def _order_hash(prefix: str) -> Column:
    return F.concat(F.lit(prefix), F.col("o_orderkey").cast("string"))


def _receipt_fields() -> dict[str, Column]:
    key = F.col("o_orderkey")
    return {
        "blockHash": _order_hash("0xb"),
        "blockNumber": _or_bad(_hex(key)),
        "contractAddress": F.lit(None).cast("string"),
        "cumulativeGasUsed": _hex(F.floor(F.col("o_totalprice") * 100)),
        "effectiveGasPrice": F.concat(F.lit("0x"), F.hex(key), F.lit("0" * 16)),
        "from": _order_hash("0xf"),
        "gasUsed": _hex(F.floor("o_totalprice")),
        "status": F.lit("0x1"),
        "to": F.when(F.col("o_orderpriority") != "5-LOW", _order_hash("0xt")),
        "transactionHash": _order_hash("0x"),
        "transactionIndex": _hex(F.col("o_custkey")),
        "type": F.lit("0x3"),
    }


def _block_fields() -> dict[str, Column]:
    key = F.col("o_orderkey")
    return {
        "baseFeePerGas": _or_bad(_hex(F.floor(F.col("o_totalprice") * 10))),
        "blobGasUsed": F.when(F.col("o_orderpriority") != "5-LOW", _hex(key * 131072)),
        "excessBlobGas": F.lit(None).cast("string"),
        "extraData": F.concat(F.lit("tag"), F.col("o_custkey").cast("string")),
        "gasLimit": F.lit("0x1c9c380"),
        "gasUsed": _hex(F.floor("o_totalprice")),
        "hash": _order_hash("0xb"),
        "miner": _order_hash("0xm"),
        "number": _hex(key),
        "receiptsRoot": _order_hash("0xr"),
        "size": _hex(F.floor(F.col("o_totalprice") / 10)),
        "timestamp": _hex(F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))),
    }


def _transaction_fields() -> dict[str, Column]:
    key = F.col("o_orderkey")
    return {
        "blockHash": _order_hash("0xb"),
        "blockNumber": _or_bad(_hex(key)),
        "chainId": F.lit("0x1"),
        "from": _order_hash("0xf"),
        "gas": _hex(F.floor("o_totalprice")),
        "gasPrice": _hex(F.floor(F.col("o_totalprice") * 10)),
        "hash": _order_hash("0x"),
        "maxFeePerGas": F.concat(F.lit("0x"), F.hex(key), F.lit("0" * 16)),
        "maxPriorityFeePerGas": _hex(F.floor(F.col("o_totalprice") * 100)),
        "nonce": _hex(F.col("o_custkey")),
        "to": _order_hash("0xt"),
        "transactionIndex": _hex(F.col("o_custkey")),
        "type": F.lit("0x3"),
        "value": F.concat(F.lit("0x"), F.hex(key), F.lit("f" * 16)),
    }


def _header_fields() -> dict[str, Column]:
    """Decimal text numbers; some fields are absent, some text is all digits."""
    key = F.col("o_orderkey").cast("string")
    low = F.col("o_orderpriority") == "5-LOW"
    return {
        "parent_hash": F.when(~low, _order_hash("0xp")),
        "fee_recipient": key,
        "state_root": _order_hash("0xs"),
        "block_number": _or_bad(key),
        "gas_limit": F.lit("30000000"),
        "gas_used": F.when(~low, F.floor("o_totalprice").cast("string")),
        "extra_data": F.concat(F.lit("tag"), F.col("o_custkey").cast("string")),
        "base_fee_per_gas": F.floor(F.col("o_totalprice") * 10).cast("string"),
        "block_hash": _order_hash("0xb"),
        "blob_gas_used": F.when(~low, F.lit("131072")),
    }


def _landed(
    spark: SparkSession, d: str, fields: dict[str, Column], path: tuple[str, ...] = ("result",)
) -> DataFrame:
    """Response lines written to a landing folder and read back."""
    folder = run_dir(spark, "landing")
    _responses(driver_table(spark, d, "orders"), fields, path).write.json(folder)
    return landing.read_landed(spark, folder)


def _plain(df: DataFrame) -> DataFrame:
    """Wide numbers as text, which both engines write alike."""
    wide = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DecimalType)]
    return df.withColumns({n: F.col(n).cast("string") for n in wide})


@query
def land_receipts(spark: SparkSession, d: str) -> DataFrame:
    return _plain(landing.land_rpc(_landed(spark, d, _receipt_fields()), RECEIPTS).good.drop("attempt"))


@query
def land_blocks(spark: SparkSession, d: str) -> DataFrame:
    return _plain(landing.land_rpc(_landed(spark, d, _block_fields()), BLOCK_DETAILS).good.drop("attempt"))


@query
def land_transactions(spark: SparkSession, d: str) -> DataFrame:
    raw = _landed(spark, d, _transaction_fields())
    return _plain(landing.land_rpc(raw, TRANSACTION_DETAILS).good.drop("attempt"))


@query
def land_payload_header(spark: SparkSession, d: str) -> DataFrame:
    raw = _landed(spark, d, _header_fields(), landing.HEADER_PATH)
    return _plain(
        landing.land_headers(raw).good.select(
            "block_root", "block_hash", "block_number", "extra_data", "base_fee_per_gas", "blob_gas_used"
        )
    )


@query
def payload_defaults(spark: SparkSession, d: str) -> DataFrame:
    raw = _landed(spark, d, _header_fields(), landing.HEADER_PATH)
    return _plain(landing.land_headers(raw).good.select(*[f.name for f in BLOCK_ROOTS.fields]))


@query
def split_rejects(spark: SparkSession, d: str) -> DataFrame:
    landed = landing.land_rpc(_landed(spark, d, _receipt_fields()), RECEIPTS)
    kinds = landed.good.select(F.lit("good").alias("status"), F.lit("").alias("reason")).unionByName(
        landed.rejects.select(F.lit("reject").alias("status"), "reason")
    )
    return kinds.groupBy("status", "reason").agg(F.count(F.lit(1)).alias("rows"))


@query
def retry_list(spark: SparkSession, d: str) -> DataFrame:
    landed = landing.land_rpc(_landed(spark, d, _receipt_fields()), RECEIPTS)
    return landing.retry_list(landed)


# --- results kept up to date --------------------------------------------------------------------
PERIODS = ("2024-01-01", "2024-01-11", "2024-01-21", None)


@query
def prop_by_blobs_kept(spark: SparkSession, d: str) -> DataFrame:
    """Three periods added one by one, the second of them twice; the result reads their partial rows alone."""
    path, t = run_dir(spark, "periods"), chain_tables(spark, d)
    for k in (0, 1, 1, 2):
        arrival_days.add_period(t, path, PERIODS[k], PERIODS[k + 1], SETTINGS)
    return cut_columns(arrival_days.arrival_by_blobs_kept(spark, path), "propagation_sec")


@query
def arrival_sketches(spark: SparkSession, d: str) -> DataFrame:
    """A sketch per day and blob index, stored; over half a month its ranks are within two in a hundred."""
    path, seen = run_dir(spark, "sketches"), view(spark, d, "sidecar")
    arrival_days.period_sketches(seen, "slot_start", ["blob_index"], "diff_ms").write.parquet(path)
    wanted = {"median": 0.5, "p95": 0.95}
    half = shaping.time_range(spark.read.parquet(path), "slot_start", "2024-01-05", "2024-01-20")
    merged = arrival_days.merged_quantiles(half, ["blob_index"], wanted)
    rows = shaping.time_range(seen, "slot_start", "2024-01-05", "2024-01-20").join(F.broadcast(merged), "blob_index")

    def within(name: str) -> Column:
        below, upto = F.count_if(F.col("diff_ms") < F.col(name)), F.count_if(F.col("diff_ms") <= F.col(name))
        near = F.lit(wanted[name]).between(below / F.count(F.lit(1)) - 0.02, upto / F.count(F.lit(1)) + 0.02)
        return near.alias(f"{name}_within")

    return rows.groupBy("blob_index", "n").agg(*[within(name) for name in wanted])


@query
def gas_by_blobs_mev_kept(spark: SparkSession, d: str) -> DataFrame:
    """Classes refreshed over three loads, in which payloads come before and after their blocks."""
    path, t = run_dir(spark, "classes"), chain_tables(spark, d)
    times, values = (None, "1997-01-01", "1999-06-01", None), (0, 165_000, 330_000, 1e18)
    for k in (0, 1, 1, 2):
        some = shaping.time_range(t.block_details, "block_time", times[k], times[k + 1])
        paid = t.payloads.where((F.col("value") >= values[k]) & (F.col("value") < values[k + 1]))
        classified.classify_load(path, k, some, paid)
    t.non_mev = classified.non_mev_kept(spark, path)
    return blobs.gas_rows(t, mev=True)


@query
def attempt_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Six landings of what is still open, the third of them recorded twice; some keys never succeed."""
    path, kinds = run_dir(spark, "ledger"), "key bigint, part string"
    orders = driver_table(spark, d, "orders")
    fails = F.when(F.col("o_orderpriority") == "5-LOW", 99)
    for priority, n in (("2-HIGH", 1), ("3-MEDIUM", 3), ("4-NOT SPECIFIED", 5)):
        fails = fails.when(F.col("o_orderpriority") == priority, n)
    work = orders.select(
        F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("part"), fails.otherwise(0).alias("fails")
    )
    for number in range(1, landing.MAX_TRIES + 1):
        asked = ledger.open_keys(work, ledger.read_ledger(spark, path, kinds))
        tried = settled(asked.select("key", "part", (F.col("fails") < number).alias("done")))
        for _ in range(2 if number == 3 else 1):
            ledger.record_attempts(spark, path, tried, number)
    found = ledger.read_ledger(spark, path, kinds)
    lost = ledger.given_up(found).select("key", F.lit(True).alias("given_up"))
    return found.select("key", "tries", "done").join(lost, "key", "left").fillna(False, ["given_up"])


# --- relays and layouts ----------------------------------------------------------------------
@query
def relay_union_dedup(spark: SparkSession, d: str) -> DataFrame:
    bids = relays.first_reports(view(spark, d, "relay_bids"), RELAYS)
    return cut_columns(bids.select("block_hash", "relay", "value"), "value")


_PAGE_SCHEMA = T.StructType(
    [
        T.StructField("slot", T.LongType()),
        T.StructField("block_hash", T.LongType()),
        T.StructField("value", T.DoubleType()),
    ]
)


@query
def land_relay_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages of a hundred slots, numbers as text, written per relay and read back as one union."""
    path = run_dir(spark, "pages")
    bid = F.struct(*[F.col(f.name).cast("string").alias(f.name) for f in _PAGE_SCHEMA.fields])
    pages = (
        view(spark, d, "relay_bids")
        .groupBy("relay", F.floor(F.col("slot") / 100).alias("page"))
        .agg(F.to_json(F.collect_list(bid)).alias("value"))
    )
    pages.drop("page").write.partitionBy("relay").text(path)
    bids = relays.read_relay_pages(spark, path, _PAGE_SCHEMA, page_per_line=True)
    kept = relays.first_reports(bids, RELAYS)
    return cut_columns(kept.select("block_hash", "relay", "value"), "value")


@query
def relay_page_rejects(spark: SparkSession, d: str) -> DataFrame:
    """Pages with unreadable numbers, and pages cut off; counted by relay and outcome."""
    path = run_dir(spark, "bad-pages")
    bids = view(spark, d, "relay_bids")
    slot = F.when(F.col("slot") % 50 == 7, F.lit("0xzz")).otherwise(F.col("slot").cast("string"))
    bid = F.struct(slot.alias("slot"), *[F.col(c).cast("string").alias(c) for c in ("block_hash", "value")])
    pages = bids.groupBy("relay", F.floor(F.col("slot") / 100).alias("page")).agg(
        F.to_json(F.collect_list(bid)).alias("text")
    )
    text = F.when(F.col("page") % 10 == 3, F.lit("[{\"slot\": ")).otherwise(F.col("text"))
    pages.select("relay", text.alias("value")).write.partitionBy("relay").text(path)
    landed = relays.land_relay_pages(spark, path, _PAGE_SCHEMA, page_per_line=True)
    good = landed.good.select("relay", F.lit("good").alias("outcome"))
    every = good.unionByName(landed.rejects.select("relay", F.col("reason").alias("outcome")))
    return every.groupBy("relay", "outcome").agg(F.count(F.lit(1)).alias("rows"))


@query
def relay_unseen_slots(spark: SparkSession, d: str) -> DataFrame:
    """What three walks missed: pages that failed, empty ones, pages that overlap, a walk without a page."""
    bids = view(spark, d, "relay_bids")
    page = F.floor(F.col("slot") / 100)
    # a page in seven also asks for the slots of the one above it
    low = F.when(page % 7 == 2, page * 100 + 60).otherwise(page * 100)
    pages = bids.where(F.col("slot") >= low).groupBy("relay", page.alias("page")).agg(
        F.to_json(F.collect_list(F.struct(F.col("slot").cast("string").alias("slot")))).alias("text")
    )
    cursor = F.col("page") * 100 + F.when(F.col("page") % 7 == 3, 130).otherwise(99)
    failed = F.col("page") % 10 == 3
    pages = pages.select(
        "relay",
        cursor.alias("cursor"),
        F.when(failed, 503).otherwise(200).alias("status"),
        F.when(F.col("page") % 10 == 5, "[]").when(failed, "<html>").otherwise(F.col("text")).alias("text"),
    )
    ends = bids.agg(F.min("slot").alias("low"), F.max("slot").alias("high"))
    walks = ends.select(F.explode(F.array(*map(F.lit, (*RELAYS, "d")))).alias("relay"), "low", "high")
    return relays.unseen_slots(pages, walks)


_BID_SCHEMA = T.StructType(
    [T.StructField("block_hash", T.LongType()), T.StructField("value", T.DoubleType())]
)


@query
def typed_append(spark: SparkSession, d: str) -> DataFrame:
    path = run_dir(spark, "append")
    bids = view(spark, d, "relay_bids")
    layouts.typed_append(bids.where(F.col("relay") == "a"), _BID_SCHEMA, path)
    layouts.typed_append(bids.where(F.col("relay") != "a"), _BID_SCHEMA, path)
    return cut_columns(spark.read.schema(_BID_SCHEMA).parquet(path), "value")


@query
def sorted_layout(spark: SparkSession, d: str) -> DataFrame:
    path = run_dir(spark, "sorted")
    layouts.sorted_layout(view(spark, d, "block_details"), path, ["hash"])
    return cut_columns(spark.read.parquet(path).select("hash", "gas_used", "extra_data"), "gas_used")


@query
def alternate_layout(spark: SparkSession, d: str) -> DataFrame:
    path = run_dir(spark, "alternate")
    layouts.alternate_layout(
        view(spark, d, "sidecar"), path, "impl", ["slot_start"], spread=["block_root", "client"]
    )
    by_impl = spark.read.parquet(path).where(F.col("impl") == SETTINGS.impl)
    return cut_columns(by_impl.select("block_root", "client", "impl", "diff_ms"), "diff_ms")


# --- streams ---------------------------------------------------------------------------------
@query
def stream_landing_(spark: SparkSession, d: str) -> DataFrame:
    home = run_dir(spark, "stream-landing")
    orders = driver_table(spark, d, "orders")
    for drop in ("F", "O", "P"):
        lines = _responses(orders.where(F.col("o_orderstatus") == drop), _receipt_fields(), ("result",))
        lines.write.mode("append").json(f"{home}/in")
        stream_landing.land_new(spark, f"{home}/in", f"{home}/out", f"{home}/checkpoint", RECEIPTS)
    return _plain(stream_landing.landed_rows(spark, f"{home}/out", RECEIPTS).drop("attempt"))


def _bid_drops(spark: SparkSession, d: str, home: str, spans: int = 1):
    """The relays' bids dropped span by span of slots, in each the least preferred relay first.

    Yields the stream and a delay as long as a span.
    """
    bids = view(spark, d, "relay_bids").withColumn("seen", scalars.slot_time(F.col("slot")))
    span = (bids.agg(F.max("slot")).first()[0] or 0) // spans + 1
    for k in range(spans):
        for relay in reversed(RELAYS):
            drop = bids.where((F.col("relay") == relay) & (F.floor(F.col("slot") / span) == k))
            drop.write.mode("append").parquet(f"{home}/in")
            delay = f"{span * scalars.SECONDS_PER_SLOT} seconds"
            yield spark.readStream.schema(bids.schema).parquet(f"{home}/in"), delay


@query
def stream_relay_dedup(spark: SparkSession, d: str) -> DataFrame:
    home = run_dir(spark, "stream-relays")
    order = relays.preference(RELAYS)
    for new, _ in _bid_drops(spark, d, home):
        stream_dedup.run_keep_first(new, ["block_hash"], order, f"{home}/out", f"{home}/checkpoint")
    stream_dedup.compact_log(spark, f"{home}/out", ["block_hash"], order)
    kept = stream_dedup.kept_rows(spark, f"{home}/out", ["block_hash"], order)
    return cut_columns(kept.select("block_hash", "relay", "value"), "value")


@query
def stream_first_arrivals(spark: SparkSession, d: str) -> DataFrame:
    home = run_dir(spark, "stream-first")
    for new, delay in _bid_drops(spark, d, home, spans=3):
        first = stream_dedup.first_arrivals(new, "block_hash", "seen", delay)
        stream_landing.run_available(first, f"{home}/out", f"{home}/checkpoint")
    return cut_columns(
        spark.read.parquet(f"{home}/out").select("block_hash", "relay", "value"), "value"
    )


@query
def stream_relay_corrections(spark: SparkSession, d: str) -> DataFrame:
    """Bids given out as they come and corrected by preferred relays; state goes as slots pass."""
    home = run_dir(spark, "stream-corrections")
    for new, delay in _bid_drops(spark, d, home, spans=2):
        best = stream_dedup.preferred_so_far(new, ["block_hash"], relays.preference(RELAYS), "seen", delay)
        stream_dedup.run_corrections(best, f"{home}/out", f"{home}/checkpoint")
    kept = stream_dedup.corrected_rows(spark, f"{home}/out", ["block_hash"])
    return cut_columns(kept.select("block_hash", "relay", "value"), "value")


def entry(spark: SparkSession) -> DataFrame:
    """Mean gas used per number of blobs."""
    return _REGISTRY["gas_by_blobs_mean"](spark, SMOKE_DIR)


def chain_queries() -> dict[str, Query]:
    """The queries of the chain analyses."""
    return dict(_REGISTRY)


def queries() -> dict[str, Query]:
    if llm_queries is None:
        return chain_queries()
    return chain_queries() | llm_queries.queries() | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    if llm_queries is None:
        return oracle_queries.all_queries()
    whole = {} if corpus_pipeline.ORACLE_SQL is None else {"pipeline": corpus_pipeline.ORACLE_SQL}
    return oracle_queries.all_queries() | llm_queries.oracle_sql() | whole
