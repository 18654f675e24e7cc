"""Rules that no constant may break: prefixes, edges, size switches, declared layouts, bounded state."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockscope import schemas
from blockscope.functions import scalars
from blockscope.operators import quantiles, windows
from blockscope.session import settled
from blockscope.sources import days, landing, relays
from blockscope.streaming import dedup
from blockscope.streaming import landing as stream_landing


def test_leading_zeros_of_any_number(values):
    text = F.concat(F.lit("0x"), F.repeat(F.lit("0"), F.lit((1 << 20) + 7)), F.lit("ff"))
    assert values(scalars.hex_to_int(text))[0] == 255


@pytest.mark.parametrize("group", [None, "a"])
def test_gap_over_a_stretch_edge(spark, group):
    df = spark.createDataFrame([(group, 99_999), (group, 100_001)], "g string, v long")
    got = windows.gap_to_previous(df, ["g"], "v", "gap")
    assert sorted(r.gap or 0 for r in got.collect()) == [0, 2]


def test_both_quantile_ways_agree_to_the_last_bit(spark):
    rng = np.random.default_rng(7)
    rows = [(int(g), float(v)) for g, v in zip(rng.integers(0, 7, 20_001), rng.lognormal(5, 2, 20_001))]
    df = spark.createDataFrame(rows, "g int, v double")
    wanted = {"a": 0.01, "b": 0.25, "c": 0.5, "d": 0.95}
    for by in (["g"], []):
        one = quantiles.grouped_quantiles(df, by, "v", wanted).collect()
        for in_memory in (0, 2850):  # all groups cut, and some of them
            other = quantiles.grouped_quantiles(df, by, "v", wanted, in_memory).collect()
            assert sorted(map(tuple, one)) == sorted(map(tuple, other))


def test_many_small_groups_are_one_aggregate(spark, monkeypatch):
    """A bound on the largest group, not on the total."""
    df = spark.range(30_000).select((F.col("id") % 10_000).alias("g"), F.col("id").cast("double").alias("v"))
    counts = settled(quantiles.value_counts(df, ["g"], "v"))
    monkeypatch.setattr(quantiles, "quantiles_by_range", None)
    got = quantiles.quantiles_of_counts(counts, ["g"], {"m": 0.5}, in_memory=1000)
    assert got.where(F.col("m") == F.col("g") + 10_000).count() == 10_000


def test_null_and_large_groups_side_by_side(spark):
    rows = [(None, float(k)) for k in range(60)] + [(1, float(k)) for k in range(5)]
    df = spark.createDataFrame(rows, "g int, v double")
    got = quantiles.grouped_quantiles(df, ["g"], "v", {"m": 0.5}, 10).collect()
    assert {(r.g, r.m) for r in got} == {(None, 29.5), (1, 2.0)}


def test_good_bodies_are_not_stored_again(spark):
    raw = spark.createDataFrame(
        [("k1", 1, 200, '{"result": {"hash": "0x1", "number": "0x2"}}'), ("k2", 1, 500, "busy")], landing.LANDED_LINE
    )
    rows = landing.classify(raw, schemas.BLOCK_DETAILS).collect()
    assert {(r.key, r.body) for r in rows} == {("k1", None), ("k2", "busy")}


def test_bad_relay_pages_are_rejects_and_the_rest_lands(spark, tmp_path):
    (tmp_path / "relay=a").mkdir()
    lines = ['[{"slot": "5", "block_hash": "x", "value": "7"}, {"slot": "zz", "block_hash": "y"}]', "[]", '[{"slot": ', "{}"]
    (tmp_path / "relay=a" / "pages.json").write_text("\n".join(lines) + "\n")
    landed = relays.land_relay_pages(spark, str(tmp_path), page_per_line=True)
    assert [(r.slot, r.block_hash) for r in landed.good.collect()] == [(5, "x")]
    assert sorted((r.relay, r.reason) for r in landed.rejects.collect()) == [
        ("a", "bad_number"), ("a", "malformed"), ("a", "malformed")
    ]
    assert relays.read_relay_pages(spark, str(tmp_path), page_per_line=True).count() == 1


def test_loads_are_logged(spark, tmp_path):
    spark.range(10).write.parquet(f"{tmp_path}/a")
    spark.range(5).write.parquet(f"{tmp_path}/b")
    for name in "ab":
        log = days.log_load(spark.read.parquet(f"{tmp_path}/{name}"), name, f"{tmp_path}/log")
    assert {r.table: r.n for r in log.groupBy("table").agg(F.sum("rows").alias("n")).collect()} == {"a": 10, "b": 5}


def test_declared_order_and_nullability():
    # The declared column order of the six tables.
    declared = {
        "relay_proposer_payload_delivered": "slot parent_hash block_hash builder_pubkey proposer_pubkey "
        "proposer_fee_recipient gas_limit gas_used value block_number num_tx relay_name",
        "canonical_beacon_transaction_receipts_blob_sidecars": "blockHash blockNumber contractAddress cumulativeGasUsed "
        "effectiveGasPrice from gasUsed status to transactionHash transactionIndex type",
        "canonical_block_details": "baseFeePerGas blobGasUsed excessBlobGas extraData gasLimit gasUsed hash miner "
        "number receiptsRoot size timestamp",
        "canonical_transaction_details": "blockHash blockNumber chainId from gas gasPrice hash maxFeePerGas "
        "maxPriorityFeePerGas nonce to transactionIndex type value",
        "mev_block_details": "slot parent_hash block_hash builder_pubkey proposer_pubkey proposer_fee_recipient "
        "gas_limit gas_used value num_tx block_number",
        "canonical_block_root": "parent_hash fee_recipient state_root receipts_root logs_bloom prev_randao block_number "
        "gas_limit gas_used timestamp extra_data base_fee_per_gas block_hash transactions_root withdrawals_root "
        "blob_gas_used excess_blob_gas block_root",
    }
    assert {name: table.schema.fieldNames() for name, table in schemas.DECLARED.items()} == {
        name: text.split() for name, text in declared.items()
    }
    assert {f.name for f in schemas.BLOCK_ROOTS.fields if f.nullable} == {"blob_gas_used", "excess_blob_gas"}
    assert {f.name for f in schemas.RECEIPTS.fields if f.nullable} == {"contractAddress", "from", "to"}


def test_stream_state_ends_and_late_copies_inside_the_delay_are_dropped(spark, tmp_path):
    source, out, checkpoint = (f"{tmp_path}/{n}" for n in ("in", "out", "checkpoint"))

    def drop(*rows):
        spark.createDataFrame(rows, "key string, at long, n int").withColumn(
            "at", F.timestamp_seconds(F.col("at") + 1_000_000)
        ).write.mode("append").parquet(source)
        stream = spark.readStream.schema("key string, at timestamp, n int").parquet(source)
        run = stream_landing.run_available(dedup.first_arrivals(stream, "key", "at", "100 seconds"), out, checkpoint)
        return run.recentProgress[-1]["stateOperators"][0]["numRowsTotal"]

    assert drop(("a", 0, 1), ("b", 10, 1)) == 2
    assert drop(("a", 50, 2)) == 2  # a copy inside the delay
    assert drop(("c", 5000, 1)) <= 3
    assert drop(("d", 5001, 1)) == 2  # a and b are past their delay
    assert sorted((r.key, r.n) for r in spark.read.parquet(out).collect()) == [("a", 1), ("b", 1), ("c", 1), ("d", 1)]


def test_keep_first_log_is_compacted_and_half_written_batches_unseen(spark, tmp_path):
    out, order = str(tmp_path / "log"), [F.col("n")]
    for k in range(3):
        spark.createDataFrame([("a", 9 - k), (f"x{k}", k)], "key string, n int").write.parquet(f"{out}/batch={k}")
    half = tmp_path / "log" / "batch=3"
    spark.createDataFrame([("a", 0)], "key string, n int").write.parquet(str(half))
    (half / "_SUCCESS").unlink()
    expected = [("a", 7), ("x0", 0), ("x1", 1), ("x2", 2)]

    def kept():
        return sorted((r.key, r.n) for r in dedup.kept_rows(spark, out, ["key"], order).collect())

    assert kept() == expected
    dedup.compact_log(spark, out, ["key"], order)
    assert kept() == expected

    def folders():
        return sorted(p.name for p in (tmp_path / "log").iterdir() if not p.name.startswith("."))

    # what a compaction replaces stays for its readers until the next one
    assert folders() == [*(f"batch={k}" for k in range(4)), "upto=2"]
    (half / "_SUCCESS").touch()
    assert kept()[0] == ("a", 0)
    dedup.compact_log(spark, out, ["key"], order)
    assert kept()[0] == ("a", 0) and folders() == ["batch=3", "upto=2", "upto=3"]
