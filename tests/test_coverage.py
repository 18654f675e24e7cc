"""Uncovered ranges, bucketed joins, loads and logs that can be repeated, cut points per group."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from blockscope.operators import intervals, quantiles
from blockscope.plans import blobs
from blockscope.plans.tables import ChainTables
from blockscope.sources import days, layouts, relays
from blockscope.streaming import dedup


# --- uncovered ranges --------------------------------------------------------------------------
def brute(spans, within):
    out = []
    for g, low, high in within:
        seen = {n for k, a, b in spans if k == g and a is not None and b is not None for n in range(a, b + 1)}
        free = [n for n in range(low, high + 1) if n not in seen]
        for n in free:
            if out and out[-1][0] == g and out[-1][2] == n - 1:
                out[-1] = (g, out[-1][1], n)
            else:
                out.append((g, n, n))
    return sorted(out, key=str)


@pytest.mark.parametrize("stretch", [1, 7, 1000])
def test_uncovered_equals_brute_force(spark, stretch):
    rng = random.Random(stretch)
    spans = [(g, a, a + rng.randrange(-1, 12)) for g in ("a", "b", None) for a in (rng.randrange(-20, 200) for _ in range(25))]
    spans += [("a", None, 5), ("a", 5, None), ("a", 40, 160), ("e", 0, 99), ("f", -50, 500)] + spans[:9]
    within = [(g, 0, 180) for g in ("a", "b", None, "d")] + [("e", 0, 99), ("f", 0, 99)]
    kind = "g string, low long, high long"
    got = intervals.uncovered(spark.createDataFrame(spans, kind), spark.createDataFrame(within, kind), ["g"], stretch=stretch)
    assert sorted(map(tuple, got.collect()), key=str) == brute(spans, within)


def test_pages_that_answer_for_nothing(spark):
    pages = [
        ("a", 99, 200, '[{"slot": "70"}, {"slot": "95"}]'), ("a", 69, 200, "[]"), ("a", 59, 500, '[{"slot": "1"}]'),
        ("a", 49, 200, "<html>"), ("a", 39, 200, '[{"slot": "30", "x": 1}, {"slot": "oops"}]'), ("a", 34, 200, '[{"slot": "20"}]'), ("a", 19, 200, None),
    ]
    df = spark.createDataFrame(pages, "relay string, cursor long, status int, text string")
    walks = spark.createDataFrame([("a", 0, 99), ("b", 3, 4)], "relay string, low long, high long")
    got = sorted(map(tuple, relays.unseen_slots(df, walks).collect()))
    assert got == [("a", 0, 19), ("a", 40, 69), ("b", 3, 4)]
    assert relays.unseen_slots(df.limit(0), walks).count() == 2


# --- bucketed joins ----------------------------------------------------------------------------
def test_chain_on_buckets_moves_only_the_sums(spark):
    tx = spark.range(4000).select(
        (F.col("id") % 900).alias("block_root"), F.lit(3).alias("type"), (F.lit(131072) * 2).alias("blob_gas")
    )
    roots = spark.range(800).select(F.col("id").alias("block_root"), (F.col("id") + 5).alias("block_hash"))
    details = spark.range(700).select(F.col("id").alias("hash"), F.col("id").cast("double").alias("gas_used"))
    fields = dict.fromkeys(ChainTables.__dataclass_fields__)
    t = ChainTables(**fields | {"transactions": tx, "block_roots": roots, "block_details": details})
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        copy = layouts.bucketed_chain(t, 4)
        rows = blobs.gas_rows(copy)
        plan = rows._jdf.queryExecution().executedPlan().toString()
        plain = blobs.gas_rows(t)._jdf.queryExecution().executedPlan().toString()
        got = sorted(map(tuple, rows.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Exchange hashpartitioning") == 1 and plain.count("Exchange hashpartitioning") >= 3
    assert got == sorted(map(tuple, blobs.gas_rows(t).collect())) and len(got) == 695


def test_buckets_grow_with_the_rows(spark, monkeypatch):
    tx = spark.range(3000).select(
        (F.col("id") % 900).alias("block_root"), F.lit(3).alias("type"), F.lit(131072).alias("blob_gas"),
        F.when(F.col("id") % 2 == 0, F.repeat(F.lit("é"), 20)).alias("to_addr"),
    )
    roots = spark.range(800).select(F.col("id").alias("block_root"), (F.col("id") + 5).alias("block_hash"))
    details = spark.range(700).select(F.col("id").alias("hash"), F.col("id").cast("double").alias("gas_used"))
    fields = dict.fromkeys(ChainTables.__dataclass_fields__)
    monkeypatch.setattr(layouts, "BUCKET_BYTES", 12_000, raising=False)
    for times, buckets in ((1, 11), (4, 44), (0, 3)):  # 44 bytes a transaction
        more = tx.withColumn("again", F.explode(F.array_repeat(F.lit(1), times))).drop("again")
        t = ChainTables(**fields | {"transactions": more, "block_roots": roots, "block_details": details})
        copy = layouts.bucketed_chain(t, 3)
        assert copy.transactions.groupBy("block_root").count().rdd.getNumPartitions() == buckets
        assert sorted(map(tuple, blobs.gas_rows(copy).collect())) == sorted(map(tuple, blobs.gas_rows(t).collect()))


# --- cut points per group ----------------------------------------------------------------------
def test_groups_in_neighbouring_ranges_are_cut_by_their_own_values(spark):
    groups, each, ranges = 300, 400, 16
    counts = spark.range(groups * each).select(
        F.floor(F.col("id") / each).alias("g"), F.col("id").cast("double").alias("__v"), F.lit(1).alias("__n")
    )
    cut = quantiles._ranged(counts, ["g"], ranges)
    largest = cut.groupBy("g", "__range").count().groupBy("g").agg(F.max("count").alias("most"), F.count("*").alias("n"))
    worst = largest.agg(F.max("most"), F.min("n")).first()
    assert worst[0] <= 3 * each / ranges and worst[1] >= ranges // 2


def test_many_large_groups_have_exact_quantiles(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": np.repeat(np.arange(40), 300), "v": np.repeat(np.arange(40) * 1000.0, 300) + rng.normal(0, 9, 12000)})
    df = spark.createDataFrame(pdf, "g long, v double")
    got = {r.g: r.m for r in quantiles.grouped_quantiles(df, ["g"], "v", {"m": 0.37}, in_memory=0).collect()}
    want = pdf.groupby("g")["v"].quantile(0.37)
    assert got == pytest.approx(want.to_dict(), rel=1e-12)


# --- loads and logs ----------------------------------------------------------------------------
def delivered(spark, path, day, n, start=0):
    rows = spark.range(start, start + n).select(F.col("id").alias("x"), F.lit(day).alias("day"))
    rows.write.mode("overwrite").parquet(f"{path}/{day}")


def counts(spark, root):
    return {r.day: r["count"] for r in days.loaded(spark, root).groupBy("day").count().collect()}


def test_loads_can_be_repeated_and_cut_short(spark, tmp_path):
    path, root = str(tmp_path / "in"), f"file://{tmp_path}/loads"
    for k in range(3):
        delivered(spark, path, f"d{k}", 10 + k)
    every = [f"{path}/d{k}" for k in range(3)]
    assert days.load_new(spark, root, every[:2]) > 0
    lines = days.load_log(spark, root).count()
    assert days.load_new(spark, root, every[:2]) == 0 and days.load_log(spark, root).count() == lines
    assert counts(spark, root) == {"d0": 10, "d1": 11}
    # a load that ended before its log lines
    spark.read.parquet(*every).withColumns({"source_file": F.lit("f"), "source": F.lit(every[2])}).write.parquet(f"{root}/rows/load=2")
    assert counts(spark, root) == {"d0": 10, "d1": 11}
    days.load_new(spark, root, every)
    assert counts(spark, root) == {"d0": 10, "d1": 11, "d2": 12}
    delivered(spark, path, "d1", 3)  # delivered anew
    days.load_new(spark, root, every)
    assert counts(spark, root) == {"d0": 10, "d1": 3, "d2": 12}
    assert days.load_log(spark, root).agg(F.sum("rows")).first()[0] == 10 + 11 + 12 + 3


def test_readers_of_a_version_keep_it(spark, tmp_path):
    root = str(tmp_path / "versions")
    with pytest.raises(ValueError):
        days.current(spark, root)
    assert days.refresh(spark.range(5).toDF("x"), root) == 1
    before = days.current(spark, root)
    spark.range(9).toDF("x").write.parquet(f"{root}/version=2")  # a refresh that was cut short
    assert days.current(spark, root).count() == 5
    assert days.refresh(spark.range(7).toDF("x"), root) == 2
    assert before.count() == 5 and days.current(spark, root).count() == 7
    assert days.refresh(spark.range(8).toDF("x"), root) == 3 and days.current(spark, root).count() == 8
    assert sorted(p.name for p in (tmp_path / "versions").iterdir()) == ["current", "version=2", "version=3"]


def test_readers_of_the_log_outlive_a_compaction(spark, tmp_path):
    out, order = str(tmp_path / "log"), [F.col("v")]
    for k in range(6):
        spark.createDataFrame([(1, 9 - k), (k, k)], "k long, v long").write.parquet(f"{out}/batch={k}")
        if k % 2:
            reader = dedup.kept_rows(spark, out, ["k"], order)
            dedup.compact_log(spark, out, ["k"], order)
            dedup.compact_log(spark, out, ["k"], order)  # nothing new: nothing is removed
            want = sorted(map(tuple, dedup.kept_rows(spark, out, ["k"], order).collect()))
            assert sorted(map(tuple, reader.collect())) == want
    assert sorted(p.name for p in (tmp_path / "log").iterdir()) == ["batch=4", "batch=5", "upto=3", "upto=5"]
