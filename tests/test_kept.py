"""Results kept up to date: corrections of a stream, the ledger of attempts, periods, sketches; the binned density."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockscope.operators import summaries
from blockscope.plans import arrival, arrival_days, blobs, classified
from blockscope.session import run_dir
from blockscope.sources import ledger, relays
from blockscope.streaming import dedup
from tests.tiny import AFTER, SETTINGS, chain, rows

KINDS = "key string, part string"


# --- corrections -------------------------------------------------------------------------------
def test_a_preferred_report_replaces_what_was_given_out(spark):
    home = run_dir(spark, "corrections")
    schema = "relay string, slot long, block_hash string, value double, seen timestamp"
    order = relays.preference(("a", "b", "c"))

    def bid(relay, slot, name, value):
        return (relay, slot, name, value, f"2024-01-01 {slot:02}:00:00")

    drops = [
        [bid("b", 1, "h1", 1.0), bid("c", 1, "h1", 2.0), bid("c", 2, "h2", 3.0)],
        [bid("a", 1, "h1", 9.0), bid("c", 3, "h3", 4.0)],  # corrects h1
        [bid("b", 3, "h3", 5.0), bid("c", 1, "h1", 6.0)],  # corrects h3, not h1
        [bid("a", 20, "h20", 1.0)],
        [bid("a", 2, "h2", 7.0), bid("b", 20, "h20", 2.0)],  # h2 is too late by now
    ]
    shown, held = [], []
    for drop in drops:
        df = spark.createDataFrame(drop, schema.replace("timestamp", "string")).withColumn("seen", F.col("seen").cast("timestamp"))
        df.write.mode("append").parquet(f"{home}/in")
        new = spark.readStream.schema(schema).parquet(f"{home}/in")
        best = dedup.preferred_so_far(new, ["block_hash"], order, "seen", "4 hours")
        held += dedup.run_corrections(best, f"{home}/out", f"{home}/check")
        now = dedup.corrected_rows(spark, f"{home}/out", ["block_hash"]).collect()
        shown.append({r.block_hash: (r.relay, r.value) for r in now})
    assert shown[0] == {"h1": ("b", 1.0), "h2": ("c", 3.0)}
    assert shown[1] == {"h1": ("a", 9.0), "h2": ("c", 3.0), "h3": ("c", 4.0)}
    assert shown[2] == shown[1] | {"h3": ("b", 5.0)}
    assert shown[4] == shown[3] == shown[2] | {"h20": ("a", 1.0)}
    assert max(held) >= 3 and held[-1] == 1


# --- ledger ------------------------------------------------------------------------------------
def files(path):
    return {f"{d}/{f}": os.stat(f"{d}/{f}").st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_a_ledger_counts_tries_and_rewrites_only_the_parts_hit(spark):
    path = run_dir(spark, "ledger-test")

    def record(number, *tries):
        ledger.record_attempts(spark, path, spark.createDataFrame(tries, f"{KINDS}, done boolean"), number)

    def found():
        return {r.key: (r.tries, r.done, r.landing) for r in ledger.read_ledger(spark, path, KINDS).collect()}

    assert found() == {}
    record(1, ("k1", "p", False), ("k2", "p", True), ("k3", "q", False), ("k3", "q", None), (None, "q", True))
    assert found() == {"k1": (1, False, 1), "k2": (1, True, 1), "k3": (2, False, 1)}
    before = files(path)
    record(2, ("k3", "q", False), ("k4", None, False))
    kept = {f: t for f, t in files(path).items() if "part=p" in f}
    assert kept and kept == {f: t for f, t in before.items() if "part=p" in f}
    want = {"k1": (1, False, 1), "k2": (1, True, 1), "k3": (3, False, 2), "k4": (1, False, 2)}
    assert found() == want
    record(2, ("k3", "q", False), ("k4", None, False), ("k5", "q", False))  # again, cut short before it had k5
    assert found() == want | {"k5": (1, False, 2)}
    for number in range(3, 6):
        record(number, ("k3", "q", False), ("k4", None, number == 5))
    assert found()["k3"] == (6, False, 5) and found()["k4"] == (4, True, 5)
    known = ledger.read_ledger(spark, path, KINDS)
    assert [tuple(r) for r in ledger.given_up(known).collect()] == [("k3", 6)]
    work = spark.createDataFrame([(f"k{n}",) for n in range(1, 7)], "key string")
    assert sorted(r.key for r in ledger.open_keys(work, known).collect()) == ["k1", "k5", "k6"]
    record(6)
    assert len(found()) == 5


# --- periods and sketches ----------------------------------------------------------------------
def test_periods_added_one_by_one_equal_the_whole(spark):
    rng = random.Random(4)
    stamps = [f"2024-03-{14 + k:02} 00:00:00" for k in range(4)]

    def seen():
        return rng.choice("ab"), rng.choice(["lighthouse", "teku"])

    blobs = [(f"r{rng.randrange(9)}", 1, *seen(), rng.randrange(6), rng.randrange(30_000), rng.choice(stamps)) for _ in range(300)]
    events = [(f"r{rng.randrange(9)}", 1, *seen(), rng.randrange(30_000), rng.choice(stamps)) for _ in range(60)]
    t = chain(spark, sidecars=blobs, block_events=events)
    path = run_dir(spark, "periods-test")
    cuts = [AFTER[:10], "2024-03-15", "2024-03-16", None]
    for k in (0, 1, 2, 1):
        arrival_days.add_period(t, path, cuts[k], cuts[k + 1], SETTINGS)
    kept = arrival_days.arrival_by_blobs_kept(spark, path)
    want = rows(arrival.arrival_by_blobs(t, SETTINGS))
    assert len(want) > 2 and rows(kept) == [(k, pytest.approx(s)) for k, s in want]
    # a result reads the reduced rows, none of the observations
    assert "diff_ms" not in kept._jdf.queryExecution().toString()


@pytest.mark.parametrize("shape", ["even", "ties", "skew"])
def test_merged_sketches_are_near_the_sketch_of_all(spark, shape):
    rng = np.random.default_rng(7)
    values = {"even": rng.random(40_000), "ties": rng.integers(0, 9, 40_000) * 1.0, "skew": rng.pareto(1.0, 40_000)}[shape]
    data = [(int(k % 23), "g" if k % 5 else None, float(v)) for k, v in enumerate(values)] + [(1, "g", None), (2, "g", float("nan")), (3, "empty", None)]
    df = spark.createDataFrame(data, "day int, g string, v double")
    wanted = {"low": 0.1, "median": 0.5, "high": 0.99}
    sketches = arrival_days.period_sketches(df, "day", ["g"], "v")
    whole = arrival_days.period_sketches(df.withColumn("day", F.lit(0)), "day", ["g"], "v")
    for found in (sketches, whole):
        for r in arrival_days.merged_quantiles(found, ["g"], wanted).collect():
            mine = np.sort([v for _, g, v in data if g == r.g and v is not None and v == v])
            assert r.n == len(mine) > 0
            for name, q in wanted.items():
                below, upto = np.searchsorted(mine, r[name], "left"), np.searchsorted(mine, r[name], "right")
                assert below / len(mine) - 0.02 <= q <= upto / len(mine) + 0.02


# --- classes -----------------------------------------------------------------------------------
@pytest.mark.parametrize("seed", range(3))
def test_classes_after_each_load_are_those_of_all_loads(spark, seed):
    """Tags that a later payload delivers, payloads before their blocks, repeated rows, loads run twice."""
    rng = random.Random(seed)
    path, details, paid = run_dir(spark, "classes-test"), [], []
    for load in range(4):
        new = [(f"h{rng.randrange(60)}", rng.choice(["t1", "t2", "t3", "t4", "t5", "t6", None])) for _ in range(15 * (load != 2))]
        bids = [(1, f"h{rng.randrange(200)}", 1.0) for _ in range(4 * (load != 1))]
        details += new
        paid += bids
        rows_of = [(h, 1, tag, 1, 1) for h, tag in new]
        for _ in range(1 + load % 2):
            t = chain(spark, block_details=rows_of, payloads=bids)
            classified.classify_load(path, load, t.block_details, t.payloads)
        whole = chain(spark, block_details=[(h, 1, tag, 1, 1) for h, tag in details], payloads=paid)
        assert rows(classified.non_mev_kept(spark, path)) == rows(blobs.non_mev_blocks(whole))
    assert len(os.listdir(f"{path}/other")) == 2


def test_plans_read_the_stored_classes_and_no_payloads(spark):
    import dataclasses

    t = chain(spark)
    stored = dataclasses.replace(t, non_mev=spark.createDataFrame([("h",)], "hash string"))
    for build in (blobs.gas_rows, arrival.arrival_by_blobs):
        for mev in (True, False):
            kept, found = (
                build(x, SETTINGS, mev=mev)._jdf.queryExecution().analyzed().toString().count("Join") for x in (stored, t)
            )
            # neither the tags of delivered blocks nor the blocks without them
            assert kept == found - 2


# --- density -----------------------------------------------------------------------------------
@pytest.mark.parametrize("shape", ["normal", "two", "tail"])
def test_binned_density_is_the_exact_one(spark, shape):
    rng = np.random.default_rng(3)
    values = {
        "normal": rng.normal(5, 2, 3000), "two": rng.choice([1.0, 4.0], 500), "tail": np.exp(rng.normal(0, 1.5, 3000)),
    }[shape]
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "v double")
    exact = {r.point: (r.x, r.density) for r in summaries.kde_grid(df, "v").collect()}
    got = {r.point: (r.x, r.density) for r in summaries.kde_binned(df, "v").collect()}
    peak = max(d for _, d in exact.values())
    assert sorted(got) == list(range(200)) and set(exact) == set(got)
    for k, (x, density) in exact.items():
        assert got[k] == (pytest.approx(x), pytest.approx(density, abs=1e-6 * peak))


def test_binned_density_of_hardly_any_values(spark):
    for values in ([], [None], [3.0], [3.0] * 5):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        assert [r.density for r in summaries.kde_binned(df, "v").collect()] == [None] * 200
