"""Each rule about unmatched rows, membership and ratios on rows small enough to work out by hand."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from blockscope.plans import arrival, blobs, payments, positions, reorgs, senders
from tests.tiny import AFTER, BEFORE, SETTINGS, chain, rows, tx


@pytest.fixture(scope="module")
def blocks(spark):
    """r1 MEV tag, r2 other tag, r3 root without hash, r4 hash without details."""
    return chain(
        spark,
        transactions=[
            tx("r1", 1, "t1", blobs=2, position=3),
            tx("r1", 1, "t2", blobs=1, position=5),
            tx("r1", 1, "t0", type_=2, position=9),
            tx("r2", 2, "t3", blobs=3),
            tx("r3", 3, "t4", blobs=1),
            tx("r4", 4, "t5", blobs=4),
        ],
        block_roots=[("r1", "h1"), ("r2", "h2"), ("r4", "h4")],
        block_details=[("h1", 100, "mev", 10, 7), ("h2", 200, "solo", 20, 7), ("h9", 5, "mev", 1, 1)],
        payloads=[(9, "h9", 2e18), (1, "h1", 1e18)],
    )


def test_mev_is_by_tag_and_a_block_without_details_is_not_non_mev(blocks):
    assert rows(blobs.non_mev_blocks(blocks)) == [("h2",)]
    assert rows(blobs.gas_rows(blocks)) == [(3.0, 100), (3.0, 200)]
    assert rows(blobs.gas_rows(blocks, mev=False)) == [(3.0, 200)]
    assert rows(blobs.gas_rows(blocks, mev=True)) == [(3.0, 100)]


def test_mev_and_non_mev_rows_are_all_rows(blocks):
    both = blobs.gas_rows(blocks, mev=True).unionByName(blobs.gas_rows(blocks, mev=False))
    assert rows(both) == rows(blobs.gas_rows(blocks))


def test_gas_statistics(blocks):
    assert rows(blobs.gas_summary(blocks)) == [(3.0, 150.0)]
    assert rows(blobs.gas_summary(blocks, statistic="median")) == [(3.0, 150.0)]
    assert rows(blobs.gas_series(blocks)) == [
        (3.0, 100.0, "MEV"),
        (3.0, 150.0, "All"),
        (3.0, 200.0, "Non-MEV"),
    ]
    with pytest.raises(ValueError):
        blobs.gas_summary(blocks, statistic="mode")


def test_blocks_without_details_have_size_zero(blocks):
    assert rows(blobs.size_by_blobs(blocks, q=1.0)) == [(1.0, 0), (3.0, 10), (3.0, 20), (4.0, 0)]


def test_transaction_number_is_the_last_blob_position(blocks):
    got = {r.block_root: r.num_of_txns for r in blobs.transactions_by_blobs(blocks).collect()}
    assert got == {"r1": 6, "r2": 1, "r3": 1, "r4": 1}


def test_half_empty_and_empty_ratio_with_zero_bytes(spark):
    t = chain(
        spark,
        transactions=[
            tx("r", 1, "a", to="0xAb", empty=3, full=4),
            tx("r", 1, "b", to="0xab", empty=2, full=4),
            tx("r", 1, "c", to="0xCd", empty=1, full=0),
            tx("r", 1, "d", to="0xcd", empty=0, full=0),
        ],
        address_labels=[("0xab", "one"), ("0xcd", "two"), ("0xee", "none")],
    )
    assert rows(blobs.half_empty_blobs(t)) == [("r", 4.0, 2)]
    assert rows(blobs.half_empty_blobs(t, address="0xAB")) == [("r", 2.0, 1)]
    assert rows(blobs.half_empty_blobs(t, senders=t.address_labels)) == [
        ("one", "r", 2.0, 1),
        ("two", "r", 2.0, 1),
    ]
    assert rows(blobs.empty_ratio_by_blobs(t)) == [("r", 0.5, 1.0), ("r", 0.75, 1.0), ("r", None, 2.0)]
    assert rows(blobs.empty_ratio_by_blobs(t, address="0xcd")) == [("r", None, 2.0)]


def test_relative_position_of_a_lone_transaction_is_null(spark):
    t = chain(
        spark,
        transactions=[
            tx("r1", 1, "a", position=0),
            tx("r2", 2, "b", position=1),
            tx("r2", 2, "c", type_=2, position=4),
        ],
    )
    assert rows(positions.relative_position(t)) == [("r1", None), ("r2", 0.25)]
    hist = positions.relative_position_histogram(t, bins=4).orderBy("bin").collect()
    assert [r.n for r in hist] == [0, 0, 1, 0]
    assert positions.blob_position_histogram(t, bins=2).agg(F.sum("n")).collect()[0][0] == 2


@pytest.fixture(scope="module")
def seen(spark):
    """Clients c1, c2 run lighthouse, c3 teku."""
    lh = "lighthouse"
    return chain(
        spark,
        sidecars=[
            ("r1", 1, "c1", lh, 0, 1000, AFTER),
            ("r1", 1, "c1", lh, 1, 3000, AFTER),
            ("r1", 1, "c1", lh, 2, 30000, AFTER),
            ("r1", 1, "c2", lh, 0, 2000, AFTER),
            ("r1", 1, "c3", "teku", 0, 500, AFTER),
            ("r2", 2, "c1", lh, 0, 4000, AFTER),
            ("r5", 5, "c2", lh, 0, 9000, AFTER),
        ],
        block_events=[
            ("r1", 1, "c1", lh, 2000, AFTER),
            ("r1", 1, "c2", lh, 5000, AFTER),
            ("r1", 1, "c3", "teku", 100, AFTER),
            ("r2", 2, "c1", lh, 1000, AFTER),
            ("r3", 3, "c1", lh, 7000, AFTER),
            ("r0", 0, "c1", lh, 6000, BEFORE),
        ],
        block_roots=[("r1", "h1"), ("r5", "h5")],
        block_details=[("h1", 1, "solo", 1, 1), ("h5", 1, "mev", 1, 1)],
        payloads=[(5, "h5", 3e18), (1, "h1", 1e18), (1, "h1b", 2e18)],
        transactions=[tx("r1", 1, "t1", blobs=2), tx("r9", 9, "t9")],
    )


def test_arrival_counts_blobs_the_client_saw_within_the_bound(seen):
    got = arrival.client_arrival(seen.sidecars, ["block_root", "client"], 24000, "lighthouse")
    assert rows(got) == [("r1", "c1", 3.0, 2), ("r1", "c2", 2.0, 1), ("r2", "c1", 4.0, 1), ("r5", "c2", 9.0, 1)]


def test_arrival_by_blobs_needs_block_and_blobs(seen):
    assert rows(arrival.arrival_by_blobs(seen, SETTINGS)) == [(1, 4.5), (2, 3.0)]


def test_block_without_hash_stays_under_mev_and_leaves_non_mev(seen, spark):
    none_mev = chain(spark, block_details=[("h5", 1, "mev", 1, 1), ("h1", 1, "solo", 1, 1)], payloads=[(5, "h5", 1.0)])
    t = type(seen)(**{**seen.__dict__, "block_details": none_mev.block_details, "payloads": none_mev.payloads})
    assert rows(arrival.arrival_by_blobs(t, SETTINGS, mev=True)) == [(1, 4.0)]
    assert rows(arrival.arrival_by_blobs(t, SETTINGS, mev=False)) == [(1, 5.0), (2, 3.0)]


def test_arrival_series_tells_blocks_apart_once(seen, spark):
    """Both known tags are delivered, and the block without a hash counts as MEV."""
    assert rows(arrival.arrival_series(seen, SETTINGS)) == [
        (1, 4.5, "All"),
        (1, 4.5, "MEV"),
        (2, 3.0, "All"),
        (2, 3.0, "MEV"),
    ]


def test_all_blocks_count_blockless_blobs_out_and_blobless_blocks_as_zero(seen):
    assert rows(arrival.arrival_by_blobs_all_blocks(seen, SETTINGS)) == [
        (0, 7.0),
        (1, pytest.approx((5.0 + 0.5 + 4.0) / 3)),
        (2, 3.0),
    ]


def test_mean_arrival_keeps_blobs_without_block_event(seen):
    assert rows(arrival.mean_arrival(seen, SETTINGS)) == [("r1", 4.0), ("r2", 4.0), ("r5", 9.0)]
    got = arrival.block_arrival_with_blobs(seen, SETTINGS)
    assert rows(got) == [("r1", 4.0, 2.0), ("r2", 4.0, 0.0), ("r5", 9.0, 0.0)]


def test_arrival_over_time_joins_both_periods(seen):
    after, before = dt.datetime(2024, 3, 14), dt.datetime(2024, 2, 1)
    assert rows(arrival.arrival_over_time(seen, SETTINGS)) == [(before, 6.0), (after, 5.0)]


def test_a_slot_paid_twice_has_two_rows(seen):
    got = arrival.slot_arrival_transactions_payments(seen, SETTINGS)
    assert rows(got) == [(1, 1, 1e18, 4.0), (1, 1, 2e18, 4.0)]


def test_payments_by_early_arrival(seen):
    assert rows(arrival.payment_by_arrival(seen, SETTINGS, q=1.0)) == [(2.5, 1e18)]
    bins = arrival.payment_arrival_bins(seen, SETTINGS, bins=4).orderBy("bin").collect()
    assert [(r.bin_center, r.median_value) for r in bins] == [(0.5, None), (1.5, None), (2.5, 1e18), (3.5, None)]
    assert arrival.payment_arrival_line(seen, SETTINGS).collect()[0].n == 1


def test_last_arrivals(seen):
    got = {r.num_blobs: (r.mean, r.median, r.n) for r in arrival.last_arrival_summary(seen, SETTINGS).collect()}
    assert got[0] == (7.0, 7.0, 1) and got[2] == (3.0, 3.0, 1)
    assert got[1] == (pytest.approx(9.5 / 3), 4.0, 3)
    density = arrival.last_arrival_density(seen, SETTINGS, bins=10)
    assert rows(density.groupBy("num_blobs").agg(F.sum("n"), F.count("n"))) == [(0, 1, 10), (1, 3, 10), (2, 1, 10)]


def test_median_payments_as_histogram_and_curve(spark):
    lh = "lighthouse"
    t = chain(
        spark,
        sidecars=[(f"r{i}", i, "c1", lh, 0, 100 * i, AFTER) for i in range(1, 6)],
        block_roots=[(f"r{i}", f"h{i}") for i in range(1, 6)],
        payloads=[(i, f"h{i}", float(i * i)) for i in range(1, 6)],
    )
    hist = arrival.payment_median_histogram(t, SETTINGS, bins=3).orderBy("bin").collect()
    assert [r.n for r in hist] == [2, 1, 1]
    assert arrival.payment_median_density(t, SETTINGS).count() == 200


def test_tip_of_unknown_block_pays_no_base_fee(spark):
    t = chain(
        spark,
        tx_details=[(h, b, Decimal(m), Decimal(p)) for h, b, m, p in
                    [("t1", "h1", 100, 50), ("t2", "h9", 100, 50), ("t3", "h1", 5, 9), ("t4", None, 7, 9)]],
        block_details=[("h1", 1, "x", 1, 90)],
        transactions=[tx("r1", 1, "t1", blobs=2), tx("r1", 1, "t1", blobs=1)],
    )
    assert rows(payments.miner_tip(t, q=1.0)) == [
        (0.0, Decimal(0)),
        (0.0, Decimal(50)),
        (0.0, Decimal(7)),
        (3.0, Decimal(10)),
    ]


def test_payment_by_blobs_is_in_eth(blocks):
    assert rows(payments.payment_by_blobs(blocks, q=1.0)) == [(3.0, 1.0)]


def test_posting_gap_and_sender_counts(spark):
    t = chain(
        spark,
        transactions=[
            tx("r", 10, "a", to="0xAA", blobs=2),
            tx("r", 10, "b", to="0xaa", blobs=1),
            tx("r", 12, "c", to="0xaa"),
            tx("r", 300, "d", to="0xaa"),
            tx("r", 301, "e", to="0xbb"),
            tx("r", 305, "f", to="0xBB"),
            tx("r", 306, "g", to="0xcc"),
            tx("r", 307, "h", to="0xaa", type_=2),
        ],
    )
    book = senders.address_book(spark, {"A": "0xAA", "B": "0xBB"})
    assert rows(senders.sender_blobs(t, book)) == [
        ("A", "0xaa", 10, 3.0, 2),
        ("A", "0xaa", 12, 1.0, 1),
        ("A", "0xaa", 300, 1.0, 1),
        ("B", "0xbb", 301, 1.0, 1),
        ("B", "0xbb", 305, 1.0, 1),
    ]
    assert rows(senders.posting_gap(t, book)) == [("A", "0xaa", 12, 1.0, 2), ("B", "0xbb", 305, 1.0, 4)]
    hist = senders.posting_gap_histogram(t, book).where("n > 0")
    assert rows(hist.select("label", "lo", "n")) == [("A", 2.0, 1), ("B", 4.0, 1)]
    posts = senders.blobs_per_post_histogram(t, book).where("n > 0")
    assert rows(posts.select("label", "lo", "n")) == [("A", 1.0, 2), ("A", 3.0, 1), ("B", 1.0, 2)]


def test_tracked_senders_are_nine(spark):
    assert senders.address_book(spark).count() == 9


def test_top_senders_are_picked_as_written_and_labelled_in_lower_case(spark):
    many = [tx("r", 1, f"x{i}", to=f"0xF{i}", blobs=2) for i in range(9)]
    t = chain(
        spark,
        transactions=[*many, tx("r", 1, "a", to="0xAB", blobs=6), tx("r", 2, "b", to="0xAB", blobs=2),
                      tx("r", 2, "c", to="0xab", blobs=1)],
        address_labels=[("0xab", "one")],
    )
    got = senders.top_sender_behaviour(t).collect()
    assert len(got) == 10
    assert {r.address: (r.label, r.num_blob_per_txn) for r in got}["0xab"] == ("one", 4.0)
    assert {r.label for r in got} == {"one", ""}


def test_reorgs(spark):
    lh = "lighthouse"
    t = chain(
        spark,
        transactions=[tx("r1", 1, "a", blobs=2), tx("r2", 2, "b")],
        reorgs=[
            (1, AFTER, lh, "US"),
            (1, AFTER, lh, "US"),
            (1, AFTER, lh, "DE"),
            (1, AFTER, "teku", "FI"),
            (7, AFTER, lh, "IN"),
            (8, BEFORE, lh, "US"),
        ],
    )
    after, before = dt.date(2024, 3, 14), dt.date(2024, 2, 1)
    assert rows(reorgs.reorgs_vs_blobs(t)) == [(1, 2.0, 1), (1, 2.0, 2), (2, 1.0, 0)]
    assert rows(reorgs.reorgs_mean_country(t)) == [(before, lh, 1.0), (after, lh, 1.5)]
    assert rows(reorgs.reorgs_by_country(t)) == [
        (after, lh, "DE", 1),
        (after, lh, "US", 2),
        (after, "teku", "FI", 1),
    ]
    assert {(r.date, r.after_reference) for r in reorgs.reorg_line(t).collect()} == {(before, 0), (after, 1)}


def test_empty_tables_give_empty_results(spark):
    t = chain(spark)
    for frame in (
        blobs.gas_summary(t, mev=True, statistic="median"),
        blobs.size_by_blobs(t),
        arrival.arrival_by_blobs(t, mev=True),
        arrival.arrival_over_time(t),
        payments.miner_tip(t),
        senders.top_sender_behaviour(t),
        reorgs.reorg_box(t),
    ):
        assert frame.count() == 0
