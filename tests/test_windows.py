import pandas as pd
import pytest
from pyspark.sql import functions as F

from blockscope.operators import windows


@pytest.fixture(scope="module")
def posts(spark):
    step = F.pmod(F.xxhash64("id"), F.lit(40))
    return (
        spark.range(1500)
        .select((F.col("id") % 3).alias("s"), (F.col("id") * 20 + step).alias("slot"))
        .union(spark.createDataFrame([(9, 5)], "s long, slot long"))
        .distinct()
    )


def expected(posts):
    pdf = posts.toPandas().sort_values(["s", "slot"])
    pdf["gap"] = pdf.groupby("s")["slot"].diff()
    return pdf


@pytest.mark.parametrize("stretch", [7, 100, 100_000])
def test_gap_over_stretches(posts, stretch):
    got = windows.gap_to_previous(posts, ["s"], "slot", "gap", stretch=stretch).toPandas()
    pd.testing.assert_frame_equal(
        got.sort_values(["s", "slot"]).reset_index(drop=True).astype(float),
        expected(posts).reset_index(drop=True).astype(float),
    )


@pytest.mark.parametrize("stretch", [7, 60, 61, 100, 100_000])
def test_bounded_gap_is_the_filtered_gap(posts, stretch):
    got = windows.gaps_within(posts, ["s"], "slot", "gap", 60, stretch=stretch).toPandas()
    want = expected(posts)
    want = want[want["gap"] <= 60]
    pd.testing.assert_frame_equal(
        got.sort_values(["s", "slot"]).reset_index(drop=True).astype(float),
        want.reset_index(drop=True).astype(float),
    )


def test_first_row_of_a_group_has_no_gap(spark):
    df = spark.createDataFrame([("x", 1), ("x", 5)], "s string, slot long")
    assert [r.gap for r in windows.gap_to_previous(df, ["s"], "slot", "gap").orderBy("slot").collect()] == [None, 4]
    assert [r.slot for r in windows.gaps_within(df, ["s"], "slot", "gap", 96).collect()] == [5]


@pytest.mark.parametrize("parts", [1, 17])
def test_keep_first_does_not_depend_on_partitioning(spark, parts):
    df = spark.createDataFrame(
        [("h", 2, 10.0), ("h", 1, 11.0), ("h", 1, 12.0), ("g", 3, None)], "k string, rank int, v double"
    ).repartition(parts)
    once = windows.keep_first(df, ["k"], [F.col("rank"), -F.col("v")])
    want = [("g", 3, None), ("h", 1, 12.0)]
    assert sorted(tuple(r) for r in once.collect()) == want
    again = windows.keep_first(once, ["k"], [F.col("rank"), -F.col("v")])
    assert sorted(tuple(r) for r in again.collect()) == want


def test_top_k_breaks_ties_and_is_not_a_full_sort(spark):
    df = spark.createDataFrame([("b", 5), ("a", 5), ("c", 9), ("d", 1)], "k string, v int")
    top = windows.top_k(df, 2, "v", ["k"])
    assert [r.k for r in top.collect()] == ["c", "a"]
    assert "TakeOrderedAndProject" in top._jdf.queryExecution().executedPlan().toString()
