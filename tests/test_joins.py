import pytest
from pyspark.sql import functions as F

from blockscope.operators import joins


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def facts(spark):
    """A third of the rows on one key, some keys NULL, some unknown."""
    key = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 11 == 0, None).otherwise(F.col("id") % 50)
    return spark.range(3000).select(key.cast("long").alias("k"), F.col("id").alias("row"))


@pytest.fixture(scope="module")
def facts_dim(spark):
    return spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w"))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("min_rows, rate", [(0, 1.0), (0, 0.2), (1_000_000, 1.0)])
@pytest.mark.parametrize("one_row", [True, False])
def test_skew_join_is_the_plain_join(facts, facts_dim, how, min_rows, rate, one_row):
    hot = joins.hot_keys(facts, ["k"], share=10, min_rows=min_rows, rate=rate)
    got = joins.skew_join(facts, facts_dim, ["k"], how=how, one_row_per_key=one_row, hot=hot)
    assert rows(got) == rows(facts.join(facts_dim, ["k"], how))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_repeat_join_is_the_plain_join(facts, facts_dim, how):
    got = joins.repeat_join(facts, facts_dim, ["k"], spread=["row"], how=how, salts=4)
    assert rows(got) == rows(facts.join(facts_dim, ["k"], how))


def test_joins_that_cannot_be_spread_are_refused(facts, facts_dim):
    with pytest.raises(ValueError):
        joins.skew_join(facts, facts_dim, ["k"], how="full")
    with pytest.raises(ValueError):
        joins.repeat_join(facts, facts_dim, ["k"], spread=["row"], how="full")


def test_hot_keys_are_few_and_the_right_ones(facts):
    for rate in (1.0, 0.2):
        hot = joins.hot_keys(facts, ["k"], share=10, min_rows=1, rate=rate)
        assert [r.k for r in hot.collect()] == [7]
    assert joins.hot_keys(facts, ["k"], share=10, min_rows=10_000, rate=1.0).count() == 0


def test_null_can_be_hot(spark, facts_dim):
    facts = spark.range(300).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("k"), F.col("id").alias("row"))
    hot = joins.hot_keys(facts, ["k"], share=10, min_rows=1, rate=1.0)
    assert [r.k for r in hot.collect()] == [None]
    for how in ("inner", "left", "left_semi", "left_anti"):
        got = joins.skew_join(facts, facts_dim, ["k"], how=how, hot=hot)
        assert rows(got) == rows(facts.join(facts_dim, ["k"], how))


def test_without_hot_keys_the_join_is_plain(facts, facts_dim):
    plan = joins.skew_join(facts, facts_dim, ["k"], how="left")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "Union" not in plan


def test_hot_rows_do_not_travel(spark, facts, facts_dim):
    """Copies of one row are joined where they are: only the usual rows are shuffled by key."""
    hot = joins.hot_keys(facts, ["k"], share=10, min_rows=1, rate=1.0)
    copies = facts.select("k").withColumn("v", F.lit(1))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = joins.skew_join(copies, facts_dim, ["k"], how="left", one_row_per_key=True, hot=hot)
        text = got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    stays = text.split("Union")[1].split("SortMergeJoin")
    assert len(stays) == 2 and "BroadcastHashJoin" in stays[1]


def test_hot_rows_do_not_travel_without_the_flag(spark, facts, facts_dim):
    """The few right rows are counted and sent; a right side with too many is repeated instead."""
    hot = joins.hot_keys(facts, ["k"], share=10, min_rows=1, rate=1.0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = joins.skew_join(facts, facts_dim, ["k"], how="left", hot=hot)
        text = got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    stays = text.split("Union")[1].split("SortMergeJoin")
    assert len(stays) == 2 and "BroadcastHashJoin" in stays[1]
    assert rows(got) == rows(facts.join(facts_dim, ["k"], "left"))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_too_many_hot_right_rows_are_repeated(spark, monkeypatch, facts, facts_dim, how):
    hot = joins.hot_keys(facts, ["k"], share=10, min_rows=1, rate=1.0)
    monkeypatch.setattr(joins, "MOST_SENT", 0)
    got = joins.skew_join(facts, facts_dim, ["k"], how=how, hot=hot)
    assert rows(got) == rows(facts.join(facts_dim, ["k"], how))


def test_null_keys_are_spread_in_membership(spark):
    """The anti join is dealt by the key and a salt that NULL keys have of their own."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(100).select(F.when(F.col("id") > 90, F.col("id")).alias("k"), "id")
        keys = spark.createDataFrame([(95,), (None,)], "k long")
        got = joins.not_in(df, keys, ["k"])
        text = got._jdf.queryExecution().executedPlan().toString()
        n = got.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert n == 99 and got.columns == ["k", "id"]
    assert "__salt" in text.split("SortMergeJoin")[1]


def test_left_join_fill_fills_unmatched_rows_only(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (3, "d")], "k long, l string")
    right = spark.createDataFrame([(1, 10), (3, None)], "k long, v int")
    for null_keys in (False, True):
        got = joins.left_join_fill(left, right, ["k"], fill={"v": 0}, null_keys=null_keys)
        assert {r.l: r.v for r in got.collect()} == {"a": 10, "b": 0, "c": 0, "d": None}


def test_left_join_fill_without_fill_keeps_null(spark):
    left = spark.createDataFrame([(1, "a"), (None, "c")], "k long, l string")
    right = spark.createDataFrame([(2, 10)], "k long, v int")
    got = joins.left_join_fill(left, right, ["k"], null_keys=True)
    assert {r.l: r.v for r in got.collect()} == {"a": None, "c": None}


def test_membership_by_tag(spark):
    items = spark.createDataFrame(
        [("h1", "t1"), ("h2", "t1"), ("h3", "t2"), ("h4", None), ("h5", "t3"), ("h5", "t2")],
        "hash string, tag string",
    )
    delivered = spark.createDataFrame([("h1",), ("h9",), ("h5",)], "hash string")
    tags = joins.member_tags(items, delivered, "hash", "tag")
    assert rows(tags) == [("t1",), ("t2",), ("t3",)]
    only_h1 = joins.member_tags(items, delivered.where("hash <> 'h5'"), "hash", "tag")
    assert rows(joins.items_without_tags(items, only_h1, "hash", "tag")) == [("h3",), ("h5",)]


def test_null_keys_stay_in_not_in_and_leave_only_in(spark):
    df = spark.createDataFrame([("x",), ("y",), (None,)], "h string")
    keys = spark.createDataFrame([("x",)], "h string")
    assert rows(joins.not_in(df, keys, ["h"])) == [("y",), (None,)]
    assert rows(joins.only_in(df, keys, ["h"])) == [("x",)]


def test_anti_joins_are_not_null_aware(spark):
    left = spark.range(10).withColumnRenamed("id", "h")
    plan = joins.not_in(left, left.where("h < 3"), ["h"])._jdf.queryExecution().toString()
    assert "LeftAnti" in plan and "NullAware" not in plan


def test_full_join_fills_each_missing_side(spark):
    left = spark.createDataFrame([(1, 10), (2, None)], "k long, l int")
    right = spark.createDataFrame([(2, "x"), (3, "y")], "k long, r string")
    got = joins.full_join_fill(left, right, ["k"], left_fill={"l": 0}, right_fill={"r": ""})
    assert rows(got.select("k", "l", "r", "in_left", "in_right")) == [
        (1, 10, "", True, False),
        (2, None, "x", True, True),
        (3, 0, "y", False, True),
    ]
