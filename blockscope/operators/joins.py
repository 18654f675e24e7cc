"""Equi joins that keep working when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockscope.session import settled

#: Rows of a few columns that are broadcast at most, after they were counted.
MOST_SENT = 200_000

_SALT = "__salt"
_HOT = "__hot"
_FOUND = "__found"


def _any_null(cols: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols])


def hot_keys(
    df: DataFrame,
    on: Sequence[str],
    share: int = 64,
    min_rows: int = 100_000,
    rate: float = 1 / 256,
) -> DataFrame:
    """Keys, NULL among them, that hold more than 1/share of the rows, counted on a drawn part.

    Fewer than ``share`` keys can pass, whatever the size of the data, so they are fetched
    and sent out with the plan.  They only decide how work is divided: no result depends on
    them.
    """
    keys = df.select(*on)
    drawn = keys if rate >= 1 else keys.sample(rate, seed=1)
    per_key = drawn.groupBy(*on).agg(F.count(F.lit(1)).alias("__n"))
    total = per_key.agg(F.sum("__n")).scalar()
    hot = per_key.where(
        (F.col("__n") / F.lit(rate) >= F.lit(min_rows)) & (F.col("__n") * F.lit(share) > total)
    ).select(*on, F.lit(True).alias(_HOT))
    return df.sparkSession.createDataFrame(hot.limit(share).collect(), hot.schema)


def sent_whole(df: DataFrame) -> tuple[DataFrame, bool]:
    """The frame settled, marked for broadcast if it was counted and is small, and whether it is."""
    df = settled(df)
    small = df.limit(MOST_SENT + 1).count() <= MOST_SENT
    return (F.broadcast(df) if small else df), small


def _null_salt(df: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows with a NULL key, which match nothing, get a salt from their other columns; all others 0."""
    rest = [c for c in df.columns if c not in on]
    others = F.xxhash64(*rest) if rest else F.lit(0).cast("long")
    return df.withColumn(_SALT, F.when(_any_null(on), others).otherwise(F.lit(0).cast("long")))


def skew_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    one_row_per_key: bool = False,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Join a fact side whose keys may be hot with a side that has few rows per key.

    Without ``hot`` this is the plain join, whose skewed partitions Spark splits as it
    runs.  Where the hot keys are known beforehand (``hot_keys``), as when one join is run
    over and over, their rows do not travel: they meet the few right
    rows of those keys where they are, be they copies of one row or not.  So do left
    rows with a NULL key, which match nothing.  All other rows are joined as usual.
    With ``one_row_per_key`` the hot right rows are fewer than the hot keys' bound and
    are broadcast; otherwise they are counted, and where they are more than
    ``MOST_SENT`` the hot keys are each shared by many tasks instead (``repeat_join``).
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"skew_join does not do {how}")
    if hot is None or hot.isEmpty():
        return left.join(right, list(on), how)
    # Bounded broadcast: fewer rows than the share that makes a key hot.
    hot = F.broadcast(hot)
    marked = left.join(hot, list(on), "left")
    stays = F.col(_HOT).isNotNull() | _any_null(on)
    few, small = right.join(hot.drop(_HOT), list(on), "left_semi"), True
    if one_row_per_key:
        few = F.broadcast(few)
    else:
        few, small = sent_whole(few)
    usual = marked.where(~stays).drop(_HOT).join(right, list(on), how)
    still = marked.where(stays).drop(_HOT)
    rest = [c for c in left.columns if c not in on] or list(on)
    there = still.join(few, list(on), how) if small else repeat_join(still, few, on, rest, how)
    return usual.unionByName(there)


def repeat_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    spread: Sequence[str],
    how: str = "inner",
    salts: int | None = None,
) -> DataFrame:
    """Join a left side with a far smaller right side, each key shared by ``salts`` tasks.

    Left rows are spread by a hash of ``spread``, columns that tell the rows of one
    key apart, and every right row is repeated.  Without ``salts`` a key is shared by as many
    tasks as a shuffle has.  The salts depend on the data alone, so a re-run task places
    each row as before.
    """
    if salts is None:
        salts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"repeat_join does not do {how}")
    salt = F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")
    every = F.sequence(F.lit(0), F.lit(salts - 1))
    return (
        left.withColumn(_SALT, salt)
        .join(right.withColumn(_SALT, F.explode(every)), [*on, _SALT], how)
        .drop(_SALT)
    )


def left_join_fill(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    fill: Mapping[str, object] | None = None,
    null_keys: bool = False,
) -> DataFrame:
    """Left join whose unmatched right columns get the given defaults instead of NULL.

    Left keys are expected to repeat little (aggregates, keyed tables).  NULL keys,
    which an earlier unmatched join produces in bulk, match nothing; ``null_keys``
    spreads them over all tasks.  Only unmatched rows are filled: a NULL stored in a
    matched row stays NULL.
    """
    keys = list(on)
    if null_keys:
        left = _null_salt(left, on)
        right = right.withColumn(_SALT, F.lit(0).cast("long"))
        keys = [*on, _SALT]
    if fill:
        right = right.withColumn(_FOUND, F.lit(True))
    joined = left.join(right, keys, "left")
    for name, default in (fill or {}).items():
        joined = joined.withColumn(
            name, F.when(F.col(_FOUND).isNull(), F.lit(default)).otherwise(F.col(name))
        )
    return joined.drop(_SALT, _FOUND)


def full_join_fill(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    left_fill: Mapping[str, object] | None = None,
    right_fill: Mapping[str, object] | None = None,
) -> DataFrame:
    """Full outer join where a side that has no match gets its defaults instead of NULL.

    ``in_left`` and ``in_right`` tell which sides a row came from.
    """
    marked = {"in_left": left.withColumn("in_left", F.lit(True)),
              "in_right": right.withColumn("in_right", F.lit(True))}
    joined = marked["in_left"].join(marked["in_right"], list(on), "full")
    for mark, fill in (("in_left", left_fill), ("in_right", right_fill)):
        joined = joined.withColumn(mark, F.coalesce(mark, F.lit(False)))
        for name, default in (fill or {}).items():
            joined = joined.withColumn(
                name, F.when(F.col(mark), F.col(name)).otherwise(F.lit(default))
            )
    return joined


def member_tags(items: DataFrame, members: DataFrame, key: str, tag: str) -> DataFrame:
    """Tags that occur on at least one item whose key is in ``members``."""
    keys = members.select(key).distinct()
    return items.join(keys, key, "left_semi").where(F.col(tag).isNotNull()).select(tag).distinct()


def items_without_tags(
    items: DataFrame, tags: DataFrame, key: str, tag: str, hot: DataFrame | None = None
) -> DataFrame:
    """Keys of items whose tag is not in ``tags``.

    A tag may sit on a large share of the items, and there are far fewer tags than items.
    """
    tagged = items.where(F.col(tag).isNotNull()).select(key, tag)
    untagged = skew_join(
        tagged, tags.distinct(), [tag], how="left_anti", one_row_per_key=True, hot=hot
    )
    return untagged.select(key).distinct()


def items_left(items: DataFrame, tags: DataFrame, tag: str) -> DataFrame:
    """The items whose tag, never NULL, is not in ``tags``, with all their columns."""
    return items.join(tags.select(tag).distinct(), tag, "left_anti").select(*items.columns)


def only_in(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key is in ``keys``; rows with a NULL key are left out."""
    return df.join(keys, list(on), "left_semi")


def not_in(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key is not in ``keys``; rows with a NULL key are kept, and spread over all tasks."""
    there = keys.select(*on).withColumn(_SALT, F.lit(0).cast("long"))
    return _null_salt(df, on).join(there, [*on, _SALT], "left_anti").drop(_SALT)
