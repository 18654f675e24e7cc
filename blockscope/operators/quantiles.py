"""Exact quantiles with linear interpolation, per group and for a whole column.

Spark's ``percentile`` keeps every distinct value of a group in one task.  That is
used for groups up to a checked number of distinct values.  Larger groups are cut into
value ranges, each group by its own cut points, so that only the ranges that hold a wanted rank are ever sorted, each
in its own task, however large the group is.  Both ways interpolate alike, to the last bit.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import isqrt
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockscope.session import settled

_V, _N, _RANGE = "__v", "__n", "__range"

# So many rows of a few numbers fit into one task's memory many times over.
IN_MEMORY = 1_000_000
RANGES = 256
# Groups whose cut points are broadcast at most, 3 kB each for 256 ranges.
SPLIT_GROUPS = 10_000


def value_counts(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(group, value, row count) without NULL and NaN; combined before the shuffle."""
    return (
        df.select(*by, F.col(value).cast("double").alias(_V))
        .where(F.col(_V).isNotNull() & ~F.isnan(_V))
        .groupBy(*by, _V)
        .agg(F.count(F.lit(1)).alias(_N))
    )


def _splitters(counts: DataFrame, by: Sequence[str], ranges: int) -> DataFrame:
    """Per group its cut points, at most ``ranges - 1``, ascending, and every so many of them as ``__coarse``.

    They are approximate ranks from a sketch of each group, merged on the map side.  They only
    balance the work, all counted rows take part in the result.
    """
    shares = [i / ranges for i in range(1, ranges)]
    cuts = F.array_distinct(F.percentile_approx(_V, shares, max(10_000, 4 * ranges)))
    found = counts.groupBy(*by).agg(cuts.alias("__cuts"))
    every = F.filter("__cuts", lambda _, i: i % _step(ranges) == _step(ranges) - 1)
    return found.withColumn("__coarse", every)


def _step(ranges: int) -> int:
    return max(1, isqrt(ranges))


def _ranged(counts: DataFrame, by: Sequence[str], ranges: int) -> DataFrame:
    """Add the number of the value range a row is in; about equally many rows of its group in each.

    The range is the number of cut points below the value, counted among the coarse ones and
    then among those up to the next coarse one.
    """
    by, step = list(by), _step(ranges)
    splitters = settled(_splitters(counts, by, ranges))
    if by:
        named = splitters.select(*[F.col(c).alias(f"__c_{c}") for c in by], "__cuts", "__coarse")
        if named.count() <= SPLIT_GROUPS:
            named = F.broadcast(named)  # the number is checked, each has two short arrays
        same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"__c_{c}")) for c in by])
        cut = counts.join(named, same).drop(*[f"__c_{c}" for c in by])
    else:
        row = splitters.first()  # fewer numbers than ranges
        cut = counts.withColumns({n: F.array(*map(F.lit, row[n] or [])).cast("array<double>") for n in ("__cuts", "__coarse")})

    def below(cuts: Column) -> Column:
        return F.size(F.filter(cuts, lambda c: c < F.col(_V)))

    cut = cut.withColumn("__at", below(F.col("__coarse")) * step)
    fine = F.slice("__cuts", F.col("__at") + 1, F.lit(step))
    return cut.withColumn(_RANGE, F.col("__at") + below(fine)).drop("__at", "__cuts", "__coarse")


def quantiles_of_counts(
    counts: DataFrame, by: Sequence[str], wanted: dict[str, float], in_memory: int = IN_MEMORY
) -> DataFrame:
    """Exact quantiles of settled ``value_counts``: one row per group, one column per name.

    Only groups of more than ``in_memory`` distinct values are cut into ranges; however
    many small groups there are, they are one aggregate.
    """
    by = list(by)
    sizes = counts.groupBy(*by).agg(F.count(F.lit(1)).alias("__size"))
    largest = sizes.agg(F.max("__size")).first()[0] or 0
    if largest <= in_memory:
        return _quantiles_in_memory(counts, by, wanted)
    ranges = max(RANGES, largest // IN_MEMORY)
    if not by:
        return quantiles_by_range(counts, by, wanted, ranges)
    # Fewer groups than counted rows divided by the bound.
    large = settled(sizes.where(F.col("__size") > in_memory).select(*[F.col(c).alias(f"__l_{c}") for c in by]))
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"__l_{c}")) for c in by])
    if large.count() <= IN_MEMORY:
        large = F.broadcast(large)  # the number is checked
    small = _quantiles_in_memory(counts.join(large, same, "left_anti"), by, wanted)
    cut = settled(counts.join(large, same, "left_semi"))
    return small.unionByName(quantiles_by_range(cut, by, wanted, ranges))


def _quantiles_in_memory(counts: DataFrame, by: Sequence[str], wanted: dict[str, float]) -> DataFrame:
    return counts.groupBy(*by).agg(
        *[F.percentile(_V, q, F.col(_N)).alias(name) for name, q in wanted.items()]
    )


def quantiles_by_range(
    counts: DataFrame, by: Sequence[str], wanted: dict[str, float], ranges: int = RANGES
) -> DataFrame:
    """As ``quantiles_of_counts`` for any number of distinct values in a group.

    Three passes over the settled counts: cut points per group, rows per range, values of the
    ranges that hold a wanted rank.
    """
    by = list(by)
    ranged = _ranged(counts, by, ranges)

    # At most `ranges` rows per group from here to `spots`.
    totals = ranged.groupBy(*by, _RANGE).agg(F.sum(_N).alias("__m"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    upto = group.orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spots = totals.select(
        *by,
        _RANGE,
        (F.sum("__m").over(upto) - F.col("__m")).alias("__before"),
        F.sum("__m").over(upto).alias("__after"),
        F.sum("__m").over(group).alias("__total"),
    )

    def rank(q: float) -> Column:
        return F.lit(q) * (F.col("__total") - 1)

    def low(q: float) -> Column:
        return F.floor(rank(q))

    def high(q: float) -> Column:
        return F.ceil(rank(q))

    def inside(p: Column, start: str, stop: str) -> Column:
        return (p >= F.col(start)) & (p < F.col(stop))

    hits = [inside(p(q), "__before", "__after") for q in wanted.values() for p in (low, high)]
    spots = spots.where(reduce(lambda a, b: a | b, hits)).select(
        *[F.col(c).alias(f"__s_{c}") for c in by],
        F.col(_RANGE).alias("__s_range"),
        "__before",
        "__total",
    )
    spots = settled(spots)
    if spots.count() <= IN_MEMORY:
        spots = F.broadcast(spots)  # the size is checked
    same = ranged[_RANGE] == F.col("__s_range")
    for c in by:
        same = same & ranged[c].eqNullSafe(F.col(f"__s_{c}"))
    near = ranged.join(spots, same, "inner").drop("__s_range", *[f"__s_{c}" for c in by])

    within = Window.partitionBy(*by, _RANGE).orderBy(_V)
    running = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = near.withColumn("__stop", F.col("__before") + F.sum(_N).over(running)).withColumn(
        "__start", F.col("__stop") - F.col(_N)
    )

    picks: list[Column] = [F.max("__total").alias("__total")]
    for name, q in wanted.items():
        picks.append(F.max(F.when(inside(low(q), "__start", "__stop"), F.col(_V))).alias(f"__lo_{name}"))
        picks.append(F.max(F.when(inside(high(q), "__start", "__stop"), F.col(_V))).alias(f"__hi_{name}"))
    ends = placed.groupBy(*by).agg(*picks)

    def between(name: str, q: float) -> Column:
        """The formula of ``percentile``, term for term, so that both ways give the same bits."""
        below, above = F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
        mixed = (high(q) - rank(q)) * below + (rank(q) - low(q)) * above
        return F.when((low(q) == high(q)) | (below == above), below).otherwise(mixed)

    return ends.select(*by, *[between(name, q).alias(name) for name, q in wanted.items()])


def grouped_quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    wanted: dict[str, float],
    in_memory: int = IN_MEMORY,
) -> DataFrame:
    """Exact quantiles of ``value`` per group.  A group whose values are all NULL is absent."""
    return quantiles_of_counts(settled(value_counts(df, by, value)), by, wanted, in_memory)


def grouped_median(df: DataFrame, by: Sequence[str], value: str, out: str) -> DataFrame:
    return grouped_quantiles(df, by, value, {out: 0.5})


def trim_quantile(
    df: DataFrame,
    value: str,
    q: float,
    method: str = "exact",
    in_memory: int = IN_MEMORY,
    settle: bool = False,
) -> DataFrame:
    """Keep rows at or below the column's q-quantile; NULL values are dropped.

    ``approx`` takes the bound from ``percentile_approx`` at one part in a million,
    without shuffling the values, for when a near bound will do.
    The rows are read twice, for the bound and for the result.  A scan or one aggregate is
    cheaper to read again than to store; ``settle`` stores rows that cost more.
    """
    if method not in ("exact", "approx"):
        raise ValueError(f"unknown quantile method {method}")
    rows = settled(df) if settle else df
    if method == "approx":
        bound = rows.agg(F.percentile_approx(F.col(value).cast("double"), q, 1_000_000))
    else:
        bound = grouped_quantiles(rows, [], value, {value: q}, in_memory)
    return rows.where(F.col(value).cast("double") <= bound.scalar())
