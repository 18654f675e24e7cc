"""Previous-row differences, keep-first and top-k without unbounded window groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


STRETCH = 100_000


def gap_to_previous(
    df: DataFrame, by: Sequence[str], order: str, out: str, stretch: int = STRETCH
) -> DataFrame:
    """Add ``out`` = ``order`` minus the previous ``order`` of the same group, NULL for the first row.

    A group is cut into stretches of ``stretch`` consecutive order values, so that a
    busy group is shared by many tasks.  Only the first row of a stretch needs
    another one: the last value of the stretch before it, taken from a small
    (group, stretch) table.
    """
    part = "__part"
    cut = df.withColumn(part, F.floor(F.col(order) / F.lit(stretch)))
    stepped = cut.withColumn(
        "__prev", F.lag(order).over(Window.partitionBy(*by, part).orderBy(order))
    )
    lasts = cut.groupBy(*by, part).agg(F.max(order).alias("__last"))
    before = lasts.select(
        *[F.col(c).alias(f"__e_{c}") for c in by],
        F.col(part).alias("__e_part"),
        F.lag("__last").over(Window.partitionBy(*by).orderBy(part)).alias("__edge"),
    )
    same = F.col(part) == F.col("__e_part")
    for c in by:  # a NULL group has edges too
        same = same & F.col(c).eqNullSafe(F.col(f"__e_{c}"))
    joined = stepped.join(before, same, "left")
    return joined.withColumn(
        out, F.col(order) - F.coalesce(F.col("__prev"), F.col("__edge"))
    ).drop(part, "__prev", "__edge", "__e_part", *[f"__e_{c}" for c in by])


def gaps_within(
    df: DataFrame, by: Sequence[str], order: str, out: str, most: int, stretch: int = STRETCH
) -> DataFrame:
    """Rows of ``gap_to_previous`` whose gap is at most ``most``, with one shuffle.

    Rows in the last ``most`` values of a stretch are also sent to the next one, as
    possible predecessors of its first row; a predecessor further away would give
    too large a gap anyway.
    """
    part, guest = "__part", "__guest"
    wide = max(stretch, most)
    own = F.floor(F.col(order) / F.lit(wide))
    near_end = F.col(order) >= (own + 1) * F.lit(wide) - F.lit(most)
    placed = df.withColumn(
        part, F.explode(F.when(near_end, F.array(own, own + 1)).otherwise(F.array(own)))
    ).withColumn(guest, F.col(part) != own)
    window = Window.partitionBy(*by, part).orderBy(order, F.col(guest).desc())
    stepped = placed.withColumn(out, F.col(order) - F.lag(order).over(window))
    return stepped.where(~F.col(guest) & (F.col(out) <= F.lit(most))).drop(part, guest)


def keep_first(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first by ``order``; remaining ties go to the smallest row.

    The least struct is an ordinary aggregate: combined on the map side, so copies
    of one key never meet in one task, and the same whatever the partitioning.
    """
    rest = [c for c in df.columns if c not in key]
    ranked = F.struct(
        *[o.alias(f"__o{i}") for i, o in enumerate(order)], F.struct(*rest).alias("__row")
    )
    best = df.groupBy(*key).agg(F.min(ranked).alias("__best"))
    return best.select(*key, "__best.__row.*").select(*df.columns)


def top_k(df: DataFrame, k: int, value: str, tie_break: Sequence[str]) -> DataFrame:
    """The k rows with the largest value; ties by ``tie_break`` ascending."""
    return df.orderBy(F.col(value).desc(), *[F.col(c).asc() for c in tie_break]).limit(k)
