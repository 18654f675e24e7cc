"""Ranges of whole numbers that a set of overlapping spans leaves uncovered."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockscope.operators.windows import STRETCH


def uncovered(
    spans: DataFrame,
    within: DataFrame,
    by: Sequence[str],
    low: str = "low",
    high: str = "high",
    stretch: int = STRETCH,
) -> DataFrame:
    """(by, low, high): the longest ranges of each group of ``within`` that no span touches.

    ``within`` has one row per group, whose ``low`` to ``high`` is looked at; spans of the same
    columns may overlap, repeat, reach beyond it or be absent.  Spans with a NULL end, or that end before
    they begin, cover nothing.

    A span opens a range if it begins beyond all that earlier ones reach.  How far those reach is a
    running maximum inside stretches of numbers, and from stretch to stretch over one row
    of each, so a group is never in one window with all its spans.
    """
    by = list(by)
    spans = spans.where(F.col(low) <= F.col(high))
    firsts = spans.groupBy(*by, low).agg(F.max(high).alias(high))  # combined before the shuffle
    cut = firsts.withColumn("__part", F.floor(F.col(low) / stretch))
    ordered = Window.partitionBy(*by, "__part").orderBy(low)
    reached = cut.withColumn("__near", F.max(high).over(ordered.rowsBetween(Window.unboundedPreceding, -1)))
    ends = cut.groupBy(*by, "__part").agg(F.max(high).alias("__end"))
    earlier = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    edges = ends.select(
        *[F.col(c).alias(f"__e_{c}") for c in by],
        F.col("__part").alias("__e_part"),
        F.max("__end").over(earlier).alias("__far"),
    )
    same = F.col("__part") == F.col("__e_part")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__e_{c}"))
    reached = reached.join(edges, same)
    known = F.greatest("__near", "__far")  # of those that are not NULL
    opened = reached.select(*by, (known + 1).alias("__from"), (F.col(low) - 1).alias("__to"))
    # the last range of a group begins after the highest number of all; its first has no beginning
    closing = ends.groupBy(*by).agg((F.max("__end") + 1).alias("__from"))
    opened = opened.unionByName(closing.withColumn("__to", F.lit(None).cast("long")))

    looked = within.select(*[F.col(c).alias(f"__w_{c}") for c in by], F.col(low).alias("__low"), F.col(high).alias("__high"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(f"__w_{c}").eqNullSafe(F.col(c))
    # a group without a span has one row without ends: all of it is uncovered
    ranges = looked.join(opened, same, "left").select(
        *[F.col(f"__w_{c}").alias(c) for c in by],
        F.greatest("__from", "__low").alias(low),
        F.least("__to", "__high").alias(high),
    )
    return ranges.where(F.col(low) <= F.col(high))
