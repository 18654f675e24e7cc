"""Bin numbers for sorted edges and for equal-width ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def edge_count(value: Column, edges: Column) -> Column:
    """How many of a sorted array of edges are <= value."""
    return F.size(F.filter(edges, lambda edge: edge <= value))


def left_closed_bin(x: Column, lo: Column, width: Column, n: int) -> Column:
    """Bin of ``[lo + b*w, lo + (b+1)*w)``, the last one closed on both sides.

    The division may land one bin off next to an edge; the edges themselves decide.
    """
    b = F.floor((x - lo) / width)
    near = (
        F.when(x < lo + b * width, b - 1)
        .when(x >= lo + (b + 1) * width, b + 1)
        .otherwise(b)
    )
    return F.greatest(F.least(near, F.lit(n - 1)), F.lit(0)).cast("int")


def right_closed_bin(x: Column, lo: Column, width: Column, n: int) -> Column:
    """Bin of ``(lo + b*w, lo + (b+1)*w]``; NULL outside, the lowest edge included in no bin."""
    b = F.ceil((x - lo) / width) - 1
    near = (
        F.when(x <= lo + b * width, b - 1)
        .when(x > lo + (b + 1) * width, b + 1)
        .otherwise(b)
    )
    return F.when((near >= 0) & (near < n), near).cast("int")
