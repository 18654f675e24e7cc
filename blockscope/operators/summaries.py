"""The statistic behind each kind of chart, as a small table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockscope.functions.bins import edge_count, left_closed_bin, right_closed_bin
from blockscope.operators.joins import repeat_join, sent_whole
from blockscope.operators.quantiles import (
    IN_MEMORY,
    grouped_quantiles,
    quantiles_of_counts,
    value_counts,
)
from blockscope.session import settled

_V, _N = "__v", "__n"


def _span(values: DataFrame, n: int) -> Column:
    """Scalar (lo, width, total) of equal-width bins over the values; one value gets lo +- 0.5."""
    flat = F.min(_V) == F.max(_V)
    lo = F.when(flat, F.min(_V) - 0.5).otherwise(F.min(_V))
    hi = F.when(flat, F.max(_V) + 0.5).otherwise(F.max(_V))
    return values.agg(
        F.struct(lo.alias("lo"), ((hi - lo) / F.lit(n)).alias("width"), F.count(_V).alias("total"))
    ).scalar()


def histogram(df: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """Equal-width bins over the column's range, the last one closed; NULL and NaN are left out.

    (bin, lo, hi, n, density), one row per bin even where it is empty; density is
    the share of rows per unit of the axis.  Reads the column twice, for the range
    and for the counts, and shuffles bin counts only; settle a costly input first.
    """
    values = df.select(F.col(value).cast("double").alias(_V)).where(
        F.col(_V).isNotNull() & ~F.isnan(_V)
    )
    span = _span(values, bins)
    lo, width = span.getField("lo"), span.getField("width")
    binned = values.withColumns({"__lo": lo, "__width": width}).select(
        left_closed_bin(F.col(_V), F.col("__lo"), F.col("__width"), bins).alias("bin")
    )
    filled = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    frame = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    edge = F.col("bin").cast("double")
    return frame.join(filled, "bin", "left").select(
        "bin",
        (lo + edge * width).alias("lo"),
        (lo + (edge + 1) * width).alias("hi"),
        F.coalesce("n", F.lit(0)).alias("n"),
        (F.coalesce("n", F.lit(0)) / (span.getField("total") * width)).alias("density"),
    )


def histogram_by(df: DataFrame, by: str, value: str, bins: int = 50) -> DataFrame:
    """``histogram`` per facet, each over its own range: (by, bin, lo, hi, n, density).

    A facet may hold a large share of the rows: its value counts are spread to meet
    the facet's range, and only bin counts are shuffled after that.
    """
    counts = settled(value_counts(df.where(F.col(by).isNotNull()), [by], value))
    flat = F.min(_V) == F.max(_V)
    spans = counts.groupBy(by).agg(
        F.when(flat, F.min(_V) - 0.5).otherwise(F.min(_V)).alias("__lo"),
        F.when(flat, F.max(_V) + 0.5).otherwise(F.max(_V)).alias("__hi"),
        F.sum(_N).alias("__total"),
    ).select(by, "__lo", ((F.col("__hi") - F.col("__lo")) / F.lit(bins)).alias("__width"), "__total")
    facet = [by, "__lo", "__width", "__total"]
    binned = repeat_join(counts, spans, [by], spread=[_V]).groupBy(
        *facet, left_closed_bin(F.col(_V), F.col("__lo"), F.col("__width"), bins).alias("bin")
    ).agg(F.sum(_N).alias("n"))
    # At most one entry per bin.
    filled = binned.groupBy(*facet).agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("filled")
    )
    lo, width, edge = F.col("__lo"), F.col("__width"), F.col("bin").cast("double")
    rows = F.coalesce(F.try_element_at("filled", F.col("bin")), F.lit(0))
    return filled.select(
        *facet, "filled", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")
    ).select(
        by,
        "bin",
        (lo + edge * width).alias("lo"),
        (lo + (edge + 1) * width).alias("hi"),
        rows.alias("n"),
        (rows / (F.col("__total") * width)).alias("density"),
    )


def histogram_edges(df: DataFrame, value: str, edges: Sequence[float], by: str) -> DataFrame:
    """Counts between given sorted edges per facet: (by, bin, lo, hi, n).

    Bins are closed on the left, the last one on both sides; values outside are
    ignored.  Every facet has every bin.
    """
    last = len(edges) - 2
    cuts = F.array(*[F.lit(float(e)) for e in edges])
    values = df.select(by, F.col(value).cast("double").alias(_V))
    number = F.when(F.col(_V) == F.lit(float(edges[-1])), F.lit(last)).otherwise(
        edge_count(F.col(_V), cuts) - 1
    )
    binned = values.groupBy(by, number.alias("bin")).agg(F.count(_V).alias("n"))
    inside = (F.col("bin") >= 0) & (F.col("bin") <= last)
    # At most one entry per bin.
    per_facet = binned.groupBy(by).agg(
        F.map_from_entries(F.collect_list(F.when(inside, F.struct("bin", "n")))).alias("filled")
    )
    return per_facet.select(by, "filled", F.explode(F.sequence(F.lit(0), F.lit(last))).alias("bin")).select(
        by,
        "bin",
        F.get(cuts, F.col("bin")).alias("lo"),
        F.get(cuts, F.col("bin") + 1).alias("hi"),
        F.coalesce(F.try_element_at("filled", F.col("bin")), F.lit(0)).alias("n"),
    )


def box_stats(df: DataFrame, by: str, value: str, in_memory: int = IN_MEMORY) -> DataFrame:
    """Box summary per category: quartiles, whiskers, number of outliers.

    Whiskers reach the furthest values within 1.5 inter-quartile ranges, never
    inside the box.  Rows without a category are left out.
    """
    counts = settled(value_counts(df.where(F.col(by).isNotNull()), [by], value))
    quartiles = quantiles_of_counts(counts, [by], {"q1": 0.25, "median": 0.5, "q3": 0.75}, in_memory)
    fences, small = sent_whole(_with_fences(quartiles))
    inside = (F.col(_V) >= F.col("__low")) & (F.col(_V) <= F.col("__high"))
    return (
        (counts.join(fences, by) if small else repeat_join(counts, fences, [by], spread=[_V]))
        .groupBy(by, "q1", "median", "q3")
        .agg(
            F.min(F.when(inside, F.col(_V))).alias("__wlo"),
            F.max(F.when(inside, F.col(_V))).alias("__whi"),
            F.sum(F.when(inside, F.lit(0)).otherwise(F.col(_N))).alias("n_out"),
        )
        .select(
            by,
            "q1",
            "median",
            "q3",
            F.least("__wlo", "q1").alias("whisker_lo"),
            F.greatest("__whi", "q3").alias("whisker_hi"),
            "n_out",
        )
    )


def _with_fences(quartiles: DataFrame) -> DataFrame:
    reach = (F.col("q3") - F.col("q1")) * 1.5
    return quartiles.withColumns({"__low": F.col("q1") - reach, "__high": F.col("q3") + reach})


def box_outliers(df: DataFrame, by: str, value: str, spread: Sequence[str]) -> DataFrame:
    """The rows beyond the fences of ``box_stats``."""
    fences = _with_fences(
        grouped_quantiles(df.where(F.col(by).isNotNull()), [by], value, {"q1": 0.25, "q3": 0.75})
    ).select(by, "__low", "__high")
    # Few fences go to the rows; only more than a broadcast holds are met by a shuffle.
    fences, small = sent_whole(fences)
    return (
        (df.join(fences, by) if small else repeat_join(df, fences, [by], spread=spread))
        .where((F.col(value) < F.col("__low")) | (F.col(value) > F.col("__high")))
        .select(*df.columns)
    )


def line_series(
    df: DataFrame, x: str, y: str, series: str | None = None, reference: str | None = None
) -> DataFrame:
    """Mean and row count of y per x (and series); with a reference date, is x on or after it?"""
    keys = [x] if series is None else [series, x]
    out = df.groupBy(*keys).agg(F.avg(y).alias("mean"), F.count(y).alias("n"))
    if reference is not None:
        after = F.col(x) >= F.lit(reference).cast("timestamp")
        out = out.withColumn("after_reference", after.cast("int"))
    return out


def regression_line(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares line through (x, y): slope, intercept, r2, n.  One pass, one row."""
    return df.agg(
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
        F.regr_count(y, x).alias("n"),
    )


def binned_median(df: DataFrame, x: str, y: str, lo: float, hi: float, n: int) -> DataFrame:
    """Median of y in n equal bins of x over ``(lo, hi]``: (bin, bin_center, median_value).

    Bins are closed on the right; empty bins are kept with a NULL median.
    """
    width = F.lit((hi - lo) / n)
    start = F.lit(float(lo))
    binned = df.select(
        right_closed_bin(F.col(x).cast("double"), start, width, n).alias("bin"), F.col(y)
    ).where(F.col("bin").isNotNull())
    medians = grouped_quantiles(binned, ["bin"], y, {"median_value": 0.5})
    frame = df.sparkSession.range(n).select(F.col("id").cast("int").alias("bin"))
    edge = F.col("bin").cast("double")
    centre = ((start + edge * width) + (start + (edge + 1) * width)) / 2
    return frame.join(medians, "bin", "left").select(
        "bin", centre.alias("bin_center"), "median_value"
    )


def kde_grid(df: DataFrame, value: str, points: int = 200, bins: int = 50) -> DataFrame:
    """Gaussian density curve on an even grid over the column's range: (point, x, density).

    Bandwidth is n^(-1/5) sample standard deviations; the curve is scaled to sit on
    a count histogram of ``bins`` bins.  Every distinct value adds to each grid point
    inside its own task; only ``points`` sums per task are shuffled.
    """
    counts = settled(value_counts(df, [], value))
    about = counts.agg(
        F.struct(
            F.min(_V).alias("lo"),
            F.max(_V).alias("hi"),
            F.sum(_N).alias("n"),
            F.try_divide(F.sum(F.col(_V) * F.col(_N)), F.sum(_N)).alias("mean"),
        )
    ).scalar()
    spread = counts.agg(
        F.sqrt(
            F.try_divide(
                F.sum(F.col(_N) * F.pow(F.col(_V) - about.getField("mean"), 2)),
                F.sum(_N) - 1,
            )
        )
    ).scalar()
    n = about.getField("n").cast("double")
    lo = about.getField("lo")
    reach = about.getField("hi") - lo
    step = reach / F.lit(points - 1)
    width = spread * F.pow(n, F.lit(-0.2))
    scaled = counts.select(
        F.col(_N),
        ((F.col(_V) - lo) / width).alias("__x"),
        (step / width).alias("__step"),
        F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"),
    )
    away = F.col("point") * F.col("__step") - F.col("__x")
    sums = scaled.groupBy("point").agg(F.sum(F.col(_N) * F.exp(-0.5 * away * away)).alias("__sum"))
    norm = (reach / F.lit(bins)) / (width * F.sqrt(F.lit(2.0) * F.pi()))
    return sums.select(
        "point",
        (lo + F.col("point") * step).alias("x"),
        (F.col("__sum") * norm).alias("density"),
    )


# A node adds nothing a double can show to points further away than so many bandwidths.
_REACH = 9


def kde_binned(
    df: DataFrame, value: str, points: int = 200, bins: int = 50, per_width: int = 512
) -> DataFrame:
    """``kde_grid`` from a fine grid in place of the distinct values: (point, x, density).

    Each value is shared by the two grid nodes next to it, in proportion to its place between them;
    the curve is the nodes' convolution with the Gaussian.  With ``per_width`` nodes a bandwidth it
    differs from ``kde_grid`` by less than one in 8 * per_width^2 parts of its peak.  The column is
    read twice and never shuffled, only occupied nodes are.  A column of one distinct value has no density (NULL).
    """
    values = df.select(F.col(value).cast("double").alias(_V)).where(F.col(_V).isNotNull() & ~F.isnan(_V))
    about = values.agg(
        F.struct(
            F.min(_V).alias("lo"),
            (F.max(_V) - F.min(_V)).alias("reach"),
            F.count(_V).cast("double").alias("n"),
            F.nullif(F.stddev_samp(_V), F.lit(0.0)).alias("spread"),
        )
    ).scalar()
    lo, reach = about.getField("lo"), about.getField("reach")
    width = about.getField("spread") * F.pow(about.getField("n"), F.lit(-0.2))
    place = (F.col(_V) - F.col("__lo")) / F.col("__width") * per_width
    placed = values.withColumns({"__lo": lo, "__width": width}).select(place.alias("__at"))
    # a cell's rows and how far above its lower node they lie in all
    cells = placed.groupBy(F.floor("__at").alias("node")).agg(
        F.count(F.lit(1)).cast("double").alias("__n"), F.sum(F.col("__at") - F.floor("__at")).alias("__upper")
    )
    ends = F.array(
        F.struct(F.col("node"), (F.col("__n") - F.col("__upper")).alias("weight")),
        F.struct((F.col("node") + 1).alias("node"), F.col("__upper").alias("weight")),
    )
    nodes = cells.select(F.inline(ends)).groupBy("node").agg(F.sum("weight").alias("weight"))
    step = reach / F.lit(points - 1)
    scaled = nodes.withColumns({"__step": step / width}).select(
        "weight", "__step", (F.col("node") / per_width).alias("__x")
    )
    first = F.greatest(F.lit(0), F.ceil((F.col("__x") - _REACH) / F.col("__step")))
    last = F.least(F.lit(points - 1), F.floor((F.col("__x") + _REACH) / F.col("__step")))
    near = scaled.where(first <= last).select("weight", "__step", "__x", F.explode(F.sequence(first, last)).alias("point"))
    away = F.col("point") * F.col("__step") - F.col("__x")
    sums = near.groupBy(F.col("point").cast("int").alias("point")).agg(
        F.sum(F.col("weight") * F.exp(-0.5 * away * away)).alias("__sum")
    )
    norm = (reach / F.lit(bins)) / (width * F.sqrt(F.lit(2.0) * F.pi()))
    frame = df.sparkSession.range(points).select(F.col("id").cast("int").alias("point"))
    return frame.join(sums, "point", "left").select(
        "point",
        (lo + F.col("point") * step).alias("x"),
        (F.coalesce("__sum", F.lit(0.0)) * norm).alias("density"),
    )
