import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from blockscope.operators import shaping, summaries


def frame(spark, values, name="v"):
    return spark.createDataFrame([(None if v is None else float(v),) for v in values], f"{name} double")


@pytest.mark.parametrize("bins", [5, 50, 1000])
def test_histogram_is_numpys(spark, bins):
    rng = np.random.default_rng(bins)
    values = np.concatenate([rng.lognormal(2, 0.5, 4000), np.arange(0, 50)]).round(2)
    got = summaries.histogram(frame(spark, [*values, None, float("nan")]), "v", bins).orderBy("bin").toPandas()
    counts, edges = np.histogram(values, bins=bins)
    density, _ = np.histogram(values, bins=bins, density=True)
    assert got["n"].tolist() == counts.tolist()
    assert got["lo"].to_numpy() == pytest.approx(edges[:-1])
    assert got["hi"].to_numpy() == pytest.approx(edges[1:])
    assert got["density"].to_numpy() == pytest.approx(density)


def test_histogram_of_one_value(spark):
    got = summaries.histogram(frame(spark, [3, 3]), "v", 4).orderBy("bin").toPandas()
    counts, edges = np.histogram([3.0, 3.0], bins=4)
    assert got["n"].tolist() == counts.tolist()
    assert got["lo"].tolist() == pytest.approx(edges[:-1].tolist())


def test_histogram_by_facet_is_numpys_per_facet(spark):
    rng = np.random.default_rng(11)
    facets = {1: rng.normal(5, 2, 800).round(1), 2: np.array([3.0, 3.0]), 3: np.arange(21.0)}
    rows = [(k, float(v)) for k, vs in facets.items() for v in vs] + [(None, 1.0), (1, None)]
    got = summaries.histogram_by(spark.createDataFrame(rows, "k int, v double"), "k", "v", 10).toPandas()
    for k, vs in facets.items():
        mine = got[got.k == k].sort_values("bin")
        counts, edges = np.histogram(vs, bins=10)
        assert mine["n"].tolist() == counts.tolist()
        assert mine["lo"].to_numpy() == pytest.approx(edges[:-1])
        assert mine["density"].to_numpy() == pytest.approx(np.histogram(vs, bins=10, density=True)[0])
    assert len(got) == 30


def test_histogram_edges_close_the_last_bin_and_drop_outside(spark):
    df = spark.createDataFrame(
        [("a", float(v)) for v in (0.5, 1, 1.5, 2, 5, 6, 6.5)] + [("b", 9.0), ("b", None)], "f string, v double"
    )
    got = summaries.histogram_edges(df, "v", [1, 2, 3, 4, 5, 6], "f").orderBy("f", "bin").toPandas()
    counts, _ = np.histogram([0.5, 1, 1.5, 2, 5, 6, 6.5], bins=[1, 2, 3, 4, 5, 6])
    assert got[got.f == "a"]["n"].tolist() == counts.tolist()
    assert got[got.f == "b"]["n"].tolist() == [0] * 5
    assert got[got.f == "b"]["lo"].tolist() == [1, 2, 3, 4, 5]


def whiskers(values):
    q1, q3 = np.percentile(values, [25, 75])
    reach = 1.5 * (q3 - q1)
    inside = [v for v in values if q1 - reach <= v <= q3 + reach]
    return min(min(inside), q1), max(max(inside), q3), len(values) - len(inside)


def test_box_stats(spark):
    rng = np.random.default_rng(1)
    groups = {1: rng.lognormal(1, 1, 500).tolist(), 2: [0.0, 0.0, 0.0, 100.0], 3: [4.0]}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [(None, 1.0), (1, None)]
    df = spark.createDataFrame(rows, "k int, v double")
    got = {r.k: r for r in summaries.box_stats(df, "k", "v").collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        lo, hi, out = whiskers(vs)
        assert (got[k].q1, got[k].median, got[k].q3) == pytest.approx(tuple(np.percentile(vs, [25, 50, 75])))
        assert (got[k].whisker_lo, got[k].whisker_hi, got[k].n_out) == pytest.approx((lo, hi, out))
    outliers = summaries.box_outliers(df, "k", "v", spread=["v"])
    assert outliers.count() == sum(r.n_out for r in got.values())


def test_binned_median_is_pandas_cut(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([np.linspace(0, 4, 101), rng.uniform(-0.5, 4.5, 500)])
    y = rng.normal(size=len(x))
    pdf = pd.DataFrame({"x": x, "y": y})
    edges = np.linspace(0, 4, 101)
    want = pdf.groupby(pd.cut(pdf["x"], edges, labels=range(100)), observed=False)["y"].median()
    got = summaries.binned_median(spark.createDataFrame(pdf), "x", "y", 0, 4, 100).orderBy("bin").toPandas()
    assert got["bin"].tolist() == list(range(100))
    np.testing.assert_allclose(got["median_value"].astype(float), want.to_numpy(), equal_nan=True)
    np.testing.assert_allclose(got["bin_center"], (edges[:-1] + edges[1:]) / 2)


def test_kde_grid(spark):
    rng = np.random.default_rng(7)
    values = np.concatenate([rng.normal(10, 2, 300).round(1), [10.0] * 40])
    got = summaries.kde_grid(frame(spark, values), "v", points=200, bins=50).orderBy("point").toPandas()
    grid = np.linspace(values.min(), values.max(), 200)
    width = values.std(ddof=1) * len(values) ** -0.2
    kernel = np.exp(-0.5 * ((grid[:, None] - values[None, :]) / width) ** 2).sum(axis=1)
    scale = (values.max() - values.min()) / 50 / (width * np.sqrt(2 * np.pi))
    np.testing.assert_allclose(got["x"], grid)
    np.testing.assert_allclose(got["density"], kernel * scale, rtol=1e-9)


def test_regression_line(spark):
    pdf = pd.DataFrame({"x": [1.0, 2.0, 3.0, 4.0], "y": [2.0, 4.1, 5.9, 8.0]})
    got = summaries.regression_line(spark.createDataFrame(pdf), "x", "y").collect()[0]
    slope, intercept = np.polyfit(pdf.x, pdf.y, 1)
    assert (got.slope, got.intercept, got.n) == pytest.approx((slope, intercept, 4))
    assert got.r2 == pytest.approx(np.corrcoef(pdf.x, pdf.y)[0, 1] ** 2)


def test_line_series_marks_the_reference_date(spark):
    df = spark.createDataFrame(
        [("a", "2024-03-12", 1.0), ("a", "2024-03-13", 3.0), ("a", "2024-03-13", 5.0)], "s string, d string, y double"
    ).withColumn("d", F.to_date("d"))
    got = summaries.line_series(df, "d", "y", series="s", reference="2024-03-13").orderBy("d").collect()
    assert [(r.mean, r.n, r.after_reference) for r in got] == [(1.0, 1, 0), (4.0, 2, 1)]
    assert summaries.line_series(df, "s", "y").collect()[0].mean == pytest.approx(3.0)


def test_finite_pairs(spark):
    df = spark.createDataFrame(
        [("1", "2"), ("x", "2"), (None, "2"), ("1", "Infinity"), ("NaN", "1"), ("-3.5", "1e3")], "x string, y string"
    )
    assert sorted(tuple(r) for r in shaping.finite_pairs(df, "x", "y").collect()) == [(-3.5, 1000.0), (1.0, 2.0)]


def test_scan_renames_by_position(spark):
    df = spark.createDataFrame([(1, "a", 3), (2, "b", 2)], "id int, n string, t int")
    got = shaping.scan(df, ["n", "id"], where=F.col("t") == 3, names=["name", "key"])
    assert got.columns == ["name", "key"] and [tuple(r) for r in got.collect()] == [("a", 1)]


def test_time_range_is_half_open_and_stack_labels(spark):
    df = spark.sql(
        "select timestamp'2024-03-01' as t union all select timestamp'2024-03-13' union all select timestamp'2024-03-14'"
    )
    assert shaping.time_range(df, "t", start="2024-03-13").count() == 2
    assert shaping.time_range(df, "t", end="2024-03-13").count() == 1
    assert shaping.time_range(df, "t", "2024-03-01", "2024-03-14").count() == 2
    both = shaping.stack_series({"x": df, "y": df.limit(1)})
    assert {r.series: r["count"] for r in both.groupBy("series").count().collect()} == {"x": 3, "y": 1}
