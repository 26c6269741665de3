import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from doseframe.operators import profile as P, stats as T


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(1)
    n = 600
    a = rng.normal(size=n)
    frame = pd.DataFrame({
        "a": a, "b": np.round(a + rng.normal(size=n), 1), "c": rng.integers(0, 4, n).astype(float), "d": rng.lognormal(0, 5, n),
    })
    frame.loc[rng.random(n) < 0.2, "b"] = np.nan
    frame.loc[rng.random(n) < 0.1, "d"] = np.nan
    # Half of the gaps are nulls, half are NaN.
    rows = [(*(None if (i % 2 and math.isnan(v)) else float(v) for v in row), i) for i, row in enumerate(frame.itertuples(index=False))]
    return frame, spark.createDataFrame(rows, "a double, b double, c double, d double, id long")


@pytest.mark.parametrize("method", ["pearson", "spearman"])
def test_correlation_equals_pandas(sample, method):
    frame, df = sample
    want = frame.corr(method=method) if method == "pearson" else _spearman(frame)
    got = {(r.x, r.y): r.r for r in getattr(T, method)(df, list(frame.columns)).collect()}
    assert len(got) == 16
    for x in frame:
        for y in frame:
            assert got[x, y] == pytest.approx(want.loc[x, y], abs=1e-9)
            assert got[x, y] == pytest.approx(got[y, x])


def _spearman(frame):
    out = pd.DataFrame(index=frame.columns, columns=frame.columns, dtype=float)
    for x in frame:
        for y in frame:
            both = frame[[x, y]].dropna() if x != y else frame[[x]].dropna()
            out.loc[x, y] = 1.0 if x == y else both[x].rank().corr(both[y].rank())
    return out


def test_trends_equal_polyfit(sample):
    frame, df = sample
    fits = {r.feature: r for r in T.trends(df, ["a", "d"], "b").collect()}
    for c in ("a", "d"):
        both = frame[[c, "b"]].dropna()
        slope, intercept = np.polyfit(both[c], both["b"], 1)
        assert (fits[c].slope, fits[c].intercept, fits[c].n) == pytest.approx((slope, intercept, len(both)))
        assert (fits[c].low, fits[c].high) == pytest.approx((both[c].min(), both[c].max()))
    assert T.trend_lines(T.trends(df, ["a"], "b")).count() == 100


def test_vif(spark, sample):
    two = spark.createDataFrame([(1.0, 1.0), (0.0, 1.0)], "x1 double, x2 double")
    assert [r.vif for r in T.vif(two, ["x1", "x2"]).collect()] == pytest.approx([2.0, 2.0])
    frame, df = sample
    x = frame.dropna().to_numpy()
    want = {}
    for i, c in enumerate(frame):
        others = np.delete(x, i, axis=1)
        resid = x[:, i] - others @ np.linalg.lstsq(others, x[:, i], rcond=None)[0]
        want[c] = (x[:, i] @ x[:, i]) / (resid @ resid)
    got = T.vif(df, list(frame.columns)).collect()
    assert {r.feature: r.vif for r in got} == pytest.approx(want, rel=1e-6)
    assert [r.vif for r in got] == sorted((r.vif for r in got), reverse=True)


def test_pca_equals_numpy(sample):
    frame, df = sample
    x = frame[["a", "b", "c"]].dropna()
    z = ((x - x.mean()) / x.std(ddof=0)).to_numpy()
    values, vectors = np.linalg.eigh(np.cov(z.T))
    order = np.argsort(values)[::-1][:2]
    loadings = vectors[:, order]
    loadings = loadings * np.sign(loadings[np.abs(loadings).argmax(axis=0), range(2)])
    got = T.pca_scores(df, ["a", "b", "c"], "a", ["id"]).orderBy("id").collect()
    assert np.allclose([[r.PCA1, r.PCA2] for r in got], z @ loadings, atol=1e-8)
    assert [got[0].explained1, got[0].explained2] == pytest.approx(list(values[order] / values.sum()))


def test_auto_bins_equal_numpy(sample):
    frame, df = sample
    for c in ("a", "c", "d"):
        counts, edges = np.histogram(frame[c].dropna(), bins="auto")
        got = P.histogram(df, c).orderBy("bin").collect()
        assert [r["count"] for r in got] == list(counts)
        assert [r.low for r in got] == pytest.approx(list(edges[:-1]))


def test_histogram_of_a_constant(spark):
    df = spark.createDataFrame([(2.0,)] * 5, "x double")
    assert [r["count"] for r in P.histogram(df, "x", 3).orderBy("bin").collect()] == [5, 0, 0]
    assert P.auto_bins(df, "x") == 1


def test_density_is_the_kernel_sum(spark):
    """Within a tenth of a percent of the exact sum, with and without a far outlier; a constant has no curve."""
    normal = np.random.default_rng(0).normal(size=3000)
    for values in (normal, np.append(normal, 1e6)):
        df = spark.createDataFrame([(float(v),) for v in values], "a double")
        curve = P.density_curve(df, "a", 60).orderBy("point").collect()
        width = values.std(ddof=1) * len(values) ** -0.2
        x = np.linspace(values.min(), values.max(), 60)
        exact = np.exp(-0.5 * ((x[:, None] - values) / width) ** 2).sum(axis=1) / (len(values) * width * np.sqrt(2 * np.pi))
        assert np.allclose([r.x for r in curve], x) and np.allclose([r.density for r in curve], exact, rtol=1e-3, atol=exact.max() * 1e-3)
    assert P.density_curve(spark.createDataFrame([(2.0,)] * 5, "a double"), "a").count() == 0


def test_density_of_many_far_values_stays_in_proportion(spark):
    """A million distinct outliers: rows made are a small multiple of the cells, not cells times points."""
    df = spark.range(1_000_000).select(F.pow(F.col("id").cast("double") / 1000, F.lit(3.0)).alias("a"))
    curve = P.density_curve(df, "a", 200)
    rows = {r.point: r.density for r in curve.collect()}
    values = (np.arange(1_000_000) / 1000) ** 3
    width = values.std(ddof=1) * len(values) ** -0.2
    for point in (0, 3, 50, 199):
        at = values.max() * point / 199
        exact = np.exp(-0.5 * ((at - values) / width) ** 2).sum() / (len(values) * width * np.sqrt(2 * np.pi))
        assert rows[point] == pytest.approx(exact, rel=1e-3)
    assert len(rows) == 200
    text = curve._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(sequence(first" in text and "explode([0" not in text


def test_vif_of_collinear_columns(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i, float(i * i % 7)) for i in range(20)], "a double, b double, c double")
    got = {r.feature: r.vif for r in T.vif(df, ["a", "b", "c"]).collect()}
    assert got["a"] == got["b"] == math.inf and 1 <= got["c"] < 100


def test_describe_with_nan(sample):
    frame, df = sample
    got = {(r.column, r.stat): r.value for r in P.describe(df, ["a", "b"]).collect()}
    assert got["a", "50%"] == pytest.approx(frame["a"].median())
    assert got["a", "std"] == pytest.approx(frame["a"].std())
    assert math.isnan(got["b", "mean"]) and got["b", "max"] == pytest.approx(frame["b"].max())
    assert got["b", "count"] + got["b", "null_count"] == len(frame)


def test_box_stats(sample):
    frame, df = sample
    row = P.box_stats(df, ["d", "missing"]).first()
    d = frame["d"].dropna()
    q1, q3 = d.quantile(0.25), d.quantile(0.75)
    inside = d[(d >= q1 - 1.5 * (q3 - q1)) & (d <= q3 + 1.5 * (q3 - q1))]
    assert (row.q1, row.q3, row.whisker_high, row.above) == pytest.approx((q1, q3, inside.max(), (d > inside.max()).sum()))


def test_strength_labels(spark):
    df = spark.createDataFrame([("p", 0.6), ("q", -0.4), ("s", 0.1), ("t", -0.9)], "feature string, r double")
    s = T.correlation_summary(df).first()
    assert (s.strongest_positive, s.strongest_negative, s.strong, s.moderate, s.weak) == ("p", "t", 2, 1, 1)
    assert [r.feature for r in T.strongest(df, 2).collect()] == ["t", "p"]
    assert [r.s for r in df.select(T.strength(F.col("r")).alias("s")).collect()] == ["SILNA", "UMIARKOWANA", "SŁABA", "SILNA"]


def test_scatter_sample_cap(sample):
    frame, df = sample
    assert T.scatter_sample(df, ["b", "d"], ["id"], 100).count() == 100
    assert T.scatter_sample(df, ["b", "d"], ["id"], 10_000).count() == len(frame[["b", "d"]].dropna())


def test_null_counts_and_value_counts(spark):
    df = spark.createDataFrame([(1, None), (2, "x"), (None, None)], "a int, b string")
    assert [(r.column, r.nulls) for r in P.null_counts(df).collect()] == [("b", 2), ("a", 1)]
    assert {(r.column, r.value, r["count"]) for r in P.value_counts(df, ["b"]).collect()} == {("b", None, 2), ("b", "x", 1)}


def test_spearman_with_a_hot_value_ties_and_columns_of_nothing(spark):
    """Every pair is ranked anew on its own rows: many gap patterns, a value in a third of the rows, a constant, all nulls."""
    rng = np.random.default_rng(4)
    n = 900
    frame = pd.DataFrame({f"c{i}": np.round(rng.normal(size=n) * 10 ** (i % 3), 1) for i in range(6)})
    frame.loc[rng.random(n) < 0.35, "c0"] = 7.0
    frame.loc[rng.random(n) < 0.3, "c1"] = -0.0
    for i in (0, 2, 3, 5):
        frame.loc[rng.random(n) < 0.15 * (i + 1), f"c{i}"] = np.nan
    frame["one"], frame["none"] = 3.0, np.nan
    df = spark.createDataFrame([tuple(None if math.isnan(v) else float(v) for v in row) for row in frame.itertuples(index=False)],
                               ", ".join(f"{c} double" for c in frame))
    got = {(r.x, r.y): r.r for r in T.spearman(df, list(frame.columns)).collect()}
    assert len(got) == 64
    for x in frame:
        for y in frame:
            both = frame[[x, y]].dropna() if x != y else frame[[x]].dropna()
            ranks = [both[c].rank() for c in (x, y)]
            varies = len(both) > 1 and all(r.nunique() > 1 for r in ranks)
            want = float(np.corrcoef(*ranks)[0, 1]) if varies else None
            assert got[x, y] == (pytest.approx(want, abs=1e-9) if varies else None), (x, y)
    assert T.spearman(df.limit(0), ["c0", "c1"]).where("r is not null").count() == 0
    assert T.spearman(df, ["c1"]).collect()[0].r == 1.0
