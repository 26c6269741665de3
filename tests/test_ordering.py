import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from doseframe.operators import ordering as O


def md5_order(ids, seed):
    return sorted(ids, key=lambda i: hashlib.md5(f"{seed}:{i}".encode()).hexdigest())


@pytest.mark.parametrize("n", [0, 1, 7, 499, 500, 9000])
def test_exact_sample(spark, n):
    df = spark.range(500)
    want = md5_order(range(500), 3)[: n or 500]
    assert sorted(r.id for r in O.exact_sample(df, n, ["id"], 3).collect()) == sorted(want)


def test_a_cut_between_equal_keys_fails(spark):
    df = spark.range(1000).select("id", (F.col("id") % 10).alias("k"))
    with pytest.raises(Exception, match="do not identify a row"):
        O.exact_sample(df, 50, ["k"]).collect()
    assert O.exact_sample(df, 100, ["k"]).count() == 100


def test_slice_and_rank(spark):
    df = spark.range(300)
    order = md5_order(range(300), 42)
    assert {r.id for r in O.positional_slice(df, 10, 25, ["id"]).collect()} == set(order[10:25])
    assert {r.id for r in O.positional_slice(df, 0, 5, ["id"]).collect()} == set(order[:5])
    assert {r.id for r in O.positional_slice(df, 290, 400, ["id"]).collect()} == set(order[290:])
    ranked = {r["rank"]: r.id for r in O.hash_rank(df, ["id"]).collect()}
    assert [ranked[i + 1] for i in range(300)] == order


@pytest.mark.parametrize("limit", [1_000_000, 500, 20])
def test_exact_quantiles_with_hot_value(spark, monkeypatch, limit):
    monkeypatch.setattr(O, "SELECT_LIMIT", limit)
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.lognormal(3, 4, 4000), np.full(3000, 17.0), [np.nan] * 5])
    df = spark.createDataFrame([(float(v), float(-v)) for v in x], "x double, y double")
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = O.exact_quantiles(df, ["x", "y"], probs)
    assert got["x"] == pytest.approx(list(np.quantile(x[~np.isnan(x)], probs)))
    assert got["y"] == pytest.approx(list(np.quantile(-x[~np.isnan(x)], probs)))


def test_quantile_at_the_edge_of_a_hot_value(spark, monkeypatch):
    """Half the rows are one value and a wanted position lies at its edge: what is left is cut by distinct values."""
    monkeypatch.setattr(O, "SELECT_LIMIT", 50)
    x = np.concatenate([np.full(3000, 7.0), np.arange(8, 3008, dtype=float)])
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    probs = [0.4999, 0.5, 0.5001, 0.75]
    assert O.exact_quantiles(df, ["x"], probs)["x"] == pytest.approx(list(np.quantile(x, probs)))


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,), (float("nan"),)], "x double")
    assert O.exact_quantiles(df, ["x"], [0.5]) == {"x": [None]}


@pytest.mark.parametrize("buckets", [4, 1000])
def test_value_ranks(spark, buckets):
    values = [10.0, 20.0, 20.0, 30.0] + [30.0] * 50 + [5.0, None, float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    ranks = {r.x: r.rk for r in O.value_ranks(df, "x", O.value_cuts(df, ["x"], buckets)["x"]).select("x", O.average_rank().alias("rk")).collect()}
    assert ranks == {5.0: 1.0, 10.0: 2.0, 20.0: 3.5, 30.0: 30.0}


def test_first_by_key(spark):
    df = spark.range(100).withColumn("k", 1000 - F.col("id"))
    assert {r.k for r in O.first_by_key(df, "k", 3).collect()} == {901, 902, 903}
    assert O.first_by_key(df, "k", 101).count() == 100
    assert {r.k for r in O.first_by_key(df, "k", 3, by_threshold=True).collect()} == {901, 902, 903}
    assert "TakeOrderedAndProject" in O.first_by_key(df, "k", 3)._jdf.queryExecution().toString()


def test_negative_zero_is_zero(spark):
    df = spark.createDataFrame([(v,) for v in [-1.0, -0.0, 0.0, -0.0, 0.0, 2.0]], "x double")
    ranks = [(r.x, r.n) for r in O.value_ranks(df, "x", O.value_cuts(df, ["x"])["x"]).collect()]
    assert sorted(ranks) == [(-1.0, 1), (0.0, 4), (2.0, 1)]
