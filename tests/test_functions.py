import hashlib
import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from doseframe import schemas as S
from doseframe.functions import encode as E, hashing as H
from doseframe.operators import featurize as K, runs as N
from registry.inputs import spread

FLOATS = [3e-4, 1e-5, 1.5e-5, 0.001, 0.1, 0.5, 1.0, 12.0, 100.0, 1234567.25, 1e7, 12345678.5, 1.5e9, 2.5e15, 1e16, 2.5e18, -2.5e-4, -1e-7, 0.00012345, 1.25e-10, 3e100, 0.0]


def test_python_float_text(spark):
    df = spark.createDataFrame([(v,) for v in FLOATS], "x double")
    got = [r.t for r in df.select(E.python_float_text(F.col("x")).alias("t")).collect()]
    assert got == [repr(v) for v in FLOATS]


def test_float_text_is_the_shortest(spark):
    rng = np.random.default_rng(8)
    x = [8.896e23, 2e-3, 1e23, *rng.normal(size=10_000), *(10 ** rng.uniform(-30, 30, 10_000)), *np.round(10 ** rng.uniform(-8, 25, 10_000), 3)]
    got = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double").select("x", E.python_float_text(F.col("x")).alias("t")).collect()
    assert [r for r in got if r.x is not None and float(r.t) != r.x] == []
    assert [(r.x, r.t) for r in got if r.x is not None and len(r.t) > len(repr(r.x))] == []
    short = [(r.x, r.t) for r in got if r.x is not None and len(re.sub(r"e.*|[.-]", "", repr(r.x)).strip("0")) <= 15]
    assert len(short) > 5_000 and [(x, t) for x, t in short if t != repr(x)] == []
    assert [r.t for r in got if r.x is None] == [None]


def test_config_key_equals_sorted_json_hash(spark):
    config = {
        "model_type": "GNN", "split_type": "scaffold", "seed": 42, "epochs": 100, "lr": 3e-4, "batch_size": 64,
        "early_stopping_patience": 12, "min_delta": 1e-4, "weight_decay": 1e-5, "pooling": 'me"an\\', "gnn_hidden_dim": 192,
        "gnn_num_layers": 4, "gnn_dropout": 0.1,
    }
    df = spark.createDataFrame([tuple(config[f] for f in S.CONFIG_FIELDS)], S.CONFIG_FIELDS)
    want = hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()[:16]
    assert N.with_config_key(df, namespace="tuning").first().cache_key == f"tuning_{want}"


def test_one_hot_and_projection(spark):
    df = spark.createDataFrame([("b", [1.0, -2.0]), ("z", [0.0, 1.0]), (None, [1.0, 1.0])], "v string, x array<double>")
    got = df.select(E.one_hot(F.col("v"), ["a", "b"]).alias("h"), E.project([[1.0, 2.0], [0.0, 0.5]], F.col("x"), [0.5, 0.0]).alias("p")).collect()
    assert [r.h for r in got] == [[0.0, 1.0], [0.0, 0.0], [0.0, 0.0]]
    assert [r.p for r in got] == [[-2.5, -1.0], [2.5, 0.5], [3.5, 0.5]]


def brute_bits(words, n_bits=2048):
    grams = [" ".join(words[i:i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]
    return sorted({int(hashlib.md5(g.encode()).hexdigest()[:7], 16) % n_bits for g in grams})


def test_fingerprint(spark):
    texts = ["", "one", "a b", "a b c a b c d", None, "x  y\nz"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.bits for r in K.with_fingerprint(df, "t").collect()]
    assert got == [None if t is None else brute_bits(t.split()) for t in texts]
    vec = K.with_vector(K.with_fingerprint(df, "t"), "bits").collect()
    assert [sorted(int(i) for i in r.features.indices) for r in vec] == [b for b in got if b is not None]
    assert all(r.features.size == 2048 and set(r.features.values) <= {1.0} for r in vec)


def test_fingerprint_of_given_tokens(spark):
    """Tokens may hold spaces; no run goes over a null token."""
    df = spark.createDataFrame([(["a ", "b", "ü"],), (["a", None, "b", "c"],), ([],), (None,)], "t array<string>")
    got = [r.bits for r in K.with_fingerprint(df, "t", tokens=F.col("t"), n_bits=1000).collect()]
    assert got[0] == brute_bits(["a ", "b", "ü"], 1000)
    assert got[1] == sorted({*brute_bits(["a"], 1000), *brute_bits(["b", "c"], 1000)})
    assert got[2:] == [[], None]


def test_fingerprints_hash_in_batches_and_over_all_cores(spark, tmp_path):
    """Not run by run in interpreted expressions, and not in one task where a file has one row group."""
    spark.range(60_000).coalesce(1).select("id", F.sha2(F.col("id").cast("string"), 512).alias("text")).write.parquet(str(tmp_path / "documents.parquet"))
    rows = K.with_fingerprint(spread(spark.read.parquet(str(tmp_path / "documents.parquet"))), "text")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "md5" not in plan
    assert len({r.p for r in rows.select("id", "bits", F.spark_partition_id().alias("p")).collect()}) > 1
    assert rows.select("id").distinct().count() == 60_000


def test_structure_tokens(spark):
    got = spark.createDataFrame([("CC(=O)N[C@H]1ClBr%12",)], "s string").select(H.structure_tokens(F.col("s")).alias("t")).first().t
    assert got == ["C", "C", "(", "=", "O", ")", "N", "[C@H]", "1", "Cl", "Br", "%12"]


def test_featurize_invalid_is_null_and_runs_once_per_structure(spark):
    def fn(s):
        if s == "bad":
            raise ValueError(s)
        return None if s == "none" else {"n": len(s)}

    df = spark.createDataFrame([(i, s) for i, s in enumerate(["aa", "bad", "aa", "none", None, "b"])], "id int, s string")
    out = {r.id: r.n for r in K.featurize(df, "s", fn, "n int", partitions=2).collect()}
    assert out == {0: 2, 1: None, 2: 2, 3: None, 4: None, 5: 1}


def test_feature_store_computes_only_new_keys(spark, tmp_path):
    path = str(tmp_path / "store")
    df = spark.createDataFrame([("a",), ("b",), ("a",)], "s string")
    K.refresh_features(df.where("s = 'a'"), "s", lambda s: {"v": 1}, "v int", path)
    out = K.refresh_features(df, "s", lambda s: {"v": 2}, "v int", path)
    assert sorted((r.s, r.v) for r in out.collect()) == [("a", 1), ("b", 2)]
