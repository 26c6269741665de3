import pytest
from pyspark.sql import functions as F

from doseframe import schemas as S
from doseframe.operators import joins as J


@pytest.fixture()
def skewed(spark):
    key = F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 700)
    left = spark.range(4000).withColumn("k", key.cast("int"))
    right = spark.range(0, 600).select(F.col("id").cast("int").alias("k"), (F.col("id") * 2).alias("v"))
    return left, right


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_hot_split_join_equals_plain_join(skewed, how):
    left, right = skewed
    weighted = right.join(J.key_weights(left, "k"), "k", "left").fillna(0, ["_w"])
    got = J.hot_split_join(left, weighted, "k", how, "_w")
    want = left.join(right, "k", how)
    cols = sorted(want.columns)
    assert sorted(map(str, got.select(cols).collect())) == sorted(map(str, want.select(cols).collect()))


def test_the_left_side_is_read_once_and_hot_keys_are_parted(spark, skewed, tmp_path):
    left, right = skewed
    left.repartition(8).write.parquet(str(tmp_path / "left"))
    left = spark.read.parquet(str(tmp_path / "left"))
    weighted = right.join(J.key_weights(left, "k"), "k")
    hot = J.hot_keys(weighted, "k", "_w")
    assert hot.where("k = 0").first()._salts > 300 and hot.count() <= J.HOT_SHARE
    weighted.write.parquet(str(tmp_path / "right"))
    right = spark.read.parquet(str(tmp_path / "right"))
    for how in ("inner", "left", "left_semi"):
        joined = J.hot_split_join(left, right, "k", how, "_w")
        text = joined._jdf.queryExecution().optimizedPlan().toString()
        assert text.count("Relation [") == 2 and "strategy=broadcast" in text
    before = spark.conf.get("spark.sql.adaptive.enabled")
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        joined = J.hot_split_join(left, right, "k", "inner", "_w")
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        total = sum(sizes)
        assert max(sizes) < total / 5 and sum(r.k == 0 for r in joined.collect()) > total / 3
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_identical_rows_of_a_hot_key_and_map_columns(spark):
    left = spark.range(0, 4000, 1, 8).select(F.lit(5).alias("k"), F.create_map(F.lit("a"), F.lit(1)).alias("m"))
    right = spark.createDataFrame([(5, "x", 4000)], "k int, v string, w long")
    got = J.hot_split_join(left, right, "k", "inner", "w")
    assert got.count() == 4000 and got.columns == ["k", "m", "v"]


def test_join_kind_is_checked(skewed):
    with pytest.raises(ValueError):
        J.hot_split_join(*skewed, "k", "full", "_w")


def test_lookup_drops_misses_and_keeps_left_label(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 3.0)], "s string, y double")
    store = spark.createDataFrame([("a", 9.0, 7)], "s string, y double, f int")
    assert sorted((r.s, r.y, r.f) for r in J.lookup(rows, store, "s").collect()) == [("a", 1.0, 7), ("a", 2.0, 7)]


def test_upsert_matches_missing_with_missing(spark):
    base = dict(model="GNN", split="random", seed=1, pooling=None, gnn_hidden_dim=None, gnn_num_layers=4, gnn_dropout=0.1, lr=1e-3, weight_decay=0.0)
    make = lambda *rows: spark.createDataFrame([tuple(r[k] for k in [*S.RESULT_KEY, "r2_val"]) for r in rows],
        "model string, split string, seed int, pooling string, gnn_hidden_dim int, gnn_num_layers int, gnn_dropout double, lr double, weight_decay double, r2_val double")
    old = make({**base, "r2_val": 0.1}, {**base, "seed": 2, "r2_val": 0.2})
    new = make({**base, "r2_val": 0.9})
    assert sorted(r.r2_val for r in J.upsert(old, new, S.RESULT_KEY).collect()) == [0.2, 0.9]
    assert sorted(r.r2_val for r in J.upsert(old, new, S.RESULT_KEY, replace_existing=False).collect()) == [0.1, 0.2, 0.9]


def test_mapped_label_default(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, k string")
    mapping = spark.createDataFrame([("a", "test", 1)], "k string, split string, n long")
    got = {r.id: r.split for r in J.mapped_label(rows, mapping, "k", "split", "train", "n").collect()}
    assert got == {1: "test", 2: "train", 3: "train"}


def test_keys_without_rows_or_weight_are_not_hot(spark):
    left = spark.createDataFrame([(1, "a")], "id int, k string").where("id > 1")
    right = spark.createDataFrame([("a", 1, 0), ("b", 2, None)], "k string, v int, w long")
    assert J.hot_split_join(left, right, "k", "inner", "w").count() == 0
    rows = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    assert sorted((r.k, r.v) for r in J.hot_split_join(rows, right, "k", "inner", "w").collect()) == [("a", 1), ("b", 2)]
