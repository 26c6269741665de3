"""The shape of physical plans: what is shuffled, and what is broadcast."""

from doseframe.operators import ordering as O, profile as P, splits as L, stats as T
from registry import QUERIES

ROOT = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def main_plan(df):
    """Names of the operators of the plan, its scalar subqueries left out."""
    node, names = df._jdf.queryExecution().sparkPlan(), []
    while True:
        names.append(node.nodeName())
        if node.children().isEmpty():
            return names
        assert node.children().size() == 1
        node = node.children().head()


def test_row_split_moves_no_rows(spark):
    orders = spark.read.parquet(f"{ROOT}/orders.parquet")
    for df in (L.random_split(orders, ["o_orderkey"]), O.exact_sample(orders, 10, ["o_orderkey"])):
        assert {n.split(" ")[0] for n in main_plan(df)} <= {"Project", "Filter", "Scan", "ColumnarToRow"}


def test_single_partition_windows_see_partition_counts_only(spark):
    text = plan(O.hash_rank(spark.read.parquet(f"{ROOT}/orders.parquet"), ["o_orderkey"]))
    # One exchange to a single partition, right above the aggregate by range partition; rows themselves are not moved again.
    lines = text.splitlines()
    singles = [i for i, line in enumerate(lines) if "Exchange SinglePartition" in line]
    assert len(singles) == 1 and "HashAggregate" in lines[singles[0] + 1]
    assert text.count("Exchange hashpartitioning") == 1 and "BroadcastHashJoin" in text


def test_range_partitions_grow_with_the_rows():
    assert [O.range_parts(n, 8) for n in (0, 5, 19_999, 60_000, 2_000_000, 10**9, 10**12)] == [1, 1, 1, 3, 8, 1000, 10**6]


def test_one_rank_table_and_no_plan_per_pair(spark):
    """Fifty-five pairs from eleven columns: one pass, and one join a column."""
    from doseframe import schemas as S
    from registry.inputs import activity

    text = T.spearman(activity(spark, ROOT), S.NUMERIC_FEATURES)._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("MapInArrow") == 1 and text.count("Join LeftOuter") == len(S.NUMERIC_FEATURES)


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(QUERIES["activity_join"](spark, ROOT))
    assert "PushedFilters: [In(c_mktsegment, [BUILDING,FURNITURE,MACHINERY])" in text
    assert "l_shipdate" not in text and "l_tax" not in text


def test_profiles_are_one_pass(spark):
    line = spark.read.parquet(f"{ROOT}/lineitem.parquet")
    for df in (P.null_counts(line), T.pearson(line, ["l_quantity", "l_tax", "l_discount"]), T.target_correlations(line, ["l_tax"], "l_quantity")):
        assert plan(df).count("FileScan") == 1


def test_top_k_does_not_sort_the_table(spark):
    orders = spark.read.parquet(f"{ROOT}/orders.parquet")
    assert "TakeOrderedAndProject" in plan(P.top_groups(orders, "o_custkey", 5))


def test_no_cartesian_products(spark):
    for name in ("etl_activity", "group_split_hot", "spearman_matrix", "neighbour_sum", "mapped_labels", "density_curve", "run_upsert"):
        text = plan(QUERIES[name](spark, ROOT))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_aggregates_combine_before_the_shuffle(spark):
    text = plan(QUERIES["neighbour_sum"](spark, ROOT))
    assert "partial_sum" in text and "Generate explode" not in text.split("HashAggregate")[0]
    assert "partial_min_by" in plan(QUERIES["first_document_per_text"](spark, ROOT))


def test_the_join_side_is_never_forced(spark):
    from doseframe.plans.etl import joined_activity
    from registry.inputs import TARGETS, sources

    logical = joined_activity(sources(spark, ROOT), TARGETS)._jdf.queryExecution().optimizedPlan().toString()
    assert "ResolvedHint" not in logical and "strategy=broadcast" not in logical

def test_a_hot_key_is_split_at_run_time(spark):
    """With no side small enough to broadcast, the partition of a popular compound is split."""
    from pyspark.sql import functions as F

    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB", "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        n = 60_000
        hot = F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 5000)
        facts = spark.range(0, n, 1, 16).select(F.col("id").alias("activity_id"), hot.alias("molregno"))
        dims = spark.range(5000).select(F.col("id").alias("molregno"), (F.col("id") * 2).alias("v"))
        joined = facts.join(dims, "molregno")
        assert joined.agg(F.count("*").alias("n")).first().n == n
        joined.write.format("noop").mode("overwrite").save()
        counted = joined.groupBy("v").agg(F.count("*").alias("n"))
        assert counted.where("n > 1000").count() == 1
        joined.collect()
        assert "skew=true" in plan(joined)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
