"""Split labels, leakage check, folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from doseframe.operators import profile as P, splits as L
from doseframe.operators.featurize import featurize
from registry.base import query, r, rounded
from registry.inputs import table

RANDOM = """s as (select *, row_number() over (order by md5('{seed}:' || o_orderkey)) as place, count(*) over () as n from orders),
 split as (select *, case when place <= floor(n * 0.1::DOUBLE) then 'test'
   when place <= floor(n * 0.1::DOUBLE) + floor(n * 0.1::DOUBLE) then 'val' else 'train' end as split from s)"""


@query("random_split", f"with {RANDOM.format(seed=42)} select o_orderkey, split from split")
def random_split(spark, d):
    return L.assign_split(table(spark, d, "orders"), "random", keys=["o_orderkey"]).select("o_orderkey", "split")


@query("split_sizes", f"""with {RANDOM.format(seed=42)} select count(*) filter (split = 'train') as n_train,
 count(*) filter (split = 'val') as n_val, count(*) filter (split = 'test') as n_test from split""")
def split_sizes(spark, d):
    return P.split_sizes(L.random_split(table(spark, d, "orders"), ["o_orderkey"]))


def _group_sql(source: str, key: str, group: str) -> str:
    return f"""with recursive src as (select {key} as id, {group} as k from {source} where {group} is not null),
 g as (select k, count(*) as n from src group by 1),
 o as (select *, row_number() over (order by n desc, md5('42:' || k), k) as i from g),
 t as (select floor(sum(n) * 0.1::DOUBLE)::BIGINT as goal from g),
 walk as (
  select 0::BIGINT as i, 0::BIGINT as test, 0::BIGINT as val, ''::VARCHAR as split
  union all
  select o.i, test + case when goal - test > 0 and test <= val then n else 0 end,
    val + case when not (goal - test > 0 and test <= val) and goal - val > 0 then n else 0 end,
    case when goal - test > 0 and test <= val then 'test' when goal - val > 0 then 'val' else 'train' end
  from walk join o on o.i = walk.i + 1 cross join t)
 select src.id, walk.split from src join o using (k) join walk on walk.i = o.i"""


@query("group_split_sources", _group_sql("documents", "doc_id", "source"))
def group_split_sources(spark, d):
    out = L.assign_split(table(spark, d, "documents"), "scaffold", group="source")
    return out.select(F.col("doc_id").alias("id"), "split")


@query("group_split_customers", _group_sql("orders", "o_orderkey", "o_custkey"))
def group_split_customers(spark, d):
    out = L.group_split(table(spark, d, "orders"), "o_custkey")
    return out.select(F.col("o_orderkey").alias("id"), "split")


# A third of the rows in one group, a third in single-row groups, some rows without a group.
HOT = "case when o_orderkey % 3 = 0 then -1 when o_orderkey % 3 = 1 then o_orderkey + 1000000000 when o_orderkey % 7 <> 0 then o_custkey end"


@query("group_split_hot", _group_sql("orders", "o_orderkey", HOT))
def group_split_hot(spark, d):
    out = L.group_split(table(spark, d, "orders").withColumn("g", F.expr(HOT)), "g")
    return out.select(F.col("o_orderkey").alias("id"), "split")


# The group is computed once per distinct name; names with 'ring' cannot be read and have none.
@query("scaffold_split_parts", _group_sql("part", "p_partkey", "case when p_name not like '%ring%' then p_name end"))
def scaffold_split_parts(spark, d):
    def scaffold(name: str) -> dict:
        if "ring" in name:
            raise ValueError("cannot read this structure")
        return {"scaffold": name}

    parts = featurize(table(spark, d, "part").select("p_partkey", "p_name"), "p_name", scaffold, "scaffold string")
    return L.assign_split(parts, "scaffold", group="scaffold").select(F.col("p_partkey").alias("id"), "split")


@query("leakage_random", f"""with {RANDOM.format(seed=42)} select o_custkey, min(split) as first_split, max(split) as last_split,
 count(*) as rows from split group by 1 having min(split) <> max(split)""")
def leakage_random(spark, d):
    return L.leaking_groups(L.random_split(table(spark, d, "orders"), ["o_orderkey"]), "o_custkey")


@query("leakage_grouped", "select 0::BIGINT as leaking, count(*) as rows from orders")
def leakage_grouped(spark, d):
    split = L.group_split(table(spark, d, "orders"), "o_custkey")
    per_group = split.groupBy("o_custkey").agg(F.min("split").alias("a"), F.max("split").alias("b"), F.count("*").alias("n"))
    return per_group.agg(F.count_if(F.col("a") != F.col("b")).alias("leaking"), F.sum("n").alias("rows"))


@query("folds", "select o_orderkey, (('0x' || substr(md5('42:' || o_orderkey), 1, 7))::BIGINT % 5)::INTEGER as fold from orders")
def folds(spark, d):
    return L.with_fold(table(spark, d, "orders"), ["o_orderkey"], 5).select("o_orderkey", "fold")
