"""How the shared test tables stand in for the source tables, once for Spark and once in SQL.

lineitem = activities, orders = assays, customer = targets, part = structures and properties.
The shared tables have no nulls, so missing values are derived the same way on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from doseframe.operators.cleaning import with_potency
from doseframe.plans.etl import joined_activity
from doseframe.session import staged

TARGETS = ["BUILDING", "FURNITURE", "MACHINERY"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt to equal partitions, as many as their size asks for: a file may have one row group."""
    return df.hint("rebalance")


def activities(spark: SparkSession, folder: str) -> DataFrame:
    line = table(spark, folder, "lineitem")
    flag, number = F.col("l_returnflag"), F.col("l_linenumber")
    return line.select(
        (((F.col("l_orderkey") * 8 + number) * 1000000 + F.col("l_partkey")) * 100000 + F.col("l_suppkey")).alias("activity_id"),
        F.col("l_orderkey").alias("assay_id"), F.col("l_partkey").alias("molregno"),
        F.col("l_extendedprice").alias("standard_value"),
        F.when(flag == "N", "nM").when(flag == "R", "uM").alias("standard_units"),
        F.when(number % 3 == 0, "IC50").when(number % 3 == 1, "Ki").otherwise("Potency").alias("standard_type"),
        F.when(number <= 3, "=").when(number == 4, ">").when(number == 5, "<").alias("standard_relation"),
        F.when(F.col("l_linestatus") == "O", F.col("l_discount") * 100).alias("pchembl_value"),
        F.when(number == 7, 1).when(number != 6, 0).alias("potential_duplicate"),
    )


def sources(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    part = table(spark, folder, "part")
    size, key = F.col("p_size"), F.col("p_partkey")
    return {
        "activities": activities(spark, folder),
        "assays": table(spark, folder, "orders").select(
            F.col("o_orderkey").alias("assay_id"), F.col("o_custkey").alias("tid"),
            F.substring("o_orderpriority", 1, 1).cast("int").alias("confidence_score"),
        ),
        "target_dictionary": table(spark, folder, "customer").select(
            F.col("c_custkey").alias("tid"), F.col("c_mktsegment").alias("chembl_id"), F.col("c_name").alias("pref_name")
        ),
        "compound_structures": part.select(
            key.alias("molregno"),
            F.when(size < 50, F.concat_ws("|", "p_name", "p_brand", "p_type")).alias("canonical_smiles"),
        ),
        "compound_properties": part.select(
            key.alias("molregno"), (F.col("p_retailprice") - 450.0).alias("mw_freebase"),
            F.when(size % 11 != 0, size / 7.0).alias("alogp"),
            (key % 14).cast("int").alias("hba"), (key % 9).cast("int").alias("hbd"), (size * 2.5).alias("psa"),
            (key % 12).cast("int").alias("rtb"), (key % 5).cast("int").alias("aromatic_rings"),
            ((size % 10) / 10.0).alias("qed_weighted"),
        ),
    }


def activity(spark: SparkSession, folder: str) -> DataFrame:
    """The joined table with units and label, before cleaning."""
    return with_potency(joined_activity(sources(spark, folder), TARGETS))


def activity_table(spark: SparkSession, folder: str) -> DataFrame:
    """The same, written once: for profiles that read it several times."""
    return staged(activity(spark, folder), "activity")


ACTIVITIES_SQL = """
activities as (
  select ((l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey) * 100000 + l_suppkey as activity_id,
    l_orderkey as assay_id, l_partkey as molregno, l_extendedprice as standard_value,
    case l_returnflag when 'N' then 'nM' when 'R' then 'uM' end as standard_units,
    case l_linenumber % 3 when 0 then 'IC50' when 1 then 'Ki' else 'Potency' end as standard_type,
    case when l_linenumber <= 3 then '=' when l_linenumber = 4 then '>' when l_linenumber = 5 then '<' end as standard_relation,
    case when l_linestatus = 'O' then l_discount * 100 end as pchembl_value,
    case when l_linenumber = 7 then 1 when l_linenumber <> 6 then 0 end as potential_duplicate
  from lineitem)"""

FLAT_SQL = ACTIVITIES_SQL + """,
structures as (
  select p_partkey as molregno, case when p_size < 50 then concat_ws('|', p_name, p_brand, p_type) end as canonical_smiles
  from part),
properties as (
  select p_partkey as molregno, p_retailprice - 450.0 as mw_freebase,
    case when p_size % 11 <> 0 then p_size / 7.0::DOUBLE end as alogp,
    (p_partkey % 14)::INTEGER as hba, (p_partkey % 9)::INTEGER as hbd, p_size * 2.5::DOUBLE as psa,
    (p_partkey % 12)::INTEGER as rtb, (p_partkey % 5)::INTEGER as aromatic_rings,
    (p_size % 10) / 10.0::DOUBLE as qed_weighted
  from part),
flat as (
  select a.activity_id, a.molregno, c.canonical_smiles, p.mw_freebase, p.alogp, p.hba, p.hbd, p.psa, p.rtb,
    p.aromatic_rings, p.qed_weighted, a.standard_value, a.standard_units, a.standard_type, a.standard_relation,
    a.pchembl_value, t.c_mktsegment as target_chembl_id, t.c_name as target_name,
    substr(o.o_orderpriority, 1, 1)::INTEGER as confidence_score
  from activities a
  join orders o on a.assay_id = o.o_orderkey
  join customer t on o.o_custkey = t.c_custkey
  join structures c on a.molregno = c.molregno
  join properties p on a.molregno = p.molregno
  where t.c_mktsegment in ('BUILDING', 'FURNITURE', 'MACHINERY') and c.canonical_smiles is not null
    and a.pchembl_value is not null and (a.potential_duplicate is null or a.potential_duplicate = 0))"""

POTENCY_SQL = """
units as (
  select * replace (case when standard_units is null and standard_value between 0.01 and 1e6 then 'nM'
    else standard_units end as standard_units) from {source}),
act as (
  select *, case when standard_units = 'nM' and standard_value is not null then
      case when standard_value > 0 then -log10(standard_value * 1e-9) when standard_value = 0 then 'inf'::DOUBLE
        when standard_value < 0 then 'nan'::DOUBLE end
    else pchembl_value end as "pIC50" from units)"""

ACT = FLAT_SQL + "," + POTENCY_SQL.format(source="flat")
