"""Activity table: join, units, label, cleaning, rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from doseframe import schemas as S
from doseframe.functions import potency as P
from doseframe.operators import cleaning as C, ordering as O
from doseframe.plans.etl import joined_activity, processed_activity, run
from doseframe.session import scratch_path
from doseframe.sources.tables import coerced, read_table
from registry.base import SQL, query, r, rounded
from registry.inputs import ACT, ACTIVITIES_SQL, FLAT_SQL, POTENCY_SQL, TARGETS, activities, activity, activity_table, sources, table

COLUMNS = """activity_id, molregno, canonical_smiles, mw_freebase, alogp, hba, hbd, psa, rtb, aromatic_rings,
 qed_weighted, standard_value, standard_units, standard_type, standard_relation, pchembl_value, target_chembl_id,
 target_name, confidence_score"""
ROUNDED = ", ".join(
    f"{r(c.strip())} as {c.strip()}" if c.strip() in ("mw_freebase", "alogp", "psa", "qed_weighted", "standard_value", "pchembl_value") else c.strip()
    for c in COLUMNS.split(",")
)
DEDUP = """
kept as (select * from act where "pIC50" is not null and not isinf("pIC50")),
firsts as (select *, row_number() over (partition by canonical_smiles order by activity_id) as rn from kept)"""


@query("etl_activity", f"with {ACT}, {DEDUP} select {ROUNDED}, {r('\"pIC50\"')} as \"pIC50\" from firsts where rn = 1")
def etl_activity(spark, d):
    return rounded(processed_activity(joined_activity(sources(spark, d), TARGETS)))


@query("etl_job", SQL["etl_activity"])
def etl_job(spark, d):
    """The whole job: source tables on disk, the cleaned table written and read back."""
    folder = scratch_path(spark, "sources")
    for name, df in sources(spark, d).items():
        coerced(df, S.SOURCE_SCHEMAS[name]).write.parquet(f"{folder}/{name}.parquet")
    run(spark, folder, f"{folder}/activity.parquet", TARGETS)
    return rounded(read_table(spark, f"{folder}/activity.parquet"))


@query("activity_join", f"with {FLAT_SQL} select {ROUNDED} from flat")
def activity_join(spark, d):
    return rounded(joined_activity(sources(spark, d), TARGETS))


@query("etl_sampled", f"""with {FLAT_SQL},
 shuffled as (select *, row_number() over (order by md5('7:' || activity_id)) as place from flat),
 picked as (select * exclude (place) from shuffled where place <= 1000),
 {POTENCY_SQL.format(source="picked")}, {DEDUP}
 select activity_id, canonical_smiles, standard_units, {r('"pIC50"')} as "pIC50" from firsts where rn = 1""")
def etl_sampled(spark, d):
    out = processed_activity(joined_activity(sources(spark, d), TARGETS), n=1000, seed=7)
    return rounded(out.select("activity_id", "canonical_smiles", "standard_units", "pIC50"))


@query("pic50_guard", f"""
 select c_custkey, case when v > 0 then 'finite' when v = 0 then 'infinite' else 'nan' end as kind,
   case when v > 0 then {r('-log10(v * 1e-9)')} end as label
 from (select c_custkey, c_acctbal as v from customer)
 union all select -1 - s_suppkey, case when s_suppkey % 3 = 0 then 'infinite' else 'finite' end,
   case when s_suppkey % 3 <> 0 then {r("-log10(s_suppkey % 3 * 1e-9)")} end from supplier""")
def pic50_guard(spark, d):
    values = table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("v")).union(
        table(spark, d, "supplier").select(-1 - F.col("s_suppkey"), (F.col("s_suppkey") % 3).cast("double"))
    )
    label = values.withColumn("standard_value", F.col("v")).withColumn("standard_units", F.lit("nM")).withColumn(
        "pchembl_value", F.lit(5.0)
    ).withColumn("label", P.pic50())
    kind = F.when(F.isnan("label"), "nan").when(P.is_infinite("label"), "infinite").otherwise("finite")
    return rounded(label.select("c_custkey", kind.alias("kind"), F.when(kind == "finite", F.col("label")).alias("label")))


@query("imputed_units", f"""with {ACTIVITIES_SQL}, {POTENCY_SQL.format(source="activities")}
 select coalesce(standard_units, 'none') as units, count(*) as rows, {r('avg("pIC50")')} as mean_label,
   count("pIC50") as labelled from act group by 1""")
def imputed_units(spark, d):
    out = C.with_potency(activities(spark, d))
    return rounded(out.groupBy(F.coalesce("standard_units", F.lit("none")).alias("units")).agg(
        F.count("*").alias("rows"), F.avg("pIC50").alias("mean_label"), F.count("pIC50").alias("labelled")
    ))


# Account balances as values: negative ones give a NaN label, which the ETL keeps and learning drops.
GUARDED = """bal as (
  select c_custkey, case when c_custkey % 5 = 0 then null when c_custkey % 7 = 0 then 0 else c_acctbal end as v,
    case when c_custkey % 4 <> 0 then c_name end as feature from customer),
lab as (select *, case when v > 0 then -log10(v * 1e-9) when v = 0 then 'inf'::DOUBLE when v < 0 then 'nan'::DOUBLE end as label from bal)"""


def _guarded(spark, d):
    key = F.col("c_custkey")
    value = F.when(key % 5 == 0, None).when(key % 7 == 0, 0.0).otherwise(F.col("c_acctbal"))
    return table(spark, d, "customer").select(
        "c_custkey", F.when(key % 4 != 0, F.col("c_name")).alias("feature"), P.neg_log10(value * 1e-9).alias("label")
    )


@query("finite_filter", f"""with {GUARDED}
 select c_custkey, case when isnan(label) then 'NaN' end as note, case when not isnan(label) then {r('label')} end as label
 from lab where label is not null and not isinf(label)""")
def finite_filter(spark, d):
    kept = _guarded(spark, d).where(P.finite_or_nan("label"))
    return rounded(kept.select(
        "c_custkey", F.when(F.isnan("label"), "NaN").alias("note"), F.when(~F.isnan("label"), F.col("label")).alias("label")
    ))


@query("label_valid", f"""with {GUARDED} select c_custkey, feature from lab
 where feature is not null and label is not null and not isnan(label)""")
def label_valid(spark, d):
    return C.label_valid(_guarded(spark, d), "feature", "label").select("c_custkey", "feature")


@query("label_valid_counts", f"""with {GUARDED}, ok as (
   select coalesce(feature is not null and label is not null and not isnan(label), false) as ok from lab)
 select count(*) filter (ok) as kept, count(*) filter (not ok) as rejected from ok""")
def label_valid_counts(spark, d):
    return C.label_valid_counts(_guarded(spark, d), "feature", "label")


@query("listwise_drop", f"with {ACT} select activity_id, {r('alogp')} as alogp, standard_relation from act where alogp is not null and standard_relation is not null")
def listwise_drop(spark, d):
    act = C.drop_nulls(activity(spark, d), ["alogp", "standard_relation"])
    return rounded(act.select("activity_id", "alogp", "standard_relation"))


@query("pairwise_complete", f"""with {GUARDED} select count(*) as rows from lab
 where label is not null and not isnan(label) and c_custkey is not null""")
def pairwise_complete(spark, d):
    return C.drop_nulls(_guarded(spark, d), ["label", "c_custkey"], nan_too=True).agg(F.count("*").alias("rows"))


@query("present_columns", f"with {ACT} select {r('standard_value')} as standard_value, {r('\"pIC50\"')} as \"pIC50\", hba from act")
def present_columns(spark, d):
    wanted = ["standard_value", "pIC50", "no_such_column", "hba", "confidence_score"]
    return rounded(C.keep_present_columns(activity(spark, d), wanted, without=["confidence_score"]))


VIOLATIONS = """v as (select activity_id, mw_freebase > 500 as mw_violation, alogp > 5 as logp_violation,
   hbd > 5 as hbd_violation, hba > 10 as hba_violation,
   ((mw_freebase > 500)::TINYINT + (alogp > 5)::TINYINT + (hbd > 5)::TINYINT + (hba > 10)::TINYINT)::TINYINT as lipinski_violations
  from act)"""


@query("rule_flags", f"with {ACT}, {VIOLATIONS} select * from v")
def rule_flags(spark, d):
    flagged = C.with_rule_violations(activity(spark, d))
    return flagged.select(
        "activity_id", "mw_violation", "logp_violation", "hbd_violation", "hba_violation", "lipinski_violations"
    )


@query("rule_violations", f"with {ACT}, {VIOLATIONS} select lipinski_violations, count(*) as count from v group by 1")
def rule_violations(spark, d):
    return C.with_rule_violations(activity(spark, d)).groupBy("lipinski_violations").agg(F.count("*").alias("count"))


@query("strict_rule", f"with {ACT} select activity_id from act where mw_freebase < 500 and alogp < 5 and hba <= 10 and hbd <= 5")
def strict_rule(spark, d):
    return C.passing_strict_rule(activity(spark, d)).select("activity_id")


@query("plausible_range", f'with {ACT} select activity_id, {r("\"pIC50\"")} as "pIC50" from act where "pIC50" between 3 and 12 and standard_value < 100000')
def plausible_range(spark, d):
    return rounded(C.plausible_range(activity(spark, d)).select("activity_id", "pIC50"))


@query("default_relation", f"with {ACTIVITIES_SQL} select coalesce(standard_relation, '=') as relation, count(*) as count from activities group by 1")
def default_relation(spark, d):
    return activities(spark, d).groupBy(P.relation_or_equal().alias("relation")).agg(F.count("*").alias("count"))


@query("median_imputation", f"""with {ACT}, m as (select quantile_cont(alogp, 0.5) as m from act)
 select activity_id, {r('coalesce(alogp, m)')} as alogp from act, m""")
def median_imputation(spark, d):
    return rounded(C.impute_median(activity_table(spark, d), ["alogp"]).select("activity_id", "alogp"))


@query("common_unit", f"""with {ACTIVITIES_SQL}
 select activity_id, {r("standard_value * case standard_units when 'nM' then 1 else 1000 end", 3)} as standard_value, 'nM' as standard_units
 from activities where standard_units is not null""")
def common_unit(spark, d):
    return rounded(C.with_common_unit(activities(spark, d)).select("activity_id", "standard_value", "standard_units"), 3)


@query("censored_values", f"""with {ACT}
 select activity_id, coalesce(standard_relation, '=') as standard_relation,
   case standard_relation when '>' then 'lower_bound' when '<' then 'upper_bound' else 'exact' end as censoring,
   case when standard_relation = '>' then 'inactive' when "pIC50" > 8 then 'potent' when "pIC50" > 6 then 'active'
     when "pIC50" is not null then 'inactive' end as activity_class from act""")
def censored_values(spark, d):
    return C.with_censoring(activity(spark, d), "label").select("activity_id", "standard_relation", "censoring", "activity_class")


@query("exact_values", f"with {ACT} select activity_id from act where coalesce(standard_relation, '=') = '='")
def exact_values(spark, d):
    return C.with_censoring(activity(spark, d), "drop").select("activity_id")


@query("structured_measured", f"""with {ACTIVITIES_SQL}, joined as (
   select a.*, case when p_size < 50 then concat_ws('|', p_name, p_brand, p_type) end as canonical_smiles
   from activities a join part on molregno = p_partkey)
 select activity_id from joined where canonical_smiles is not null and (standard_value is not null or pchembl_value is not null)""")
def structured_measured(spark, d):
    joined = activities(spark, d).join(sources(spark, d)["compound_structures"], "molregno")
    return C.structured_and_measured(joined).select("activity_id")


@query("potency_classes", f"""with {ACT} select case when "pIC50" > 8 then 'potent' when "pIC50" > 6 then 'active'
   when "pIC50" is not null then 'inactive' end as potency, count(*) as count from act where confidence_score >= 3 group by 1""")
def potency_classes(spark, d):
    return C.confident(activity(spark, d), 3).groupBy(P.potency_class().alias("potency")).agg(F.count("*").alias("count"))


@query("duplicate_audit", f"""with {ACT} select molregno, target_chembl_id, count(*) as rows, {r('max("pIC50") - min("pIC50")')} as spread
 from act group by 1, 2 having count(*) > 1""")
def duplicate_audit(spark, d):
    return rounded(C.duplicate_audit(activity(spark, d), ["molregno", "target_chembl_id"], "pIC50"))


@query("duplicate_structures", f"""with {ACT} select canonical_smiles, count(*) as rows, (max(molregno) - min(molregno))::BIGINT as spread
 from act group by 1 having count(*) > 1""")
def duplicate_structures(spark, d):
    return C.duplicate_audit(activity(spark, d), ["canonical_smiles"], "molregno")


@query("large_targets", """select o_custkey, o_orderkey from orders where o_custkey in
 (select o_custkey from orders group by 1 having count(*) >= 12)""")
def large_targets(spark, d):
    return C.groups_with_enough_rows(table(spark, d, "orders"), "o_custkey", 12).select("o_custkey", "o_orderkey")


@query("first_document_per_text", """select doc_id, source from (
  select *, row_number() over (partition by text order by doc_id) as rn from documents) where rn = 1""")
def first_document_per_text(spark, d):
    return C.first_per_text(table(spark, d, "documents"), "text", ["doc_id"], ["doc_id", "source"])


@query("exact_sample", "select o_orderkey from (select *, row_number() over (order by md5('11:' || o_orderkey)) as rn from orders) where rn <= 700")
def exact_sample(spark, d):
    return O.exact_sample(table(spark, d, "orders"), 700, ["o_orderkey"], 11).select("o_orderkey")


@query("shuffled_slice", "select o_orderkey from (select *, row_number() over (order by md5('42:' || o_orderkey)) as rn from orders) where rn > 100 and rn <= 900")
def shuffled_slice(spark, d):
    return O.positional_slice(table(spark, d, "orders"), 100, 900, ["o_orderkey"]).select("o_orderkey")


@query("row_index", "select o_orderkey, row_number() over (order by md5('42:' || o_orderkey), o_orderkey) as row_id from orders")
def row_index(spark, d):
    return O.hash_rank(table(spark, d, "orders"), ["o_orderkey"], out="row_id").select("o_orderkey", "row_id")
