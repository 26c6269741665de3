"""Profiles, correlations, distributions."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from doseframe import schemas as S
from doseframe.operators import cleaning as C, profile as P, stats as T
from registry.base import query, r, rounded
from registry.inputs import ACT, ACTIVITIES_SQL, activities, activity, activity_table, table

LABELLED = "labelled as (select d.*, l.quality, l.toxic from documents d left join labels l using (doc_id))"


def quoted(cols: list[str]) -> list[str]:
    """Column names for SQL."""
    return [f'"{c}"' if c != c.lower() else c for c in cols]


def labelled(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")


@query("null_profile", f"""with {LABELLED}
 select 'doc_id' as column, count(*) - count(doc_id) as nulls from labelled
 union all select 'text', count(*) - count(text) from labelled
 union all select 'lang', count(*) - count(lang) from labelled
 union all select 'source', count(*) - count(source) from labelled
 union all select 'n_chars', count(*) - count(n_chars) from labelled
 union all select 'quality', count(*) - count(quality) from labelled
 union all select 'toxic', count(*) - count(toxic) from labelled""")
def null_profile(spark, d):
    return P.null_counts(labelled(spark, d))


def _describe_sql(source: str, cols: list[str]) -> str:
    parts = []
    for c in cols:
        for stat, expr in (
            ("count", f"count({c})"), ("null_count", f"count(*) - count({c})"), ("mean", f"avg({c})"),
            ("std", f"stddev_samp({c})"), ("min", f"min({c})"), ("25%", f"quantile_cont({c}, 0.25)"),
            ("50%", f"quantile_cont({c}, 0.5)"), ("75%", f"quantile_cont({c}, 0.75)"), ("max", f"max({c})"),
        ):
            name = c.strip('"')
            parts.append(f"select '{name}' as column, '{stat}' as stat, {r(expr, 4)} as value from {source}")
    return " union all ".join(parts)


DESCRIBED = [*quoted(S.NUMERIC_FEATURES), "pchembl_value"]


@query("describe_activity", f"with {ACT} {_describe_sql('act', DESCRIBED)}")
def describe_activity(spark, d):
    return rounded(P.describe(activity_table(spark, d), [c.strip('"') for c in DESCRIBED]), 4)


@query("describe_events", _describe_sql("events", ["value"]))
def describe_events(spark, d):
    return rounded(P.describe(table(spark, d, "events"), ["value"]), 4)


TEXT_COLUMNS = {"documents": ["text", "lang", "source"], "orders": ["o_orderpriority", "o_orderstatus"]}


@query("describe_text", " union all ".join(
    f"select '{t}' as table_name, '{c}' as column, count({c}) as count, count(*) - count({c}) as null_count, min({c}) as min, max({c}) as max from {t}"
    for t, cols in TEXT_COLUMNS.items() for c in cols))
def describe_text(spark, d):
    docs, orders = (P.describe_text(table(spark, d, t), cols).select(F.lit(t).alias("table_name"), "*") for t, cols in TEXT_COLUMNS.items())
    return docs.unionByName(orders)


@query("value_counts", f"""with {ACT}
 select 'standard_type' as column, standard_type as value, count(*) as count from act group by 2
 union all select 'standard_units', standard_units, count(*) from act group by 2
 union all select 'standard_relation', standard_relation, count(*) from act group by 2""")
def value_counts(spark, d):
    return P.value_counts(activity(spark, d), ["standard_type", "standard_units", "standard_relation"])


@query("group_sizes", "select o_custkey, count(*) as count from orders group by 1")
def group_sizes(spark, d):
    return P.group_count(table(spark, d, "orders"), "o_custkey")


@query("top_targets", f"""with {ACT} select target_name, count(molregno) as count from act group by 1
 order by count desc, target_name limit 15""")
def top_targets(spark, d):
    return P.top_groups(activity(spark, d), "target_name", 15, "molregno")


@query("top_parts", "select l_partkey, count(*) as count from lineitem group by 1 order by 2 desc, 1 limit 10")
def top_parts(spark, d):
    return P.top_groups(table(spark, d, "lineitem"), "l_partkey", 10)


@query("top_potent", f"""with {ACT} select activity_id, target_name, {r('"pIC50"')} as "pIC50",
   'Target: ' || target_name || chr(10) || 'pIC50: ' || printf('%.2f', "pIC50") as caption
 from act where canonical_smiles is not null and "pIC50" is not null order by act."pIC50" desc, activity_id limit 8""")
def top_potent(spark, d):
    top = P.top_rows(activity(spark, d), "pIC50", "canonical_smiles", "target_name", ["activity_id"])
    return rounded(top.select("activity_id", "target_name", "pIC50", "caption"))


@query("drug_like_share", f"""with {ACT}, v as (select (mw_freebase > 500)::INT + (alogp > 5)::INT + (hbd > 5)::INT + (hba > 10)::INT as n from act)
 select count(*) filter (n <= 1) as passing, count(*) as rows, {r('count(*) filter (n <= 1) / count(*)')} as share from v""")
def drug_like_share(spark, d):
    return rounded(P.share(C.with_rule_violations(activity(spark, d)), F.col("lipinski_violations") <= 1))


@query("value_span", """select 'l_quantity' as column, min(l_quantity) as low, max(l_quantity) as high from lineitem
 union all select 'l_extendedprice', min(l_extendedprice), max(l_extendedprice) from lineitem""")
def value_span(spark, d):
    return P.value_span(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"])


def _hist_sql(source: str, x: str, bins: str) -> str:
    return f"""
 s as (select min({x}) as lo, max({x}) as hi, ({bins})::INTEGER as k from {source}),
 b as (select least(floor(({x} - lo) / ((hi - lo) / k)), k - 1)::BIGINT as bin, count(*) as n from {source}, s group by 1)
 select g.bin::BIGINT as bin, {r('lo + (hi - lo) / k * g.bin', 4)} as low, {r('lo + (hi - lo) / k * (g.bin + 1)', 4)} as high,
   coalesce(n, 0)::BIGINT as count
 from s cross join (select unnest(range(0, (select k from s))) as bin) g left join b on b.bin = g.bin"""


@query("histogram", f"with {_hist_sql('events', 'value', '30')}")
def histogram(spark, d):
    return rounded(P.histogram(table(spark, d, "events"), "value", 30), 4)


AUTO = """select case when iqr > 0 then ceil(span / least(greatest(2 * iqr / pow(n, 1.0/3), span / sqrt(n) / 2), span / (log2(n) + 1)))
 else ceil(log2(n) + 1) end from (select count(*)::DOUBLE as n, max(l_extendedprice) - min(l_extendedprice) as span,
 quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25) as iqr from lineitem)"""


@query("histogram_auto", f"with {_hist_sql('lineitem', 'l_extendedprice', AUTO)}")
def histogram_auto(spark, d):
    return rounded(P.histogram(table(spark, d, "lineitem"), "l_extendedprice"), 4)


@query("violation_histogram", f"""with {ACT}, v as (select (mw_freebase > 500)::INT + (alogp > 5)::INT + (hbd > 5)::INT + (hba > 10)::INT as x from act),
 w as (select x::DOUBLE as x from v where x is not null), {_hist_sql('w', 'x', '5')}""")
def violation_histogram(spark, d):
    return rounded(P.histogram(C.with_rule_violations(activity_table(spark, d)), "lipinski_violations", 5), 4)


@query("density_curve", f"""with s as (select count(*) as n, stddev_samp(value) as sd, min(value) as lo, max(value) as hi from events),
 p as (select *, sd * pow(n, -0.2) as bw from s),
 b as (select floor((value - lo) / pow(2.0, floor(log2(bw / 16)))) as cell, count(*) as k from events, p group by 1),
 c as (select lo + pow(2.0, floor(log2(bw / 16))) * (cell + 0.5) as c, k from b, p),
 g as (select unnest(range(0, 200)) as i),
 x as (select i, lo + (hi - lo) * i / 199.0::DOUBLE as x from g, p)
 select i::BIGINT as point, {r('any_value(x)')} as x,
   {r('sum(k * exp(-0.5 * pow((x - c) / bw, 2)) / (n * bw * sqrt(2 * pi())))', 9)} as density
 from x, c, p group by i""")
def density_curve(spark, d):
    curve = P.density_curve(table(spark, d, "events"), "value")
    return curve.select(
        "point", (F.round("x", 6) + 0.0).alias("x"), (F.round("density", 9) + 0.0).alias("density")
    )


def _box_sql(c: str, source: str) -> str:
    return f"""select '{c}' as column, {r('q1')} as q1, {r('q2')} as median, {r('q3')} as q3,
  {r(f'min({c}) filter ({c} between lo and hi)')} as whisker_low, {r(f'max({c}) filter ({c} between lo and hi)')} as whisker_high,
  count(*) filter ({c} < lo) as below, count(*) filter ({c} > hi) as above
 from {source}, (select *, q1 - 1.5 * (q3 - q1) as lo, q3 + 1.5 * (q3 - q1) as hi from (
   select quantile_cont({c}, 0.25) as q1, quantile_cont({c}, 0.5) as q2, quantile_cont({c}, 0.75) as q3 from {source})) group by all"""


@query("box_stats", f"with {ACT}, m as materialized (select {', '.join(quoted(S.BOX_FEATURES))} from act) "
       + " union all ".join(_box_sql(c, "m").replace(f"select '{c}'", "select '" + c.strip('"') + "'") for c in quoted(S.BOX_FEATURES)))
def box_stats(spark, d):
    return rounded(P.box_stats(activity_table(spark, d), [*S.BOX_FEATURES, "absent"]))


@query("box_stats_events", _box_sql("value", "events"))
def box_stats_events(spark, d):
    return rounded(P.box_stats(table(spark, d, "events"), ["value"]))


NUMERIC = quoted(S.NUMERIC_FEATURES)


def _corr_sql(cols: list[str], source: str) -> str:
    return " union all ".join(
        f"select '{a.strip(chr(34))}' as x, '{b.strip(chr(34))}' as y, {r(f'corr({a}, {b})')} as r from {source}"
        for a in cols for b in cols
    )


@query("pearson_matrix", f"with {ACT} {_corr_sql(NUMERIC, 'act')}")
def pearson_matrix(spark, d):
    return rounded(T.pearson(activity(spark, d), [c.strip('"') for c in NUMERIC]))


TARGET_R = "tr as (" + " union all ".join(
    f"select '{c}' as feature, corr({c}, \"pIC50\") as r from act" for c in S.NUMERIC_FEATURES[:-1]
) + ")"
FEATURES = S.NUMERIC_FEATURES[:-1]


@query("target_correlations", f"""with {ACT}, {TARGET_R}
 select feature, {r('r')} as r, case when abs(r) > 0.5 then 'SILNA' when abs(r) > 0.3 then 'UMIARKOWANA' else 'SŁABA' end as strength,
   case when r > 0 then '↑ dodatnia' else '↓ ujemna' end as direction, printf('%+.3f', r) as label from tr""")
def target_correlations(spark, d):
    return rounded(T.target_correlations(activity(spark, d), FEATURES, "pIC50"))


@query("strongest_features", f"with {ACT}, {TARGET_R} select feature from tr order by abs(r) desc, feature limit 4")
def strongest_features(spark, d):
    return T.strongest(T.target_correlations(activity(spark, d), FEATURES, "pIC50"), 4).select("feature")


@query("correlation_summary", f"""with {ACT}, {TARGET_R}
 select arg_max(feature, r) filter (r > 0) as strongest_positive, {r('max(r) filter (r > 0)')} as strongest_positive_r,
   arg_min(feature, r) filter (r < 0) as strongest_negative, {r('min(r) filter (r < 0)')} as strongest_negative_r,
   count(*) filter (abs(r) > 0.5) as strong, count(*) filter (abs(r) > 0.3 and abs(r) <= 0.5) as moderate,
   count(*) filter (abs(r) <= 0.3) as weak from tr""")
def correlation_summary(spark, d):
    return rounded(T.correlation_summary(T.target_correlations(activity(spark, d), FEATURES, "pIC50")))


SPEARMAN = ["l_quantity", "l_extendedprice", "l_discount"]


def _spearman_sql(source: str, cols: list[str]) -> str:
    parts = [f"select '{c.strip(chr(34))}' as x, '{c.strip(chr(34))}' as y, case when min({c}) < max({c}) then 1.0::DOUBLE end as r from {source}" for c in cols]
    for a, b in combinations(cols, 2):
        ranked = f"""select rank() over (order by {a}) + (count(*) over (partition by {a}) - 1) / 2.0 as ra,
            rank() over (order by {b}) + (count(*) over (partition by {b}) - 1) / 2.0 as rb
            from {source} where {a} is not null and {b} is not null"""
        for x, y in ((a, b), (b, a)):
            parts.append(f"select '{x.strip(chr(34))}' as x, '{y.strip(chr(34))}' as y, {r('corr(ra, rb)')} as r from ({ranked})")
    return " union all ".join(parts)


@query("spearman_matrix", f"with {ACT}, m as materialized (select {', '.join(NUMERIC)} from act) " + _spearman_sql("m", NUMERIC))
def spearman_matrix(spark, d):
    return rounded(T.spearman(activity(spark, d), S.NUMERIC_FEATURES))


@query("spearman_lineitem", _spearman_sql("lineitem", SPEARMAN))
def spearman_lineitem(spark, d):
    return rounded(T.spearman(table(spark, d, "lineitem"), SPEARMAN))


@query("spearman_with_gaps", f"with {LABELLED} " + _spearman_sql("labelled", ["n_chars", "quality", "toxic"]))
def spearman_with_gaps(spark, d):
    return rounded(T.spearman(labelled(spark, d), ["n_chars", "quality", "toxic"]))


def _trend_sql(c: str, y: str, source: str) -> str:
    return f"""select '{c}' as feature, regr_slope({y}, {c}) as slope, regr_intercept({y}, {c}) as intercept,
  min({c}) filter ({y} is not null)::DOUBLE as low, max({c}) filter ({y} is not null)::DOUBLE as high,
  count({c}) filter ({y} is not null) as n from {source}"""


TRENDS = " union all ".join(_trend_sql(c, '"pIC50"', "act") for c in ["mw_freebase", "alogp", "hba", "psa"])


@query("trend_fits", f"with {ACT}, t as ({TRENDS}) select feature, {r('slope')} as slope, {r('intercept')} as intercept, {r('low')} as low, {r('high')} as high, n from t")
def trend_fits(spark, d):
    return rounded(T.trends(activity(spark, d), ["mw_freebase", "alogp", "hba", "psa"], "pIC50"))


@query("trend_lines", f"""with {ACT}, t as ({TRENDS}), g as (select unnest(range(0, 100)) as point),
 p as (select feature, point, low + (high - low) * point / 99.0::DOUBLE as x, slope, intercept from t, g)
 select feature, point::BIGINT as point, {r('x')} as x, {r('intercept + slope * x')} as y from p""")
def trend_lines(spark, d):
    return rounded(T.trend_lines(T.trends(activity(spark, d), ["mw_freebase", "alogp", "hba", "psa"], "pIC50")))


VIF = """g as (select sum(a*a) as aa, sum(a*b) as ab, sum(a*c) as ac, sum(b*b) as bb, sum(b*c) as bc, sum(c*c) as cc
   from (select l_quantity as a, l_extendedprice as b, l_discount as c from lineitem)),
 det as (select *, aa*(bb*cc - bc*bc) - ab*(ab*cc - bc*ac) + ac*(ab*bc - bb*ac) as det from g),
 v as (select 'l_quantity' as feature, aa * (bb*cc - bc*bc) / det as vif from det
   union all select 'l_extendedprice', bb * (aa*cc - ac*ac) / det from det
   union all select 'l_discount', cc * (aa*bb - ab*ab) / det from det)"""


@query("vif_lineitem", f"with {VIF} select feature, {r('vif')} as vif, case when vif > 10 then 'strong' when vif > 5 then 'moderate' else 'none' end as label from v")
def vif_lineitem(spark, d):
    return rounded(T.vif(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]))


def _vif_sql(source: str, cols: list[str]) -> str:
    """Sums of products with a unit diagonal; sweeping every pivot leaves the inverse with its sign turned. Columns that
    others give up to rounding (here alogp and psa) are infinite."""
    k = len(cols)
    cells = " union all ".join(
        f"select {i} as i, {j} as j, sum({a} * {b}) / sqrt(sum({a} * {a}) * sum({b} * {b})) as a from m"
        for i, a in enumerate(cols) for j, b in enumerate(cols))
    steps = "".join(f""",
 g{p + 1} as materialized (select x.i, x.j, case when x.i = {p} and x.j = {p} then -1 / p.a when x.i = {p} or x.j = {p} then x.a / p.a
   else x.a - r.a * c.a / p.a end as a
   from g{p} x join g{p} p on p.i = {p} and p.j = {p} join g{p} r on r.i = x.i and r.j = {p} join g{p} c on c.i = {p} and c.j = x.j)"""
                    for p in range(k))
    full = " and ".join(f"{c} is not null" for c in cols)
    return f"""m as materialized (select {', '.join(f'{c}::DOUBLE as {c}' for c in cols)} from {source} where {full}),
 g0 as materialized ({cells}){steps},
 v as (select ({cols!r})[i + 1] as feature, case when -a between 0 and 1e12 then -a else 'inf'::DOUBLE end as vif from g{k} where i = j)"""


@query("vif", f"""with {ACT}, {_vif_sql('act', S.VIF_FEATURES)}
 select feature, {r('vif')} as vif, case when vif > 10 then 'strong' when vif > 5 then 'moderate' else 'none' end as label from v""")
def vif(spark, d):
    return rounded(T.vif(activity_table(spark, d), S.VIF_FEATURES))


@query("vif_summary", f"with {VIF} select count(*) filter (vif > 10) as high, count(*) filter (vif > 5 and vif <= 10) as moderate from v")
def vif_summary(spark, d):
    return T.vif_summary(T.vif(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]))


@query("standardized", f"""with {ACT}, s as (select avg(mw_freebase) as m1, stddev_pop(mw_freebase) as s1, avg(hba) as m2, stddev_pop(hba) as s2 from act)
 select activity_id, {r('(mw_freebase - m1) / s1')} as mw_freebase, {r('(hba - m2) / s2')} as hba from act, s""")
def standardized(spark, d):
    return rounded(T.standardized(activity_table(spark, d), ["mw_freebase", "hba"]).select("activity_id", "mw_freebase", "hba"))


# Two standardized columns: the components are (1, 1) and (1, -1) over sqrt 2, with shares (1 +- r) / 2.
@query("pca_scores", f"""with {ACT}, f as (select activity_id, "pIC50", mw_freebase as a, psa as b from act where "pIC50" is not null),
 s as (select avg(a) as ma, stddev_pop(a) as sa, avg(b) as mb, stddev_pop(b) as sb, corr(a, b) as r from f),
 z as (select *, (a - ma) / sa as za, (b - mb) / sb as zb, case when r > 0 then 1 else -1 end as sg from f, s)
 select activity_id, {r('"pIC50"', 5)} as "pIC50", {r('(za + sg * zb) / sqrt(2)', 5)} as "PCA1", {r('(za - sg * zb) / sqrt(2)', 5)} as "PCA2",
   {r('(1 + abs(r)) / 2', 5)} as explained1, {r('(1 - abs(r)) / 2', 5)} as explained2 from z""")
def pca_scores(spark, d):
    return rounded(T.pca_scores(activity_table(spark, d), ["mw_freebase", "psa"], "pIC50", ["activity_id"]), 5)


# Seven columns: the scores have mean 0 and, along a component, the explained share of 7 as variance.
@query("pca_activity", f"""with {ACT}, f as (select * from act where alogp is not null and "pIC50" is not null)
 select count(*) as rows, 0.0::DOUBLE as mean1, 0.0::DOUBLE as mean2, 0.0::DOUBLE as overlap, true as ordered,
   true as matches_share from f""")
def pca_activity(spark, d):
    cols = ["mw_freebase", "alogp", "hba", "hbd", "psa", "rtb", "aromatic_rings"]
    s = T.pca_scores(activity_table(spark, d), cols, "pIC50", ["activity_id"])
    return rounded(s.agg(
        F.count("*").alias("rows"), F.avg("PCA1").alias("mean1"), F.avg("PCA2").alias("mean2"),
        F.covar_pop("PCA1", "PCA2").alias("overlap"), (F.var_pop("PCA1") >= F.var_pop("PCA2")).alias("ordered"),
        ((F.abs(F.var_pop("PCA1") - 7 * F.max("explained1")) < 1e-6)
         & (F.abs(F.var_pop("PCA2") - 7 * F.max("explained2")) < 1e-6)).alias("matches_share"),
    ))


@query("plot_sample", f"""with {ACTIVITIES_SQL}
 select activity_id, standard_value, pchembl_value from (
   select *, row_number() over (order by md5('42:' || activity_id)) as rn from activities where pchembl_value is not null)
 where rn <= 5000""")
def plot_sample(spark, d):
    return T.scatter_sample(activities(spark, d), ["standard_value", "pchembl_value"], ["activity_id"], 5000)
