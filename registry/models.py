"""Scores, tuning and run tables, baseline models."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from doseframe import schemas as S
from doseframe.operators import evaluate as E, joins as J, runs as N, splits as L, stats as T
from doseframe.plans.learn import fingerprint_table, train_and_score
from doseframe.session import scratch_path, staged
from registry.base import query, r, rounded
from registry.inputs import ACT, activity, activity_table, spread, table
from registry.splitting import RANDOM

PREDICTED = "pr as (select *, l_extendedprice / 10000 as y, l_quantity / 5 as p from lineitem)"
SCORES = f"""count(*) as n, 0::BIGINT as nan_targets, 0::BIGINT as nan_predictions,
 {r('1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*))')} as r2, {r('avg((y - p) * (y - p))')} as mse,
 {r('sqrt(avg((y - p) * (y - p)))')} as rmse, {r('avg(abs(y - p))')} as mae,
 {r('avg(case when abs(y - p) <= 1 then 0.5 * (y - p) * (y - p) else abs(y - p) - 0.5 end)')} as huber,
 {r('avg(abs(y - p) + ln(1 + exp(-2 * abs(y - p))) - ln(2))')} as log_cosh"""


def predicted(spark, d):
    return table(spark, d, "lineitem").withColumn("y", F.col("l_extendedprice") / 10000).withColumn("p", F.col("l_quantity") / 5)


@query("regression_scores", f"with {PREDICTED} select l_returnflag, {SCORES} from pr group by 1")
def regression_scores(spark, d):
    return rounded(E.regression_scores(predicted(spark, d), by=["l_returnflag"]))


@query("residuals", f"with {PREDICTED} select l_linenumber, {r('sum(y - p)', 4)} as total, {r('min(y - p)')} as low, {r('max(y - p)')} as high from pr group by 1")
def residuals(spark, d):
    res = predicted(spark, d).withColumn("res", E.residual())
    out = res.groupBy("l_linenumber").agg(F.sum("res").alias("total"), F.min("res").alias("low"), F.max("res").alias("high"))
    return out.select("l_linenumber", F.round("total", 4).alias("total"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query("batch_mean_loss", f"""with s as (select power(o_totalprice / 100000 - o_custkey % 5, 2) as sq,
   row_number() over (order by md5('42:' || o_orderkey)) as place from orders),
 b as (select floor((place - 1) / 64) as batch, avg(sq) as loss from s group by 1)
 select count(*) as batches, {r('avg(loss)')} as loss from b""")
def batch_mean_loss(spark, d):
    rows = table(spark, d, "orders").withColumn("y", F.col("o_totalprice") / 100000).withColumn("p", (F.col("o_custkey") % 5).cast("double"))
    return rounded(E.batch_mean_loss(rows, ["o_orderkey"]))


@query("mean_baseline", f"""with {RANDOM.format(seed=42)}, m as (select avg(o_totalprice / 10000) as m from split where split = 'train'),
 pr as (select split, o_totalprice / 10000 as y, m as p from split, m) select split, {SCORES} from pr group by 1""")
def mean_baseline(spark, d):
    split = L.random_split(table(spark, d, "orders"), ["o_orderkey"]).withColumn("y", F.col("o_totalprice") / 10000)
    return rounded(E.regression_scores(E.with_mean_baseline(split), by=["split"]))


AUC = """rk as (select {pos} as pos, rank() over (order by {score}) + (count(*) over (partition by {score}) - 1) / 2.0 as rk
   from {source} where {score} is not null and ({pos}) is not null)
 select count(*) filter (pos) as positives, count(*) filter (not pos) as negatives,
   {out} as auc from rk"""
AUC_OUT = r("(sum(rk) filter (pos) - count(*) filter (pos) * (count(*) filter (pos) + 1) / 2) / (count(*) filter (pos) * count(*) filter (not pos))")


@query("auc_price", "with " + AUC.format(pos="l_quantity > 25", score="l_extendedprice", source="lineitem", out=AUC_OUT))
def auc_price(spark, d):
    return rounded(E.auc(table(spark, d, "lineitem"), "l_extendedprice", F.col("l_quantity") > 25))


@query("auc_active", f"with {ACT}, " + AUC.format(pos='"pIC50" > 4.3', score="alogp", source="act", out=AUC_OUT))
def auc_active(spark, d):
    return rounded(E.auc(activity_table(spark, d), "alogp", F.col("pIC50") > 4.3))


# One training run per user, one epoch per day, losses from the day's values.
HISTORY = """h as (select user_id, day(ts)::INTEGER as epoch, max(value) as train_loss, avg(value) as val_loss,
   case when day(ts) % 3 > 0 then min(value) end as val_r2, case when day(ts) > 10 then 0.0003 else 0.001 end::DOUBLE as lr
  from events group by user_id, day(ts))"""


def history(spark, d):
    day = F.dayofmonth("ts")
    return table(spark, d, "events").groupBy("user_id", day.alias("epoch")).agg(
        F.max("value").alias("train_loss"), F.avg("value").alias("val_loss"), F.min("value").alias("low")
    ).select(
        "user_id", "epoch", "train_loss", "val_loss", F.when(F.col("epoch") % 3 > 0, F.col("low")).alias("val_r2"),
        F.when(F.col("epoch") > 10, 3e-4).otherwise(1e-3).alias("lr"),
    )


@query("early_stopping", f"""with recursive {HISTORY},
 o as (select *, row_number() over (partition by user_id order by epoch) as i from h),
 w as (
  select user_id, 0::BIGINT as i, 'inf'::DOUBLE as best, -1::BIGINT as best_epoch, 0 as idle, 0.0::DOUBLE as st, 0.0::DOUBLE as sv from (select distinct user_id from h)
  union all
  select w.user_id, o.i, case when val_loss < best - 0.5 then val_loss else best end,
    case when val_loss < best - 0.5 then o.epoch::BIGINT else best_epoch end, case when val_loss < best - 0.5 then 0 else idle + 1 end,
    st + train_loss, sv + val_loss
  from w join o on o.user_id = w.user_id and o.i = w.i + 1 where idle < 4),
 f as (select *, row_number() over (partition by user_id order by i desc) as last from w)
 select user_id, best_epoch::INTEGER as best_epoch, {r('best', 9)} as best_val_loss, i::INTEGER as epochs_trained,
  {r('st / i', 9)} as avg_train_loss, {r('sv / i', 9)} as avg_val_loss from f where last = 1""")
def early_stopping(spark, d):
    # Nine digits: a mean of cents over 16 or 32 epochs is often an exact tie at six.
    return rounded(E.early_stopping(history(spark, d), run="user_id", patience=4, min_delta=0.5), 9)


@query("epoch_metrics", f"""with {HISTORY} select user_id, epoch, 'train_loss' as metric, {r('train_loss')} as value from h
 union all select user_id, epoch, 'val_loss', {r('val_loss')} from h
 union all select user_id, epoch, 'val_r2', {r('val_r2')} from h where val_r2 is not null
 union all select user_id, epoch, 'lr', {r('lr')} from h""")
def epoch_metrics(spark, d):
    return rounded(N.epoch_metrics(history(spark, d), ["user_id", "epoch"]))


# Result rows from orders: one per priority, status, customer class and year.
RESULTS = """res as (
  select o_orderpriority as model, case o_orderstatus when 'F' then 'random' when 'O' then 'scaffold' else 'other' end as split,
    (o_custkey % 3)::INTEGER as seed, case when o_orderpriority <> '1-URGENT' then 'mean' end as pooling,
    case when year(o_orderdate) % 2 = 0 then 192 end as gnn_hidden_dim, 4 as gnn_num_layers, 0.1::DOUBLE as gnn_dropout,
    case when year(o_orderdate) % 3 = 0 then 0.001 else 0.0003 end::DOUBLE as lr, 0.00001::DOUBLE as weight_decay,
    avg(o_totalprice) / 1000000 as r2_val, stddev_pop(o_totalprice) / 100000 as best_val_loss, count(*) as n
  from orders where {where} group by all)"""


def results(spark, d, where="true"):
    even = F.year("o_orderdate") % 2 == 0
    status = F.when(F.col("o_orderstatus") == "F", "random").when(F.col("o_orderstatus") == "O", "scaffold").otherwise("other")
    return table(spark, d, "orders").where(where).groupBy(
        F.col("o_orderpriority").alias("model"), status.alias("split"), (F.col("o_custkey") % 3).cast("int").alias("seed"),
        F.when(F.col("o_orderpriority") != "1-URGENT", "mean").alias("pooling"), F.when(even, 192).alias("gnn_hidden_dim"),
        F.lit(4).alias("gnn_num_layers"), F.lit(0.1).alias("gnn_dropout"),
        F.when(F.year("o_orderdate") % 3 == 0, 1e-3).otherwise(3e-4).alias("lr"), F.lit(1e-5).alias("weight_decay"),
    ).agg(
        (F.avg("o_totalprice") / 1000000).alias("r2_val"), (F.stddev_pop("o_totalprice") / 100000).alias("best_val_loss"),
        F.count("*").alias("n"),
    )


RESULT_COLUMNS = f"""model, split, seed, pooling, gnn_hidden_dim, gnn_num_layers, gnn_dropout, lr, weight_decay,
 {r('r2_val')} as r2_val, {r('best_val_loss')} as best_val_loss, n"""
KEYS_MATCH = " and ".join(f"a.{k} is not distinct from b.{k}" for k in S.RESULT_KEY)


UPSERT_SQL = f"""with {RESULTS.format(where="o_totalprice < 250000").replace("res as", "a as")},
 {RESULTS.format(where="o_totalprice >= 250000 and o_custkey % 3 <> 2").replace("res as", "b as")},
 u as (select * from a where not exists (select 1 from b where {KEYS_MATCH}) union all select * from b)
 select {RESULT_COLUMNS} from u"""


def _result_batches(spark, d):
    return results(spark, d, "o_totalprice < 250000"), results(spark, d, "o_totalprice >= 250000 and o_custkey % 3 <> 2")


@query("run_upsert", UPSERT_SQL)
def run_upsert(spark, d):
    return rounded(J.upsert(*_result_batches(spark, d), S.RESULT_KEY))


@query("stored_upsert", UPSERT_SQL)
def stored_upsert(spark, d):
    """Two batches into a stored table, the second one twice, as after a job that was run again."""
    path = scratch_path(spark, "results")
    old, new = _result_batches(spark, d)
    for batch in (old, new, new):
        out = N.upsert_stored(batch, path, S.RESULT_KEY)
    return rounded(out)


@query("tuning_table", f"""with {RESULTS.format(where="true")}
 select model, split, lr, weight_decay, pooling, gnn_hidden_dim, gnn_num_layers, gnn_dropout,
  array_to_string(list_sort(list_distinct(list(seed))), ',') as seeds, {r('avg(r2_val)')} as r2_val_mean,
  {r('stddev_pop(r2_val)')} as r2_val_std, {r('avg(best_val_loss)')} as best_val_loss_mean, {r('stddev_pop(best_val_loss)')} as best_val_loss_std
 from res group by all""")
def tuning_table(spark, d):
    return rounded(E.tuning_table(results(spark, d)))


@query("results_report", f"""with {RESULTS.format(where="true")} select model, split, seed, lr, weight_decay, pooling, gnn_hidden_dim, gnn_num_layers,
 gnn_dropout, {r('best_val_loss')} as best_val_loss, {r('r2_val')} as r2_val from res""")
def results_report(spark, d):
    return rounded(E.results_report(results(spark, d)))


@query("comparison_report", f"""with {RESULTS.format(where="true")} select model,
 {r("min(best_val_loss) filter (split = 'random')")} as random_loss, {r("arg_min(r2_val, best_val_loss) filter (split = 'random')")} as random_r2,
 {r("min(best_val_loss) filter (split = 'scaffold')")} as scaffold_loss, {r("arg_min(r2_val, best_val_loss) filter (split = 'scaffold')")} as scaffold_r2
 from res group by 1""")
def comparison_report(spark, d):
    return rounded(E.comparison_report(results(spark, d)))


@query("run_log", f"""with {RESULTS.format(where="true")},
 sz as (select case o_orderstatus when 'F' then 'random' when 'O' then 'scaffold' else 'other' end as split, count(*) as n_train from orders group by 1)
 select model || '_' || split || '_seed' || seed as run_name, 'bioactivity_regression' as task, split as split_type, seed::VARCHAR as seed,
  case when pooling is null then 0 else 1 end + case when gnn_hidden_dim is null then 0 else 1 end as optional_params,
  {r('r2_val')} as r2_val, false as has_r2_test, n_train::DOUBLE as n_train from res join sz using (split)""")
def run_log(spark, d):
    res = results(spark, d).withColumn("r2_test", F.lit(None).cast("double"))
    status = F.when(F.col("o_orderstatus") == "F", "random").when(F.col("o_orderstatus") == "O", "scaffold").otherwise("other")
    sizes = table(spark, d, "orders").groupBy(status.alias("split")).agg(
        F.count("*").alias("n_train"), F.lit(0).alias("n_val"), F.lit(0).alias("n_test")
    )
    log = N.run_log(res, sizes)
    has = lambda k: F.map_contains_key("params", k).cast("int")
    return rounded(log.select(
        "run_name", F.col("tags.task").alias("task"), F.col("tags.split_type").alias("split_type"), F.col("tags.seed").alias("seed"),
        (has("pooling") + has("gnn_hidden_dim")).alias("optional_params"), F.col("metrics.r2_val").alias("r2_val"),
        F.map_contains_key("metrics", "r2_test").alias("has_r2_test"), F.col("metrics.n_train").alias("n_train"),
    ))


CONFIG_FIELDS = ["lr", "seed", "split", "amount"]
CONFIG_SQL = """c as (select distinct o_orderpriority as model, o_orderstatus as split, (o_custkey % 100)::INTEGER as seed,
   case o_custkey % 4 when 0 then 0.0003 when 1 then 0.00001 when 2 then 0.5 else 12.0 end::DOUBLE as lr,
   case o_custkey % 3 when 0 then 1500000000.0 when 1 then 2.5e18 else -0.00025 end::DOUBLE as amount from orders),
 k as (select *, '{"amount": ' || case seed_amount when 0 then '1500000000.0' when 1 then '2.5e+18' else '-0.00025' end || ', "lr": ' ||
   case seed % 4 when 0 then '0.0003' when 1 then '1e-05' when 2 then '0.5' else '12.0' end || ', "seed": ' || seed || ', "split": "' || split || '"}' as j
  from (select *, case amount when 1500000000.0 then 0 when 2.5e18 then 1 else 2 end as seed_amount from c))"""


def configs(spark, d):
    key = F.col("o_custkey")
    return table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("model"), F.col("o_orderstatus").alias("split"), (key % 100).cast("int").alias("seed"),
        F.when(key % 4 == 0, 3e-4).when(key % 4 == 1, 1e-5).when(key % 4 == 2, 0.5).otherwise(12.0).alias("lr"),
        F.when(key % 3 == 0, 1.5e9).when(key % 3 == 1, 2.5e18).otherwise(-2.5e-4).alias("amount"),
    ).distinct()


@query("config_keys", f"with {CONFIG_SQL} select model, split, seed, lr, amount, 'default_' || substr(sha256(j), 1, 16) as cache_key from k")
def config_keys(spark, d):
    return N.with_config_key(configs(spark, d), CONFIG_FIELDS).select("model", "split", "seed", "lr", "amount", "cache_key")


@query("configs_to_run", f"with {CONFIG_SQL} select model, split, seed, lr, amount from k where split <> 'F'")
def configs_to_run(spark, d):
    keyed = staged(N.with_config_key(configs(spark, d), CONFIG_FIELDS), "configs")
    return N.configs_to_run(keyed, keyed.where("split = 'F'")).select("model", "split", "seed", "lr", "amount")


@query("config_scores", f"""with {RESULTS.format(where="true")}, cfg as (select * from (values ('scaffold', 192), ('random', 192), ('unseen', 64)) t(split, hidden)),
 sc as (select split, {r('max(r2_val)')} as r2_val from res group by 1)
 select split, hidden, r2_val from cfg left join sc using (split)""")
def config_scores(spark, d):
    cfg = [("scaffold", 192), ("random", 192), ("unseen", 64)]
    frame = spark.createDataFrame(cfg, "split string, hidden int")
    return rounded(J.config_with_scores(frame, results(spark, d).groupBy("split").agg(F.max("r2_val").alias("r2_val"))))


@query("mapped_labels", """select o_orderkey, coalesce(c.c_mktsegment, 'train') as label from orders
 left join (select * from customer where c_acctbal > 5000) c on o_custkey = c_custkey""")
def mapped_labels(spark, d):
    rich = table(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("label"))
    orders = table(spark, d, "orders")
    return J.mapped_label(orders, rich.join(J.key_weights(orders, "o_custkey"), "o_custkey"), "o_custkey", "label", "train", "_w").select("o_orderkey", "label")


def _seed_frames(spark, d):
    from functools import reduce

    orders = table(spark, d, "orders").withColumn("y", F.col("o_totalprice") / 10000)
    frames = [
        E.with_mean_baseline(L.random_split(orders, ["o_orderkey"], seed=s)).where("split = 'val'")
        .select(F.lit(s).alias("seed"), "y", "p") for s in (1, 2, 3)
    ]
    return reduce(lambda a, b: a.unionByName(b), frames)


def _seed_sql() -> str:
    parts = []
    for s in (1, 2, 3):
        parts.append(f"""s{s} as (with {RANDOM.format(seed=s)} select {s} as seed, o_totalprice / 10000 as y,
          (select avg(o_totalprice / 10000) from split where split = 'train') as p from split where split = 'val')""")
    return ", ".join(parts) + ", allseeds as (select * from s1 union all select * from s2 union all select * from s3)"


@query("seed_repetition", f"""with {_seed_sql()}, m as (select seed, avg((y - p) * (y - p)) as mse from allseeds group by 1)
 select count(*) as seeds, {r('avg(mse)')} as mse_mean, {r('stddev_pop(mse)')} as mse_std from m""")
def seed_repetition(spark, d):
    per = E.regression_scores(_seed_frames(spark, d), by=["seed"])
    return rounded(per.agg(F.count("*").alias("seeds"), F.avg("mse").alias("mse_mean"), F.stddev_pop("mse").alias("mse_std")))


@query("grid_search", f"""with {_seed_sql()}, g as (select unnest([0.5, 5.0, 50.0])::DOUBLE as delta),
 l as (select delta, seed, avg(case when abs(y - p) <= delta then 0.5 * (y - p) * (y - p) else delta * (abs(y - p) - 0.5 * delta) end) as loss
   from allseeds, g group by 1, 2)
 select delta, count(*) as seeds, {r('avg(loss)')} as loss_mean, {r('stddev_pop(loss)')} as loss_std from l group by 1""")
def grid_search(spark, d):
    grid = E.parameter_grid(spark, {"delta": [0.5, 5.0, 50.0]}, seeds=[1, 2, 3]).withColumn("seed", F.col("seed").cast("int"))
    rows = _seed_frames(spark, d).join(F.broadcast(grid), "seed")  # nine settings
    res, a = E.residual(), F.abs(E.residual())
    loss = F.when(a <= F.col("delta"), 0.5 * res * res).otherwise(F.col("delta") * (a - 0.5 * F.col("delta")))
    per = rows.groupBy("delta", "seed").agg(F.avg(loss).alias("loss"))
    return rounded(per.groupBy("delta").agg(F.count("*").alias("seeds"), F.avg("loss").alias("loss_mean"), F.stddev_pop("loss").alias("loss_std")))


# Least squares on two features has a closed form.
OLS = f"""{RANDOM.format(seed=42)},
 f as (select split, o_totalprice / 100000 as y, (o_custkey % 17)::DOUBLE as a, (o_orderkey % 13)::DOUBLE as b from split),
 c as (select avg(a) as ma, avg(b) as mb, avg(y) as my, var_pop(a) as aa, var_pop(b) as bb, covar_pop(a, b) as ab,
   covar_pop(a, y) as ay, covar_pop(b, y) as byy from f where split = 'train'),
 w as (select *, (ay * bb - byy * ab) / (aa * bb - ab * ab) as wa, (byy * aa - ay * ab) / (aa * bb - ab * ab) as wb from c),
 pr as (select split, y, my + wa * (a - ma) + wb * (b - mb) as p from f, w)"""


@query("linear_model", f"with {OLS} select split, {SCORES} from pr group by 1")
def linear_model(spark, d):
    rows = table(spark, d, "orders").select(
        "o_orderkey", (F.col("o_totalprice") / 100000).alias("t"),
        F.array((F.col("o_custkey") % 17).cast("double"), (F.col("o_orderkey") % 13).cast("double")).alias("x"),
    )
    return rounded(train_and_score(rows, ["o_orderkey"], "t", features="x", solver="normal")[1])


@query("linear_predictions", f"with {OLS} select split, count(*) as n, {r('sum(p)', 4)} as total from pr group by 1")
def linear_predictions(spark, d):
    rows = table(spark, d, "orders").select(
        "o_orderkey", (F.col("o_totalprice") / 100000).alias("t"),
        F.array((F.col("o_custkey") % 17).cast("double"), (F.col("o_orderkey") % 13).cast("double")).alias("x"),
    )
    scored = train_and_score(rows, ["o_orderkey"], "t", features="x", solver="normal")[0]
    return rounded(scored.groupBy("split").agg(F.count("*").alias("n"), F.sum("p").alias("total")), 4)


@query("fingerprint_model")
def fingerprint_model(spark, d):
    """Linear model on hashed text bits, grouped split by source."""
    docs = spread(table(spark, d, "documents")).withColumn("label", F.log1p("n_chars"))
    ready = fingerprint_table(docs, "text", "label").select("doc_id", "source", "label", "bits")
    return rounded(train_and_score(ready, ["doc_id"], "label", "scaffold", "source", maxIter=10, regParam=0.1)[1])


@query("graph_model")
def graph_model(spark, d):
    """Boosted trees on the mean of node vectors after one neighbourhood round."""
    from doseframe.operators import graph as G
    from registry.features import WIDTH, chain

    nodes, arcs = chain(spark, d)
    mols = G.readout(G.neighbour_aggregate(nodes, arcs, WIDTH), WIDTH, "mean")
    target = table(spark, d, "embeddings").groupBy(F.floor(F.col("vec_id") / 10).cast("bigint").alias("mol_id")).agg(F.avg("label").alias("label"))
    return rounded(train_and_score(mols.join(target, "mol_id"), ["mol_id"], "label", features="feats", model="trees", maxIter=5, maxDepth=3)[1])


@query("feature_importance")
def feature_importance(spark, d):
    cols = ["mw_freebase", "hba", "hbd", "psa", "rtb", "aromatic_rings"]
    rows = activity_table(spark, d).where("pIC50 is not null")
    return E.feature_importance(rows, cols, "pIC50", maxIter=5, maxDepth=3)


# The linear model of the train rows on the others, one feature at a time taken from the next row in hash order.
@query("permutation_importance", f"""with {RANDOM.format(seed=42)},
 f as (select o_orderkey, split, o_totalprice / 100000 as y, floor(o_totalprice / 50000)::DOUBLE as a, (o_custkey % 17)::DOUBLE as b from split),
 c as (select avg(a) as ma, avg(b) as mb, avg(y) as my, var_pop(a) as aa, var_pop(b) as bb, covar_pop(a, b) as ab,
   covar_pop(a, y) as ay, covar_pop(b, y) as byy from f where split = 'train'),
 w as (select *, (ay * bb - byy * ab) / (aa * bb - ab * ab) as wa, (byy * aa - ay * ab) / (aa * bb - ab * ab) as wb from c),
 turns as (select *, row_number() over (order by md5('42:' || o_orderkey)) as i, count(*) over () as total from f where split <> 'train'),
 errs as (select t.y - my - wa * (t.a - ma) - wb * (t.b - mb) as own, t.y - my - wa * (x.a - ma) - wb * (t.b - mb) as ea,
   t.y - my - wa * (t.a - ma) - wb * (x.b - mb) as eb from turns t join turns x on x.i = t.i % t.total + 1 cross join w),
 means as (select count(*) as n, avg(own * own) as mse, avg(ea * ea) as pa, avg(eb * eb) as pb from errs),
 lines as (select 'a' as feature, n, mse, pa as permuted from means union all select 'b', n, mse, pb from means)
 select feature, n, {r('mse')} as mse, {r('permuted')} as mse_permuted, {r('permuted - mse')} as lost from lines""")
def permutation_importance(spark, d):
    rows = table(spark, d, "orders").select(
        "o_orderkey", (F.col("o_totalprice") / 100000).alias("y"), F.floor(F.col("o_totalprice") / 50000).cast("double").alias("a"),
        (F.col("o_custkey") % 17).cast("double").alias("b"),
    )
    split = L.random_split(rows, ["o_orderkey"])
    model = E.fit_baseline(split.withColumn("x", array_to_vector(F.array("a", "b"))), "x", "y", solver="normal")
    wa, wb = map(float, model.coefficients)
    held_out = split.where("split <> 'train'")
    return rounded(E.permutation_importance(held_out, ["a", "b"], "y", lambda x: x["a"] * wa + x["b"] * wb + model.intercept, ["o_orderkey"]))


@query("cross_validation")
def cross_validation(spark, d):
    rows = L.with_fold(table(spark, d, "orders"), ["o_orderkey"], 3).select(
        "fold", (F.col("o_totalprice") / 100000).alias("t"),
        array_to_vector(F.array((F.col("o_custkey") % 17).cast("double"), (F.col("o_orderkey") % 13).cast("double"))).alias("features"),
    )
    return rounded(E.cross_validated(rows, "features", "t", "fold", 3, {"regParam": [0.0, 1.0]}))


# Two features: the slopes by Cramer's rule on the rows outside a fold, the scores on its rows.
FOLDS_SQL = f"""x as (select (('0x' || substr(md5('42:' || o_orderkey), 1, 7))::BIGINT % 5)::INTEGER as fold,
   (o_custkey % 17)::DOUBLE as a, (o_orderkey % 13)::DOUBLE as b, o_totalprice / 100000 as t from orders),
 f as (select fold, penalty from (select distinct fold from x), (select unnest([0.0::DOUBLE, 0.5::DOUBLE]) as penalty)),
 m as (select f.fold, penalty, avg(a) as ma, avg(b) as mb, avg(t) as mt, var_pop(a) + penalty as aa, var_pop(b) + penalty as bb,
   covar_pop(a, b) as ab, covar_pop(a, t) as ta, covar_pop(b, t) as tb from f join x on x.fold <> f.fold group by f.fold, penalty),
 s as (select *, (ta * bb - tb * ab) / (aa * bb - ab * ab) as ka, (tb * aa - ta * ab) / (aa * bb - ab * ab) as kb from m),
 e as (select s.fold, penalty, t, mt + ka * (a - ma) + kb * (b - mb) as p from s join x using (fold)),
 scores as (select fold, penalty, count(*) as n, 1 - sum((t - p) ** 2) / (var_pop(t) * count(*)) as r2, sqrt(avg((t - p) ** 2)) as rmse
   from e group by all)"""


def fold_scores(spark, d):
    rows = L.with_fold(table(spark, d, "orders"), ["o_orderkey"], 5).select(
        "fold", (F.col("o_custkey") % 17).alias("a"), (F.col("o_orderkey") % 13).alias("b"), (F.col("o_totalprice") / 100000).alias("t")
    )
    return E.fold_regressions(rows, ["a", "b"], "t", "fold", [0.0, 0.5])


@query("fold_regressions", f"with {FOLDS_SQL} select fold, penalty, n, {r('r2')} as r2, {r('rmse')} as rmse from scores")
def fold_regressions(spark, d):
    return rounded(fold_scores(spark, d))


@query("fold_summary", f"with {FOLDS_SQL} select penalty, count(*) as folds, {r('avg(r2)')} as r2_mean, {r('stddev_pop(r2)')} as r2_std from scores group by 1")
def fold_summary(spark, d):
    return rounded(E.fold_summary(fold_scores(spark, d)))


@query("feature_transforms", f"""with {ACT}, s as (select avg(mw_freebase) as m, stddev_pop(mw_freebase) as sd from act)
 select activity_id, {r('(mw_freebase - m) / sd')} as mw_freebase, {r('ln(1 + standard_value)')} as log_value,
  array_to_string([(standard_type = 'IC50')::INTEGER, (standard_type = 'Ki')::INTEGER], ',') as type_code from act, s""")
def feature_transforms(spark, d):
    from doseframe.functions.encode import one_hot

    scaled = T.standardized(activity_table(spark, d), ["mw_freebase"])
    return rounded(scaled.select(
        "activity_id", "mw_freebase", F.log1p("standard_value").alias("log_value"),
        F.array_join(one_hot(F.col("standard_type"), ["IC50", "Ki"]).cast("array<int>").cast("array<string>"), ",").alias("type_code"),
    ))
