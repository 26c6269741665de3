import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from doseframe import schemas as S
from doseframe.operators import evaluate as E, runs as N
from doseframe.plans.learn import fingerprint_table, train_and_score


def scores(spark, pairs):
    return E.regression_scores(spark.createDataFrame(pairs, "y double, p double")).first()


def test_r2(spark):
    s = scores(spark, [(1.0, 1.0), (2.0, 2.0), (3.0, 2.0)])
    assert (s.r2, s.mse, s.mae, s.n) == (0.5, pytest.approx(1 / 3), pytest.approx(1 / 3), 3)
    assert scores(spark, [(2.0, 2.0), (2.0, 2.0)]).r2 == 1.0
    assert scores(spark, [(2.0, 2.0), (2.0, 3.0)]).r2 == 0.0
    nan = scores(spark, [(1.0, float("nan")), (float("nan"), 1.0), (1.0, 2.0), (3.0, 4.0)])
    assert (nan.nan_targets, nan.nan_predictions, nan.n, nan.mse) == (1, 1, 2, 1.0)
    far = scores(spark, [(5000.0, 0.0), (0.0, 0.0)])
    assert far.log_cosh == pytest.approx((5000 - math.log(2)) / 2) and far.huber == pytest.approx((5000 - 0.5) / 2)


def test_batch_mean_loss(spark):
    df = spark.createDataFrame([(i, 0.0, float(i)) for i in range(7)], "id int, y double, p double")
    row = E.batch_mean_loss(df, ["id"], batch=7).first()
    assert (row.batches, row.loss) == (1, pytest.approx(np.mean(np.arange(7) ** 2)))
    assert E.batch_mean_loss(df, ["id"], batch=2).first().batches == 4


HISTORY = "run_id string, epoch int, train_loss double, val_loss double"


def stop(spark, losses, **options):
    rows = [("r", i, 2.0 * i, v) for i, v in enumerate(losses, start=1)]
    return E.early_stopping(spark.createDataFrame(rows, HISTORY), **options).first()


def test_early_stopping(spark):
    r = stop(spark, [0.9, 0.8, 0.79995, 0.81, 0.1], patience=2, min_delta=1e-4)
    assert (r.best_epoch, r.best_val_loss, r.epochs_trained) == (2, 0.8, 4)
    assert r.avg_train_loss == 5.0 and r.avg_val_loss == pytest.approx((0.9 + 0.8 + 0.79995 + 0.81) / 4)
    nan = stop(spark, [float("nan"), 0.5, float("nan")], patience=3)
    assert (nan.best_epoch, nan.best_val_loss, nan.epochs_trained) == (2, 0.5, 3)
    never = stop(spark, [float("nan")] * 5, patience=2)
    assert (never.best_epoch, never.epochs_trained) == (-1, 2) and never.best_val_loss == math.inf
    assert stop(spark, [1.0 / i for i in range(1, 50)], max_epochs=10).epochs_trained == 10


def test_early_stopping_long_runs_and_epoch_numbers(spark):
    long = stop(spark, [1.0 / i for i in range(1, 301)], min_delta=0.0)
    assert (long.best_epoch, long.epochs_trained) == (300, 300)
    rows = [("r", 10, 0.0, 0.9), ("r", 20, 0.0, 0.5), ("r", 30, 0.0, 0.4)]
    gaps = E.early_stopping(spark.createDataFrame(rows, HISTORY)).first()
    assert (gaps.best_epoch, gaps.epochs_trained) == (30, 3)


def test_reports_by_model_split_and_run(spark):
    rows = [("a", "random", 1, 0.1, 0.2), ("a", "random", 2, 0.5, 0.9), ("b", "random", 1, 0.3, 0.4), ("a", "scaffold", 1, 0.2, 0.7)]
    df = spark.createDataFrame(rows, "model string, split string, seed int, best_val_loss double, r2_val double")
    best = {r.model: (r.random_loss, r.random_r2) for r in E.comparison_report(df).collect()}
    assert best == {"a": (0.1, 0.2), "b": (0.3, 0.4)}
    table = {(r.model, r.split): (r.seeds, r.r2_val_mean) for r in E.tuning_table(df, ["model", "split"]).collect()}
    assert table == {("a", "random"): ("1,2", pytest.approx(0.55)), ("b", "random"): ("1", 0.4), ("a", "scaffold"): ("1", 0.7)}
    log = N.run_log(df.withColumn("patience", F.lit(12)).withColumn("evaluate_test", F.lit(False))).first()
    assert log.params["patience"] == "12" and log.params["evaluate_test"] == "false"


def test_auc(spark):
    df = spark.createDataFrame([(0.1, False), (0.4, False), (0.35, True), (0.8, True), (float("nan"), True), (0.5, None)], "s double, pos boolean")
    assert E.auc(df, "s", F.col("pos")).first().auc == pytest.approx(0.75)
    ties = spark.createDataFrame([(1.0, i % 2 == 0) for i in range(50)], "s double, pos boolean")
    assert E.auc(ties, "s", F.col("pos")).first().auc == pytest.approx(0.5)
    assert E.auc(ties.where("pos"), "s", F.col("pos")).first().auc is None


def test_grid_and_tuning(spark):
    space = {"lr": [1e-3, 1e-4], "weight_decay": [0.0], "pooling": ["mean", "add"], "gnn_hidden_dim": [64], "gnn_num_layers": [2, 3], "gnn_dropout": [0.1]}
    grid = E.parameter_grid(spark, space, seeds=[1, 2])
    assert grid.count() == 16 and grid.columns == [*space, "seed"]
    results = grid.withColumn("r2_val", F.when(F.col("seed") == 1, 0.4).otherwise(0.6) + F.col("lr")).withColumn("best_val_loss", F.col("gnn_num_layers") * 1.0)
    table = E.tuning_table(results).collect()
    assert len(table) == 8 and table[0].seeds == "1,2"
    assert (table[0].lr, table[0].gnn_num_layers) == (1e-3, 2)
    assert table[0].r2_val_mean == pytest.approx(0.501) and table[0].r2_val_std == pytest.approx(0.1)


def test_reports(spark):
    rows = [("MLP", "random", 0.7, 0.4), ("MLP", "scaffold", 0.4, 0.6), ("GNN", "random", None, None)]
    df = spark.createDataFrame(rows, "model string, split string, r2_val double, best_val_loss double")
    assert [r.r2_val for r in E.results_report(df).collect()] == [0.7, 0.4, None]
    wide = {r.model: r for r in E.comparison_report(df).collect()}
    assert wide["MLP"].scaffold_r2 == 0.4 and wide["GNN"].scaffold_loss is None


def test_run_log(spark, tmp_path):
    row = dict.fromkeys(S.RESULT_SCHEMA.names) | {"model": "MLP", "split": "random", "seed": 42, "lr": 3e-4, "r2_val": 0.7, "best_val_loss": 0.4, "from_cache": False}
    results = spark.createDataFrame([tuple(row[n] for n in S.RESULT_SCHEMA.names)], S.RESULT_SCHEMA)
    sizes = spark.createDataFrame([(80, 10, 10)], "n_train long, n_val long, n_test long")
    path = str(tmp_path / "runs")
    for _ in range(2):
        N.append_runs(N.run_log(results, sizes, extra_tags={"framework": "spark"}), path)
    logged = N.read_runs(spark, path).collect()
    assert len(logged) == 2
    r = logged[0]
    assert r.run_name == "MLP_random_seed42" and r.tags["framework"] == "spark" and r.tags["seed"] == "42"
    assert r.metrics == {"n_train": 80.0, "n_val": 10.0, "n_test": 10.0, "best_val_loss": 0.4, "r2_val": 0.7}
    assert "pooling" not in r.params and r.params["from_cache"] == "false"


def test_epoch_metrics_skip_missing(spark):
    df = spark.createDataFrame([("r", 1, 0.5, 0.6, None, 1e-3)], S.EPOCH_SCHEMA)
    assert {(r.metric, r.value) for r in N.epoch_metrics(df).collect()} == {("train_loss", 0.5), ("val_loss", 0.6), ("lr", 1e-3)}


def test_configs_to_run(spark):
    df = spark.createDataFrame([("a",), ("b",)], "cache_key string")
    done = df.where("cache_key = 'a'")
    assert [r.cache_key for r in N.configs_to_run(df, done).collect()] == ["b"]
    assert N.configs_to_run(df, done, force=True).count() == 2


def test_train_and_score(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 2))
    rows = [(i, f"g{i % 37}", [float(a), float(b)], float(3 * a - b + 1)) for i, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "id int, g string, x array<double>, y0 double")
    preds, table = train_and_score(df, ["id"], "y0", features="x", solver="normal")
    assert {r.split: round(r.r2, 6) for r in table.collect()} == {"train": 1.0, "val": 1.0, "test": 1.0}
    assert preds.count() == 400
    _, grouped = train_and_score(df, ["id"], "y0", "scaffold", "g", features="x", solver="normal")
    assert {r.split for r in grouped.collect()} == {"train", "val", "test"}
    with pytest.raises(ValueError):
        train_and_score(df, ["id"], "y0", features="x", model="forest")


def test_fingerprints_learn(spark):
    docs = spark.createDataFrame([(i, "good" if i % 2 else "bad thing", 8.0 if i % 2 else 4.0) for i in range(60)], "id int, canonical_smiles string, pIC50 double")
    _, table = train_and_score(fingerprint_table(docs), ["id"], "pIC50", maxIter=20)
    assert all(r.r2 > 0.99 for r in table.collect() if r.n > 1 and r.mse > 0)


def test_importance_of_the_only_useful_feature(spark):
    rng = np.random.default_rng(3)
    rows = [(float(a), float(b), 1.0 if a > 0 else -1.0) for a, b in rng.normal(size=(300, 2))] + [(0.5, 0.5, None), (0.5, 0.5, float("nan"))]
    df = spark.createDataFrame(rows, "a double, b double, y double")
    top = E.feature_importance(df, ["b", "a"], "y", maxIter=2, maxDepth=2).collect()
    assert top[0].feature == "a" and top[0].importance > 0.95


def test_permutation_importance(spark):
    """Against the same re-pairing by hand: hash order, each row with the value of the next one."""
    import hashlib

    rng = np.random.default_rng(6)
    x = rng.normal(size=(200, 2))
    y = 3 * x[:, 0] + 0.1 * rng.normal(size=200)
    rows = [(i, float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows + [(900, None, 1.0, 1.0), (901, 1.0, 1.0, float("nan"))], "id int, a double, b double, y double")
    got = {r.feature: r for r in E.permutation_importance(df, ["a", "b"], "y", lambda v: v["a"] * 3.0 + v["b"] * 0.5, ["id"]).collect()}
    order = sorted(range(200), key=lambda i: hashlib.md5(f"42:{i}".encode()).hexdigest())
    donor = {i: order[(at + 1) % 200] for at, i in enumerate(order)}
    base = np.mean([(y[i] - 3 * x[i, 0] - 0.5 * x[i, 1]) ** 2 for i in range(200)])
    a = np.mean([(y[i] - 3 * x[donor[i], 0] - 0.5 * x[i, 1]) ** 2 for i in range(200)])
    b = np.mean([(y[i] - 3 * x[i, 0] - 0.5 * x[donor[i], 1]) ** 2 for i in range(200)])
    assert got["a"].n == 200 and got["a"].mse == pytest.approx(base)
    assert (got["a"].mse_permuted, got["b"].mse_permuted) == (pytest.approx(a), pytest.approx(b))
    assert got["a"].lost > 5 > abs(got["b"].lost)
    none = E.permutation_importance(df.limit(0), ["a"], "y", lambda v: v["a"], ["id"]).first()
    assert (none.n, none.mse) == (0, None)


def test_stored_upsert_is_safe_to_repeat(spark, tmp_path):
    path = str(tmp_path / "results")
    frame = lambda rows: spark.createDataFrame(rows, "model string, lr double, r2 double")
    first = frame([("m", 0.1, 0.5), ("m", None, 0.4), ("n", 0.1, 0.3), (None, None, 0.2)])
    second = frame([("m", None, 0.9), ("k", 0.2, 0.8)])
    assert N.upsert_stored(first, path, ["model", "lr"]).count() == 4
    for _ in range(2):
        got = N.upsert_stored(second, path, ["model", "lr"])
        assert sorted((r.model or "", r.lr or 0, r.r2) for r in got.collect()) == [("", 0, 0.2), ("k", 0.2, 0.8), ("m", 0, 0.9), ("m", 0.1, 0.5), ("n", 0.1, 0.3)]
    assert N.upsert_stored(second.limit(0), path, ["model", "lr"]).count() == 5


def test_cross_validation_of_an_exact_line(spark):
    from pyspark.ml.functions import array_to_vector

    df = spark.range(120).select(
        (F.col("id") % 3).cast("int").alias("fold"), (F.col("id") * 2.0 + 1).alias("y"), array_to_vector(F.array(F.col("id") * 1.0)).alias("x")
    )
    got = {r.parameters: r for r in E.cross_validated(df, "x", "y", "fold", 3, {"regParam": [0.0, 50.0]}).collect()}
    assert got["regParam=0.0"].r2_mean == pytest.approx(1.0) and got["regParam=0.0"].r2_std == pytest.approx(0.0, abs=1e-6)
    assert got["regParam=50.0"].r2_mean < 0.95


def test_trees_learn_a_step(spark):
    rows = [(i, [float(i % 40)], 5.0 if i % 40 >= 20 else 1.0) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, x array<double>, y0 double")
    _, table = train_and_score(df, ["id"], "y0", features="x", model="trees", maxIter=3, maxDepth=2)
    assert all(r.r2 > 0.99 for r in table.collect())


def test_fold_regressions_are_fits_on_the_other_folds(spark):
    """Against numpy least squares and ridge; collinear features, nulls, a large offset, a constant label, one fold."""
    rng = np.random.default_rng(6)
    n = 400
    x = rng.normal(size=(n, 2)) + [1e6, -3]
    y = 2 * x[:, 0] - x[:, 1] + rng.normal(size=n)
    fold = rng.integers(0, 4, n)
    rows = [(int(f), float(a), float(b), 2 * float(b), float(t)) for f, (a, b), t in zip(fold, x, y)]
    df = spark.createDataFrame(rows + [(1, None, 1.0, 2.0, 3.0), (None, 1.0, 1.0, 2.0, 3.0)], "f int, a double, b double, c double, y double")
    got = {(r.f, r.penalty): r for r in E.fold_regressions(df, ["a", "b", "c"], "y", "f", [0.0, 0.3]).collect()}
    full = np.column_stack([x, 2 * x[:, 1]])
    for f in range(4):
        train, test = fold != f, fold == f
        for penalty in (0.0, 0.3):
            mean, centre = full[train].mean(axis=0), y[train].mean()
            z = full[train] - mean
            slopes = np.linalg.pinv(z.T @ z + penalty * len(z) * np.eye(3), rcond=1e-10) @ z.T @ (y[train] - centre)
            missed = ((y[test] - centre - (full[test] - mean) @ slopes) ** 2).sum()
            row = got[f, penalty]
            assert row.n == test.sum() and row.r2 == pytest.approx(1 - missed / (y[test].var() * test.sum()), abs=1e-6)
            assert row.rmse == pytest.approx(math.sqrt(missed / test.sum()), rel=1e-6)
    flat = spark.createDataFrame([(k % 2, float(k), 5.0) for k in range(10)], "f int, a double, y double")
    assert [r.r2 for r in E.fold_regressions(flat, ["a"], "y", "f").collect()] == [None, None]
    assert E.fold_regressions(flat.where("f = 0"), ["a"], "y", "f").count() == 0
    assert E.fold_regressions(flat.limit(0), ["a"], "y", "f").count() == 0
