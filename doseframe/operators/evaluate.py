"""Scores of predictions, early stopping, tuning tables and baseline models."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
from pyspark.ml import Model
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from doseframe import schemas as S
from doseframe.functions.potency import present
from doseframe.operators.ordering import average_rank, hash_rank, value_cuts, value_ranks


def residual(y: str = "y", p: str = "p") -> Column:
    return F.col(y) - F.col(p)


def log_cosh(r: Column) -> Column:
    """log(cosh(r)) without overflow."""
    a = F.abs(r)
    return a + F.log1p(F.exp(-2.0 * a)) - F.lit(0.6931471805599453)


def huber(r: Column, delta: float = 1.0) -> Column:
    a = F.abs(r)
    return F.when(a <= delta, 0.5 * r * r).otherwise(delta * (a - 0.5 * delta))


def r2_from(y: Column, p: Column) -> Column:
    """1 - SS_res / SS_tot; a constant target scores 1 when met exactly, else 0."""
    total = F.var_pop(y) * F.count(y)
    missed = F.sum((y - p) * (y - p))
    return F.when(total > 0, 1.0 - F.try_divide(missed, total)).when(missed == 0, 1.0).when(missed > 0, 0.0)


def regression_scores(df: DataFrame, y: str = "y", p: str = "p", by: Sequence[str] = (), delta: float = 1.0) -> DataFrame:
    """r2, mse, rmse, mae, huber, log_cosh, n and the NaN counts, in one pass; scores skip NaN rows."""
    ok = present(y) & present(p)
    yy, pp = F.when(ok, F.col(y)), F.when(ok, F.col(p))
    r = yy - pp
    return df.groupBy(*by).agg(
        F.count_if(ok).alias("n"),
        F.count_if(F.isnan(y)).alias("nan_targets"), F.count_if(F.isnan(p)).alias("nan_predictions"),
        r2_from(yy, pp).alias("r2"), F.avg(r * r).alias("mse"), F.sqrt(F.avg(r * r)).alias("rmse"),
        F.avg(F.abs(r)).alias("mae"), F.avg(huber(r, delta)).alias("huber"), F.avg(log_cosh(r)).alias("log_cosh"),
    )


def batch_mean_loss(df: DataFrame, keys: Sequence[str], y: str = "y", p: str = "p", batch: int = S.BATCH_SIZE, seed: int = S.SPLIT_SEED) -> DataFrame:
    """Mean of per-batch means over batches in seeded hash order; a short last batch weighs the same."""
    ranked = hash_rank(df, keys, seed, "_rank").withColumn("_batch", F.floor((F.col("_rank") - 1) / batch))
    r = residual(y, p)
    return ranked.groupBy("_batch").agg(F.avg(r * r).alias("_loss")).agg(
        F.count("*").alias("batches"), F.avg("_loss").alias("loss")
    )


def with_mean_baseline(df: DataFrame, y: str = "y", split: str = "split", out: str = "p") -> DataFrame:
    """Adds the mean of the train rows as the prediction for every row."""
    mean = df.where(F.col(split) == "train").agg(F.avg(y).alias("m")).scalar()
    return df.withColumn(out, mean)


def auc(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """Area under the ROC curve by average ranks; null when only one class is present."""
    flagged = df.select(score, positive.alias("_pos")).where(F.col("_pos").isNotNull())
    cuts = value_cuts(flagged, [score])[score]
    ranks = value_ranks(flagged, score, cuts, {"_p": F.count_if("_pos")})
    pos, n = F.sum("_p").cast("double"), F.sum("n").cast("double")
    return ranks.agg(
        F.sum("_p").alias("positives"), (F.sum("n") - F.sum("_p")).alias("negatives"),
        F.try_divide(F.sum(F.col("_p") * average_rank()) - pos * (pos + 1) / 2, pos * (n - pos)).alias("auc"),
    )


def early_stopping(
    history: DataFrame, run: str = "run_id", epoch: str = "epoch", loss: str = "val_loss", train_loss: str = "train_loss",
    max_epochs: int | None = None, patience: int = S.PATIENCE, min_delta: float = S.MIN_DELTA,
) -> DataFrame:
    """Per run: best_epoch, best_val_loss, epochs_trained and the mean losses up to the stop.

    An epoch improves when its loss is below the best by more than min_delta; training stops after
    `patience` epochs without. best_epoch is the epoch's own number, -1 where none improves. All epochs
    count unless `max_epochs` is given; a run's list is as long as its training.
    """
    inside = history if max_epochs is None else history.where(F.col(epoch) <= max_epochs)
    # One entry per epoch even if the log holds copies of a row: the copy with the smallest loss.
    steps = inside.groupBy(run, epoch).agg(F.min_by(F.struct(train_loss, loss), F.struct(loss, train_loss)).alias("_row"))
    listed = steps.groupBy(run).agg(F.array_sort(F.collect_list(F.struct(
        F.col(epoch).cast("int").alias("e"), F.col(f"_row.{loss}").cast("double").alias("v"),
        F.col(f"_row.{train_loss}").cast("double").alias("t"),
    ))).alias("_steps"))
    start = F.struct(
        F.lit(float("inf")).alias("best"), F.lit(-1).alias("best_epoch"), F.lit(0).alias("idle"),
        F.lit(0).alias("seen"), F.lit(0.0).alias("sv"), F.lit(0.0).alias("st"),
    )

    def step(acc: Column, x: Column) -> Column:
        # Spark orders NaN above every number, so a NaN loss is no improvement, as in IEEE.
        better = F.coalesce(x["v"] < acc["best"] - min_delta, F.lit(False))
        moved = F.struct(
            F.when(better, x["v"]).otherwise(acc["best"]).alias("best"),
            F.when(better, x["e"]).otherwise(acc["best_epoch"]).alias("best_epoch"),
            F.when(better, 0).otherwise(acc["idle"] + 1).alias("idle"),
            (acc["seen"] + 1).alias("seen"), (acc["sv"] + x["v"]).alias("sv"), (acc["st"] + x["t"]).alias("st"),
        )
        return F.when(acc["idle"] >= patience, acc).otherwise(moved)

    folded = listed.select(run, F.aggregate("_steps", start, step).alias("f"))
    return folded.select(
        run, F.col("f.best_epoch").alias("best_epoch"), F.col("f.best").alias("best_val_loss"),
        F.col("f.seen").alias("epochs_trained"),
        (F.col("f.st") / F.col("f.seen")).alias("avg_train_loss"), (F.col("f.sv") / F.col("f.seen")).alias("avg_val_loss"),
    )


def parameter_grid(spark: SparkSession, space: dict[str, Sequence], seeds: Sequence[int] = ()) -> DataFrame:
    """One row per combination of the axes (and seed). Axes are short settings lists."""
    axes = {**space, **({"seed": list(seeds)} if seeds else {})}
    return spark.createDataFrame(list(itertools.product(*axes.values())), list(axes))


def tuning_table(results: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Mean and population std of r2_val and best_val_loss over the seeds of a model, split and configuration, best first."""
    keys = keys or [*(c for c in ("model", "split") if c in results.columns), *S.GRID_KEY]
    metrics = [("r2_val", F.avg, "mean"), ("r2_val", F.stddev_pop, "std"), ("best_val_loss", F.avg, "mean"), ("best_val_loss", F.stddev_pop, "std")]
    return (
        results.groupBy(*keys)
        .agg(
            # One entry per seed of the search, a short settings list.
            F.concat_ws(",", F.transform(F.array_sort(F.collect_set("seed")), lambda s: s.cast("string"))).alias("seeds"),
            *[f(c).alias(f"{c}_{s}") for c, f, s in metrics],
        )
        .orderBy(F.desc("r2_val_mean"), F.asc("best_val_loss_mean"), *keys)
    )


def results_report(results: DataFrame) -> DataFrame:
    """The report columns the table has, best validation R2 first, missing scores last."""
    return results.select(*[c for c in S.REPORT_COLUMNS if c in results.columns]).orderBy(F.desc_nulls_last("r2_val"))


def comparison_report(results: DataFrame, splits: Sequence[str] = ("random", "scaffold")) -> DataFrame:
    """One row per model: loss and R2, on each split, of the run with the least loss (of equal ones the best R2)."""
    return results.groupBy("model").pivot("split", list(splits)).agg(
        F.min("best_val_loss").alias("loss"), F.min_by("r2_val", F.struct("best_val_loss", -F.col("r2_val"))).alias("r2")
    )


def fit_baseline(df: DataFrame, features: str, label: str, model: str = "linear", split: str = "split", **params) -> Model:
    """A Spark ML regressor fitted on the train rows; 'linear' or 'trees'."""
    kinds = {"linear": LinearRegression, "trees": GBTRegressor}
    if model not in kinds:
        raise ValueError("model must be 'linear' or 'trees'")
    estimator = kinds[model](featuresCol=features, labelCol=label, predictionCol="p", **params)
    return estimator.fit(df.where(F.col(split) == "train").select(features, label))


def predictions(model: Model, df: DataFrame, keys: Sequence[str], label: str, split: str = "split") -> DataFrame:
    """(keys, split, y, p) of every row."""
    return model.transform(df).select(*keys, split, F.col(label).cast("double").alias("y"), "p")


def feature_importance(df: DataFrame, cols: Sequence[str], label: str, **params) -> DataFrame:
    """(feature, importance) from boosted trees, largest first."""
    ready = VectorAssembler(inputCols=list(cols), outputCol="features", handleInvalid="skip").transform(
        df.select(*cols, label).where(present(label))
    )
    model = GBTRegressor(featuresCol="features", labelCol=label, **params).fit(ready)
    rows = [(c, float(v)) for c, v in zip(cols, model.featureImportances.toArray())]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def permutation_importance(
    df: DataFrame, features: Sequence[str], label: str, predict: Callable[[dict[str, Column]], Column], keys: Sequence[str], seed: int = S.SPLIT_SEED
) -> DataFrame:
    """(feature, n, mse, mse_permuted, lost): what the squared error gains when the values of a feature are re-paired.

    `predict` gives a model's prediction from the feature columns. Rows are ranked once in seeded hash order, and a
    row takes the feature's value from the next row, the last one from the first; all features share that one join.
    The keys identify a row. Rows without a feature or the label take no part; without any row the errors are null.
    """
    names = {f: f"_f{i}" for i, f in enumerate(features)}
    vals = df.select(*keys, F.col(label).cast("double").alias("_y"), *[F.col(f).cast("double").alias(c) for f, c in names.items()])
    vals = vals.where(reduce(lambda a, b: a & b, [present(c) for c in ("_y", *names.values())]))
    ranked = hash_rank(vals, keys, seed, "_rank").select("_rank", "_y", *names.values())
    last = ranked.agg(F.max("_rank")).scalar()
    before = F.when(F.col("_rank") == 1, last).otherwise(F.col("_rank") - 1)
    given = ranked.select(before.alias("_rank"), *[F.col(c).alias(f"_new{c}") for c in names.values()])
    own = {f: F.col(c) for f, c in names.items()}

    def error(values: dict[str, Column]) -> Column:
        return F.avg(F.pow(F.col("_y") - predict(values), 2))

    row = ranked.join(given, "_rank").agg(
        F.count("*").alias("n"), error(own).alias("mse"), *[error(own | {f: F.col(f"_new{c}")}).alias(c) for f, c in names.items()]
    )
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(f).alias("feature"), "n", "mse", F.col(c).alias("mse_permuted"), (F.col(c) - F.col("mse")).alias("lost")) for f, c in names.items()
    ])))


def cross_validated(df: DataFrame, features: str, label: str, fold: str, k: int, space: dict[str, Sequence], metric: str = "r2") -> DataFrame:
    """(parameters, mean, std of the metric over the folds) of a linear model."""
    model = LinearRegression(featuresCol=features, labelCol=label)
    grid = ParamGridBuilder()
    for name, values in space.items():
        grid = grid.addGrid(model.getParam(name), list(values))
    maps = grid.build()
    fitted = CrossValidator(
        estimator=model, estimatorParamMaps=maps, evaluator=RegressionEvaluator(labelCol=label, metricName=metric),
        numFolds=k, foldCol=fold,
    ).fit(df)
    rows = [
        (",".join(f"{p.name}={v}" for p, v in sorted(m.items(), key=lambda e: e[0].name)), float(a), float(s))
        for m, a, s in zip(maps, fitted.avgMetrics, fitted.stdMetrics)
    ]
    return df.sparkSession.createDataFrame(rows, f"parameters string, {metric}_mean double, {metric}_std double")


def _fold_sums(df: DataFrame, cols: Sequence[str], fold: str) -> dict:
    """Per fold the sums of products of (1, columns), columns shifted by their means; one row a fold reaches the driver."""
    vals = df.select(fold, *[F.col(c).cast("double").alias(c) for c in cols]).where(F.col(fold).isNotNull()).na.drop(subset=list(cols))
    means = vals.agg(*[F.avg(c).alias(c) for c in cols]).first()
    shifted = [F.lit(1.0), *[F.col(c) - F.lit(means[c]) for c in cols]] if means[0] is not None else [F.lit(1.0)] * (len(cols) + 1)
    k = len(shifted)
    cells = [(i, j) for i in range(k) for j in range(i, k)]
    out = {}
    for row in vals.groupBy(fold).agg(*[F.sum(shifted[i] * shifted[j]).alias(f"s{i}_{j}") for i, j in cells]).collect():
        sums = np.zeros((k, k))
        for i, j in cells:
            sums[i, j] = sums[j, i] = row[f"s{i}_{j}"]
        out[row[fold]] = sums
    return out


def fold_regressions(df: DataFrame, features: Sequence[str], label: str, fold: str, penalties: Sequence[float] = (0.0,)) -> DataFrame:
    """(fold, penalty, n, r2, rmse) of linear models fitted on all other folds, for every fold and penalty at once.

    The sums of a fold's training rows are the total minus its own, and its squared errors follow from its own sums:
    the table is read for the means and once more for all fits and scores. A penalty times the number of training rows
    is added to the squares of the centred features. Rows with a null take no part; a fold with no other rows, or none
    of its own, has no model; r2 is null for a fold whose label does not vary.
    """
    sums = _fold_sums(df, [*features, label], fold)
    total = sum(sums.values()) if sums else None
    rows = []
    for name, own in sums.items():
        rest = total - own
        if rest[0, 0] <= 0:
            continue
        middle = rest[0] / rest[0, 0]
        spread = rest - rest[0, 0] * np.outer(middle, middle)
        squares, with_label = spread[1:-1, 1:-1], spread[1:-1, -1]
        n, label_mean = own[0, 0], own[0, -1] / own[0, 0]
        around = own[-1, -1] - n * label_mean ** 2
        for penalty in penalties:
            slopes = np.linalg.pinv(squares + penalty * rest[0, 0] * np.eye(len(squares)), rcond=1e-12, hermitian=True) @ with_label
            # The residual is a linear form of (1, features, label): its square sum is a quadratic form of the sums.
            form = np.concatenate([[slopes @ middle[1:-1] - middle[-1]], -slopes, [1.0]])
            missed = max(float(form @ own @ form), 0.0)
            r2 = 1 - missed / float(around) if around > 1e-12 * n else None
            rows.append((name, float(penalty), int(n), r2, math.sqrt(missed / n)))
    kind = df.schema[fold].dataType.simpleString()
    return df.sparkSession.createDataFrame(rows, f"`{fold}` {kind}, penalty double, n bigint, r2 double, rmse double")


def fold_summary(scores: DataFrame) -> DataFrame:
    """(penalty, folds, r2_mean, r2_std): mean and population deviation over the folds."""
    return scores.groupBy("penalty").agg(
        F.count("*").alias("folds"), F.avg("r2").alias("r2_mean"), F.stddev_pop("r2").alias("r2_std")
    )
