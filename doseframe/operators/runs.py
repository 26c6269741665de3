"""Run log, epoch metrics and reuse of finished configurations, as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from doseframe import schemas as S
from doseframe.functions.encode import config_key
from doseframe.operators.joins import upsert
from doseframe.session import staged

# Partitions of a stored result table; the key of a row decides its partition.
RUN_BUCKETS, BUCKET = 32, "_bucket"
KINDS = {"string": "text", "double": "float", "float": "float", "boolean": "bool"}


def _map(fields: dict[str, Column], kind: str) -> Column:
    """Map of the fields that are not null."""
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.cast(kind).alias("value")) for k, v in fields.items()])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def run_log(results: DataFrame, sizes: DataFrame | None = None, project: str = "bioactivity", extra_tags: dict[str, str] | None = None) -> DataFrame:
    """runs(run_name, tags, params, metrics) from result rows; a missing r2_test is left out.

    `sizes` has one row with n_train, n_val, n_test, or one per split with a `split` column.
    """
    tags = {
        "project": F.lit(project), "task": F.lit("bioactivity_regression"), "target": F.lit("pIC50"),
        "model_type": F.col("model"), "split_type": F.col("split"), "seed": F.col("seed"),
        **{k: F.lit(v) for k, v in (extra_tags or {}).items()},
    }
    metrics = ["avg_train_loss", "avg_val_loss", "best_val_loss", "r2_val", "r2_test"]
    if sizes is not None:
        metrics = ["n_train", "n_val", "n_test", *metrics]
        if "split" in sizes.columns:
            results = results.join(sizes, "split", "left")
        else:
            row = sizes.agg(F.struct(*[F.first(c).alias(c) for c in ("n_train", "n_val", "n_test")]).alias("s")).scalar()
            results = results.withColumns({c: row.getField(c) for c in ("n_train", "n_val", "n_test")})
    known = results.columns
    # Every other column of a result row is a parameter of its run.
    params = [c for c in known if c not in metrics and c not in ("model", "split")]
    return results.select(
        F.concat_ws("_", "model", "split", F.concat(F.lit("seed"), F.col("seed"))).alias("run_name"),
        _map(tags, "string").alias("tags"),
        _map({"model_type": F.col("model"), "split_type": F.col("split"), **{c: F.col(c) for c in params}}, "string").alias("params"),
        _map({c: F.col(c) for c in metrics if c in known}, "double").alias("metrics"),
    )


def append_runs(runs: DataFrame, path: str) -> None:
    runs.write.mode("append").option("compression", "zstd").parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.RUN_SCHEMA).parquet(path)


def upsert_stored(new: DataFrame, path: str, key: Sequence[str]) -> DataFrame:
    """Replaces the rows of the result table at `path` that have a key of `new` (missing equals missing), appends
    the others, and returns the whole table, which starts empty.

    The table is partitioned by a hash of the key. Only partitions that `new` touches are read and written
    again; the result is staged before any is replaced, so a job that failed can be repeated with the same outcome.
    """
    spark = new.sparkSession
    bucket = F.pmod(F.xxhash64(*key), F.lit(RUN_BUCKETS)).cast("int")
    fresh = staged(new.withColumn(BUCKET, bucket), "new-results")
    spark.createDataFrame([], fresh.schema).write.mode("append").partitionBy(BUCKET).parquet(path)
    stored = spark.read.schema(fresh.schema).parquet(path)
    touched = [r[0] for r in fresh.select(BUCKET).distinct().collect()]  # RUN_BUCKETS at most
    if touched:
        whole = staged(upsert(stored.where(F.col(BUCKET).isin(touched)), fresh, key), "results")
        out = whole.repartition(len(touched), BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        out.option("compression", "zstd").partitionBy(BUCKET).parquet(path)
    return spark.read.schema(fresh.schema).parquet(path).drop(BUCKET)


def epoch_metrics(history: DataFrame, ids: Sequence[str] = ("run_id", "epoch"), metrics: Sequence[str] = S.EPOCH_METRICS) -> DataFrame:
    """(ids, metric, value): the epoch log in long form, without missing values."""
    have = [m for m in metrics if m in history.columns]
    return history.unpivot(list(ids), have, "metric", "value").where(F.col("value").isNotNull())


def with_config_key(configs: DataFrame, fields: Sequence[str] = S.CONFIG_FIELDS, namespace: str = "default") -> DataFrame:
    """Adds `cache_key`, namespace and hash of the configuration fields."""
    typed = {f: (F.col(f), KINDS.get(configs.schema[f].dataType.simpleString(), "int")) for f in fields}
    return configs.withColumn("cache_key", F.concat(F.lit(f"{namespace}_"), config_key(typed)))


def configs_to_run(configs: DataFrame, finished: DataFrame, force: bool = False) -> DataFrame:
    """Configurations whose key has no finished run; all of them when forced."""
    return configs if force else configs.join(finished.select("cache_key").distinct(), "cache_key", "left_anti")
