"""Joins to a side with one row per key, safe against keys that hold most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

# A key is hot when it holds at least 1/HOT_SHARE of the rows, so there are at most HOT_SHARE.
HOT_SHARE = 1000


def hot_keys(weights: DataFrame, on: str, weight: str, total: int | None = None) -> DataFrame:
    """(key, _salts) of the hot keys, at most HOT_SHARE rows: so many parts that none has more than 1/HOT_SHARE of the rows.

    `weights` has one row per key, `weight` is the number of rows that hold it; a key without rows is never hot.
    """
    whole = weights.agg(F.sum(weight)).first()[0] if total is None else total
    hot = weights.where((F.col(weight) > 0) & (F.col(weight) * HOT_SHARE >= F.lit(whole or 0)))
    salted = hot.select(on, F.ceil(F.col(weight) * HOT_SHARE / F.lit(float(whole or 1))).cast("int").alias("_salts"))
    # The bound holds by the sum of the weights; the rows become a local table that any plan can broadcast.
    return weights.sparkSession.createDataFrame(salted.collect(), salted.schema)


def _hashable(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]


def _known(how: str) -> None:
    if how not in ("inner", "left", "left_semi"):
        raise ValueError("how must be 'inner', 'left' or 'left_semi'")


def salted_join(left: DataFrame, right: DataFrame, on: str, how: str, hot: DataFrame) -> DataFrame:
    """Join `left` to `right` (one row per key); hot keys are marked by one broadcast and salted in the same pass.

    Both sides are read once. Rows of a hot key go to one of its parts, by their content and the task that reads them,
    and meet a copy of the key's row there; there are at most 2 * HOT_SHARE copies. Rows without a key match nothing
    and are spread as well. `how` is 'inner', 'left' or 'left_semi'.
    """
    _known(how)
    spread = F.xxhash64(*_hashable(left), F.spark_partition_id())
    if how != "left":
        left = left.where(F.col(on).isNotNull())
    salts = F.coalesce("_salts", F.when(F.col(on).isNull(), F.lit(HOT_SHARE)), F.lit(1))
    marked = left.withColumn("_spread", spread).join(F.broadcast(hot), on, "left").withColumn("_salt", F.pmod("_spread", salts).cast("int"))
    copies = right.join(F.broadcast(hot), on, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))
    ).drop("_salts")
    return marked.drop("_spread", "_salts").join(copies, [on, "_salt"], how).drop("_salt")


def hot_split_join(
    left: DataFrame, right: DataFrame, on: str, how: str, weight: str, total: int | None = None
) -> DataFrame:
    """`salted_join` where `weight`, a column of `right`, tells how many rows of `left` have the key.

    `total` saves a pass where the sum of the weights is known.
    """
    _known(how)
    return salted_join(left, right.drop(weight), on, how, hot_keys(right.select(on, weight), on, weight, total))


def key_weights(df: DataFrame, on: str, weight: str = "_w") -> DataFrame:
    """Rows per key, combined before the shuffle."""
    return df.where(F.col(on).isNotNull()).groupBy(on).agg(F.count("*").alias(weight))


def lookup(left: DataFrame, features: DataFrame, on: str) -> DataFrame:
    """Attach stored features; rows without any are dropped, columns of `left` win."""
    keep = [c for c in features.columns if c == on or c not in left.columns]
    return salted_join(left, features.select(*keep), on, "inner", hot_keys(key_weights(left, on), on, "_w"))


def mapped_label(
    left: DataFrame, mapping: DataFrame, on: str, label: str, default: str, weight: str, total: int | None = None
) -> DataFrame:
    """Label of each row's key, `default` where the key is not in the mapping."""
    joined = hot_split_join(left, mapping.select(on, label, weight), on, "left", weight, total)
    return joined.withColumn(label, F.coalesce(F.col(label), F.lit(default)))


def config_with_scores(configs: DataFrame, scores: DataFrame, on: Sequence[str] = ("split",)) -> DataFrame:
    """Configurations with their scores; a configuration without a score stays."""
    return configs.join(scores, list(on), "left")


def missing_keys(keys: DataFrame, stored: DataFrame, on: Sequence[str]) -> DataFrame:
    """Distinct input keys that the feature store does not hold yet."""
    return keys.select(*on).distinct().join(stored.select(*on), list(on), "left_anti")


def upsert(existing: DataFrame, new: DataFrame, key: Sequence[str], replace_existing: bool = True) -> DataFrame:
    """Replace rows with the same key (missing equals missing), then append."""
    if not replace_existing:
        return existing.unionByName(new)
    fresh = new.select(*[F.col(k).alias(f"_new_{k}") for k in key]).distinct()
    same = None
    for k in key:
        match = F.col(k).eqNullSafe(F.col(f"_new_{k}"))
        same = match if same is None else same & match
    return existing.join(fresh, same, "left_anti").unionByName(new)
