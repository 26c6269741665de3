"""Filters, imputation, deduplication and audits of the activity table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from doseframe import schemas as S
from doseframe.functions import potency as P
from doseframe.operators.joins import hot_split_join
from doseframe.operators.ordering import exact_quantiles


def keep_present_columns(df: DataFrame, wanted: Sequence[str], without: Sequence[str] = ()) -> DataFrame:
    """The wanted columns the table has, in the wanted order, less `without`."""
    return df.select(*[c for c in wanted if c in df.columns and c not in without])


def with_potency(df: DataFrame) -> DataFrame:
    """Impute units, then compute the label: imputed rows become computable."""
    return df.withColumn("standard_units", P.imputed_units()).withColumn("pIC50", P.pic50())


def first_per_key(df: DataFrame, key: str | Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row per key, the first in `order`; repeatable, and combined before the shuffle.

    A null key is a key of its own.
    """
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys]
    kept = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(kept).select(*keys, "_row.*").select(*df.columns)


def first_per_text(df: DataFrame, text: str, order: Sequence[str | Column], keep: Sequence[str]) -> DataFrame:
    """`first_per_key` for long texts: grouped by sha-256 and length, so a text is only shuffled
    when it is among the columns to keep."""
    kept = F.min_by(F.struct(*keep), F.struct(*order)).alias("_row")
    return df.groupBy(F.sha2(text, 256).alias("_h"), F.length(text).alias("_n")).agg(kept).select("_row.*")


def clean_activity(df: DataFrame, order: Sequence[str] = ("activity_id",)) -> DataFrame:
    """Drop rows without a finite label (NaN stays), one row per structure."""
    return first_per_key(df.where(P.finite_or_nan("pIC50")), "canonical_smiles", order)


def label_valid(df: DataFrame, feature: str, label: str = "pIC50") -> DataFrame:
    """Rows that can be learned from: a feature, and a label that is no null or NaN."""
    return df.where(F.col(feature).isNotNull() & P.present(label))


def label_valid_counts(df: DataFrame, feature: str, label: str = "pIC50") -> DataFrame:
    """Rows kept and rejected by `label_valid`, in one pass."""
    ok = F.col(feature).isNotNull() & P.present(label)
    return df.agg(F.count_if(ok).alias("kept"), (F.count("*") - F.count_if(ok)).alias("rejected"))


def drop_nulls(df: DataFrame, cols: Sequence[str], nan_too: bool = False) -> DataFrame:
    """Listwise drop of nulls; `nan_too` treats NaN as missing as well."""
    for c in cols:
        df = df.where(P.present(c) if nan_too else F.col(c).isNotNull())
    return df


def with_rule_violations(df: DataFrame, **cols: str) -> DataFrame:
    """The four rule flags and their sum; a null flag makes the sum null."""
    flags = P.rule_flags(**cols)
    total = sum((f.cast("tinyint") for f in list(flags.values())[1:]), list(flags.values())[0].cast("tinyint"))
    return df.withColumns({**flags, "lipinski_violations": total})


def passing_strict_rule(df: DataFrame, **cols: str) -> DataFrame:
    return df.where(P.passes_strict_rule(**cols))


def plausible_range(df: DataFrame, label: str = "pIC50", value: str = "standard_value") -> DataFrame:
    """Label within 3..12 and value below 100,000 nM."""
    return df.where(F.col(label).between(3, 12) & (F.col(value) < 100_000))


def structured_and_measured(df: DataFrame) -> DataFrame:
    """Rows with a structure and at least one of value and ready-made label."""
    return df.where(
        F.col("canonical_smiles").isNotNull()
        & (F.col("standard_value").isNotNull() | F.col("pchembl_value").isNotNull())
    )


def with_common_unit(df: DataFrame) -> DataFrame:
    """Concentrations converted to nM; rows in other units are dropped."""
    return (
        df.withColumn("standard_value", P.value_in_nm())
        .where(F.col("standard_value").isNotNull())
        .withColumn("standard_units", F.lit(S.NANOMOLAR))
    )


def with_censoring(df: DataFrame, mode: str = "mark") -> DataFrame:
    """Threshold measurements: 'drop' them, 'mark' them, or 'label' them inactive.

    'label' calls a row inactive when its true value is known only to lie above the number given.
    """
    marked = df.withColumn("standard_relation", P.relation_or_equal()).withColumn("censoring", P.censoring())
    if mode == "mark":
        return marked
    if mode == "drop":
        return marked.where(F.col("censoring") == "exact")
    if mode == "label":
        return marked.withColumn(
            "activity_class",
            F.when(F.col("censoring") == "lower_bound", F.lit("inactive")).otherwise(P.potency_class()),
        )
    raise ValueError("mode must be 'mark', 'drop' or 'label'")


def impute_median(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Fill missing values (null or NaN) with the column's exact median."""
    medians = exact_quantiles(df, cols, [0.5])
    return df.withColumns({
        c: F.coalesce(P.nan_to_null(c), F.lit(medians[c][0])) for c in cols if medians[c][0] is not None
    })


def duplicate_audit(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Keys with more than one row, their count and the spread of their values."""
    return (
        df.groupBy(*keys)
        .agg(F.count("*").alias("rows"), (F.max(value) - F.min(value)).alias("spread"))
        .where(F.col("rows") > 1)
    )


def confident(df: DataFrame, minimum: int, score: str = "confidence_score") -> DataFrame:
    return df.where(F.col(score) >= minimum)


def groups_with_enough_rows(df: DataFrame, key: str, minimum: int) -> DataFrame:
    """Rows of the groups that have at least `minimum` rows."""
    sizes = df.groupBy(key).agg(F.count("*").alias("_w")).where(F.col("_w") >= minimum)
    return hot_split_join(df, sizes, key, "left_semi", "_w")
