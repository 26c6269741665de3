"""Activity table job: five source tables to one cleaned table.

    spark-submit -m doseframe.plans.etl <source dir> <output path>
"""

from __future__ import annotations

import logging
import sys
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from doseframe import schemas as S
from doseframe.operators.cleaning import clean_activity, with_potency
from doseframe.operators.ordering import exact_sample
from doseframe.session import build_session
from doseframe.sources.sinks import write_parquet
from doseframe.sources.tables import read_table

log = logging.getLogger(__name__)


def load_sources(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {n: read_table(spark, f"{folder}/{n}.parquet", s) for n, s in S.SOURCE_SCHEMAS.items()}


def joined_activity(t: Mapping[str, DataFrame], target_ids: Sequence[str] = tuple(S.TARGET_IDS)) -> DataFrame:
    """The 19 source columns of measured, non-duplicate rows of the given targets.

    The chosen assays come first and cut the measurements down before the compound joins. No side
    is forced into memory: Spark broadcasts it when its measured size allows, else it shuffles and
    splits partitions that a popular assay or compound makes too large.
    """
    targets = t["target_dictionary"].where(F.col("chembl_id").isin(list(target_ids)))
    assays = t["assays"].join(targets, "tid").select(
        "assay_id", F.col("confidence_score").try_cast("int").alias("confidence_score"),
        F.col("chembl_id").alias("target_chembl_id"), F.col("pref_name").alias("target_name"),
    )
    measured = t["activities"].where(
        F.col("pchembl_value").isNotNull()
        & (F.col("potential_duplicate").isNull() | (F.col("potential_duplicate") == 0))
    )
    structures = t["compound_structures"].where(F.col("canonical_smiles").isNotNull())
    flat = (
        measured.join(assays, "assay_id")
        .join(structures, "molregno")
        .join(t["compound_properties"], "molregno")
    )
    return flat.select(*[
        F.col(f.name).try_cast(f.dataType).alias(f.name) for f in S.ACTIVITY_SCHEMA.fields if f.name != "pIC50"
    ])


def processed_activity(
    df: DataFrame, n: int | None = None, seed: int = S.SPLIT_SEED, keys: Sequence[str] = ("activity_id",)
) -> DataFrame:
    """Optional sample first, then units, label, cleaning and one row per structure."""
    return clean_activity(with_potency(exact_sample(df, n, keys, seed)), keys)


def run(spark: SparkSession, source: str, output: str, target_ids: Sequence[str] = tuple(S.TARGET_IDS)) -> int:
    rows = write_parquet(processed_activity(joined_activity(load_sources(spark, source), target_ids)), output)
    log.info("saved %d records to %s", rows, output)
    return rows


if __name__ == "__main__":
    logging.basicConfig(level=logging.INFO)
    run(build_session("activity-etl"), sys.argv[1], sys.argv[2])
