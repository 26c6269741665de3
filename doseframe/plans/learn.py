"""Feature, split, fit and score job on a cleaned activity table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from doseframe.operators.cleaning import label_valid
from doseframe.operators.evaluate import fit_baseline, predictions, regression_scores
from doseframe.operators.featurize import with_fingerprint, with_vector
from doseframe.operators.splits import assign_split
from doseframe.session import staged


def fingerprint_table(df: DataFrame, structure: str = "canonical_smiles", label: str = "pIC50") -> DataFrame:
    """Rows with fingerprint bits and a usable label.

    Only a missing text has no bits, so the filter runs on the text, before any hashing.
    """
    return with_fingerprint(label_valid(df, structure, label), structure)


def train_and_score(
    df: DataFrame, keys: Sequence[str], label: str, kind: str = "random", group: str | None = None, model: str = "linear",
    features: str = "bits", seed: int = 42, **params,
) -> tuple[DataFrame, DataFrame]:
    """(predictions, scores per split). `features` is a column of set bits or of fixed-width vectors.

    The features are computed once and written before the split, the fit and the scores read them.
    """
    df = staged(df, "learning-table")
    labelled = assign_split(df, kind, keys=keys, group=group, seed=seed) if kind == "random" else assign_split(df, kind, group=group, seed=seed)
    ready = (
        with_vector(labelled, features)
        if dict(labelled.dtypes)[features] == "array<int>"
        else labelled.withColumn("features", array_to_vector(F.col(features)))
    ).select(*keys, "split", label, "features").persist()
    fitted = fit_baseline(ready, "features", label, model, **params)
    scored = predictions(fitted, ready, keys, label)
    return scored, regression_scores(scored, by=["split"])
