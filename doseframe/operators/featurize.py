"""Per-structure features, computed once per distinct structure."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from doseframe import schemas as S
from doseframe.functions import hashing as H
from doseframe.operators.cleaning import first_per_key
from doseframe.operators.joins import hot_split_join, missing_keys
from doseframe.session import staged


def _applied(fn: Callable[[str], dict | None], key: str, columns: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for text in batch[key]:
                try:
                    found.append(fn(text) or {})
                except (ImportError, MemoryError, OSError):  # of the machine, not of the structure
                    raise
                except Exception:  # an invalid structure has no features
                    found.append({})
            yield batch.assign(**{c: pd.Series([f.get(c) for f in found], dtype=object, index=batch.index) for c in columns})

    return run


def apply_to_keys(keys: DataFrame, key: str, fn: Callable[[str], dict | None], schema: str) -> DataFrame:
    """`fn` for each row of a table of distinct keys; a failure or None gives nulls."""
    added = StructType.fromDDL(schema)
    out = StructType([*keys.schema.fields, *added.fields])
    return keys.mapInPandas(_applied(fn, key, added.fieldNames()), out)


def featurize(
    df: DataFrame, key: str, fn: Callable[[str], dict | None], schema: str, partitions: int | None = None
) -> DataFrame:
    """Adds the features of each row's structure; an invalid structure gets nulls, never an error.

    Structures repeat, so `fn` sees each one once; results are staged, then joined back.
    """
    keys = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_w"))
    if partitions:
        keys = keys.repartition(partitions, key)
    found = staged(apply_to_keys(keys, key, fn, schema), "features")
    return hot_split_join(df, found, key, "left", "_w")


def refresh_features(
    df: DataFrame, key: str, fn: Callable[[str], dict | None], schema: str, path: str
) -> DataFrame:
    """Feature store at `path`: computes and appends only the structures it lacks, returns it whole."""
    spark = df.sparkSession
    stored_schema = StructType([df.schema[key], *StructType.fromDDL(schema).fields])
    wanted = df.where(F.col(key).isNotNull())
    spark.createDataFrame([], stored_schema).write.mode("append").parquet(path)
    stored = spark.read.schema(stored_schema).parquet(path)
    # Staged first: the table is not read while it is written.
    fresh = staged(apply_to_keys(missing_keys(wanted, stored, [key]), key, fn, schema), "new-features")
    fresh.write.mode("append").option("compression", "zstd").parquet(path)
    return spark.read.schema(stored_schema).parquet(path)


def with_fingerprint(df: DataFrame, text: str, tokens: Column | None = None, n_bits: int = S.FINGERPRINT_BITS, out: str = "bits") -> DataFrame:
    """Adds the sorted set bits of the text's hashed token runs; null text gives null."""
    if tokens is None:
        return df.withColumn(out, H.text_fingerprint(text, n_bits))
    return df.withColumn("_tokens", tokens).withColumn(out, H.hashed_fingerprint("_tokens", n_bits)).drop("_tokens")


def with_vector(df: DataFrame, bits: str = "bits", n_bits: int = S.FINGERPRINT_BITS, out: str = "features") -> DataFrame:
    """Set bits as a sparse 0/1 vector for Spark ML."""
    names = CountVectorizerModel.from_vocabulary([str(i) for i in range(n_bits)], inputCol="_words", outputCol=out)
    words = df.where(F.col(bits).isNotNull()).withColumn("_words", F.col(bits).cast("array<string>"))
    return names.setBinary(True).setMinTF(1.0).transform(words).drop("_words")


def distinct_structures(df: DataFrame, structure: str, order: Sequence[str]) -> DataFrame:
    """One row per structure, the first in order."""
    return first_per_key(df.where(F.col(structure).isNotNull()), structure, order)


def token_nodes(df: DataFrame, mol_id: str, text: str, tokens: Column | None = None) -> DataFrame:
    """nodes(mol_id, atom_idx, token)."""
    words = H.structure_tokens(F.col(text)) if tokens is None else tokens
    return df.select(F.col(mol_id).alias("mol_id"), F.posexplode(words).alias("atom_idx", "token"))


def token_edges(df: DataFrame, mol_id: str, text: str, tokens: Column | None = None) -> DataFrame:
    """edges(mol_id, src, dst) between neighbouring tokens, both ways; none for a single token."""
    words = H.structure_tokens(F.col(text)) if tokens is None else tokens
    return (
        df.select(F.col(mol_id).alias("mol_id"), F.size(words).alias("_n"))
        .where(F.col("_n") > 1)
        .select("mol_id", F.explode(F.sequence(F.lit(1), F.col("_n") - 1)).alias("_i"))
        .select("mol_id", F.inline(F.array(
            F.struct((F.col("_i") - 1).alias("src"), F.col("_i").alias("dst")),
            F.struct(F.col("_i").alias("src"), (F.col("_i") - 1).alias("dst")),
        )))
    )
