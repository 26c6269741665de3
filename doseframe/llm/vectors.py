"""Vectors as matrices: one row per id, packed blocks, best scores per query."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

ID_DTYPE = np.int64


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, vec) with vec array<double>: one row per id, without null ids and without vectors that are null,
    empty or hold null or non-finite components. Of rows that repeat an id the smallest vector (in array order)
    stays."""
    vec = F.col(vector).cast("array<double>")
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.select(F.col(key).cast("long").alias("id"), vec.alias("vec")).where(F.col("id").isNotNull() & F.col("vec").isNotNull()).where(
        fine & (F.size("vec") > 0)
    ).groupBy("id").agg(F.min("vec").alias("vec"))


def best(hits: DataFrame, k: int, score: str = "score") -> DataFrame:
    """The k best (query_id, vec_id, score) of each query with rank: highest score, then smallest id."""
    order = Window.partitionBy("query_id").orderBy(F.desc(score), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", score)


def matrix(vectors) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in vectors]) if len(vectors) else np.empty((0, 0))


def pack(array: np.ndarray) -> bytes:
    return np.ascontiguousarray(array).tobytes()


def unpack(data: bytes, dtype, width: int | None = None) -> np.ndarray:
    out = np.frombuffer(data, dtype=dtype)
    return out if width is None else out.reshape(-1, width) if width else out.reshape(-1, 0)


def top_of_rows(scores: np.ndarray, ids: np.ndarray, k: int) -> list[np.ndarray]:
    """For each row the positions of its k best finite scores, ties at the edge included and cut by id."""
    out = []
    for row in scores:
        fit = np.flatnonzero(np.isfinite(row))
        if len(fit) > k:
            edge = np.partition(row[fit], len(fit) - k)[len(fit) - k]
            fit = fit[row[fit] >= edge]
        fit = fit[np.lexsort((ids[fit], -row[fit]))][:k]
        out.append(fit)
    return out


def is_query(key: Column, every: int) -> Column:
    return key % every == 0
