"""Exact inner-product search by norm buckets (local cosine thresholds).

Vectors are grouped by length. With a lower bound t of a query's k-th best product, a vector of a bucket
can only matter if its cosine to the query reaches t / (|q| * longest of the bucket): above 1 the bucket is
skipped; a high threshold prunes by coordinates (a coordinate far from the query's rules a vector out); a low
one prunes by length only (a vector shorter than t / |q| is ruled out). What is left is verified by product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from doseframe.llm.vectors import best, is_query, matrix, pack, top_of_rows, unpack, usable
from doseframe.session import staged

# Norm buckets; vectors of one packed block; queries of one packed block.
BUCKETS, BLOCK, QUERIES = 32, 8_192, 1_024
# From this local cosine threshold on, coordinates prune; that many of a query's largest ones are looked at.
COORDINATES_FROM, FOCUS = 0.6, 3
# Below this bound products of whole numbers are exact in double precision.
EXACT_TO = 2.0**53


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact products of whole-number vectors; beyond double precision by Python integers, cut to a long."""
    if not queries.size or not vectors.size:
        return np.zeros((len(queries), len(vectors)))
    if queries.shape[1] * np.abs(queries).max() * np.abs(vectors).max() < EXACT_TO:
        return queries @ vectors.T
    whole = [[int(x) for x in row] for row in vectors]
    return np.array([[max(-2**63, min(2**63 - 1, sum(int(a) * b for a, b in zip(q, row)))) for row in whole] for q in queries], dtype=object)


def search_block(q_ids, q, bound, ids, vectors, lengths, k: int) -> tuple[list, list, list]:
    """Hits of a block of queries in a block of vectors sorted from long to short; bound: known k-th best or -inf."""
    out_q, out_v, out_s = [], [], []
    norms = np.sqrt((q * q).sum(axis=1))
    slack = 1 + 1e-9
    longest = lengths[0] if len(lengths) else 0.0
    with np.errstate(divide="ignore", invalid="ignore"):
        need = np.where(bound > 0, bound / (norms * slack), -np.inf)  # least length that can reach the bound
        local = np.where(bound > 0, need / longest if longest else np.inf, -np.inf)
    alive = np.flatnonzero(local <= 1)
    plain = alive[local[alive] < COORDINATES_FROM]
    if len(plain):
        reach = int(np.searchsorted(-lengths, -need[plain].min(), side="right"))
        scores = products(q[plain], vectors[:reach])
        _emit(plain, scores, np.arange(reach), q_ids, bound, ids, k, (out_q, out_v, out_s))
    for i in alive[local[alive] >= COORDINATES_FROM]:
        reach = int(np.searchsorted(-lengths, -need[i], side="right"))
        fit = np.arange(reach)
        unit = q[i] / norms[i]
        with np.errstate(divide="ignore", invalid="ignore"):
            for f in np.argsort(-np.abs(unit))[:FOCUS]:
                cosine = np.minimum(1.0, need[i] / lengths[fit])
                wide = np.sqrt(np.maximum(0.0, 1 - cosine**2) * max(0.0, 1 - unit[f] ** 2)) + 1e-9
                coordinate = vectors[fit, f] / lengths[fit]
                fit = fit[_feasible(coordinate, unit[f], cosine, wide)]
        if len(fit):
            _emit(np.array([i]), products(q[i:i + 1], vectors[fit]), fit, q_ids, bound, ids, k, (out_q, out_v, out_s))
    return out_q, out_v, out_s


def _feasible(x: np.ndarray, u: float, t: np.ndarray, wide: np.ndarray) -> np.ndarray:
    """Coordinates x that a unit vector with a cosine of at least t to a unit vector with coordinate u can have."""
    low = np.where(u < -t, -1.0, u * t - wide)
    high = np.where(u > t, 1.0, u * t + wide)
    return (x >= low - 1e-9) & (x <= high + 1e-9)


def _emit(rows, scores, fit, q_ids, bound, ids, k, out) -> None:
    own = ids[fit][None, :] == q_ids[rows][:, None]
    if scores.dtype == object:
        values = np.where(own, None, scores)
        for i, row in zip(rows, values):
            order = sorted((-s, int(ids[fit[j]]), j) for j, s in enumerate(row) if s is not None and s >= bound[i])[:k]
            for s, v, _ in order:
                out[0].append(int(q_ids[i])), out[1].append(v), out[2].append(-s)
        return
    scores = np.where(own | (scores < bound[rows][:, None]), -np.inf, scores)
    for i, row, keep in zip(rows, scores, top_of_rows(scores, ids[fit], k)):
        out[0].extend([int(q_ids[i])] * len(keep))
        out[1].extend(ids[fit[keep]].tolist())
        out[2].extend(int(x) for x in row[keep])


def _blocks(df: DataFrame, keys: list[str], extra: list[str]) -> DataFrame:
    """Rows of equal keys packed into one row: ids, vectors (long to short) and further double columns."""
    schema = ", ".join(f"{k} {t}" for k, t in df.select(*keys).dtypes) + ", width int, ids binary, vecs binary"
    schema += "".join(f", {e} binary" for e in extra)

    def packing(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["norm", "id"], ascending=[False, True])
        m = matrix(list(pdf["vec"]))
        row = {k: [pdf[k].iloc[0]] for k in keys} | {"width": [m.shape[1]], "ids": [pack(pdf["id"].to_numpy(np.int64))], "vecs": [pack(m)]}
        return pd.DataFrame(row | {e: [pack(pdf[e].to_numpy(np.float64))] for e in extra})

    return df.groupBy(*keys).applyInPandas(packing, schema)


def _search(queries: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """Hits of every query block in every vector block of its width, best k of each query and block."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                q, v = unpack(r.q_vecs, np.float64, r.width), unpack(r.vecs, np.float64, r.width)
                found = search_block(
                    unpack(r.q_ids, np.int64), q, unpack(r.bound, np.float64), unpack(r.ids, np.int64), v, np.sqrt((v * v).sum(axis=1)), k
                )
                yield pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), found)), columns=["query_id", "vec_id", "score"]).astype("int64")

    places = blocks.select("width", "bucket", "part")
    asked = queries.select("width", F.col("ids").alias("q_ids"), F.col("vecs").alias("q_vecs"), "bound").join(places, "width")
    return asked.repartition("width", "bucket", "part", F.xxhash64("q_ids")).join(blocks, ["width", "bucket", "part"]).select(
        "width", "q_ids", "q_vecs", "bound", "ids", "vecs"
    ).mapInPandas(run, "query_id long, vec_id long, score long")


def top_products(df: DataFrame, key: str, vector: str, k: int, every: int, scale: float = 64.0) -> DataFrame:
    """The k largest inner products of floor(scale * component) vectors for each query (id divisible by `every`):
    query_id, rank from 1, vec_id, score, ties to the smaller id, the query's own id left out.

    Vectors that are null, empty or hold null or non-finite components take no part, nor do null ids; of rows that
    repeat an id the smallest vector counts. Vectors meet those of their own width only. A query with
    fewer than k candidates returns all of them. Products beyond a long are cut to its ends.

    Vectors and queries are packed into blocks of bounded size; each query block meets each vector block
    once, after the bucket of the longest vectors has given every query its first bound.
    """
    whole = usable(df, key, vector).withColumn("vec", F.transform("vec", lambda x: F.floor(x * scale).cast("double")))
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
    whole = staged(whole.select("id", "vec", norm.alias("norm"), F.size("vec").alias("w")), "vectors")
    n = whole.count()
    cuts = sorted(set(whole.approxQuantile("norm", [i / BUCKETS for i in range(1, BUCKETS)], 0.001))) if n > BLOCK else []
    # Bucket 0 holds the longest vectors.
    bucket = F.lit(0)
    for c in cuts:
        bucket = bucket + (F.col("norm") < c).cast("int")
    sizes = whole.groupBy("w", bucket.alias("bucket")).agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("parts"))
    placed = whole.withColumn("bucket", bucket).join(sizes, ["w", "bucket"])
    placed = placed.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    blocks = staged(_blocks(placed, ["w", "bucket", "part"], []).drop("w"), "blocks")
    asked = whole.where(is_query(F.col("id"), every))
    groups = asked.count() // QUERIES + 1

    def packed_queries(bounds: DataFrame | None) -> DataFrame:
        rows = asked if bounds is None else asked.join(bounds, "id", "left")
        rows = rows.withColumn("bound", F.lit(float("-inf")) if bounds is None else F.coalesce("bound", F.lit(float("-inf"))))
        rows = rows.withColumn("group", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int"))
        return staged(_blocks(rows, ["w", "group"], ["bound"]), "queries")

    first = staged(best(_search(packed_queries(None), blocks.where("bucket = 0"), k), k), "first")
    bounds = first.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("bound"))
    rest = _search(packed_queries(bounds), blocks.where("bucket > 0"), k)
    return best(first.drop("rank").unionByName(rest), k)
