"""Mixing to target weights with soft membership.

A classifier fitted on the labelled table gives every document a posterior over domains. Document rates r >= 0
are then fitted by projected gradient on the least squares of (expected domain tokens - targets), starting at
r = 1. A rate depends on the document's posterior and on the few residual vectors of the steps alone, so a
step is one distributed sum, and nothing of the documents is ever on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from doseframe.llm.terms import FIT_ROWS_PER_CLASS, TermTable, chosen_rows, labelled_sample, padded, telling_terms
from doseframe.llm.text import byte_groups
from doseframe.session import staged

EPOCHS, BATCH, RATE, DECAY = 30, 256, 0.2, 1e-4
# Texts classified at once.
GROUP_BYTES = 2 << 20
# Steps at most, and the share of all target tokens that residuals may have at the end.
STEPS, TOLERANCE = 60, 1e-7


@dataclass
class Membership:
    """Linear softmax over chosen terms."""
    terms: np.ndarray
    bias: np.ndarray
    weights: np.ndarray

    def posteriors(self, rows: list) -> np.ndarray:
        sizes = [len(r) for r in rows]
        of, places = np.repeat(np.arange(len(rows)), sizes), np.fromiter(chain.from_iterable(rows), np.int64, sum(sizes))
        return self.posteriors_at(of, places, len(rows))

    def posteriors_at(self, of: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
        """The same for pairs (text, place) of `n` texts, in order."""
        z = np.stack([b + np.bincount(of, w[places], n) for b, w in zip(self.bias, self.weights.T)], axis=1)
        z = np.exp(z - z.max(axis=1, keepdims=True)) if len(z) else z
        return z / z.sum(axis=1, keepdims=True)


@dataclass
class Rates:
    """The residual steps of a fit; `residual` is what is left of each target, in tokens."""
    steps: list[np.ndarray] = field(default_factory=list)
    residual: np.ndarray | None = None

    def of(self, posteriors: np.ndarray) -> np.ndarray:
        rate = np.ones(len(posteriors))
        for step in self.steps:
            rate = np.maximum(0.0, rate - posteriors @ step)
        return rate


def domain_labels(labels: DataFrame) -> DataFrame:
    """doc_id and domain of the label table: 2 toxic, 1 of good quality, 0 of poor quality; null if unknown."""
    domain = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 1, 1).when(F.col("quality") == 0, 0)
    return labels.select("doc_id", domain.alias("label"))


def fit_membership(docs: DataFrame, labels: DataFrame, domains: int, text: str = "text", per_class: int = FIT_ROWS_PER_CLASS) -> Membership:
    """A classifier fitted on at most `per_class` rows of each domain; without labels it gives smoothed shares."""
    rows, totals = labelled_sample(docs, text, labels, domains, per_class)
    terms = telling_terms(rows, domains)
    positions, got = chosen_rows(rows, terms)
    return fit_softmax(terms, positions, got, totals)


def fit_softmax(terms: np.ndarray, rows: list[np.ndarray], labels: np.ndarray, totals: list[int], seed: int = 5) -> Membership:
    domains, n = len(totals), len(terms)
    share = (np.array(totals) + 0.5) / (sum(totals) + 0.5 * domains)
    bias, w = np.log(share), np.zeros((n + 1, domains))
    if n and len(rows):
        have = np.bincount(labels, minlength=domains)
        weight = (share * len(rows) / np.maximum(have, 1))[labels]
        gw, gb, rng = np.full(w.shape, 1e-6), np.full(domains, 1e-6), np.random.default_rng(seed)
        for _ in range(EPOCHS):
            order = rng.permutation(len(rows))
            for start in range(0, len(order), BATCH):
                batch = order[start:start + BATCH]
                x = padded([rows[i] for i in batch], n)
                z = bias + w[x].sum(axis=1)
                z = np.exp(z - z.max(axis=1, keepdims=True))
                err = z / z.sum(axis=1, keepdims=True)
                err[np.arange(len(batch)), labels[batch]] -= 1
                err *= weight[batch][:, None] / len(batch)
                places = x.ravel()
                dw = np.stack([np.bincount(places, np.repeat(e, x.shape[1]), n + 1) for e in err.T], axis=1)
                used = np.flatnonzero(np.bincount(places, minlength=n + 1))
                dw[used] += DECAY * w[used]
                dw[n] = 0
                gw += dw * dw
                w -= RATE * dw / np.sqrt(gw)
                db = err.sum(axis=0)
                gb += db * db
                bias = bias - RATE * db / np.sqrt(gb)
    return Membership(terms, bias, w[:n])


def member_column(text: Column, model: Membership) -> Column:
    """Struct n_tokens (words of the whole text; 0 for null and empty texts) and p (posterior of each domain)."""
    @F.arrow_udf("n_tokens long, p array<double>")
    def member(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = TermTable(model.terms)
        for texts in batches:
            sizes, found = [np.empty(0, np.int64)], [np.empty((0, len(model.bias)))]
            for part in byte_groups(pa.record_batch([texts], ["text"]), 0, GROUP_BYTES):
                size, of, places = table.find(part.column(0))
                sizes.append(size)
                found.append(model.posteriors_at(of, places, len(size)))
            p = np.concatenate(found)
            offsets = pa.array(np.arange(len(p) + 1) * p.shape[1], pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(p.ravel(), pa.float64()))
            yield pa.StructArray.from_arrays([pa.array(np.concatenate(sizes), pa.int64()), lists], ["n_tokens", "p"])

    return member(text)


def _sums(members: DataFrame, rates: Rates, domains: int) -> np.ndarray:
    """Expected domain tokens at the rates, then the tokens of each pair of domains among documents with a rate
    above 0, in one distributed sum."""
    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(domains + domains * domains)
        for pdf in batches:
            if len(pdf):
                p, n = np.stack(pdf["p"]), pdf["n_tokens"].to_numpy(float)
                rate = rates.of(p)
                free = rate > 0
                total[:domains] += (n * rate) @ p
                total[domains:] += (p[free].T @ (n[free, None] * p[free])).ravel()
        yield pd.DataFrame({"at": np.arange(len(total)), "x": total})

    rows = members.select("n_tokens", "p").mapInPandas(partial, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).collect()
    out = np.zeros(domains + domains * domains)
    for r in rows:
        out[r["at"]] = r["x"]
    return out


def fit_rates(members: DataFrame, shares: list[float], anchor: int | None = None) -> Rates:
    """Rates whose expected domain tokens meet `shares` of a total; members has n_tokens and p.

    The total is that of all documents; with `anchor` it is the one at which that domain keeps the tokens it
    has. Residuals are weighted by the inverse of the token matrix of the documents above the bound, so that
    a step is exact while the same documents stay there. Targets that no rates can meet (domains without
    any token among them) are approached; `residual` tells how far.
    """
    if len(shares) == 0 or min(shares) < 0 or not sum(shares) > 0:
        raise ValueError("shares are not negative and one is positive")
    k = len(shares)
    rates = Rates()
    first = _sums(members, rates, k)
    have, matrix = first[:k], first[k:].reshape(k, k)
    target = np.array(shares) / sum(shares)
    total = have.sum() if anchor is None or target[anchor] == 0 else have[anchor] / target[anchor]
    target = target * total
    got = have
    for _ in range(STEPS):
        rates.residual = got - target
        if np.abs(rates.residual).max(initial=0) <= TOLERANCE * max(total, 1.0):
            break
        rates.steps.append(np.linalg.pinv(matrix, rcond=1e-10, hermitian=True) @ rates.residual)
        sums = _sums(members, rates, k)
        got, matrix = sums[:k], sums[k:].reshape(k, k)
    rates.residual = got - target
    return rates


def rate_column(p: Column, rates: Rates) -> Column:
    """The rate of a document with posterior `p`."""
    @F.pandas_udf("double")
    def rate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for ps in batches:
            yield pd.Series(rates.of(np.stack(ps)) if len(ps) else [], index=ps.index, dtype=float)

    return rate(p)


def copies_column(key: Column, rate: Column) -> Column:
    """Whole copies for a rate: its whole part, and one more where a hash of the key lies below the rest."""
    chance = F.pmod(F.xxhash64(key, F.lit("mix")), F.lit(1 << 52)).cast("double") / float(1 << 52)
    return (F.floor(rate) + (chance < rate - F.floor(rate)).cast("long")).cast("int")


def mix(docs: DataFrame, key: str, text: str, labels: DataFrame, shares: list[float], anchor: int | None = None) -> DataFrame:
    """One row per document: the key, n_tokens, p, rate, copies. `labels` has doc_id and label (a domain).

    Null and empty texts have no tokens and the posterior of a text without terms. Repeated rows are
    documents of their own with equal rates; null keys share one draw. An empty table gives no rows.
    """
    model = fit_membership(docs.withColumnRenamed(key, "doc_id") if key != "doc_id" else docs, labels, len(shares), text)
    members = docs.select(F.col(key).alias("key"), member_column(F.col(text), model).alias("m"))
    members = staged(members.select("key", "m.n_tokens", "m.p"), "members")
    rates = fit_rates(members, shares, anchor)
    rated = members.withColumn("rate", rate_column(F.col("p"), rates))
    return rated.select(F.col("key").alias(key), "n_tokens", "p", "rate", copies_column(F.col("key"), F.col("rate")).alias("copies"))
