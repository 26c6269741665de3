"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(bias + sum of weights + sum over pairs of <v_i, v_j>): the pair part learns that an insult
together with a group mention weighs more than both alone, which additive weights cannot.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from doseframe.llm.terms import FIT_ROWS_PER_CLASS, LEAST_EVIDENCE, LEAST_ROWS, SlotIndex, labelled_sample, slot_rows
from doseframe.llm.text import byte_groups, id_fold

FACTORS, EPOCHS, BATCH, RATE, DECAY = 8, 40, 256, 0.1, 1e-4
# Places of the hash table; squared length of a mean row of the terms that are fitted second.
SLOTS, LENGTH = 1 << 18, 1.0
# Texts scored at once: their places take some times their bytes.
GROUP_BYTES = 2 << 20


@dataclass
class Machine:
    terms: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def scores(self, rows: list) -> np.ndarray:
        """Probabilities for rows of distinct positions into `terms`; an empty row has the bias alone."""
        out = np.empty(len(rows))
        for i, r in enumerate(rows):
            r = np.asarray(r, dtype=np.int64)
            v = self.factors[r]
            s = v.sum(axis=0)
            out[i] = self.bias + self.weights[r].sum() + 0.5 * float(s @ s - (v * v).sum())
        return 1.0 / (1.0 + np.exp(-np.clip(out, -40, 40)))


class Batch:
    """Rows as one flat list of positions, with the order that brings equal positions together."""

    def __init__(self, rows: list[np.ndarray], labels: np.ndarray, weight: np.ndarray):
        sizes = np.array([len(r) for r in rows])
        flat = np.concatenate(rows)
        order = np.argsort(flat, kind="stable")
        self.used, first = np.unique(flat[order], return_index=True)
        self.first, self.col = first, np.repeat(np.arange(len(self.used)), np.diff(np.append(first, len(flat))))[np.argsort(order)].astype(np.int32)
        self.row = np.repeat(np.arange(len(rows)), sizes)[order].astype(np.int32)
        self.starts, self.full = np.cumsum(sizes) - sizes, sizes > 0
        self.labels, self.weight = labels, weight

    def by_row(self, a: np.ndarray) -> np.ndarray:
        """Sum over each row's positions of the values of the used positions."""
        out = np.zeros((len(self.starts), a.shape[1]), dtype=a.dtype)
        out[self.full] = np.add.reduceat(a[self.col], self.starts[self.full], axis=0)
        return out

    def by_position(self, a: np.ndarray) -> np.ndarray:
        """Sum over the rows that hold each used position of the values of the rows."""
        return np.add.reduceat(a[self.row], self.first, axis=0)


def evidence(rows: list[np.ndarray], labels: np.ndarray, n: int) -> np.ndarray:
    """Likelihood ratio statistic of each position's presence and the label; 0 below LEAST_ROWS rows."""
    seen = [np.bincount(np.concatenate([np.empty(0, np.int32), *(r for r, y in zip(rows, labels) if y == c)]), minlength=n) for c in (0, 1)]
    both, out = seen[0] + seen[1], np.zeros(n)
    for c in (0, 1):
        size = int((labels == c).sum())
        for got, of in ((seen[c], both), (size - seen[c], len(rows) - both)):
            out += np.where(got > 0, 2 * got * np.log(np.maximum(got, 1) * len(rows) / np.maximum(of * size, 1)), 0.0)
    return np.where(both >= LEAST_ROWS, out, 0.0)


def fit_machine(terms: np.ndarray, rows: list[np.ndarray], labels: np.ndarray, totals: list[int], seed: int = 7) -> Machine:
    """Adagrad on the log loss; the classes are weighted back to their shares among all labelled rows.

    Terms that tell the labels apart alone are fitted first, then all terms together on what is left, the others
    with smaller values: else the many terms of a text learn the fitted texts by heart. Positions that no row
    holds have no part in a score.
    """
    have = np.bincount(labels, minlength=2).astype(float) if len(labels) else np.zeros(2)
    bias = float(np.log((totals[1] + 0.5) / (totals[0] + 9.5)))  # without labels, a twentieth
    n = len(terms)
    # One row a position: the weight, then the factors.
    w = np.zeros((n, 1 + FACTORS), dtype=np.float32)
    if n and have.all() and any(map(len, rows)):
        rng = np.random.default_rng(seed)
        strong = evidence(rows, labels, n) >= LEAST_EVIDENCE
        small = min(1.0, np.sqrt(LENGTH / np.mean([len(r) for r in rows])))
        value = np.where(strong, 1.0, small).astype(np.float32)[:, None]
        held = np.unique(np.concatenate(rows))
        w[held, 1:] = rng.normal(0, 0.05, (len(held), FACTORS))
        share = np.array(totals[:2]) / sum(totals[:2])
        weight = (share * have.sum() / have)[labels]
        order = rng.permutation(len(rows))
        for part in (strong, np.ones(n, dtype=bool)):
            if part.any():
                kept = [r[part[r]] for r in rows]
                batches = [Batch([kept[i] for i in p], labels[p], weight[p]) for p in np.split(order, range(BATCH, len(order), BATCH))]
                bias = _descend(w, value, bias, [b for b in batches if b.full.any()], rng)
        w *= value
    return Machine(terms, float(bias), w[:, 0].copy(), w[:, 1:].copy())


def _descend(w: np.ndarray, value: np.ndarray, bias: float, batches: list[Batch], rng: np.random.Generator) -> float:
    """EPOCHS of steps on `w`, in place; returns the bias."""
    g2, gb = np.full(w.shape, 1e-6, dtype=np.float32), 1e-6
    for _ in range(EPOCHS):
        for at in rng.permutation(len(batches)):
            b = batches[at]
            plain, x = w[b.used], value[b.used]
            mine = plain * x
            sums = b.by_row(np.concatenate((mine, (mine[:, 1:] ** 2).sum(axis=1, keepdims=True)), axis=1))
            s = sums[:, 1:-1]
            z = bias + sums[:, 0] + 0.5 * ((s * s).sum(axis=1) - sums[:, -1])
            err = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - b.labels) * b.weight / len(b.labels)
            d = b.by_position(np.concatenate((err[:, None], err[:, None] * s), axis=1).astype(np.float32))
            d[:, 1:] -= d[:, :1] * mine[:, 1:]
            d = d * x + np.float32(DECAY) * plain
            g = g2[b.used] + d * d
            g2[b.used] = g
            w[b.used] = plain - np.float32(RATE) * d / np.sqrt(g)
            db = err.sum()
            gb += db * db
            bias -= RATE * db / np.sqrt(gb)
    return bias


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", per_class: int = FIT_ROWS_PER_CLASS) -> Machine:
    """A machine over all hashed terms, fitted on at most `per_class` rows of each label of `labels` (doc_id, label 0 or 1).

    Without rows of both labels every text scores the smoothed share of label 1, a twentieth without labels.
    """
    rows, totals = labelled_sample(docs, text, labels, 2, per_class)
    positions, got = slot_rows(rows, SLOTS)
    return fit_machine(np.arange(SLOTS), positions, got, totals)


def score_column(text: Column, machine: Machine) -> Column:
    """Probability of label 1 for a whole text; null and empty texts are scored like any other."""
    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = SlotIndex(len(machine.terms))
        for texts in batches:
            for part in byte_groups(pa.record_batch([texts], ["text"]), 0, GROUP_BYTES):
                yield pa.array(machine.scores([index.find(t) for t in part.column(0).to_pylist()]), pa.float64())

    return score(text)


def training_labels(labels: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """doc_id and label (toxic) of the rows outside the held-out fold."""
    return labels.where(id_fold(F.col("doc_id"), folds) != held).select("doc_id", F.col("toxic").cast("int").alias("label"))
