"""Periodic runs of words in whole texts, and texts with repeated periods left out.

A run is a stretch of words with smallest period q, of at least MIN_LENGTH words and two periods, that no neighbouring
word extends. Every run of period q holds two neighbouring multiples of q, so these pairs (the harmonic grid, n ln n of
them) are the candidates; those whose words and one pair of neighbours agree are extended both ways by the grammar.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from doseframe.llm.recompression import Grammar
from doseframe.llm.text import byte_groups

MIN_LENGTH = 12
GROUP_BYTES = 6 << 20   # texts handled at once; a longer text is handled alone, as a whole
CANDIDATES = 1 << 18    # grid pairs extended at once


def runs_of(texts: Sequence[Sequence[bytes]], min_length: int = MIN_LENGTH) -> list[np.ndarray]:
    """For each list of words its runs as rows (start, length, period), by start, then period."""
    sizes = np.array([len(w) for w in texts], dtype=np.int64)
    out = [np.empty((0, 3), dtype=np.int64) for _ in texts]
    # Longest first: the grid of a long period then covers a prefix of the sequence.
    order = [int(k) for k in np.argsort(-sizes, kind="stable") if sizes[k] >= max(min_length, 2)]
    if not order:
        return out
    names: dict[bytes, int] = {}
    number = names.setdefault
    words = [np.array([number(w, len(names)) for w in texts[k]], dtype=np.int64) for k in order]
    size = len(names)
    # Separators, each its own symbol, before every text and at the end.
    parts = [x for k, w in enumerate(words) for x in ([size + k], w)] + [[size + len(words)]]
    symbols = np.concatenate(parts).astype(np.int64)
    ends = np.cumsum(sizes[order] + 1)
    starts = ends - sizes[order]
    grammar = Grammar(symbols, size + len(words) + 1, 4 * len(order) + 64)
    found = _runs(symbols, grammar, sizes[order], ends, min_length)
    owner = np.searchsorted(ends, found[:, 0], "right")
    found[:, 0] -= starts[owner]
    edges = np.searchsorted(owner, np.arange(len(order) + 1))
    for k, lo, hi in zip(order, edges, edges[1:]):
        rows = found[lo:hi]
        out[k] = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    return out


def _runs(symbols: np.ndarray, grammar: Grammar, sizes: np.ndarray, ends: np.ndarray, min_length: int) -> np.ndarray:
    """(start, length, period) over the joined sequence, by start and end, each stretch with its smallest period."""
    kept, waiting, held = [np.empty((0, 3), dtype=np.int64)], [], 0

    def flush() -> None:
        nonlocal waiting, held
        if waiting:
            i = np.concatenate([w[0] for w in waiting])
            p = np.repeat([w[1] for w in waiting], [len(w[0]) for w in waiting])
            for lo in range(0, len(i), CANDIDATES):
                kept.append(_extended(grammar, i[lo:lo + CANDIDATES], p[lo:lo + CANDIDATES], min_length))
            # Pairs of one run give one row: only distinct runs are kept on.
            kept[:] = [_smallest(np.concatenate(kept))]
        waiting, held = [], 0

    longest_first = -sizes
    for p in range(1, int(sizes[0]) // 2 + 1):
        fit = int(np.searchsorted(longest_first, -max(2 * p, min_length), "right"))
        if not fit:
            break
        grid = symbols[0:int(ends[fit - 1]):p]
        i = np.flatnonzero(grid[1:] == grid[:-1]) * p
        if not len(i):
            continue
        # A run matches its copy one period on in at least six neighbouring places, or all that there are.
        if max(p, min_length - p) > 1:
            i = i[(symbols[i + 1] == symbols[i + p + 1]) | (symbols[i - 1] == symbols[i + p - 1])]
        if len(i):
            waiting.append((i, p))
            held += len(i)
            if held >= CANDIDATES:
                flush()
    flush()
    return kept[0]


def _extended(grammar: Grammar, i: np.ndarray, p: np.ndarray, min_length: int) -> np.ndarray:
    before, after = grammar.extend(i, i + p, back=True), grammar.extend(i, i + p)
    matched = before + after
    fit = (matched >= p) & (matched + p >= min_length)
    return np.stack([(i - before)[fit], (matched + p)[fit], p[fit]], axis=1)


def _smallest(rows: np.ndarray) -> np.ndarray:
    """One row a stretch. A period of a stretch twice as long is a multiple of its smallest one, which reaches as far."""
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1))[:len(rows)]
    return rows[new]


def kept_words(words: Sequence[bytes], runs: np.ndarray) -> list[bytes]:
    """The words that no run contains after its first period."""
    if not len(runs):
        return list(words)
    change = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    stays = np.cumsum(change)[:-1] == 0
    return [w for w, s in zip(words, stays) if s]


def find(
    df: DataFrame, key: str, text: str, min_length: int = MIN_LENGTH,
    rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None,
) -> DataFrame:
    """(key, n_words, runs array<struct<start, length, period>>, collapsed) of every row of `df`.

    Words are what stands between spaces and the control characters 9 to 13, cases kept. `collapsed` has the words
    left without the repeated periods, joined by one space. A null or empty text has no words, no runs and an empty
    `collapsed`; rows that repeat a key or a text each give their row; a null key stays null. No other column of `df`
    is read, so names cannot clash. `rewrite(key, words)` may put other words in place first.

    No shuffle: tasks handle whole texts in groups of GROUP_BYTES, so memory does not grow with the table.
    """
    key_type = df.schema[key].dataType.simpleString()
    narrow = df.select(F.col(key).alias("k"), F.col(text).cast("binary").alias("t"))

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_groups(batch, 1, GROUP_BYTES):
                yield _batch(part.column(0), part.column(1).to_pylist())

    def _batch(keys: pa.Array, texts: list) -> pa.RecordBatch:
        words = [[] if t is None else t.split() for t in texts]
        if rewrite is not None:
            words = [rewrite(k, w) for k, w in zip(keys.to_pylist(), words)]
        runs = runs_of(words, min_length)
        sizes = np.cumsum([0] + [len(r) for r in runs])
        flat = np.concatenate(runs) if runs else np.empty((0, 3), dtype=np.int64)
        fields = pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], ["start", "length", "period"])
        rest = [b" ".join(kept_words(w, r)) for w, r in zip(words, runs)]
        return pa.RecordBatch.from_arrays([
            keys, pa.array([len(w) for w in words], pa.int64()),
            pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), fields), pa.array(rest, pa.binary()),
        ], ["k", "n_words", "runs", "rest"])

    schema = f"k {key_type}, n_words long, runs array<struct<start: long, length: long, period: long>>, rest binary"
    return narrow.mapInArrow(tasks, schema).select(
        F.col("k").alias(key), "n_words", "runs", F.col("rest").cast("string").alias("collapsed")
    )


def digests(found: DataFrame, key: str) -> DataFrame:
    """Number of runs, the longest (ties: smallest start, then period; nulls without one) and hashes of `find`'s rows."""
    rows = F.col("runs")
    # Ordered by start, then period: the first of the greatest length is the wanted one.
    most = F.array_max(F.transform(rows, lambda x: x["length"]))
    top = F.filter(rows, lambda x: x["length"] == most)
    text = F.array_join(F.transform(rows, lambda x: F.concat_ws(",", x["start"], x["length"], x["period"])), "\n")
    lines = F.when(F.size(rows) > 0, F.concat(text, F.lit("\n"))).otherwise(F.lit(""))
    top = F.when(F.size(rows) > 0, F.get(top, F.lit(0)))
    return found.select(
        key, F.size(rows).cast("long").alias("n_runs"), top["start"].alias("start"), top["length"].alias("length"),
        top["period"].alias("period"),
        lines.alias("_lines"), "collapsed",
    ).select(
        key, "n_runs", "start", "length", "period",
        F.expr("1000 * length div period").alias("exponent_milli"),
        F.sha2("_lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def repeated_tail(key: int | None, words: list[bytes]) -> list[bytes]:
    """A text of every tenth key (by crc32 of its decimal text) goes on in copies of a period from some word on."""
    h = zlib.crc32(str(key).encode()) if key is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
