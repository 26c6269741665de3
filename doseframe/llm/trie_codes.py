"""Vector codes of consecutive parts, each the nearest entry of its codebook, by a trie over the distinct parts.

The distinct parts of a position, in lexicographic order, are the leaves of a trie whose inner nodes are common leading
components. The walk is depth first: a node holds the squared distances to all entries over its components, its children
add theirs, so a shared prefix is summed up once. Below a node of few leaves the levels are computed as arrays. A leaf
takes the nearest entry and adds its components, weighted by its number of copies, to that entry's sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from doseframe.session import staged

LEAVES = 4096            # leaves whose levels are computed as arrays
STORED = 1 << 14         # leaves in one row of the written table
SHIFT = 1 << 31          # makes a component an unsigned number with the same order
WORD = np.dtype(">u4")


class Trie:
    """Walk over sorted distinct rows of integers (leaves x width)."""

    def __init__(self, leaves: np.ndarray):
        self.leaves = leaves
        same = leaves[1:] == leaves[:-1]
        # Leading components that a leaf shares with the one before it.
        self.shared = np.append(-1, np.where(same.all(axis=1), leaves.shape[1], np.argmin(same, axis=1)))[:len(leaves)]

    def nearest(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry (ties: the lower) and its squared distance for every leaf."""
        n = len(self.leaves)
        best, distance = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        todo = [(0, n, 0, np.zeros((1, len(entries)), dtype=np.int64))] if n else []
        while todo:
            lo, hi, depth, path = todo.pop()
            if hi - lo > LEAVES and depth < self.leaves.shape[1]:
                todo += reversed(self._children(lo, hi, depth, path, entries))
                continue
            sums = self._levels(lo, hi, depth, path, entries)
            best[lo:hi] = sums.argmin(axis=1)
            distance[lo:hi] = np.take_along_axis(sums, best[lo:hi, None], axis=1)[:, 0]
        return best, distance

    def _children(self, lo: int, hi: int, depth: int, path: np.ndarray, entries: np.ndarray) -> list[tuple]:
        """A large node's children; neighbours of few leaves stay together under the node itself."""
        cuts = lo + np.flatnonzero(self.shared[lo:hi] <= depth)
        cuts = np.append(np.append(lo, cuts[cuts > lo]), hi)
        out, begin = [], lo
        for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
            if b - a > LEAVES:
                if begin < a:
                    out.append((begin, a, depth, path))
                out.append((a, b, depth + 1, path + (self.leaves[a, depth] - entries[:, depth]) ** 2))
                begin = b
            elif b - begin > LEAVES:
                out.append((begin, a, depth, path))
                begin = a
        return out + ([(begin, hi, depth, path)] if begin < hi else [])

    def _levels(self, lo: int, hi: int, depth: int, path: np.ndarray, entries: np.ndarray) -> np.ndarray:
        """Sums of the leaves lo..hi-1 from those of the node above them, one level after the other."""
        shared = self.shared[lo:hi].copy()
        shared[0] = -1
        parents = np.zeros(1, dtype=np.int64)
        for d in range(depth, self.leaves.shape[1]):
            nodes = np.flatnonzero(shared <= d)
            path = path[np.searchsorted(parents, nodes, "right") - 1]
            path += (self.leaves[lo + nodes, d][:, None] - entries[:, d]) ** 2
            parents = nodes
        return path


def distinct_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows in lexicographic order, the place of each row among them, and their counts."""
    if not len(rows):
        return rows, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    if not rows.shape[1]:
        return rows[:1], np.zeros(len(rows), dtype=np.int64), np.array([len(rows)])
    order = np.lexsort(rows.T[::-1])
    ranked = rows[order]
    new = np.append(True, (ranked[1:] != ranked[:-1]).any(axis=1))
    place = np.empty(len(rows), dtype=np.int64)
    place[order] = np.cumsum(new) - 1
    return ranked[new], place, np.diff(np.append(np.flatnonzero(new), len(rows)))


@dataclass
class Codebooks:
    """Integer entries (positions x entries x width of a part)."""

    entries: np.ndarray

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def integer_vectors(df: DataFrame, key: str, vector: str, label: str, scale: int) -> DataFrame:
    """(id, label, v array<long>): floor(scale * component); no row whose vector is null or holds null or non-finite
    components."""
    whole = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale))
    fine = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    kept = F.col(vector).isNotNull() & fine
    return df.where(kept).select(F.col(key).alias("id"), F.col(label).alias("label"), whole.alias("v"))


def _matrix(column: pa.Array, positions: int, width: int) -> np.ndarray:
    """rows x positions x width; fails on vectors of another length and where a distance would not fit a long."""
    lengths = np.asarray(column.value_lengths())
    if (lengths != positions * width).any():
        raise ValueError(f"all vectors must have {positions * width} components")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(flat) and 4 * positions * width * max(abs(int(flat.min())), abs(int(flat.max()))) ** 2 >= 1 << 63:
        raise ValueError("components are too large for exact distances")
    return flat.reshape(-1, positions, width)


def _stored_parts(vectors: DataFrame, positions: int, width: int) -> DataFrame:
    """(position, leaves, counts): the distinct parts of all vectors, sorted, in rows of at most STORED leaves.

    Copies are counted in the tasks first, so a vector that a third of the rows repeat moves once a batch.
    """
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _matrix(batch.column(0), positions, width)
            for position in range(positions):
                leaves, _, counts = distinct_rows(rows[:, position])
                packed = (leaves + SHIFT).astype(WORD).tobytes()
                size = width * WORD.itemsize
                yield pa.RecordBatch.from_arrays([
                    pa.array([position] * len(counts), pa.int32()),
                    pa.array([packed[k * size:(k + 1) * size] for k in range(len(counts))], pa.binary()),
                    pa.array(counts, pa.int64()),
                ], ["position", "part", "n"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, int]] = []
        at = -1

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([
                pa.array([at], pa.int32()), pa.array([b"".join(p for p, _ in held)], pa.binary()),
                pa.array([np.array([n for _, n in held], dtype=np.int64).tobytes()], pa.binary()),
            ], ["position", "leaves", "counts"])

        for batch in batches:
            for position, part, n in zip(*[c.to_pylist() for c in batch.columns]):
                if held and position == at and held[-1][0] == part:
                    held[-1] = part, held[-1][1] + n
                    continue
                if held and (position != at or len(held) >= STORED):
                    yield row()
                    held = []
                held.append((part, n))
                at = position
        if held:
            yield row()

    parts = vectors.select("v").mapInArrow(split, "position int, part binary, n long")
    ranged = parts.repartitionByRange("position", "part").sortWithinPartitions("position", "part")
    return staged(ranged.mapInArrow(merge, "position int, leaves binary, counts binary"), "trie-parts")


def _moved(stored: DataFrame, books: np.ndarray) -> np.ndarray:
    """Entries after one round: floor of the mean of their parts; an entry without parts stays."""
    positions, size, width = books.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, number = np.zeros(books.shape, dtype=np.int64), np.zeros((positions, size), dtype=np.int64)
        for batch in batches:
            for position, leaves, counts in zip(*[c.to_pylist() for c in batch.columns]):
                weights = np.frombuffer(counts, dtype=np.int64)
                rows = np.frombuffer(leaves, dtype=WORD).astype(np.int64).reshape(len(weights), width) - SHIFT
                best, _ = Trie(rows).nearest(books[position])
                np.add.at(total[position], best, rows * weights[:, None])
                np.add.at(number[position], best, weights)
        position, entry = np.nonzero(number)
        yield pa.RecordBatch.from_arrays([
            pa.array(position, pa.int32()), pa.array(entry, pa.int32()), pa.array(number[position, entry], pa.int64()),
            pa.array(list(total[position, entry]), pa.list_(pa.int64())),
        ], ["position", "entry", "n", "s"])

    found = stored.mapInArrow(sums, "position int, entry int, n long, s array<long>")
    rows = found.groupBy("position", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[d]).alias(f"s{d}") for d in range(width)])
    out = books.copy()
    # One row an entry of the codebooks reaches the driver.
    for row in rows.collect():
        out[row["position"], row["entry"]] = [row[f"s{d}"] // row["n"] for d in range(width)]
    return out


def fit(vectors: DataFrame, positions: int = 8, entries: int = 16, rounds: int = 6) -> Codebooks | None:
    """Codebooks of `integer_vectors` rows; they start as the parts of the vectors with the smallest ids.

    Null ids come last; of rows that repeat an id the smaller vector comes first. With fewer vectors there are fewer
    entries; none for an empty table.
    """
    first = [row["v"] for row in vectors.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()]
    if not first:
        return None
    if len({len(v) for v in first}) > 1 or len(first[0]) % positions:
        raise ValueError(f"vectors must have one length, a multiple of {positions}")
    width = len(first[0]) // positions
    books = np.array(first, dtype=np.int64).reshape(len(first), positions, width).transpose(1, 0, 2).copy()
    stored = _stored_parts(vectors, positions, width)
    for _ in range(rounds):
        books = _moved(stored, books)
    return Codebooks(books)


def codes(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """(id, label, code, error) of `integer_vectors` rows: entry numbers in part order as two hex digits each, and the
    squared distances summed over the parts."""
    positions, _, width = books.entries.shape

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _matrix(batch.column(2), positions, width)
            code, error = np.zeros((len(rows), positions), dtype=np.uint8), np.zeros(len(rows), dtype=np.int64)
            for position in range(positions):
                leaves, place, _ = distinct_rows(rows[:, position])
                best, distance = Trie(leaves).nearest(books.entries[position])
                code[:, position] = best[place]
                error += distance[place]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array(error),
            ], ["id", "label", "code", "error"])

    kinds = ", ".join(f"{c} {vectors.schema[c].dataType.simpleString()}" for c in ("id", "label"))
    return vectors.mapInArrow(assign, f"{kinds}, code string, error long")


def compress(
    df: DataFrame, key: str, vector: str, label: str, positions: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096
) -> DataFrame:
    """(key, code, error, label_error, codebooks_sha256) of every row of `df` whose vector is whole and finite.

    Rows that repeat an id or a vector each count and each give a row. `label_error` is the error summed over equal
    labels, null labels together. An empty table gives no rows. Only the three columns are read, so others cannot
    clash. Vectors of unequal length, or too large for exact long distances, fail the job.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits a part")
    vectors = integer_vectors(df, key, vector, label, scale)
    books = fit(vectors, positions, entries, rounds)
    if books is None:
        found, digest = vectors.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), ""
    else:
        found, digest = staged(codes(vectors, books), "trie-codes"), books.digest()
    sums = found.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    return found.join(sums, F.col("label").eqNullSafe(F.col("_label"))).select(
        F.col("id").alias(key), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")
    )
