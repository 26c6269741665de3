"""Hashed terms of texts, a bounded sample of labelled rows, and the terms that tell labels apart."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType

from doseframe.llm.text import split_words, words
from doseframe.session import staged

# Labelled rows of each class that a classifier is fitted on at most (chosen by a hash of the id).
FIT_ROWS_PER_CLASS = 5_000
# Terms a classifier uses at most, and the least evidence (likelihood ratio statistic) and rows of each.
MAX_TERMS, LEAST_EVIDENCE, LEAST_ROWS = 4_096, 15.0, 4
PREFIXES = (4, 5, 6)
EDGE = b".,;:!?\"'()[]{}<>*#&-_"
SYMBOLS = b"#&*@$%^~|<>{}[]=+\\/_0123456789"

# The same as tables over bytes, and that of the checksum.
_EDGE, _SYMBOL = (np.isin(np.arange(256), list(kinds)) for kinds in (EDGE, SYMBOLS))
_CRC = np.array([zlib.crc32(bytes([b]), 0xFFFFFFFF) ^ 0xFFFFFFFF for b in range(256)], dtype=np.uint32)

# Checksums go on from that of the mark before the text.
WORD, MARKS = zlib.crc32(b"w"), [(n, zlib.crc32(b"p%d" % n)) for n in PREFIXES]


def prefix_terms(bare: bytes, crc32=zlib.crc32) -> list[int]:
    """Hashes of the first bytes of a word without edge punctuation."""
    size = len(bare)
    return [crc32(bare[:n], mark) for n, mark in MARKS if size >= n]


def word_terms(word: bytes) -> tuple[int, ...]:
    """Hashes of a word without edge punctuation and of its first bytes."""
    bare = word.strip(EDGE) or word
    return (zlib.crc32(bare, WORD), *prefix_terms(bare))


def shape_terms(found: list[bytes], distinct: int) -> tuple[int, ...]:
    """Hashes of coarse shape: length, repetition, word length, symbols. A text without words has the first only."""
    joined = b"".join(found)
    size = len(joined)
    return tuple(map(shape_hash, shape_marks(len(found), distinct, size, size - len(joined.translate(None, SYMBOLS)))))


def shape_marks(n: int, distinct: int, size: int, symbols: int) -> list[tuple[bytes, int]]:
    """Coarse shape of `n` words, `distinct` of them distinct, with `size` bytes, `symbols` of which are symbols."""
    marks = [(b"n", int(math.log2(n + 1) * 2))]
    if n:
        marks += [(b"r", int(20 * distinct / n)), (b"l", int(2 * size / n)), (b"s", int(min(40, 100 * symbols / size)))]
    return marks


def shape_hash(mark: tuple[bytes, int]) -> int:
    return zlib.crc32(b"shape%b%d" % mark)


def terms_of(text: str | None) -> np.ndarray:
    """Sorted distinct term hashes of a whole text."""
    found = words(text)
    kinds = set(found)
    got = set(shape_terms(found, len(kinds)))
    for w in kinds:
        got.update(word_terms(w))
    return np.array(sorted(got), dtype=np.int64)


@F.pandas_udf(ArrayType(LongType()))
def term_column(texts: pd.Series) -> pd.Series:
    return pd.Series([terms_of(t) for t in texts], index=texts.index, dtype=object)


def slots_of(terms: np.ndarray, slots: int) -> np.ndarray:
    """Sorted distinct places of term hashes in a table of `slots`."""
    return np.unique(np.asarray(terms, dtype=np.int64) % slots)


class SlotIndex:
    """Places of all terms of a text in a table of `slots`; remembers the words it has met."""

    KEPT_WORDS = 100_000

    def __init__(self, slots: int):
        self.slots = slots
        self.known: dict[bytes, tuple[int, ...]] = {}

    def find(self, text: str | None) -> list[int]:
        found = words(text)
        kinds = set(found)
        slots, known = self.slots, self.known
        got = {t % slots for t in shape_terms(found, len(kinds))}
        for w in kinds:
            hits = known.get(w)
            if hits is None:
                if len(known) >= self.KEPT_WORDS:
                    known.clear()
                hits = known[w] = tuple(t % slots for t in word_terms(w))
            got.update(hits)
        return sorted(got)


class TermIndex:
    """Positions of the chosen terms that a text holds; remembers the words and first bytes it has met."""

    KEPT_WORDS = 200_000

    def __init__(self, chosen: np.ndarray):
        self.place = {int(t): i for i, t in enumerate(chosen)}
        self._forget()

    def _forget(self) -> None:
        # Most words hold no chosen term: sets tell in one step which are new and which count.
        self.met: set[bytes] = set()
        self.telling: set[bytes] = set()
        self.hits: dict[bytes, tuple[int, ...]] = {}
        self.heads: dict[bytes, tuple[int, ...]] = {}

    def _learn(self, new: set[bytes]) -> None:
        place, heads, longest, crc32 = self.place, self.heads, PREFIXES[-1], zlib.crc32
        for w in new:
            bare = w.strip(EDGE) or w
            head = bare[:longest]
            hits = heads.get(head)
            if hits is None:
                hits = heads[head] = tuple([place[t] for t in prefix_terms(head) if t in place])
            own = place.get(crc32(bare, WORD))
            if hits or own is not None:
                self.hits[w] = hits if own is None else (own, *hits)
                self.telling.add(w)

    def find(self, found: list[bytes]) -> list[int]:
        """Sorted positions for the words of a text."""
        kinds, place = set(found), self.place
        if len(self.met) >= self.KEPT_WORDS:
            self._forget()
        new = kinds.difference(self.met)
        self.met |= new
        self._learn(new)
        got = {place[t] for t in shape_terms(found, len(kinds)) if t in place}
        for w in kinds & self.telling:
            got.update(self.hits[w])
        return sorted(got)


def _distinct_pairs(a: np.ndarray, b: np.ndarray, below_a: int, below_b: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of two arrays of numbers below the given ones, in order."""
    below_b = max(1, below_b)
    both = np.sort((a * below_b + b).astype(np.uint32 if below_a * below_b <= 1 << 32 else np.int64))
    both = both[np.flatnonzero(np.diff(both, prepend=both[:1] + 1))]
    first, second = np.divmod(both, both.dtype.type(below_b))
    return first.astype(np.int64), second.astype(np.int64)


class TermTable:
    """Positions of the chosen terms in many texts at once, by array operations; equal to TermIndex and without a memory.

    Words are split and made distinct in Arrow, and the hashes of all distinct words are computed together.
    """

    LONGEST = 64   # bytes of a word; longer ones are hashed one by one

    def __init__(self, chosen: np.ndarray):
        self.chosen = np.asarray(chosen, dtype=np.int64)
        self.order = np.argsort(self.chosen, kind="stable")
        self.sorted = self.chosen[self.order]
        self.maybe = np.zeros(1 << 16, dtype=bool)
        self.maybe[self.sorted & 0xFFFF] = True
        self.shapes: dict[tuple[bytes, int], int] = {}

    def _places(self, hashes: np.ndarray) -> np.ndarray:
        """Position of each hash among the chosen terms, -1 without one."""
        out = np.full(len(hashes), -1, dtype=np.int64)
        some = np.flatnonzero(self.maybe[hashes & 0xFFFF])
        values = hashes[some].astype(np.int64)
        found = _among(values, self.sorted)
        out[some[found]] = self.order[np.searchsorted(self.sorted, values[found])]
        return out

    def _shape(self, mark: tuple[bytes, int]) -> int:
        at = self.shapes.get(mark)
        if at is None:
            at = self.shapes[mark] = int(self._places(np.array([shape_hash(mark)]))[0])
        return at

    def _word_places(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, position) of the chosen terms of words, given as parts of `data`."""
        long = np.flatnonzero(end - start > self.LONGEST)
        short = np.flatnonzero(end - start <= self.LONGEST)
        lo, hi = start[short].astype(np.int64), end[short].astype(np.int64)
        edge = np.arange(len(lo))
        while len(edge):
            edge = edge[_EDGE[data[lo[edge]]]]
            lo[edge] += 1
            edge = edge[lo[edge] < hi[edge]]
        empty = lo == hi    # edge punctuation alone counts as it is
        lo[empty] = start[short[empty]]
        edge = np.flatnonzero(~empty)
        while len(edge):    # ends at a byte that is no edge
            edge = edge[_EDGE[data[hi[edge] - 1]]]
            hi[edge] -= 1
        by_size = np.argsort(lo - hi, kind="stable")   # longest first: words with a byte left come before the others
        lo, size, word = lo[by_size], (hi - lo)[by_size], short[by_size]
        words_at, places_at = [], []

        def keep(which: np.ndarray, hashes: np.ndarray) -> None:
            at = self._places(hashes)
            hit = np.flatnonzero(at >= 0)
            words_at.append(which[hit])
            places_at.append(at[hit])

        states = {mark: np.full(len(lo), mark ^ 0xFFFFFFFF, dtype=np.uint32) for mark in (WORD, *(m for _, m in MARKS))}
        until = {WORD: self.LONGEST, **{mark: n for n, mark in MARKS}}
        for j in range(int(size[0]) if len(size) else 0):
            m = int(np.searchsorted(-size, -j, "left"))   # words of more than j bytes
            byte = data[lo[:m] + j]
            for mark, state in states.items():
                if j < until[mark]:
                    state[:m] = _CRC[(state[:m] ^ byte) & 0xFF] ^ (state[:m] >> 8)
        keep(word, states[WORD] ^ 0xFFFFFFFF)
        for n, mark in MARKS:
            m = int(np.searchsorted(-size, -n, "right"))
            keep(word[:m], states[mark][:m] ^ 0xFFFFFFFF)
        for i in long:
            hashes = np.array(word_terms(data[start[i]:end[i]].tobytes()), dtype=np.int64)
            keep(np.full(len(hashes), i), hashes)
        return np.concatenate(words_at), np.concatenate(places_at)

    def find(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words of each text; then pairs (text, position), distinct and in order."""
        n = len(texts)
        of, found = split_words(texts)
        coded = found.dictionary_encode()
        code, kinds = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
        bounds = np.frombuffer(kinds.buffers()[1], dtype=np.int32)[kinds.offset:kinds.offset + len(kinds) + 1]
        data = np.frombuffer(kinds.buffers()[2] or b"", dtype=np.uint8)
        size = np.diff(bounds) if len(kinds) else np.empty(0, np.int32)
        symbol = np.concatenate(([0], np.cumsum(_SYMBOL[data], dtype=np.int64)))
        symbols = symbol[bounds[1:]] - symbol[bounds[:-1]] if len(kinds) else size
        words_of = np.bincount(of, minlength=n)
        bytes_of = np.bincount(of, size[code], n)
        symbols_of = np.bincount(of, symbols[code], n)
        of, code = _distinct_pairs(of, code, n, len(kinds))
        distinct = np.bincount(of, minlength=n)
        shape_of, shape_at = [], []
        shapes = zip(words_of.tolist(), distinct.tolist(), bytes_of.astype(np.int64).tolist(), symbols_of.astype(np.int64).tolist())
        for i, shape in enumerate(shapes):
            for mark in shape_marks(*shape):
                at = self._shape(mark)
                if at >= 0:
                    shape_of.append(i)
                    shape_at.append(at)
        word, place = self._word_places(data, bounds[:-1], bounds[1:]) if len(kinds) else (np.empty(0, np.int64),) * 2
        by_word = np.argsort(word, kind="stable")
        place = place[by_word]
        first = np.searchsorted(word[by_word], np.arange(len(kinds) + 1))
        many = np.diff(first)
        telling = np.flatnonzero(many[code]) if len(code) else np.empty(0, np.int64)
        of, code = of[telling], code[telling]
        each = many[code]
        at = np.repeat(first[code] - (np.cumsum(each) - each), each) + np.arange(each.sum())
        hit_of = np.concatenate((np.repeat(of, each), np.array(shape_of, dtype=np.int64)))
        hits = np.concatenate((place[at], np.array(shape_at, dtype=np.int64)))
        return words_of, *_distinct_pairs(hit_of, hits, n, len(self.chosen))


def labelled_sample(
    docs: DataFrame, text: str, labels: DataFrame, classes: int, per_class: int = FIT_ROWS_PER_CLASS
) -> tuple[DataFrame, list[int]]:
    """Rows (doc_id, label, terms) of at most `per_class` labelled rows a class, and all rows a class has.

    `labels` has doc_id and label (0 to classes - 1); null ids and labels take no part and of an id's
    repeated rows the largest label counts. The choice goes by a hash of the id. Near copies of a text
    (equal smallest terms) count once, so that one copied text does not pass for many. Only the bounded
    list of chosen ids is sent to the scan of `docs`; no text is moved.
    """
    known = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    known = staged(known, "labels")
    totals = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64("doc_id")
    chosen = None
    for c in range(classes):
        part = known.where(F.col("label") == c).orderBy(order, "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select(F.col("doc_id"), F.col(text).alias("_text"))
    rows = texts.join(F.broadcast(staged(chosen, "chosen")), "doc_id").select("doc_id", "label", term_column("_text").alias("terms"))
    rows = staged(rows, "terms")
    first = F.min_by(F.struct("doc_id", "label"), F.struct("doc_id", "label"))
    keep = rows.groupBy(F.xxhash64(F.slice("terms", 1, 6)).alias("k")).agg(first.alias("f")).select("f.doc_id", "f.label")
    return rows.join(F.broadcast(keep.distinct()), ["doc_id", "label"]), [int(totals.get(c, 0)) for c in range(classes)]


def telling_terms(rows: DataFrame, classes: int) -> np.ndarray:
    """Hashes of the terms whose presence depends most on the class, at most MAX_TERMS."""
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    if total == 0:
        return np.empty(0, dtype=np.int64)
    counts = rows.select("label", F.explode("terms").alias("term")).groupBy("term").agg(
        *[F.sum((F.col("label") == c).cast("long")).alias(f"n{c}") for c in range(classes)]
    )
    n = sum((F.col(f"n{c}") for c in range(1, classes)), F.col("n0")).cast("double")
    evidence = F.lit(0.0)
    for c in range(classes):
        size = float(sizes.get(c, 0))
        if 0 < size:
            for seen, of in ((F.col(f"n{c}").cast("double"), n), (F.lit(size) - F.col(f"n{c}"), F.lit(float(total)) - n)):
                evidence = evidence + F.when((seen > 0) & (of > 0), 2 * seen * F.log(seen * total / (of * size))).otherwise(0.0)
    top = counts.select("term", n.alias("n"), evidence.alias("e")).where((F.col("n") >= LEAST_ROWS) & (F.col("e") >= LEAST_EVIDENCE))
    return np.array([r["term"] for r in top.orderBy(F.desc("e"), "term").limit(MAX_TERMS).collect()], dtype=np.int64)


def _among(values: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """Which of the values occur among sorted terms."""
    at = np.searchsorted(terms, values)
    at[at == len(terms)] = 0
    return terms[at] == values if len(terms) else np.zeros(len(values), dtype=bool)


def _collected(rows: DataFrame) -> list:
    """Rows by doc_id and label; sorted here, since a sort in Spark would evaluate their columns twice."""
    return sorted(rows.collect(), key=lambda r: (r["doc_id"], r["label"]))


def chosen_rows(rows: DataFrame, chosen: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Positions of the chosen terms in each row and the rows' labels, on the driver: bounded by the sample."""
    order = np.sort(chosen)
    rank = np.argsort(chosen, kind="stable")

    @F.pandas_udf("array<int>")
    def places(terms: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in terms:
            yield pd.Series([rank[np.flatnonzero(_among(order, t))].astype(np.int32) for t in batch], dtype=object)

    got = _collected(rows.select("doc_id", "label", places("terms").alias("p")))
    return [np.array(sorted(r["p"]), dtype=np.int64) for r in got], np.array([r["label"] for r in got], dtype=np.int64)


def slot_rows(rows: DataFrame, slots: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Places of all terms of each row and the rows' labels, on the driver: bounded by the sample."""
    @F.pandas_udf("binary")
    def places(terms: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in terms:
            yield pd.Series([slots_of(t, slots).astype(np.int32).tobytes() for t in batch], dtype=object)

    got = _collected(rows.select("doc_id", "label", places("terms").alias("p")))
    return [np.frombuffer(r["p"], dtype=np.int32) for r in got], np.array([r["label"] for r in got], dtype=np.int64)


def padded(rows: list[np.ndarray], pad: int) -> np.ndarray:
    """Rows of positions as one matrix, filled up with `pad`."""
    out = np.full((len(rows), max([1, *map(len, rows)])), pad, dtype=np.int64)
    for i, r in enumerate(rows):
        out[i, :len(r)] = r
    return out


def column_of(text: str | Column) -> Column:
    return F.col(text) if isinstance(text, str) else text
