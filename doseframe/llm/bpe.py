"""Byte-level BPE by tree reduction: halves are encoded apart and joined at their boundary.

Encodings form a monoid under this join. The result for a byte string is the one token sequence in which
every token encodes to itself and every adjacent pair is stable: encoding the pair's bytes gives that
pair. So a join re-encodes a window around the boundary and widens it until the tokens at both of its
edges are those that were there before; everything outside is then proven unchanged.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from doseframe.llm.text import byte_groups

# Leaves of the reduction, in bytes. Any positive number gives the same tokens.
LEAF_BYTES = 16
# Encoded pattern matches kept per task; the memory is emptied when it is full.
KEPT_MATCHES = 400_000
# Windows longer than this are merged with a heap of pairs.
HEAP_BYTES = 96
NO_RANK = 1 << 60
# Texts whose ids are held at once.
GROUP_BYTES = 2 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank from a rank file: base64 token, space, rank."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class Merger:
    """Encodes byte strings by the ranks of a vocabulary; works without any pattern."""

    def __init__(self, ranks: dict[bytes, int], leaf: int = LEAF_BYTES):
        if leaf < 1:
            raise ValueError("leaves hold at least one byte")
        self.ranks, self.leaf = ranks, leaf

    def merge(self, data: bytes) -> list[bytes]:
        """The direct form: join the leftmost pair of lowest rank until no pair is in the vocabulary."""
        if len(data) > HEAP_BYTES:
            return self._merge_long(data)
        get = self.ranks.get
        parts = [data[i:i + 1] for i in range(len(data))]
        pairs = [get(data[i:i + 2], NO_RANK) for i in range(len(data) - 1)]
        while pairs:
            low = min(pairs)
            if low == NO_RANK:
                break
            i = pairs.index(low)
            parts[i] += parts[i + 1]
            del parts[i + 1], pairs[i]
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], NO_RANK)
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], NO_RANK)
        return parts

    def _merge_long(self, data: bytes) -> list[bytes]:
        """The same with a heap of pairs and linked parts, for windows that have grown long."""
        get, n = self.ranks.get, len(data)
        part: list[bytes | None] = [data[i:i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank, i, 2) for i in range(n - 1) if (rank := get(data[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = after[i]
            if part[i] is None or j >= n or len(part[i]) + len(part[j]) != size:
                continue  # one of the two has been joined meanwhile
            part[i], part[j] = part[i] + part[j], None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (rank := get(part[a] + part[b])) is not None:
                    heapq.heappush(heap, (rank, a, len(part[a]) + len(part[b])))
        return [p for p in part if p is not None]

    def join(self, left: list[bytes], right: list[bytes]) -> list[bytes]:
        """The encoding of two encoded neighbours together."""
        if not left or not right:
            return left + right
        a = b = 1
        while True:
            middle = self.merge(b"".join(left[-a:]) + b"".join(right[:b]))
            # An edge is stable when its token is kept: its pair with the token outside is one that
            # was there before. At the end of the string there is no pair to keep.
            left_ok = a == len(left) or middle[0] == left[-a]
            right_ok = b == len(right) or middle[-1] == right[b - 1]
            if left_ok and right_ok:
                return left[:len(left) - a] + middle + right[b:]
            if not left_ok:
                a = min(2 * a, len(left))
            if not right_ok:
                b = min(2 * b, len(right))

    def reduce(self, data: bytes) -> list[bytes]:
        """Encode by halves; level by level, so that long strings need no deep recursion."""
        level = [self.merge(data[i:i + self.leaf]) for i in range(0, len(data), self.leaf)]
        while len(level) > 1:
            joined = [self.join(a, b) for a, b in zip(level[::2], level[1::2])]
            level = joined + level[len(level) - len(level) % 2:]
        return level[0] if level else []

    def encode(self, data: bytes) -> tuple[int, ...]:
        """Ids of one pattern match. A match that is itself a token is that token, reachable or not."""
        rank = self.ranks.get(data)
        return (rank,) if rank is not None else tuple(self.ranks[t] for t in self.reduce(data))


class Tokenizer:
    """Splits texts by a pattern and encodes every match apart. A null text is an empty one."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf: int = LEAF_BYTES):
        self.merger, self.split = Merger(ranks, leaf), regex.compile(pattern).findall
        self.token = {rank: token for token, rank in ranks.items()}
        self.digits = {rank: str(rank) for rank in self.token}
        self.known: dict[str, tuple[int, ...]] = {}

    def encode(self, text: str | None) -> list[int]:
        ids: list[int] = []
        known, add = self.known, ids.extend
        for match in self.split(text or ""):
            found = known.get(match)
            if found is None:
                found = self.merger.encode(match.encode("utf-8", "replace"))
                if len(known) >= KEPT_MATCHES:
                    known.clear()
                if len(match) <= 64:
                    known[match] = found
            add(found)
        return ids

    def decode(self, ids) -> bytes:
        """Tokens concatenated; an unknown id raises KeyError."""
        return b"".join(map(self.token.__getitem__, ids))

    def digest(self, ids: list[int]) -> tuple[int, str, str]:
        """Number of ids, hash of the ids as decimal text joined by commas, hash of the decoded bytes."""
        joined = ",".join(map(self.digits.__getitem__, ids))
        return len(ids), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(self.decode(ids)).hexdigest()


def encode_column(text: Column, ranks: dict[bytes, int], pattern: str, leaf: int = LEAF_BYTES) -> Column:
    """array<int> of token ids; empty for null and empty texts. Ranks travel with the function: the
    vocabulary is a file of fixed size, so no executor needs the file itself."""
    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = Tokenizer(ranks, pattern, leaf)
        for texts in batches:
            yield pd.Series([tokenizer.encode(t) for t in texts], index=texts.index, dtype=object)

    return encode(text)


def decode_column(ids: Column, ranks: dict[bytes, int]) -> Column:
    """The UTF-8 bytes of array<int> ids; null ids give no bytes."""
    @F.pandas_udf("binary")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        token = {rank: t for t, rank in ranks.items()}
        for arrays in batches:
            yield pd.Series(
                [b"" if a is None else b"".join(map(token.__getitem__, a)) for a in arrays], index=arrays.index, dtype=object
            )

    return decode(ids)


def tokenized(
    df: DataFrame, kept: Sequence[str], text: str, ranks: dict[bytes, int], pattern: str, leaf: int = LEAF_BYTES
) -> DataFrame:
    """The `kept` columns of every row with n_tokens, ids array<int>, ids_sha256 and decoded_sha256 of its text.

    A null or empty text has no ids; rows that repeat a key or a text each give their row; columns that are not kept
    are not read. Texts are handled in groups of GROUP_BYTES, ids go from the list of one text into an integer array at
    once, and a group's rows leave the task before the next group is read; a longer text is a group of its own.
    """
    narrow = df.select(*kept, F.col(text).cast("binary").alias("_text"))
    at = len(kept)

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Tokenizer(ranks, pattern, leaf)
        for batch in batches:
            for part in byte_groups(batch, at, GROUP_BYTES):
                arrays, digests = [], []
                for raw in part.column(at):
                    ids = tokenizer.encode(raw.as_py().decode() if raw.is_valid else "")
                    arrays.append(np.array(ids, dtype=np.int32))
                    digests.append(tokenizer.digest(ids))
                offsets = np.cumsum([0, *map(len, arrays)], dtype=np.int64)
                values = np.concatenate(arrays) if arrays else np.empty(0, dtype=np.int32)
                n, ids_hash, bytes_hash = zip(*digests) if digests else ((), (), ())
                yield pa.RecordBatch.from_arrays([
                    *part.columns[:at], pa.array(n, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values)),
                    pa.array(ids_hash, pa.string()), pa.array(bytes_hash, pa.string()),
                ], [*kept, "n_tokens", "ids", "ids_sha256", "decoded_sha256"])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept)
    return narrow.mapInArrow(tasks, f"{kinds}, n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string")


def digest_column(text: Column, ranks: dict[bytes, int], pattern: str, leaf: int = LEAF_BYTES) -> Column:
    """Struct n_tokens, ids_sha256, decoded_sha256: encoded, decoded and hashed in one pass.

    The ids of long texts never leave the task that made them.
    """
    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tokenizer = Tokenizer(ranks, pattern, leaf)
        for texts in batches:
            rows = []
            for t in texts:
                rows.append(tokenizer.digest(tokenizer.encode(t)))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return digest(text)
