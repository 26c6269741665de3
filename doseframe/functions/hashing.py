"""Seeded hash order as JVM expressions, hashed fingerprints over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

from doseframe import schemas as S

try:
    from _md5 import md5  # of short texts in two thirds of the time
except ImportError:
    from hashlib import md5


def seeded_hash(keys: list[str | Column], seed: int) -> Column:
    """md5 of 'seed:key1:key2...' as 32 hex digits: a repeatable shuffle order."""
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in cols]))


def hash_bucket(text: Column, buckets: int) -> Column:
    """md5 of the text, reduced to 0..buckets-1."""
    return (F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("bigint") % F.lit(buckets)).cast("int")


def word_tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def structure_tokens(text: Column) -> Column:
    """Tokens of a line notation: bracket atoms, two-letter elements, ring labels, single signs."""
    return F.regexp_extract_all(text, F.lit(r"(\[[^\]]+\]|Br|Cl|%\d{2}|.)"), F.lit(1))


def _set_bits(words: Sequence[bytes | None], n_bits: int, radius: int) -> np.ndarray:
    """Sorted distinct `hash_bucket` values of the runs of 1 to radius + 1 words; no run goes over a null."""
    runs: set[bytes] = set()
    for missing, part in groupby(words, lambda w: w is None) if None in words else [(False, words)]:
        if not missing:
            part = list(part)
            runs.update(part)
            for size in range(2, radius + 2):
                runs.update(map(b" ".join, zip(*[part[i:] for i in range(size)])))
    digests = b"".join([md5(run).digest() for run in runs])
    # The first seven hex digits of each digest.
    return np.unique((np.frombuffer(digests, ">u4")[::4] >> 4) % n_bits).astype(np.int32)


def _lists(found: Iterable[np.ndarray | None]) -> pa.Array:
    return pa.array(found, pa.list_(pa.int32()))


def hashed_fingerprint(tokens: str, n_bits: int = S.FINGERPRINT_BITS, radius: int = 2) -> Column:
    """Sorted set bits of all token runs of length 1..radius+1.

    `tokens` names an array column. A run plays the part a circular substructure has in a
    chemical fingerprint; the bits are not those of a chemistry library. Null stays null.
    """
    @F.arrow_udf("array<int>")
    def bits(rows: pa.Array) -> pa.Array:
        rows = rows.cast(pa.list_(pa.binary()))
        return _lists([None if r is None else _set_bits(r, n_bits, radius) for r in rows.to_pylist()])

    return bits(F.col(tokens))


def text_fingerprint(text: str, n_bits: int = S.FINGERPRINT_BITS, radius: int = 2) -> Column:
    """`hashed_fingerprint` of the text's `word_tokens`; `bytes.split` cuts where that pattern does."""
    @F.arrow_udf("array<int>")
    def bits(rows: pa.Array) -> pa.Array:
        return _lists([None if r is None else _set_bits(r.split(), n_bits, radius) for r in rows.cast(pa.binary()).to_pylist()])

    return bits(F.col(text))
