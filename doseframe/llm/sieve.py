"""A Bloom filter of fixed size, to drop rows before a join moves them.

It never drops a row that has a partner. Its size does not depend on the data: with very many keys it drops less,
and the join that follows does the rest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

BITS, HASHES = 1 << 25, 3


def _places(keys: np.ndarray) -> Iterator[np.ndarray]:
    x = keys.astype(np.int64).view(np.uint64)
    for i in range(1, HASHES + 1):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15 + 2 * i)
        x = x ^ (x >> np.uint64(29))
        yield x >> np.uint64(64 - 25)


def sieve(keys: DataFrame) -> Callable[[Column], Column]:
    """A condition that holds for every long among the only column of `keys`, and for few others; false for null."""
    name = keys.columns[0]

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = np.zeros(BITS // 64, dtype=np.uint64)
        for pdf in batches:
            for at in _places(pdf[name].to_numpy(np.int64)):
                np.bitwise_or.at(words, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        some = np.flatnonzero(words)
        yield pd.DataFrame({"at": some, "bits": words[some].view(np.int64)})

    rows = keys.where(F.col(name).isNotNull()).mapInPandas(fill, "at int, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(BITS // 64, dtype=np.uint64)
    words[rows["at"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)

    @F.pandas_udf("boolean")
    def holds(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            null = batch.isna().to_numpy()
            out = ~null
            for at in _places(batch.fillna(0).to_numpy(np.int64)):
                out &= ((words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)
            yield pd.Series(out, index=batch.index)

    return lambda col: holds(col)
