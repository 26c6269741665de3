"""Small text helpers shared by the operators of this subpackage."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """A-Z lowered, every other character kept."""
    return F.translate(col, UPPER, LOWER)


def words(text: str | None) -> list[bytes]:
    """Runs of anything but space and the control characters 9 to 13, with A-Z lowered, as UTF-8.

    `bytes.lower` and `bytes.split` treat exactly these characters; a null text has no words.
    """
    return [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The same of many texts at once: the text of each word, and the words."""
    return split_at_space(pc.ascii_lower(texts.cast(pa.binary()).view(pa.string())))


def split_at_space(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The words of many texts as they are written."""
    lists = pc.ascii_split_whitespace(texts.cast(pa.binary()).view(pa.string()))
    found = lists.flatten()
    many = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    some = pc.not_equal(pc.binary_length(found), 0)   # space at an end leaves an empty word
    return np.repeat(np.arange(len(texts)), many)[some.to_numpy(zero_copy_only=False)], found.filter(some)


def id_fold(col: Column, folds: int) -> Column:
    """crc32 of an id's decimal text modulo `folds`; null for a null id."""
    return F.crc32(col.cast("string").cast("binary")) % folds


def fold_of(value: int, folds: int) -> int:
    """The same in Python."""
    return zlib.crc32(str(value).encode()) % folds


def unused(df: DataFrame, name: str) -> str:
    """`name`, with underscores until no column of `df` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def byte_groups(batch: pa.RecordBatch, column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch, in order, whose values of a binary or text column have at most `limit` bytes in all;
    a value beyond the limit is a slice of its own."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    lo, done = 0, 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(upto, done + limit, "right")))
        yield batch.slice(lo, hi - lo)
        lo, done = hi, int(upto[hi - 1])
