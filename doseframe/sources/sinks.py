"""Parquet sinks with row counts taken while writing."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

log = logging.getLogger(__name__)

# Tables exported at the same time.
SIDE_BY_SIDE = 4


def write_parquet(df: DataFrame, path: str) -> int:
    """Overwrite `path`, zstd-compressed; returns the rows written, counted in the same pass."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").option("compression", "zstd").parquet(path)
    return seen.get["rows"]


def export_tables(
    spark: SparkSession, names: Iterable[str], read: Callable[[str], DataFrame], out_dir: str, limit: int | None = None
) -> DataFrame:
    """Each table to `out_dir`/raw_<table>.parquet; a table that fails is logged and skipped.

    Returns (table_name, rows, ok, truncated, error), one row per table. Tables are written whole unless the
    caller gives a limit; a table cut by it is marked. Tables are written side by side.
    """
    def one(name: str) -> tuple:
        try:
            df = read(name)
            # A limit runs in one task, so it is only put on a table that is longer.
            cut = limit is not None and df.count() > limit
            return name, write_parquet(df.limit(limit) if cut else df, f"{out_dir}/raw_{name}.parquet"), True, cut, None
        except Exception as exc:  # one bad table must not stop the others
            log.error("export of %s failed: %s", name, exc)
            return name, None, False, False, (str(exc).splitlines() or [type(exc).__name__])[0]

    with ThreadPoolExecutor(SIDE_BY_SIDE) as pool:
        status = list(pool.map(one, sorted(names)))
    return spark.createDataFrame(status, "table_name string, rows bigint, ok boolean, truncated boolean, error string")
