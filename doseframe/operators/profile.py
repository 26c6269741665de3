"""Profiles of a table: missing values, summaries, counts, distributions, top-k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import NumericType, StringType

from doseframe.functions.potency import nan_to_null, present
from doseframe.operators.ordering import exact_quantiles


def _numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def _long(one_row: DataFrame, entries: list[tuple[str, str, Column]]) -> DataFrame:
    """One aggregate row to (column, stat, value)."""
    return one_row.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(s).alias("stat"), v.cast("double").alias("value"))
        for c, s, v in entries
    ])))


def melt(df: DataFrame, ids: Sequence[str], cols: Sequence[str], name: str = "column", value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(cols), name, value)


def null_counts(df: DataFrame) -> DataFrame:
    """(column, nulls) of every column from one pass, most nulls first."""
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return melt(row, [], df.columns, "column", "nulls").orderBy(F.desc("nulls"), "column")


def describe(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, stat, value): count, null_count, mean, std, min, quartiles, max.

    Mean and std show NaN when the column holds one; min, max and quartiles pass over it.
    """
    cols = list(cols or _numeric(df))
    quartiles = exact_quantiles(df, cols, [0.25, 0.5, 0.75])
    row = df.agg(*[
        agg.alias(f"{stat}_{i}")
        for i, c in enumerate(cols)
        for stat, agg in (
            ("count", F.count(c)), ("null_count", F.count_if(F.col(c).isNull())),
            ("mean", F.avg(c)), ("std", F.stddev_samp(c)),
            ("min", F.min(nan_to_null(c))), ("max", F.max(nan_to_null(c))),
        )
    ])
    entries = []
    for i, c in enumerate(cols):
        entries += [(c, s, F.col(f"{s}_{i}")) for s in ("count", "null_count", "mean", "std", "min", "max")]
        entries += [(c, s, F.lit(q)) for s, q in zip(("25%", "50%", "75%"), quartiles[c])]
    return _long(row, entries)


def describe_text(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, count, null_count, min, max) of the text columns, in one pass."""
    cols = list(cols or [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)])
    row = df.agg(*[
        F.struct(
            F.lit(c).alias("column"), F.count(c).alias("count"), F.count_if(F.col(c).isNull()).alias("null_count"),
            F.min(c).alias("min"), F.max(c).alias("max"),
        ).alias(f"c{i}")
        for i, c in enumerate(cols)
    ])
    return row.select(F.inline(F.array(*row.columns)))


def group_count(df: DataFrame, key: str, counted: str | None = None, out: str = "count") -> DataFrame:
    """Rows per key, or rows with a non-null `counted`."""
    return df.groupBy(key).agg(F.count(counted or "*").alias(out))


def top_groups(df: DataFrame, key: str, k: int = 15, counted: str | None = None) -> DataFrame:
    return group_count(df, key, counted).orderBy(F.desc("count"), F.asc_nulls_first(key)).limit(k)


def value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, value, count) for several columns in one pass; null is a value."""
    text = df.select(*[F.col(c).cast("string").alias(c) for c in cols])
    return melt(text, [], cols).groupBy("column", "value").agg(F.count("*").alias("count"))


def share(df: DataFrame, condition: Column) -> DataFrame:
    """Share of all rows that meet the condition; undecided rows count as not meeting it."""
    return df.agg(
        F.count_if(condition).alias("passing"), F.count("*").alias("rows"),
        F.try_divide(F.count_if(condition), F.count("*")).alias("share"),
    )


def top_rows(df: DataFrame, label: str, structure: str, name: str, tie: Sequence[str], k: int = 8) -> DataFrame:
    """The k rows with the highest label, with a caption; a NaN label sorts first."""
    return (
        df.where(F.col(structure).isNotNull() & F.col(label).isNotNull())
        .orderBy(F.desc(label), *tie)
        .limit(k)
        .withColumn("caption", F.format_string("Target: %s\npIC50: %.2f", F.col(name), F.col(label)))
    )


def value_span(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, low, high) of the present values, in one pass."""
    row = df.agg(*[f(nan_to_null(c)).alias(f"{s}_{c}") for c in cols for s, f in (("lo", F.min), ("hi", F.max))])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"lo_{c}").alias("low"), F.col(f"hi_{c}").alias("high")) for c in cols
    ])))


def auto_bins(df: DataFrame, col: str) -> int:
    """Bin count of the automatic rule: the narrower of the Sturges and the
    Freedman-Diaconis width, the latter held to at least half the square-root width."""
    low, q1, q3, high = exact_quantiles(df, [col], [0.0, 0.25, 0.75, 1.0])[col]
    if low is None or low == high:
        return 1
    import math

    n = df.where(present(col)).count()
    span = high - low
    sturges = span / (math.log2(n) + 1)
    spread = 2 * (q3 - q1) / n ** (1 / 3)
    width = min(max(spread, span / math.sqrt(n) / 2), sturges) if spread else sturges
    return max(1, math.ceil(span / width))


def histogram(df: DataFrame, col: str, bins: int | None = None) -> DataFrame:
    """(bin, low, high, count) of equal-width bins over the present values, empty bins included."""
    bins = bins or auto_bins(df, col)
    x = F.col(col).cast("double")
    data = df.where(present(col)).select(x.alias("x"))
    span = data.agg(F.struct(F.min("x").alias("lo"), F.max("x").alias("hi")).alias("s")).scalar()
    low = span.getField("lo")
    width = (span.getField("hi") - low) / F.lit(float(bins))
    place = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor(F.try_divide(F.col("x") - low, width)), F.lit(bins - 1))
    )
    counts = data.groupBy(place.cast("bigint").alias("bin")).agg(F.count("*").alias("n"))
    frame = df.sparkSession.range(bins).withColumnRenamed("id", "bin")
    # The number of bins may grow with the rows: the sides' sizes decide how they are joined.
    return frame.join(counts, "bin", "left").select(
        "bin",
        (low + width * F.col("bin")).alias("low"),
        (low + width * (F.col("bin") + 1)).alias("high"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("count"),
    )


REACH = 8  # bandwidths


def density_curve(df: DataFrame, col: str, points: int = 200) -> DataFrame:
    """(point, x, density): Gaussian kernel density from the least to the largest value, n^(-1/5) * std bandwidth.

    Values are gathered in cells of at most a sixteenth of the bandwidth, whatever the range, so far outliers do
    not blur the rest; what lies beyond REACH bandwidths (a share of 1e-14 of a peak) adds nothing. A column without
    spread has no curve (no rows).
    """
    data = df.where(present(col)).select(F.col(col).cast("double").alias("x"))
    stats = data.agg(F.struct(
        F.count("*").alias("n"), F.stddev_samp("x").alias("sd"), F.min("x").alias("lo"), F.max("x").alias("hi")
    ).alias("s")).scalar()
    low, high = stats.getField("lo"), stats.getField("hi")
    bandwidth = stats.getField("sd") * F.pow(stats.getField("n").cast("double"), F.lit(-0.2))
    # A power of two: the last digit of the deviation does not move values to other cells.
    sized = data.withColumn("bw", bandwidth).where(F.col("bw") > 0)
    sized = sized.withColumn("width", F.pow(F.lit(2.0), F.floor(F.log2(F.col("bw") / 16))))
    cells = sized.groupBy("bw", "width", F.floor((F.col("x") - low) / F.col("width")).alias("cell")).agg(F.count("*").alias("count"))
    # A cell meets only the points of the grid within REACH bandwidths of it, however many points or cells there are.
    step = (high - low) / F.lit(points - 1.0)
    near = [(F.col("c") + side * REACH * F.col("bw") - low) / step for side in (-1, 1)]
    first, last = F.greatest(F.ceil(near[0]), F.lit(0)), F.least(F.floor(near[1]), F.lit(points - 1))
    centred = cells.select("bw", "count", (low + F.col("width") * (F.col("cell") + 0.5)).alias("c"))
    spread = centred.withColumns({"first": first, "last": last}).where("first <= last").select(
        "bw", "count", "c", F.explode(F.sequence("first", "last")).alias("i")
    )
    kernel = F.exp(-0.5 * F.pow((low + step * F.col("i") - F.col("c")) / F.col("bw"), F.lit(2.0)))
    norm = stats.getField("n") * F.col("bw") * F.sqrt(F.lit(2.0) * F.pi())
    heights = spread.groupBy("i").agg(F.sum(F.col("count") * kernel / norm).alias("density"))
    grid = df.sparkSession.range(points).select(F.col("id").alias("i")).where(bandwidth > 0)
    return grid.join(heights, "i", "left").select(
        F.col("i").alias("point"), (low + (high - low) * F.col("i") / F.lit(points - 1.0)).alias("x"),
        F.coalesce("density", F.lit(0.0)).alias("density"),
    )


def box_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, q1, median, q3, whisker_low, whisker_high, below, above) with 1.5 IQR fences."""
    cols = [c for c in cols if c in df.columns]
    q = exact_quantiles(df, cols, [0.25, 0.5, 0.75])
    cols = [c for c in cols if q[c][0] is not None]
    aggs, entries = [], []
    for i, c in enumerate(cols):
        q1, mid, q3 = q[c]
        lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        x = nan_to_null(c)
        inside = F.when(x.between(lo, hi), x)
        aggs += [
            F.min(inside).alias(f"wl{i}"), F.max(inside).alias(f"wh{i}"),
            F.count_if(x < lo).alias(f"nb{i}"), F.count_if(x > hi).alias(f"na{i}"),
        ]
        entries.append(F.struct(
            F.lit(c).alias("column"), F.lit(q1).alias("q1"), F.lit(mid).alias("median"), F.lit(q3).alias("q3"),
            F.col(f"wl{i}").alias("whisker_low"), F.col(f"wh{i}").alias("whisker_high"),
            F.col(f"nb{i}").alias("below"), F.col(f"na{i}").alias("above"),
        ))
    return df.agg(*aggs).select(F.inline(F.array(*entries)))


def split_sizes(df: DataFrame, split: str = "split") -> DataFrame:
    """One row n_train, n_val, n_test."""
    return df.agg(*[F.count_if(F.col(split) == s).alias(f"n_{s}") for s in ("train", "val", "test")])


def any_nan(df: DataFrame, vector: str) -> DataFrame:
    """Does any vector hold a NaN?"""
    return df.agg(F.coalesce(F.bool_or(F.exists(vector, lambda v: F.isnan(v))), F.lit(False)).alias("has_nan"))
