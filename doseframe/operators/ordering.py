"""Global order without a global sort: hash cuts, dense ranks, value ranks, order statistics.

Every single-partition window in this module runs over counts of buckets or range partitions, or SELECT_LIMIT values at most.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from doseframe.functions.hashing import seeded_hash
from doseframe.functions.potency import present
from doseframe.session import staged

HEX = 16
CUT_DIGITS = 4    # 65,536 buckets: a cut sorts 1/65,536 of the rows
RANGE_ROWS = 1_000_000  # rows of a range partition, but for the sampling error
LEAST_ROWS = 20_000     # fewer rows are not worth a partition of their own
VALUE_BUCKETS = 1000
SELECT_LIMIT = 200_000
PARTS = 64  # parts that a pass over distinct values cuts a span into


def _running(sizes: DataFrame, bucket: str) -> DataFrame:
    """Bucket counts (few, fixed) to (bucket, start, end, total)."""
    upto = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)
    return sizes.select(
        bucket,
        (F.sum("n").over(upto) - F.col("n")).alias("start"),
        F.sum("n").over(upto).alias("end"),
        F.sum("n").over(Window.partitionBy()).alias("total"),
    )


def hash_cuts(df: DataFrame, keys: Sequence[str], seed: int, goals: Callable[[Column], list[Column]]) -> Column:
    """Hashes at which the first `goal` rows in seeded hash order end, as one scalar struct c0, c1, ...

    The keys identify a row; where a cut would fall between rows of equal keys the job fails, because no
    exact cut exists. Two narrow scans: bucket counts, then the one bucket per goal that holds the
    boundary. The table itself is neither shuffled nor sorted. A goal of 0 gives null.
    """
    hashed = df.select(seeded_hash(list(keys), seed).alias("_h")).withColumn("_b", F.substring("_h", 1, CUT_DIGITS))
    run = _running(hashed.groupBy("_b").agg(F.count("*").alias("n")), "_b")
    wanted = goals(F.col("total"))
    hits = run.select(
        "_b", "start", "end",
        F.inline(F.array(*[F.struct(F.lit(i).alias("cut"), g.cast("bigint").alias("goal")) for i, g in enumerate(wanted)])),
    ).where((F.col("start") < F.col("goal")) & (F.col("goal") <= F.col("end")))
    # At most one row per goal, so the broadcast is bounded by the number of goals.
    order = Window.partitionBy("cut").orderBy("_h")
    edge = hashed.join(F.broadcast(hits), "_b").withColumns(
        {"_r": F.row_number().over(order), "_next": F.lead("_h").over(order)}
    ).where(F.col("_r") == F.col("goal") - F.col("start"))
    tied = F.raise_error(F.lit(f"the keys {', '.join(keys)} do not identify a row"))
    edge = edge.withColumn("_h", F.when(F.col("_next") == F.col("_h"), tied.cast("string")).otherwise(F.col("_h")))
    return edge.agg(
        F.struct(*[F.max(F.when(F.col("cut") == i, F.col("_h"))).alias(f"c{i}") for i in range(len(wanted))]).alias("cuts")
    ).scalar()


def exact_sample(df: DataFrame, n: int | None, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """Exactly n rows, repeatable; the whole table when n is empty or not below its size."""
    if not n:
        return df
    cuts = hash_cuts(df, keys, seed, lambda total: [F.when(F.lit(n) < total, F.lit(n))])
    return df.where(F.coalesce(seeded_hash(list(keys), seed) <= cuts.getField("c0"), F.lit(True)))


def positional_slice(df: DataFrame, lo: int, hi: int, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """Rows lo..hi-1 of the table in seeded hash order."""
    cuts = hash_cuts(df, keys, seed, lambda total: [F.least(F.lit(lo), total), F.least(F.lit(hi), total)])
    h = seeded_hash(list(keys), seed)
    above = F.lit(True) if lo <= 0 else h > cuts.getField("c0")
    return df.where(above & (h <= cuts.getField("c1")))


def range_parts(rows: int, cores: int) -> int:
    """Range partitions for so many rows: all cores busy, no partition above RANGE_ROWS at any size."""
    return max(1, -(-rows // RANGE_ROWS), min(cores, -(-rows // LEAST_ROWS)))


def ranged(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """`df` sorted by `order` over range partitions and written once, with `_part` and `_at`, the 0-based place in it.

    One shuffle; partitions follow each other in the order. Where `order` identifies a row, no value is hot.
    """
    spark = df.sparkSession
    parts = range_parts(df.count(), spark.sparkContext.defaultParallelism)
    # The id holds the partition's number above its lowest 33 bits, the place in it below.
    numbered = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    at = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    return staged(numbered.select(*df.columns, F.shiftright("_m", 33).alias("_part"), at.alias("_at")), name)


def hash_rank(df: DataFrame, keys: Sequence[str], seed: int = 42, out: str = "rank") -> DataFrame:
    """Dense 1-based rank in seeded hash order; the keys identify a row.

    Positions in range partitions plus the sizes of the partitions before: two levels, no fixed number of buckets.
    """
    rows = ranged(df.withColumn("_h", seeded_hash(list(keys), seed)), ["_h", *keys], "ranked")
    # One row a partition, that is one for RANGE_ROWS rows.
    starts = _running(rows.groupBy("_part").agg(F.count("*").alias("n")), "_part").select("_part", "start")
    rank = (F.col("start") + F.col("_at") + 1).cast("bigint")
    return rows.join(F.broadcast(starts), "_part").withColumn(out, rank).drop("_h", "_part", "_at", "start")


def running_before(df: DataFrame, group: str, value: str, sums: Sequence[str]) -> DataFrame:
    """(group, value, the sums, before_<sum>...): for each distinct (group, value) what lies below the value in its group.

    Range partitions of distinct values, prefix sums in each, and the totals of the partitions before.
    """
    rows = ranged(df.select(group, value, *sums), [group, value], "running")
    upto = Window.partitionBy("_part", group).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("_part", group).agg(*[F.sum(c).alias(c) for c in sums])
    # One row a partition and group.
    starts = totals.select("_part", group, *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_start_{c}") for c in sums])
    local = rows.withColumns({f"before_{c}": F.sum(c).over(upto) - F.col(c) for c in sums})
    return local.join(F.broadcast(starts), ["_part", group]).select(
        group, value, *sums, *[(F.col(f"before_{c}") + F.col(f"_start_{c}")).alias(f"before_{c}") for c in sums]
    )


def value_cuts(df: DataFrame, cols: Sequence[str], buckets: int = VALUE_BUCKETS) -> dict[str, list[float]]:
    """Distinct approximate quantiles per column: one pass, a fixed number of values each."""
    probs = [i / buckets for i in range(1, buckets)]
    found = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).approxQuantile(list(cols), probs, 0.5 / buckets)
    return {c: sorted({v + 0.0 for v in q if math.isfinite(v)}) for c, q in zip(cols, found)}


def value_ranks(
    df: DataFrame, col: str, cuts: list[float], extra: dict[str, Column] | None = None
) -> DataFrame:
    """One row per distinct value of `col`: value, n, before (rows below it) and `extra` aggregates.

    Copies of a value are combined before the shuffle; each range bucket is ordered on its own.
    """
    extra = extra or {}
    # Adding 0.0 makes -0.0 and 0.0 the same value before they are put into buckets.
    base = df.where(present(col)).withColumn(col, F.col(col).cast("double") + F.lit(0.0))
    inner = cuts or [0.0]
    base = Bucketizer(
        splits=[float("-inf"), *inner, float("inf")], inputCol=col, outputCol="_b", handleInvalid="keep"
    ).transform(base)
    counts = base.groupBy("_b", col).agg(F.count("*").alias("n"), *[a.alias(k) for k, a in extra.items()])
    offsets = _running(counts.groupBy("_b").agg(F.sum("n").alias("n")), "_b").select("_b", "start")
    upto = Window.partitionBy("_b").orderBy(col).rowsBetween(Window.unboundedPreceding, 0)
    return (
        counts.withColumn("_upto", F.sum("n").over(upto))
        .join(F.broadcast(offsets), "_b")
        .select(col, "n", (F.col("start") + F.col("_upto") - F.col("n")).alias("before"), *extra)
    )


def average_rank() -> Column:
    """Average rank of a value in a `value_ranks` table."""
    return F.col("before") + (F.col("n") + 1) / F.lit(2.0)


def order_statistics(df: DataFrame, wanted: dict[str, Callable[[int], list[int]]]) -> dict[str, tuple[int, dict[int, float]]]:
    """Exact values at 0-based positions of the ascending order, per column.

    `wanted[col]` maps the number of present values to the positions asked for. While the range
    that holds a position has more than SELECT_LIMIT rows, one pass with a bounded sketch narrows
    it; the last step counts the distinct values left in it. Only the answers reach the driver.
    """
    cols = list(wanted)
    vals = df.select(*[F.when(present(c), F.col(c).cast("double")).alias(c) for c in cols])
    first = vals.agg(
        *[f(c).alias(f"{k}_{i}") for i, c in enumerate(cols) for k, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]
    ).first()
    spans, answers = {}, {}
    for i, c in enumerate(cols):
        n = first[f"n_{i}"]
        answers[c] = (n, {})
        for run in _runs(wanted[c](n)) if n else ():
            spans[(c, *run)] = (first[f"lo_{i}"], first[f"hi_{i}"], 0, n)
    spans = _narrowed(vals, spans)
    for (c, k), value in _picked(vals, spans).items():
        answers[c][1][k] = value
    return answers


def _runs(positions: list[int]) -> list[tuple[int, int]]:
    """Neighbouring positions as (first, last)."""
    out: list[tuple[int, int]] = []
    for k in sorted(set(positions)):
        if out and k == out[-1][1] + 1:
            out[-1] = (out[-1][0], k)
        else:
            out.append((k, k))
    return out


def _narrowed(vals: DataFrame, spans: dict) -> dict:
    """Spans (low, high, rows below, rows inside) shrunk to at most SELECT_LIMIT rows, or to a few values."""
    margin, accuracy = 0.0005, 10_000
    pending = [t for t, s in spans.items() if s[3] > SELECT_LIMIT and s[0] < s[1]]
    while pending:
        # One sketch per distinct span, asked for the marks of all its positions.
        shared: dict[tuple, list] = {}
        for t in pending:
            shared.setdefault((t[0], spans[t]), []).append(t)
        found = vals.agg(*[
            F.percentile_approx(
                F.when(F.col(c).between(lo, hi), F.col(c)),
                [q for t in members for q in (max(0.0, (t[1] - below) / inside - margin), min(1.0, (t[2] - below) / inside + margin))],
                accuracy,
            ).alias(f"m{g}")
            for g, ((c, (lo, hi, below, inside)), members) in enumerate(shared.items())
        ]).first()
        marks = {t: found[f"m{g}"][2 * i:2 * i + 2] for g, members in enumerate(shared.values()) for i, t in enumerate(members)}
        sizes = vals.agg(*[
            F.count_if(expr).alias(f"{name}{j}")
            for j, t in enumerate(pending)
            for name, expr in (("b", F.col(t[0]) < marks[t][0]), ("i", F.col(t[0]).between(*marks[t])))
        ]).first()
        again = []
        for j, t in enumerate(pending):
            below, inside = sizes[f"b{j}"], sizes[f"i{j}"]
            if not (below <= t[1] and t[2] < below + inside):
                continue  # the wider span of the previous pass is still right
            shrunk = inside * 2 <= spans[t][3]
            spans[t] = (*marks[t], below, inside)
            if shrunk and inside > SELECT_LIMIT and marks[t][0] < marks[t][1]:
                again.append(t)
        pending = again
    return spans


def _picked(vals: DataFrame, spans: dict) -> dict:
    groups: dict[tuple, list] = {}
    for (c, first, last), (lo, hi, below, _) in spans.items():
        groups.setdefault((c, lo, hi, below), []).extend(range(first, last + 1))
    if not groups:
        return {}
    order = list(groups)
    tagged = F.array(*[
        F.struct(F.lit(g).alias("g"), F.when(F.col(c).between(lo, hi), F.col(c)).alias("v"))
        for g, (c, lo, hi, _) in enumerate(order)
    ])
    counts = (
        vals.select(F.inline(tagged)).where(F.col("v").isNotNull()).groupBy("g", "v").agg(F.count("*").alias("n"))
    )
    asked = {(g, k): k - key[3] for g, key in enumerate(order) for k in groups[key]}
    # Rows left in a span bound its distinct values; a span that a hot value kept wide may hold many others.
    if any(inside > SELECT_LIMIT and lo < hi for lo, hi, _, inside in spans.values()):
        return {(order[g][0], k): v for (g, k), v in _by_distinct(counts, asked).items()}
    upto = Window.partitionBy("g").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    run = counts.withColumn("end", F.sum("n").over(upto))
    hit = F.lit(False)
    for g, key in enumerate(order):
        for k in groups[key]:
            at = F.lit(k - key[3])
            hit = hit | ((F.col("g") == g) & (F.col("end") - F.col("n") <= at) & (at < F.col("end")))
    out = {}
    for row in run.where(hit).collect():
        key = order[row["g"]]
        for k in groups[key]:
            if row["end"] - row["n"] <= k - key[3] < row["end"]:
                out[(key[0], k)] = row["v"]
    return out


def _by_distinct(counts: DataFrame, asked: dict[tuple[int, int], int]) -> dict[tuple[int, int], float]:
    """Values at the positions `asked[g, name]` of each group of `counts` (g, v, n), by cuts of the distinct values.

    A hot value is one row here, so every pass leaves about a PARTS-th of a group's distinct values.
    """
    counts = staged(counts, "distinct-values")
    accuracy = 10_000
    shares = [i / PARTS for i in range(1, PARTS)]
    left = {t: (None, None, 0) for t in asked}  # low (included), high (excluded), rows below
    out: dict[tuple[int, int], float] = {}
    while left:
        names = list(left)
        inside = {}
        for t in names:
            lo, hi, _ = left[t]
            cond = F.col("g") == t[0]
            cond = cond if lo is None else cond & (F.col("v") >= lo)
            inside[t] = cond if hi is None else cond & (F.col("v") < hi)
        cuts = counts.agg(*[
            F.struct(
                F.count_if(inside[t]).alias("m"), F.percentile_approx(F.when(inside[t], F.col("v")), shares, accuracy).alias("q")
            ).alias(f"c{i}") for i, t in enumerate(names)
        ]).first()
        small = [t for i, t in enumerate(names) if cuts[f"c{i}"]["m"] <= SELECT_LIMIT]
        for t in small:
            place = F.sum("n").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)) + left[t][2]
            run = counts.where(inside[t]).withColumn("end", place)
            out[t] = run.where((F.col("end") - F.col("n") <= asked[t]) & (F.col("end") > asked[t])).first()["v"]
        marks = {t: sorted(set(cuts[f"c{i}"]["q"])) for i, t in enumerate(names) if t not in small}
        if not marks:
            break
        sums = counts.agg(*[
            F.array(*[F.coalesce(F.sum(F.when((F.col("g") == t[0]) & (F.col("v") < m), F.col("n"))), F.lit(0)) for m in ms]).alias(f"s{i}")
            for i, (t, ms) in enumerate(marks.items())
        ]).first()
        again = {}
        for i, (t, ms) in enumerate(marks.items()):
            lo, hi, below = left[t]
            for m, s in zip(ms, sums[f"s{i}"]):
                if s <= asked[t]:
                    lo, below = m, s
                else:
                    hi = m
                    break
            again[t] = (lo, hi, below)
        left = again
    return out


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles of the present values, exact at any table size."""
    def positions(n: int) -> list[int]:
        return [f(p * (n - 1)) for p in probs for f in (math.floor, math.ceil)]

    out = {}
    for c, (n, at) in order_statistics(df, {c: positions for c in cols}).items():
        if not n:
            out[c] = [None] * len(probs)
            continue
        values = []
        for p in probs:
            x = p * (n - 1)
            low, high = at[math.floor(x)], at[math.ceil(x)]
            values.append(low + (high - low) * (x - math.floor(x)))
        out[c] = values
    return out


def first_by_key(df: DataFrame, key: str, n: int, by_threshold: bool = False) -> DataFrame:
    """The n rows with the smallest values of a unique numeric key: the first n of each task, then of all.

    With `by_threshold`, for an n that one task cannot hold, rows are compared with the n-th key and stay unsorted.
    """
    if not by_threshold:
        return df.orderBy(key).limit(n)
    found, at = order_statistics(df, {key: lambda size: [n - 1] if n <= size else []})[key]
    return df.where(F.col(key) <= F.lit(at[n - 1])) if n <= found else df
