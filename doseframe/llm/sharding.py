"""Jump consistent hashing of stable keys to shards, in column expressions only.

The hash keeps no ring table: a key walks through a short sequence of jumps, and the last jump below
the shard count is its shard. Adding a shard moves only the keys whose next jump lands in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from doseframe.session import staged

# Multiplier and mask of the published hash.
MULTIPLIER = 2862933555777941757
MASK32 = 0xFFFFFFFF


def _next_state(hi: Column, lo: Column) -> tuple[Column, Column]:
    """state * MULTIPLIER + 1 modulo 2**64 on two 32-bit halves; no product exceeds 63 bits."""
    m_hi, m_lo = MULTIPLIER >> 32, MULTIPLIER & MASK32
    m0, m1 = m_lo & 0xFFFF, m_lo >> 16
    p0, p1 = lo * F.lit(m0) + F.lit(1), lo * F.lit(m1)
    low = p0 + F.shiftleft(p1.bitwiseAND(F.lit(0xFFFF)), 16)
    carry = F.shiftright(low, 32) + F.shiftright(p1, 16)
    high = (
        carry + (lo * F.lit(m_hi)).bitwiseAND(F.lit(MASK32)) + hi * F.lit(m0)
        + F.shiftleft((hi * F.lit(m1)).bitwiseAND(F.lit(0xFFFF)), 16)
    )
    return high.bitwiseAND(F.lit(MASK32)), low.bitwiseAND(F.lit(MASK32))


def jump_shards(key: Column, counts: list[int]) -> Column:
    """Struct s0, s1, ... with the shard of a long key for each shard count; a null key counts as 0.

    The jumps grow strictly, so max(counts) steps always reach the end; later steps change nothing.
    All counts read the same sequence of jumps.
    """
    if not counts or min(counts) < 1:
        raise ValueError("shard counts start at 1")
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    fields = [f"s{i}" for i in range(len(counts))]
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("hi"), key.bitwiseAND(F.lit(MASK32)).alias("lo"),
        F.lit(0).cast("long").alias("jump"), *[F.lit(0).cast("long").alias(f) for f in fields],
    )

    def step(state: Column, _: Column) -> Column:
        hi, lo = _next_state(state["hi"], state["lo"])
        at = state["jump"]
        nxt = F.floor((at + 1).cast("double") * (F.lit(2147483648.0) / (F.shiftright(hi, 1) + 1).cast("double"))).cast("long")
        done = at >= max(counts)
        return F.when(done, state).otherwise(F.struct(
            hi.alias("hi"), lo.alias("lo"), nxt.alias("jump"),
            *[F.when(at < n, at).otherwise(state[f]).alias(f) for f, n in zip(fields, counts)],
        ))

    end = F.aggregate(F.sequence(F.lit(0), F.lit(max(counts))), start, step)
    return F.struct(*[end[f].cast("int").alias(f) for f in fields])


def shard(df: DataFrame, key: str, text: str, shards: int, partitions: int | None = None) -> DataFrame:
    """One row per row of `df`: the key, size, text_crc32, law, shard, slot, grown_shard.

    size is the UTF-8 bytes of the text plus 1; a null text has no bytes and the crc of none (0). A null
    key is placed as key 0, its slots come first. `grown_shard` is the place with one more shard. `slot`
    counts a shard's rows from 0 by key; equal keys (repeated rows) follow in any order. Other columns
    of `df` are not read. An empty table gives no rows.

    The rows are narrow before they are first moved; texts never are. Slots come from range-partitioned
    positions plus the number of rows before each partition, so no shard meets in one task; a row number
    in the range key splits a key that repeats.
    """
    utf8 = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    at = jump_shards(F.col(key), [shards, shards + 1])
    placed = df.select(
        F.col(key).alias("k"), (F.octet_length(utf8) + 1).cast("long").alias("size"), F.crc32(utf8).alias("crc"),
        at.alias("at"), F.monotonically_increasing_id().alias("rid"),
    ).select("k", "size", "crc", F.col("at.s0").alias("shard"), F.col("at.s1").alias("grown"), "rid")
    order = ["shard", "k", "rid"]
    spread = placed.repartitionByRange(*([partitions] if partitions else []), *order).sortWithinPartitions(*order)
    rows = staged(spread.withColumn("pos", F.monotonically_increasing_id()), "shards")
    part = F.shiftright("pos", 33)
    runs = rows.groupBy(part.alias("part"), "shard").agg(F.min("pos").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("part", "shard", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return rows.withColumn("part", part).join(runs, ["part", "shard"]).select(
        F.col("k").alias(key), "size", F.col("crc").alias("text_crc32"), F.lit("key").alias("law"), "shard",
        (F.col("pos") + F.col("shift")).alias("slot"), F.col("grown").alias("grown_shard"),
    )
