"""Train / val / test labels of exact size, by row or by whole group."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Window, functions as F

from doseframe import schemas as S
from doseframe.functions.encode import truncated_share
from doseframe.functions.hashing import hash_bucket, seeded_hash
from doseframe.operators.joins import HOT_SHARE, mapped_label
from doseframe.operators.ordering import hash_cuts, ranged, running_before
from doseframe.session import staged



def random_split(
    df: DataFrame, keys: Sequence[str], test_size: float = S.TEST_SIZE, val_size: float = S.VAL_SIZE, seed: int = S.SPLIT_SEED
) -> DataFrame:
    """Adds `split`: the first floor(test_size*n) rows in seeded hash order are test, the next
    floor(val_size*n) val. The keys identify a row. Rows are labelled in place, without a shuffle."""
    def goals(total):
        test = truncated_share(test_size, total)
        return [test, test + truncated_share(val_size, total)]

    cuts = hash_cuts(df, keys, seed, goals)
    h = seeded_hash(list(keys), seed)
    return df.withColumn(
        "split", F.when(h <= cuts.getField("c0"), "test").when(h <= cuts.getField("c1"), "val").otherwise("train")
    )


def _blocks(sizes: list[tuple[int, int]], need_test: int, need_val: int) -> Iterator[tuple[int, int, int, str]]:
    """Greedy assignment in runs: (size, first, last, label) over positions of equal-sized groups.

    `sizes` holds (size, number of groups), largest first. A label 'test/val' or 'val/test' is a
    strict alternation that begins with the first name. Each group goes to test while its need is
    positive and no smaller than that of val, else to val while that need is positive, else to train.
    """
    for size, groups in sizes:
        at = 1
        while at <= groups:
            rounds = lambda need: -(-need // size)  # groups until the need is met
            gap = need_test - need_val
            if need_test <= 0 and need_val <= 0:
                label, run = "train", groups
            elif need_val <= 0 or (need_test > 0 and gap >= size):
                label = "test"
                run = rounds(need_test) if need_val <= 0 else min(gap // size, rounds(need_test))
            elif need_test <= 0 or -gap > size:
                label = "val"
                run = rounds(need_val) if need_test <= 0 else min(max(1, rounds(-gap) - 1), rounds(need_val))
            else:
                label = "test/val" if gap >= 0 else "val/test"
                first, second = (need_test, need_val) if gap >= 0 else (need_val, need_test)
                run = min(2 * rounds(first) - 1, 2 * rounds(second))
            run = min(run, groups - at + 1)
            lead = (run + 1) // 2
            need_test -= size * {"test": run, "test/val": lead, "val/test": run - lead}.get(label, 0)
            need_val -= size * {"val": run, "val/test": lead, "test/val": run - lead}.get(label, 0)
            yield size, at, at + run - 1, label
            at += run


def _positions(groups: DataFrame, group: str, seed: int) -> DataFrame:
    """Adds `pos`, the 1-based place of each group among those of its size, in seeded hash order."""
    rows = ranged(groups.withColumn("_h", seeded_hash([group], seed)), ["_n", "_h", group], "group-order")
    # Groups of a size lie next to each other: one row for each partition that holds some.
    runs = rows.groupBy("_part", "_n").agg(F.min("_at").alias("_first"), F.count("*").alias("_c"))
    earlier = Window.partitionBy("_n").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("_part", "_n", "_first", F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_before"))
    return rows.join(runs, ["_part", "_n"]).withColumn("pos", F.col("_before") + F.col("_at") - F.col("_first") + 1)


def size_head(groups: DataFrame, goal: int) -> list[tuple[int, int]]:
    """(size, number of groups) of the largest sizes, until what lies above a size is the goal and one group more.

    Sums run in Spark; sizes below the head belong to no goal and never reach the driver.
    """
    sizes = groups.groupBy("_n").agg(F.count("*").alias("m")).select(
        F.lit(0).alias("g"), (-F.col("_n")).alias("at"), "m", (F.col("m") * F.col("_n")).alias("w")
    )
    run = running_before(sizes, "g", "at", ["w", "m"])
    largest = run.agg(F.max(-F.col("at"))).first()[0] or 0
    head = run.where(F.col("before_w") < F.lit(goal + largest)).orderBy("at").collect()
    return [(-r["at"], r["m"]) for r in head]


def group_split(
    df: DataFrame, group: str, test_size: float = S.TEST_SIZE, val_size: float = S.VAL_SIZE, seed: int = S.SPLIT_SEED
) -> DataFrame:
    """Adds `split` such that no group is in two splits; rows without a group are dropped.

    Groups are taken by size, largest first, ties in seeded hash order, and fill test and val up to
    their targets by whole groups. The driver sees one number per distinct size among the groups that fill them;
    groups are placed by Spark, and hot groups are parted on the way back.
    """
    spark = df.sparkSession
    rows = df.where(F.col(group).isNotNull())
    groups = staged(rows.groupBy(group).agg(F.count("*").alias("_n")), "group-sizes")
    total = groups.agg(F.sum("_n")).first()[0] or 0
    need_test, need_val = int(total * test_size), int(total * val_size)
    plans: dict[int, list] = {}
    for size, first, last, label in _blocks(size_head(groups, need_test + need_val), need_test, need_val):
        plans.setdefault(size, []).append((first, last, label))
    plans = {c: runs for c, runs in plans.items() if any(r[2] != "train" for r in runs)}
    table = spark.createDataFrame(
        [(c, len(runs) > 1 or "/" in runs[0][2], runs) for c, runs in plans.items()],
        "_n bigint, mixed boolean, runs array<struct<first:bigint,last:bigint,label:string>>",
    )
    used = groups.join(table, "_n")
    plain = used.where(~F.col("mixed")).select(group, "_n", F.element_at("runs", 1)["label"].alias("split"))
    run = F.element_at(F.filter("runs", lambda r: F.col("pos").between(r["first"], r["last"])), 1)
    odd = (F.col("pos") - F.col("run.first")) % 2
    placed = _positions(used.where("mixed"), group, seed).withColumn("run", run).select(
        group, "_n",
        F.when(F.col("run.label").contains("/"), F.element_at(F.split("run.label", "/"), (odd + 1).cast("int")))
        .otherwise(F.col("run.label")).alias("split"),
    )
    chosen = plain.unionByName(placed).where("split <> 'train'")
    # Hot groups stay in the mapping whatever their label, so that they are joined by broadcast.
    hot_train = groups.where(F.col("_n") * HOT_SHARE >= total).join(chosen.select(group), group, "left_anti")
    mapping = chosen.unionByName(hot_train.select(group, "_n", F.lit("train").alias("split")))
    return mapped_label(rows, mapping, group, "split", "train", "_n", total)


def assign_split(df: DataFrame, kind: str, keys: Sequence[str] = (), group: str | None = None, **options) -> DataFrame:
    """'random' (needs `keys`) or 'scaffold' (needs `group`)."""
    if kind == "random":
        return random_split(df, keys, **options)
    if kind == "scaffold":
        if group is None:
            raise ValueError("a scaffold split needs a group column")
        return group_split(df, group, **options)
    raise ValueError("kind must be 'random' or 'scaffold'")


def leaking_groups(df: DataFrame, group: str, split: str = "split") -> DataFrame:
    """Groups that occur in more than one split; empty for a sound split.

    Labels are few, so the set per group is small and is built before the shuffle.
    """
    return df.groupBy(group).agg(
        F.min(split).alias("first_split"), F.max(split).alias("last_split"), F.count("*").alias("rows")
    ).where(F.col("first_split") != F.col("last_split"))


def with_fold(df: DataFrame, keys: Sequence[str], k: int, seed: int = S.SPLIT_SEED) -> DataFrame:
    """Adds `fold` 0..k-1 by hash, for cross-validation."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in keys])
    return df.withColumn("fold", hash_bucket(text, k))
