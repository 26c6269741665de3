import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from doseframe.operators import splits as L


def expanded(sizes, goal_test, goal_val):
    counts = sorted(Counter(sizes).items(), reverse=True)
    labels = []
    for _, first, last, label in L._blocks(counts, goal_test, goal_val):
        names = label.split("/")
        labels += [names[i % len(names)] for i in range(last - first + 1)]
    return labels


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=60), st.floats(0, 0.6), st.floats(0, 0.6))
def test_blocks_meet_the_goals_by_whole_groups(sizes, test_size, val_size):
    """Train comes last; no part gets a group once its goal is met; of two open goals the larger need is served."""
    sizes = sorted(sizes, reverse=True)
    goal = {"test": int(sum(sizes) * test_size), "val": int(sum(sizes) * val_size)}
    labels = expanded(sizes, goal["test"], goal["val"])
    assert len(labels) == len(sizes)
    had = {part: np.cumsum([n * (x == part) for n, x in zip(sizes, labels)]) - [n * (x == part) for n, x in zip(sizes, labels)] for part in goal}
    need = {part: goal[part] - had[part] for part in goal}
    for i, label in enumerate(labels):
        open_goals = {part: need[part][i] for part in goal if need[part][i] > 0}
        assert label == "train" if not open_goals else open_goals.get(label) == max(open_goals.values())
        if len(open_goals) == 2 and need["test"][i] == need["val"][i]:
            assert label == "test"


def brute_group_split(pairs, seed=42, share=0.1):
    sizes = Counter(g for _, g in pairs if g is not None)
    order = sorted(sizes, key=lambda g: (-sizes[g], hashlib.md5(f"{seed}:{g}".encode()).hexdigest()))
    goal = int(sum(sizes.values()) * share)
    label = dict(zip(order, expanded([sizes[g] for g in order], goal, goal)))
    return {i: label[g] for i, g in pairs if g is not None}


def skewed(n):
    """A third in one group, a third in single-row groups, the rest in small ones, some without."""
    return [(i, "hot" if i % 3 == 0 else f"one{i}" if i % 3 == 1 else f"g{i % 40}" if i % 5 else None) for i in range(n)]


@pytest.mark.parametrize("partitions", [1, 4, 200])
def test_group_split_with_hot_group(spark, partitions):
    pairs = skewed(1500)
    df = spark.createDataFrame(pairs, "id int, g string")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        out = L.assign_split(df, "scaffold", group="g")
        assert {r.id: r.split for r in out.collect()} == brute_group_split(pairs)
        assert L.leaking_groups(out, "g").count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_three_hot_groups_one_in_train(spark):
    pairs = [(i, "abc"[i % 3]) for i in range(300)]
    df = spark.createDataFrame(pairs, "id int, g string")
    assert {r.id: r.split for r in L.group_split(df, "g").collect()} == brute_group_split(pairs)


def test_group_split_fixture(spark):
    df = spark.createDataFrame([(g,) for g in "AAAABBBCCD"], "g string")
    assert {(r.g, r.split) for r in L.group_split(df, "g").collect()} == {("A", "test"), ("B", "val"), ("C", "train"), ("D", "train")}


@pytest.mark.parametrize("n,want", [(25, (2, 2, 21)), (5, (0, 0, 5)), (1000, (100, 100, 800)), (0, (0, 0, 0))])
def test_random_split_sizes(spark, n, want):
    split = L.random_split(spark.range(n), ["id"])
    counts = Counter(r.split for r in split.collect())
    assert (counts["test"], counts["val"], counts["train"]) == want


def test_split_does_not_depend_on_partitions(spark):
    one = {r.id: r.split for r in L.random_split(spark.range(500).repartition(1), ["id"]).collect()}
    many = {r.id: r.split for r in L.random_split(spark.range(500).repartition(37), ["id"]).collect()}
    assert one == many
    other = {r.id: r.split for r in L.random_split(spark.range(500), ["id"], seed=1).collect()}
    assert one != other


def test_kind_is_checked(spark):
    with pytest.raises(ValueError):
        L.assign_split(spark.range(3), "sorted", keys=["id"])
    with pytest.raises(ValueError):
        L.assign_split(spark.range(3), "scaffold")


def test_folds(spark):
    sizes = L.with_fold(spark.range(1000), ["id"], 5).groupBy("fold").agg(F.count("*").alias("n")).collect()
    assert len(sizes) == 5 and sum(r.n for r in sizes) == 1000


def test_only_the_head_of_a_hundred_thousand_sizes_reaches_the_driver(spark):
    """One group of every size from 1 to 100,000: the split of a tenth and a tenth needs the largest tenth of the sizes."""
    n = 100_000
    groups = spark.range(1, n + 1).select(F.col("id").alias("g"), F.col("id").alias("_n"))
    total = n * (n + 1) // 2
    goal = total // 10
    head = L.size_head(groups, 2 * goal)
    assert [c for c, _ in head] == list(range(n, n - len(head), -1)) and all(m == 1 for _, m in head)
    assert len(head) < 0.11 * n and sum(c for c, _ in head) >= 2 * goal
    # The blocks of the head are those of all sizes.
    everything = [b for b in L._blocks([(c, 1) for c in range(n, 0, -1)], goal, goal) if b[3] != "train"]
    assert [b for b in L._blocks(head, goal, goal) if b[3] != "train"] == everything
