"""Connected components of an edge table by smallest labels, every round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from doseframe.session import staged

# Copies of a hub's label, so that a node with very many edges is not joined in one task.
SALTS = 16


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of `edges` (a, b longs): label is the smallest node it can reach.

    Each round hands a label to all neighbours and then follows labels of labels, so that the number of
    rounds grows with the logarithm of a path's length. Null ends and loops take no part. Labels are
    combined in the tasks before they are shuffled; a hub's label is salted.
    """
    both = edges.where("a <> b").select("a", "b")
    both = staged(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        copies = labels.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        sent = both.select(F.col("a").alias("node"), "b", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int").alias("salt"))
        near = sent.join(copies, ["node", "salt"]).groupBy(F.col("b").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        step = staged(step, "labels")
        up = step.select(F.col("node").alias("label"), F.col("label").alias("above"))
        # Many nodes share one label: the label's own label is looked up through salted copies, too.
        up = up.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        own = step.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
        labels = staged(own.join(up, ["label", "salt"]).select("node", F.col("above").alias("label"), "old"), "labels")
        if labels.where("label <> old").isEmpty():
            return labels.select("node", "label")
        labels = labels.select("node", "label")


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """`labels` (node, label) after `links` (a, b) join parts. A part is named by its label, a node without one by
    itself. Only the links, not the parts' members, take part in the rounds of components."""
    links = staged(links, "links")
    if links.isEmpty():
        return labels
    joined = components(links)
    up = joined.select(F.col("node").alias("label"), F.col("label").alias("above"))
    up = up.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    old = labels.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(up, ["label", "salt"], "left")
    old = old.select("node", F.coalesce("above", "label").alias("label"))
    return staged(old.unionByName(joined.join(labels.select("node"), "node", "left_anti")), "labels")
