"""Node and edge tables: features, neighbourhood aggregation, readout.

Feature vectors have a fixed width, so sums run as one aggregate per element over one row per
edge, combined before the shuffle; no vector is exploded and no neighbour list is collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from doseframe import schemas as S
from doseframe.functions.encode import one_hot, project
from doseframe.operators.joins import hot_split_join
from doseframe.operators.profile import histogram
from doseframe.session import cut_lineage

AGGREGATORS = {
    "sum": F.sum, "add": F.sum, "mean": F.avg, "max": F.max, "min": F.min, "std": F.stddev_pop,
}


# Elements that one aggregate sums: beyond 100 buffer fields it is no longer compiled.
BLOCK = {"sum": 64, "add": 64, "mean": 32, "max": 64, "min": 64, "std": 24}


def node_features(atoms: DataFrame) -> DataFrame:
    """nodes(mol_id, atom_idx, feats[28]) from atom attributes.

    Columns: mol_id, atom_idx, atomic_num, hybridization, chiral_tag, degree, formal_charge,
    num_hs, total_valence, num_radical, is_aromatic, is_in_ring.
    """
    scaled = F.array(
        F.col("degree") / 4.0, (F.col("formal_charge") + 4) / 8.0, F.col("num_hs") / 4.0,
        F.col("total_valence") / 8.0, F.col("num_radical") / 2.0,
        F.col("is_aromatic").cast("double"), F.col("is_in_ring").cast("double"),
    )
    feats = F.concat(
        one_hot(F.col("atomic_num"), S.ATOMIC_NUMBERS), one_hot(F.col("hybridization"), S.HYBRIDIZATIONS),
        one_hot(F.col("chiral_tag"), S.CHIRAL_TAGS), scaled,
    )
    return atoms.select("mol_id", "atom_idx", feats.alias("feats"))


def edge_features(bonds: DataFrame) -> DataFrame:
    """edges(mol_id, src, dst, feats[11]), each bond in both directions.

    Columns: mol_id, begin_idx, end_idx, bond_type, stereo, is_conjugated, is_in_ring.
    """
    feats = F.concat(
        one_hot(F.col("bond_type"), S.BOND_TYPES), one_hot(F.col("stereo"), S.BOND_STEREO),
        F.array(F.col("is_conjugated").cast("double"), F.col("is_in_ring").cast("double")),
    )
    ends = F.array(
        F.struct(F.col("begin_idx").alias("src"), F.col("end_idx").alias("dst")),
        F.struct(F.col("end_idx").alias("src"), F.col("begin_idx").alias("dst")),
    )
    return bonds.select("mol_id", feats.alias("feats"), F.inline(ends)).select("mol_id", "src", "dst", "feats")


def projected(table: DataFrame, weights: Sequence[Sequence[float]], bias: Sequence[float] | None = None, activate: bool = False) -> DataFrame:
    """`feats` times a fixed matrix, plus bias, optionally through relu."""
    out = project([list(r) for r in weights], F.col("feats"), None if bias is None else list(bias))
    if activate:
        out = F.transform(out, lambda v: F.greatest(v, F.lit(0.0)))
    return table.withColumn("feats", out)


def _messages(nodes: DataFrame, edges: DataFrame, hubs: bool) -> DataFrame:
    """(mol_id, dst, x, e): for each edge the vectors of its source and of itself."""
    source = nodes.select(F.struct("mol_id", F.col("atom_idx").alias("src")).alias("_at"), F.col("feats").alias("x"))
    arcs = edges.select(
        F.struct("mol_id", "src").alias("_at"), "mol_id", "dst",
        (F.col("feats") if "feats" in edges.columns else F.lit(None).cast("array<double>")).alias("e"),
    )
    if not hubs:
        return arcs.join(source, "_at")
    degree = arcs.groupBy("_at").agg(F.count("*").alias("_w"))
    return hot_split_join(arcs, source.join(degree, "_at"), "_at", "inner", "_w")


def neighbour_aggregate(
    nodes: DataFrame, edges: DataFrame, width: int, how: str = "sum", own: bool = True, residual: bool = False,
    hubs: bool = False,
) -> DataFrame:
    """nodes with feats = x_i + AGG_j relu(x_j + e_ij), one round without learned weights.

    Edges without `feats` pass x_j as it is. `own=False` leaves x_i out, `residual` adds it once
    more after a relu. A node without neighbours keeps 0 as the aggregate. `hubs=True` takes
    sources with very many edges (a virtual node) out of the shuffle.
    """
    if how not in AGGREGATORS:
        raise ValueError(f"how must be one of {sorted(AGGREGATORS)}")
    joined = _messages(nodes, edges, hubs)
    has_edge = "feats" in edges.columns

    size = BLOCK[how]
    blocks = -(-width // size)
    # Every message is taken apart into blocks, which are combined in the task before the shuffle.
    parts = joined.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))) if blocks > 1 else joined
    keys = ["mol_id", "dst", "block"][:2 + (blocks > 1)]
    place = F.col("block") * size if blocks > 1 else F.lit(0)

    def message(i: int) -> Column:
        x = F.get("x", place + i)
        return F.greatest(x + F.get("e", place + i), F.lit(0.0)) if has_edge else x

    least = min(size, width)
    sums = parts.groupBy(*keys).agg(*[AGGREGATORS[how](message(i)).alias(f"a{i}") for i in range(least)])
    vectors = sums.select("mol_id", F.col("dst").alias("atom_idx"), *keys[2:], F.array(*[f"a{i}" for i in range(least)]).alias("a"))
    if blocks > 1:
        ordered = F.sort_array(F.collect_list(F.struct("block", "a")))
        vectors = vectors.groupBy("mol_id", "atom_idx").agg(F.flatten(F.transform(ordered, lambda b: b["a"])).alias("a"))

    def updated(x: Column, found: Column) -> Column:
        out = F.coalesce(found, F.lit(0.0))
        out = x + out if own else out
        return F.greatest(out, F.lit(0.0)) + x if residual else out

    # One short function for all elements: hundreds of expressions would not fit a compiled method.
    own_part = F.slice("feats", 1, width)
    found = F.coalesce(F.slice("a", 1, width), F.array_repeat(F.lit(0.0), width))
    return nodes.join(vectors, ["mol_id", "atom_idx"], "left").select(
        "mol_id", "atom_idx", F.zip_with(own_part, found, updated).alias("feats")
    )


def degree_normalized(nodes: DataFrame, edges: DataFrame, width: int) -> DataFrame:
    """One graph-convolution round: sum over neighbours and self of x_j / sqrt(d_i d_j),
    where d counts a self loop."""
    degree = edges.groupBy("mol_id", F.col("dst").alias("atom_idx")).agg(F.count("*").alias("_d"))
    scaled = nodes.join(degree, ["mol_id", "atom_idx"], "left").withColumn(
        "_s", 1.0 / F.sqrt(F.coalesce("_d", F.lit(0)) + 1.0)
    )
    senders = scaled.select("mol_id", "atom_idx", F.transform("feats", lambda v: v * F.col("_s")).alias("feats"))
    summed = neighbour_aggregate(senders, edges.select("mol_id", "src", "dst"), width, "sum", own=True)
    return summed.join(scaled.select("mol_id", "atom_idx", "_s"), ["mol_id", "atom_idx"]).select(
        "mol_id", "atom_idx", F.transform("feats", lambda v: v * F.col("_s")).alias("feats")
    )


def rounds(nodes: DataFrame, edges: DataFrame, width: int, n: int, **options) -> DataFrame:
    """n aggregation rounds; each is written out before the next, so a lost executor costs one."""
    for step in range(n):
        nodes = neighbour_aggregate(nodes, edges, width, **options)
        if step < n - 1:
            nodes = cut_lineage(nodes)
    return nodes


def readout(nodes: DataFrame, width: int, pooling: str = "mean") -> DataFrame:
    """(mol_id, feats): one vector per molecule; pooling mean, add, min, max, std or min+max."""
    names = pooling.split("+")
    if any(p not in AGGREGATORS for p in names):
        raise ValueError(f"pooling must be made of {sorted(AGGREGATORS)}")
    aggs = [AGGREGATORS[p](F.get("feats", F.lit(i))).alias(f"{p}{i}") for p in names for i in range(width)]
    return nodes.groupBy("mol_id").agg(*aggs).select(
        "mol_id", F.array(*[F.col(f"{p}{i}") for p in names for i in range(width)]).alias("feats")
    )


def with_virtual_node(nodes: DataFrame, edges: DataFrame, width: int, edge_width: int | None = None) -> tuple[DataFrame, DataFrame]:
    """One extra node (index -1, zero features) per molecule, linked both ways to every atom."""
    zeros = F.array(*[F.lit(0.0)] * width)
    extra = nodes.select("mol_id").distinct().select("mol_id", F.lit(-1).cast(nodes.schema["atom_idx"].dataType).alias("atom_idx"), zeros.alias("feats"))
    ends = F.array(
        F.struct(F.col("atom_idx").alias("src"), F.lit(-1).cast(edges.schema["dst"].dataType).alias("dst")),
        F.struct(F.lit(-1).cast(edges.schema["src"].dataType).alias("src"), F.col("atom_idx").alias("dst")),
    )
    links = nodes.select("mol_id", F.inline(ends))
    if "feats" in edges.columns:
        links = links.withColumn("feats", F.array(*[F.lit(0.0)] * (edge_width or width)))
    return nodes.unionByName(extra), edges.unionByName(links)


def molecule_sizes(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("mol_id").agg(F.count("*").alias("atoms"))


def large_molecules(nodes: DataFrame, thresholds: Sequence[int] = (200, 300, 400)) -> DataFrame:
    """One row: molecules in all, and those with at least each number of atoms."""
    return molecule_sizes(nodes).agg(
        F.count("*").alias("molecules"), *[F.count_if(F.col("atoms") >= t).alias(f"atoms_ge_{t}") for t in thresholds]
    )


def size_distribution(nodes: DataFrame, bins: int | None = None) -> DataFrame:
    return histogram(molecule_sizes(nodes), "atoms", bins)
