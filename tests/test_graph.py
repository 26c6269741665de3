import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from doseframe.operators import featurize as K, graph as G


def feats(df):
    return {(r.mol_id, r.atom_idx): r.feats for r in df.collect()}


@pytest.fixture(scope="module")
def chain(spark):
    """Atoms 1-2-3 with x = 5, 0, 2 and edge feature -1; a second molecule with one atom."""
    nodes = spark.createDataFrame([(1, 1, [5.0]), (1, 2, [0.0]), (1, 3, [2.0]), (2, 1, [7.0])], "mol_id long, atom_idx int, feats array<double>")
    edges = spark.createDataFrame([(1, s, d, [-1.0]) for s, d in ((1, 2), (2, 1), (2, 3), (3, 2))], "mol_id long, src int, dst int, feats array<double>")
    return nodes, edges


@pytest.mark.parametrize("hubs", [False, True])
def test_neighbour_sum_fixture(chain, hubs):
    out = G.neighbour_aggregate(*chain, 1, hubs=hubs)
    assert feats(out) == {(1, 1): [5.0], (1, 2): [5.0], (1, 3): [2.0], (2, 1): [7.0]}
    pooled = {r.mol_id: r.feats for r in G.readout(out, 1, "add").collect()}
    assert pooled == {1: [12.0], 2: [7.0]}
    assert {r.mol_id: r.feats for r in G.readout(out, 1, "mean").collect()} == {1: [4.0], 2: [7.0]}


def test_pooling_names_are_checked(chain):
    with pytest.raises(ValueError):
        G.readout(chain[0], 1, "median")
    with pytest.raises(ValueError):
        G.neighbour_aggregate(*chain, 1, how="median")


def test_rounds_and_residual(chain):
    two = feats(G.rounds(*chain, 1, 2))
    assert two[1, 2] == [5.0 + 4.0 + 1.0] and two[2, 1] == [7.0]
    res = feats(G.neighbour_aggregate(*chain, 1, residual=True))
    assert res[1, 1] == [10.0] and res[2, 1] == [14.0]


def test_other_aggregators(chain):
    nodes, edges = chain
    plain = edges.drop("feats")
    for how, want in (("max", 5.0), ("min", 2.0), ("mean", 3.5), ("std", 1.5)):
        assert feats(G.neighbour_aggregate(nodes, plain, 1, how, own=False))[1, 2] == [want]


def test_degree_normalized_equals_matrix_form(chain):
    nodes, edges = chain
    adj = np.array([[1, 1, 0], [1, 1, 1], [0, 1, 1]], float)
    d = 1 / np.sqrt(adj.sum(1))
    want = (d[:, None] * adj * d) @ np.array([5.0, 0.0, 2.0])
    got = feats(G.degree_normalized(nodes, edges.drop("feats"), 1))
    assert [got[1, i][0] for i in (1, 2, 3)] == pytest.approx(list(want))
    assert got[2, 1] == [7.0]


def test_virtual_node_reaches_every_atom(chain):
    nodes, edges = G.with_virtual_node(*chain, 1)
    assert nodes.count() == 6 and edges.count() == 4 + 8
    assert feats(G.neighbour_aggregate(nodes, edges, 1, hubs=True))[1, -1] == [7.0]


def test_node_and_edge_features(spark):
    atoms = spark.createDataFrame(
        [(1, 0, 6, "SP3", "CHI_UNSPECIFIED", 4, 0, 3, 4, 0, False, True), (1, 1, 99, "OTHER", "CHI_OTHER", 1, -1, 0, 2, 1, True, False)],
        "mol_id long, atom_idx int, atomic_num int, hybridization string, chiral_tag string, degree int, formal_charge int, num_hs int, total_valence int, num_radical int, is_aromatic boolean, is_in_ring boolean")
    got = feats(G.node_features(atoms))
    carbon, other = got[1, 0], got[1, 1]
    assert len(carbon) == len(other) == 28
    assert [i for i, v in enumerate(carbon) if v] == [2, 15, 18, 21, 22, 23, 24, 27]
    assert carbon[21:] == [1.0, 0.5, 0.75, 0.5, 0.0, 0.0, 1.0]
    assert other == [0.0] * 21 + [0.25, 0.375, 0.0, 0.25, 0.5, 1.0, 0.0]
    bonds = spark.createDataFrame([(1, 0, 1, "DOUBLE", "STEREOZ", True, False)], "mol_id long, begin_idx int, end_idx int, bond_type string, stereo string, is_conjugated boolean, is_in_ring boolean")
    arcs = G.edge_features(bonds).collect()
    assert {(r.src, r.dst) for r in arcs} == {(0, 1), (1, 0)}
    assert all(r.feats == [0, 1, 0, 0, 0, 1, 0, 0, 0, 1, 0] for r in arcs)


def test_token_graph(spark):
    df = spark.createDataFrame([(1, "CCl"), (2, "N"), (3, "")], "id int, s string")
    assert {(r.mol_id, r.atom_idx, r.token) for r in K.token_nodes(df, "id", "s").collect()} == {(1, 0, "C"), (1, 1, "Cl"), (2, 0, "N")}
    assert {(r.mol_id, r.src, r.dst) for r in K.token_edges(df, "id", "s").collect()} == {(1, 0, 1), (1, 1, 0)}


def test_sizes(spark):
    nodes = spark.range(700).select((F.col("id") >= 250).cast("long").alias("mol_id"))
    row = G.large_molecules(nodes).first()
    assert (row.molecules, row.atoms_ge_200, row.atoms_ge_300, row.atoms_ge_400) == (2, 2, 1, 1)


def test_projected(chain):
    got = feats(G.projected(chain[0], [[2.0], [-1.0]], [0.0, 1.0], activate=True))
    assert got[1, 1] == [10.0, 0.0] and got[1, 2] == [0.0, 1.0]


@pytest.mark.parametrize("how", ["sum", "mean", "max", "std"])
def test_wide_vectors_are_summed_in_compiled_blocks(spark, how):
    """Width 192, ragged blocks and a node without neighbours, against numpy; the final aggregate is compiled."""
    rng = np.random.default_rng(3)
    width, x = 192, rng.normal(size=(4, 192))
    nodes = spark.createDataFrame([(1, i, [float(v) for v in x[i]]) for i in range(4)], "mol_id long, atom_idx int, feats array<double>")
    edges = spark.createDataFrame([(1, s, t) for s, t in [(0, 1), (2, 1), (1, 0), (0, 2), (1, 2)]], "mol_id long, src int, dst int")
    for w in (width, 100):
        cut = nodes.withColumn("feats", F.slice("feats", 1, w))
        df = G.neighbour_aggregate(cut, edges, w, how, own=False)
        got = {r.atom_idx: r.feats for r in df.collect()}
        fn = {"sum": np.sum, "mean": np.mean, "max": np.max, "std": np.std}[how]
        for node, sources in {0: [1], 1: [0, 2], 2: [0, 1]}.items():
            assert got[node] == pytest.approx(list(fn(x[sources, :w], axis=0)), abs=1e-12)
        assert got[3] == [0.0] * w and all(len(v) == w for v in got.values())
    text = df._jdf.queryExecution().executedPlan().toString()
    compiled = re.findall(r"\*\(\d+\) HashAggregate\(keys=\[mol_id#\d+L?, dst#\d+, block#\d+\]", text)
    assert len(compiled) >= 2
