"""Exact search against brute force; graph search by recall; odd vectors."""

import numpy as np
import pytest

from doseframe.llm import ann_graph, exact_topk

NAN, INF = float("nan"), float("inf")
ODD = [(900, None), (901, [1.0, None, 2.0, 3.0]), (902, [NAN, 1.0, 1.0, 1.0]), (903, [INF, 0.0, 0.0, 0.0]), (None, [1.0, 2.0, 3.0, 4.0]), (904, []), (905, [1.0])]


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, vec array<double>").selectExpr("*", "'c' as id", "1 as score", "2 as w")


def vectors(n, seed=0, spread=True):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, 4)) * (rng.lognormal(0, 1.5, (n, 1)) if spread else 1)
    v[5] = v[6] = v[n - 1]
    return v


def best(v, ids, q, k, scale=None):
    w = np.floor(scale * v) if scale else v
    s = w @ w[q]
    order = sorted((-s[i], ids[i]) for i in range(len(v)) if i != q)[:k]
    return [(i, -x) for x, i in order]


@pytest.mark.parametrize("block", [8_192, 40])
def test_exact(spark, monkeypatch, block):
    monkeypatch.setattr(exact_topk, "BLOCK", block)
    monkeypatch.setattr(exact_topk, "QUERIES", 7)
    v = vectors(300)
    rows = [(i, v[i].tolist()) for i in range(300)] + ODD + [(3, v[3].tolist())]
    got = {}
    for r in exact_topk.top_products(frame(spark, rows), "vec_id", "vec", 5, 20).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(got) == list(range(0, 300, 20)) and 900 not in got
    for q, found in got.items():
        assert [(i, s) for _, i, s in sorted(found)] == best(v, list(range(300)), q, 5, 64)


def test_coordinate_pruning_keeps_every_answer():
    rng = np.random.default_rng(2)
    v = np.floor(64 * rng.normal(size=(500, 6)))
    v = v[np.argsort(-np.sqrt((v * v).sum(axis=1)))]
    q = v[rng.choice(500, 30)] + np.floor(rng.normal(size=(30, 6)) * 5)
    ids = np.arange(500)
    scores = q @ v.T
    bound = np.sort(scores, axis=1)[:, -5]
    out = exact_topk.search_block(np.full(30, -1) - np.arange(30), q, bound, ids, v, np.sqrt((v * v).sum(axis=1)), 5)
    got = {}
    for a, b, s in zip(*out):
        got.setdefault(a, set()).add(s)
    for i in range(30):
        assert sorted(got[-1 - i])[-1] == scores[i].max() and min(got[-1 - i]) >= bound[i]


def test_few_rows_and_large_components(spark):
    few = frame(spark, [(0, [1.0, 2.0]), (1, [3.0, -1.0]), (20, [0.0, 0.0])])
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in exact_topk.top_products(few, "vec_id", "vec", 20, 20).collect()]
    assert sorted(got) == [(0, 1, 1, 4096), (0, 2, 20, 0), (20, 1, 0, 0), (20, 2, 1, 0)]
    huge = frame(spark, [(0, [1e9, 1e9]), (1, [1e9, 1e9]), (2, [-1e9, -1e9])])
    got = [(r.vec_id, r.score) for r in exact_topk.top_products(huge, "vec_id", "vec", 2, 20).collect()]
    assert got == [(1, 2**63 - 1), (2, -(2**63))]
    assert exact_topk.top_products(few.limit(0), "vec_id", "vec", 3, 20).count() == 0


def test_graph_recall(spark, monkeypatch):
    monkeypatch.setattr(ann_graph, "SHARD", 400)
    rng = np.random.default_rng(1)
    v = rng.normal(size=(1500, 24))
    v[100:160] = v[100]  # many copies
    rows = [(i, v[i].tolist()) for i in range(1500)]
    df = spark.createDataFrame(rows, "vec_id long, vec array<double>")
    got = {}
    for r in ann_graph.nearest(df, "vec_id", "vec", 10, 20).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    hit = 0
    for q in range(0, 1500, 20):
        want = best(v, list(range(1500)), q, 10)
        assert sorted(got[q]) == list(range(1, 11))
        assert all(abs(s - v[i] @ v[q]) < 1e-9 for i, s in got[q].values())
        hit += len({i for i, _ in want} & {i for i, _ in got[q].values()})
    assert hit / (10 * 75) >= 0.9
    assert [got[100][i][0] for i in range(1, 11)] == list(range(101, 111))


@pytest.mark.parametrize("clusters", [0, 40])
def test_recall_at_64_components(clusters):
    """One shard of 4,000 vectors at the registered degree and beams: without clusters, and with small ones."""
    rng = np.random.default_rng(4)
    v = rng.normal(size=(4000, 64))
    if clusters:
        v = 0.3 * v + rng.normal(size=(clusters, 64))[rng.integers(0, clusters, 4000)]
    points = ann_graph.lifted(v)
    graph, entry = ann_graph.build_graph(points)
    asked = np.concatenate((v[::20], np.zeros((200, 1))), axis=1).astype(np.float32)
    found, _ = ann_graph.beam_search(points, graph, entry, asked, ann_graph.BEAM)
    scores = v[::20] @ v.T
    scores[np.arange(200), np.arange(0, 4000, 20)] = -np.inf
    want = np.argsort(-scores, axis=1)[:, :20]
    exact = np.where(found < 0, -np.inf, np.take_along_axis(scores, np.maximum(found, 0), axis=1))
    got = np.take_along_axis(found, np.argsort(-exact, axis=1)[:, :20], axis=1)
    assert sum(len(set(a) & set(b)) for a, b in zip(want, got)) / want.size >= 0.95


def test_a_task_for_every_graph(spark, monkeypatch):
    """Few rows, much work: the build and the search have tasks by the number of shards, not by bytes."""
    monkeypatch.setattr(ann_graph, "SHARD", 50)
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(400)]
    index = ann_graph.build_index(spark.createDataFrame(rows, "id long, vec array<double>"), 50)
    assert index.rdd.getNumPartitions() == ann_graph.SPREAD * 8
    found = ann_graph.search_index(index, spark.createDataFrame(rows[:20], "query_id long, vec array<double>"), 3)
    assert found.rdd.getNumPartitions() == ann_graph.SPREAD * 8 and found.count() == 20 * 8 * 3


def test_graph_reaches_every_point():
    rng = np.random.default_rng(3)
    points = np.concatenate((rng.normal(size=(200, 5)), rng.normal(size=(50, 5)) * 0.01 + 30)).astype(np.float32)
    graph, entry = ann_graph.build_graph(points, degree=6, beam=20)
    seen, todo = {entry}, [entry]
    while todo:
        for x in graph[todo.pop()]:
            if x < 250 and x not in seen:
                seen.add(int(x))
                todo.append(int(x))
    assert len(seen) == 250


def test_graph_odd_vectors(spark):
    rows = [(0, [1.0, 0.0, 0.0, 0.0]), (1, [2.0, 0.0, 0.0, 0.0]), (2, [0.0, 0.0, 0.0, 0.0]), (3, [-1.0, 0.0, 0.0, 1.0]), (3, [-1.0, 0.0, 0.0, 1.0])]
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann_graph.nearest(frame(spark, rows + ODD), "vec_id", "vec", 20, 20).collect()]
    assert sorted(got) == [(0, 1, 1, 2.0), (0, 2, 3, -1.0)]
    assert ann_graph.nearest(frame(spark, rows).limit(0), "vec_id", "vec", 5, 20).count() == 0
