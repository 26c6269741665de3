"""Walks of the trie against all distances, the query against its SQL, edge cases against a plain loop."""

import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from check_queries import compare, connect
from doseframe.llm import trie_codes
from doseframe.llm.queries import QUERIES


def brute(rows, rounds=6):
    """(id, code, error, label_error, digest) of (id, vector, label) rows."""
    kept = [(k, [math.floor(4096 * float(x)) for x in v], y) for k, v, y in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    w = len(kept[0][1]) // 8
    cut = [[tuple(v[p * w:(p + 1) * w]) for p in range(8)] for _, v, _ in kept]
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][1]))[:16]
    books = [[cut[i][p] for i in order] for p in range(8)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(8):
            groups = {}
            for c in cut:
                groups.setdefault(nearest(c[p], books[p])[1], []).append(c[p])
            books[p] = [tuple(sum(d) // len(groups[k]) for d in zip(*groups[k])) if k in groups else e for k, e in enumerate(books[p])]
    found = [[nearest(c[p], books[p]) for p in range(8)] for c in cut]
    errors = [sum(d for d, _ in f) for f in found]
    total = {}
    for (_, _, y), e in zip(kept, errors):
        total[y] = total.get(y, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(k, "".join(f"{e:02x}" for _, e in f), err, total[y], digest) for (k, _, y), f, err in zip(kept, found, errors)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(-3, 3), min_size=3, max_size=3), max_size=40), st.integers(1, 6), st.integers(1, 9), st.data())
def test_nearest_entries_of_all_leaves(rows, entries, leaves, data):
    book = np.array(data.draw(st.lists(st.lists(st.integers(-3, 3), min_size=3, max_size=3), min_size=entries, max_size=entries)))
    rows = np.array(rows, dtype=np.int64).reshape(-1, 3)
    distinct, place, counts = trie_codes.distinct_rows(rows)
    assert sorted(map(tuple, rows)) == sorted(tuple(distinct[p]) for p in place) and counts.sum() == len(rows)
    before, trie_codes.LEAVES = trie_codes.LEAVES, leaves
    try:
        best, distance = trie_codes.Trie(distinct).nearest(book)
    finally:
        trie_codes.LEAVES = before
    every = ((distinct[:, None, :] - book[None]) ** 2).sum(axis=2)
    assert best.tolist() == every.argmin(axis=1).tolist() and distance.tolist() == every.min(axis=1).tolist()


def test_shared_prefixes_are_summed_once():
    rows = np.array([(a, b, c) for a in range(4) for b in range(5) for c in range(6)], dtype=np.int64)
    assert (trie_codes.Trie(rows).shared < 1).sum() == 4 and (trie_codes.Trie(rows).shared < 2).sum() == 20


def test_query_equals_its_sql(spark):
    ok, note = compare(spark, connect("/root/testdata/sf0.001"), "op12_trie_codes", "/root/testdata/sf0.001")
    assert ok, note


@pytest.mark.parametrize("n", [3, 16, 90])
def test_edges_against_a_loop(spark, save, n):
    rng = random.Random(n)
    rows = [(k, [rng.choice([-0.5, 0.0, 0.25, rng.gauss(0, 1)]) for _ in range(16)], rng.choice([1, 2, None])) for k in range(n)]
    rows += [(200, None, 1), (201, [None] + [0.0] * 15, 1), (202, [math.nan] * 16, 2), (203, [math.inf] + [1.0] * 15, 2)]
    rows += [rows[0], rows[0], (rows[1][0], rows[2][1], None), (None, rows[1][1], 2)] + [(300 + k, rows[1][1], 2) for k in range(40)]
    df = spark.createDataFrame([(k, v, y, "c", 1.0) for k, v, y in rows], "vec_id long, embedding array<double>, label int, code string, v double")
    got = QUERIES["op12_trie_codes"](spark, save(embeddings=df.repartition(3)))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(brute(rows), key=repr)


def test_empty_table_and_unequal_lengths(spark):
    df = spark.createDataFrame([(1, [1.0] * 8, 1), (2, [1.0] * 16, 1)], "vec_id long, embedding array<double>, label int")
    assert trie_codes.compress(df.limit(0), "vec_id", "embedding", "label").collect() == []
    with pytest.raises(Exception, match="one length"):
        trie_codes.compress(df, "vec_id", "embedding", "label")
    with pytest.raises(Exception, match="too large"):
        trie_codes.compress(df.selectExpr("vec_id", "transform(array_repeat(1e9D, 8), x -> x) as embedding", "label"), "vec_id", "embedding", "label").collect()
