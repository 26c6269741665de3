"""Near duplicates against all pairs by brute force; hot groups; odd inputs; one row kept of each group."""

import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from doseframe.llm import minmax
from doseframe.llm.components import components, merged
from doseframe.llm.queries import QUERIES
from doseframe.llm.text import words


def shingles(text, k):
    w = words(text)
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, k, percent=80):
    """component of every row index, by smallest key reachable."""
    sets = [shingles(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                up[root(i)] = root(j)
    low = {}
    for i, (key, _) in enumerate(rows):
        low.setdefault(root(i), []).append(key)
    return [min(low[root(i)]) for i in range(len(rows))], [len(s) for s in sets]


def corpus(seed=0):
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randint(0, 300)
    out = []
    for g in range(25):
        base = [word() for _ in range(rng.randint(1, 80))]
        for _ in range(rng.randint(1, 8)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 12))):
                copy[rng.randrange(len(copy))] = word()
            out.append(" ".join(copy))
    rng.shuffle(out)
    return list(enumerate(out))


def test_against_all_pairs(spark):
    rows = corpus() + [(1000 + i, t) for i, t in enumerate([None, "", " \t ", "one", "ONE", "one two", "One\x0bTwo", "É é", "é é"])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n", "'x' as digest", "2 as class")
    for k in (2, 5):
        want, sizes = brute(rows, k)
        got = {r.doc_id: r for r in minmax.near_duplicates(df, "doc_id", "text", k).collect()}
        assert len(got) == len(rows)
        for (key, _), component, size in zip(rows, want, sizes):
            assert (got[key].component_id, got[key].n_shingles, got[key].kept) == (component, size, component == key)


def test_group_of_copies_in_blocks(spark, monkeypatch):
    """A large group of near copies, cut into small blocks, gives what all pairs give."""
    monkeypatch.setattr(minmax, "BLOCK", 16)
    monkeypatch.setattr(minmax, "GROUP_ROWS", 40)
    rng = random.Random(5)
    base = ["b%d" % i for i in range(60)]
    rows = []
    for i in range(150):
        copy = list(base)
        for _ in range(rng.randint(0, 6)):
            copy[rng.randrange(60)] = "x%d" % rng.randint(0, 10**6)
        rows.append((i, " ".join(copy)))
    got = {r.doc_id: r.component_id for r in minmax.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", 2).collect()}
    want, _ = brute(rows, 2)
    assert [got[i] for i in range(150)] == want


def test_links_grow_with_the_members(spark, monkeypatch):
    """Near copies of one text: a few links a member reach the components, in both rounds together."""
    sizes = []
    monkeypatch.setattr(minmax, "components", lambda links: sizes.append(links.count()) or components(links))
    monkeypatch.setattr("doseframe.llm.components.components", lambda links: sizes.append(links.count()) or components(links))
    rng = random.Random(8)
    base = ["b%d" % i for i in range(80)]
    rows = []
    for i in range(400):
        copy = list(base)
        for _ in range(rng.randint(1, 4)):
            copy[rng.randrange(80)] = "x%d" % rng.randint(0, 10**6)
        rows.append((i, " ".join(copy)))
    got = minmax.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", 2).collect()
    assert [r.component_id for r in sorted(got, key=lambda r: r.doc_id)] == brute(rows, 2)[0]
    assert 0 < sum(sizes) <= (minmax.PIVOTS + 2) * 400


def test_merged_parts(spark):
    labels = spark.createDataFrame([(1, 1), (2, 1), (5, 5), (6, 5)], "node long, label long")
    got = {r.node: r.label for r in merged(labels, spark.createDataFrame([(5, 1), (9, 8)], "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 5: 1, 6: 1, 8: 8, 9: 8}


def test_repeats_and_null_keys(spark):
    rows = [(3, "a b c d e f"), (3, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (None, "q"), (9, "z z"), (9, "z z"), (4, None), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'l' as lang")
    got = minmax.near_duplicates(df, "doc_id", "text", 2).collect()
    assert len(got) == 9 and sum(r.first for r in got) == 5
    assert {r.component_id for r in got if r.n_shingles == 5} == {2}
    kept = sorted((r.doc_id or 0, r.text or "") for r in minmax.keep_one(df, "doc_id", "text", 2).collect())
    assert kept == [(0, "q"), (2, "a b c d e f"), (4, ""), (4, ""), (9, "z z")]
    assert minmax.keep_one(df.limit(0), "doc_id", "text").count() == 0
    assert minmax.keep_one(df, "doc_id", "text", 2).columns == df.columns


def test_long_texts_are_cut_at_blanks(monkeypatch):
    make = minmax.Sketcher(2)
    text = "Some wörds and ALL of them " * 500
    whole = make.set_of(text)
    monkeypatch.setattr(minmax, "TEXT_CHUNK", 64)
    assert (make.set_of(text) == whole).all() and len(whole) == len(shingles(text, 2))
    assert len(make.set_of("x" * 5000)) == 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "ab", "B", "é", " ", "x y"]), max_size=12))
def test_set_sizes(parts):
    text = " ".join(parts)
    assert len(minmax.Sketcher(2).set_of(text)) == len(shingles(text, 2))
    kinds = minmax.Sketcher(2).set_of(text)
    assert len(minmax.unpacked(minmax.packed(kinds))) == len(kinds)


def test_signatures_estimate_similarity():
    make = minmax.Sketcher(1)
    a = make.set_of(" ".join(f"w{i}" for i in range(1000)))
    b = make.set_of(" ".join(f"w{i}" for i in range(200, 1200)))
    x, y = (np.frombuffer(make.bands_of(k)[1], np.uint8) for k in (a, b))
    assert abs((x == y).mean() - 800 / 1200) < 0.1


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(50, i) for i in range(60, 90)] + [(7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {50: 50} | {i: 50 for i in range(60, 90)}


def test_query_rows(spark):
    df = QUERIES["op3_minmax_dedup"](spark, "/root/testdata/sf0.001")
    assert df.dtypes == [("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint"), ("kept", "boolean")]


def test_texts_of_a_batch_are_taken_in_parts():
    texts = ["a" * 300_000] * 20 + [None, "", "b" * (minmax.TEXTS_AT_ONCE + 1), "c"]
    parts = list(minmax._few(iter([pa.array(texts), pa.array([], pa.string())])))
    assert [t for part in parts for t in part] == texts
    assert all(len(part) == 1 or sum(len(t or "") for t in part) <= minmax.TEXTS_AT_ONCE for part in parts)
    assert len(parts) > 3
