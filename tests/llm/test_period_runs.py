"""Runs against a scan of every period, grammar extensions against direct comparison, edge cases of the query."""

import hashlib
import random
import zlib

import numpy as np
from hypothesis import given, settings, strategies as st

from doseframe.llm import period_runs
from doseframe.llm.queries import QUERIES
from doseframe.llm.recompression import Grammar
from doseframe.llm.text import table


def brute_runs(words, least=12):
    """Maximal stretches of every period; of one stretch the smallest period."""
    found = {}
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j - i + p >= max(least, 2 * p):
                found.setdefault((i, j - i + p), p)
            i = max(j, i + 1)
    return sorted((s, n, p) for (s, n), p in found.items())


def brute_row(key, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(key).encode())
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    top = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None,
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


@st.composite
def texts(draw):
    words = draw(st.lists(st.sampled_from([b"a", b"b", b"c"][:draw(st.integers(1, 3))]), max_size=60))
    for _ in range(draw(st.integers(0, 3))):
        if len(words) > 3:
            at, q = draw(st.integers(0, len(words) - 2)), draw(st.integers(1, 9))
            for i in range(at + q, min(len(words), at + q * draw(st.integers(2, 6)))):
                words[i] = words[i - q]
    return words


@settings(max_examples=250, deadline=None)
@given(st.lists(texts(), max_size=5), st.sampled_from([2, 5, 12]))
def test_all_runs_of_groups_of_texts(group, least):
    got = period_runs.runs_of(group, least)
    assert [[tuple(r) for r in rows.tolist()] for rows in got] == [brute_runs(w, least) for w in group]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=2, max_size=80), st.data())
def test_extensions_by_the_grammar(symbols, data):
    n = len(symbols)
    grammar = Grammar(np.array([3, *symbols, 4]), 5, data.draw(st.sampled_from([1, 8])))
    i = data.draw(st.integers(1, n - 1))
    j = data.draw(st.integers(i + 1, n))
    s = [3, *symbols, 4]
    ahead = next(k for k in range(n + 2) if s[i + k] != s[j + k])
    behind = next(k for k in range(n + 2) if s[i - 1 - k] != s[j - 1 - k])
    at = np.array([i]), np.array([j])
    assert grammar.extend(*at).tolist() == [ahead]
    assert grammar.extend(*at, back=True).tolist() == [behind]


def test_long_periodic_text_has_few_levels_and_one_run():
    words = [b"%d" % (i % 700) for i in range(40_000)]
    assert [r.tolist() for r in period_runs.runs_of([words])] == [[[0, 40_000, 700]]]
    grammar = Grammar(np.array([2, *[0, 1] * 5000, 3]), 4, 8)
    assert len(grammar.levels) < 12


def test_query_against_brute_force(spark, save):
    rng = random.Random(5)
    texts = [" ".join(rng.choices("ab cd É x \t\n".split(" "), k=rng.choice([3, 14, 60]))) for _ in range(60)]
    texts += [None, "", " \t\n", "one", "x " * 5000, "A a " * 6, "a b " * 8 + "c", texts[0], texts[0]]
    rows = [(k, t) for k, t in enumerate(texts)] + [(3, texts[3])]
    rows.append((next(k for k in range(1000) if zlib.crc32(str(k).encode()) % 10 == 0), "w1 w2 w3 w4 w5 w6 w7 w8 w9 " * 9))
    df = spark.createDataFrame([(k, t, t, 1) for k, t in rows], "doc_id long, text string, runs string, n_runs int")
    got = QUERIES["op13_period_runs"](spark, save(documents=df.repartition(3)))
    want = sorted((k, *brute_row(k, t)) for k, t in rows)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert dict(got.dtypes)["n_runs"] == dict(got.dtypes)["exponent_milli"] == "bigint"


def test_given_documents(spark):
    folder = "/root/testdata/sf0.001"
    rows = table(spark, folder, "documents").select("doc_id", "text").collect()
    short = {r.doc_id: r.text for r in rows if len((r.text or "").split()) < 1200}
    got = {r[0]: tuple(r)[1:] for r in QUERIES["op13_period_runs"](spark, folder).collect()}
    assert len(got) == len(rows) and len(short) > 150
    assert all(got[k] == brute_row(k, t) for k, t in short.items())
    assert sum(r[0] > 0 for r in got.values()) >= 10


def test_spans_nulls_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b " * 7), (1, None)], "k string, text string")
    rows = {r.k: r for r in period_runs.find(df, "k", "text").collect()}
    assert [tuple(x) for x in rows[None].runs] == [(0, 14, 2)] and rows[None].collapsed == "a b"
    assert rows["1"].runs == [] and rows["1"].collapsed == "" and rows["1"].n_words == 0
    assert period_runs.digests(period_runs.find(df.limit(0), "k", "text"), "k").collect() == []
