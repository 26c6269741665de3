"""Rates against a plain projected gradient in numpy, targets met, odd inputs."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from doseframe.llm import mixing, terms
from doseframe.llm.queries import MIX_SHARES, QUERIES
from doseframe.llm.text import words


def plain(n, p, target, steps=100_000):
    """Projected gradient with a small step on the same weighted residuals, from rates of 1."""
    inverse = np.linalg.pinv((n[:, None] * p).T @ p)
    rate = np.ones(len(n))
    for _ in range(steps):
        residual = (n * rate) @ p - target
        if np.abs(residual).max() < 1e-9 * target.sum():
            break
        rate = np.maximum(0, rate - 0.3 * (p @ (inverse @ residual)))
    return rate


@pytest.mark.parametrize("shares", [[0.2, 0.5, 0.3], [0.02, 0.9, 0.08], [0.6, 0.1, 0.3]])
def test_targets_are_met(spark, shares):
    rng = np.random.default_rng(1)
    n = rng.integers(0, 2000, 400)
    p = rng.dirichlet([0.4, 0.6, 0.3], 400)
    members = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p)], "n_tokens long, p array<double>")
    rates = mixing.fit_rates(members, shares)
    got = rates.of(p)
    target = np.array(shares) * n.sum()
    assert (got >= 0).all() and np.abs((n * got) @ p - target).max() < 1e-5 * n.sum()
    want = plain(n, p, target)
    assert np.abs((n * want) @ p - target).max() < 1e-5 * n.sum()
    if (want > 0).all():
        assert np.allclose(got, want, atol=1e-6)


def test_bad_shares_and_empty_domains(spark):
    members = spark.createDataFrame([(10, [1.0, 0.0])], "n_tokens long, p array<double>")
    assert mixing.fit_rates(members, [0.5, 0.5]).of(np.array([[1.0, 0.0]]))[0] == pytest.approx(0.5)
    for bad in ([], [0.0], [-1.0, 2.0]):
        with pytest.raises(ValueError):
            mixing.fit_rates(members, bad)


def test_query(spark):
    got = QUERIES["op7_soft_mixing"](spark, "/root/testdata/sf0.01").toPandas()
    p, n = got[["p_poor", "p_good", "p_toxic"]].to_numpy(), got["n_tokens"].to_numpy(float)
    assert len(got) == 1000 and np.allclose(p.sum(axis=1), 1) and (got["rate"] >= 0).all()
    assert np.abs((n * got["rate"].to_numpy()) @ p / n.sum() - np.array(MIX_SHARES)).max() < 1e-4
    assert (abs(got["copies"] - got["rate"]) < 1).all()


def test_odd_inputs(spark, save):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "a b " * 9000, 1), (3, "a b", 1), (None, "a", 1)], "doc_id long, text string, rate int")
    labels = spark.createDataFrame([(3, 1, 0), (3, None, None), (None, 0, 0)], "doc_id long, quality int, toxic int")
    got = QUERIES["op7_soft_mixing"](spark, save(documents=docs, labels=labels)).collect()
    assert sorted(r.n_tokens for r in got) == [0, 0, 1, 2, 18000]
    assert QUERIES["op7_soft_mixing"](spark, save(documents=docs.limit(0), labels=labels.limit(0))).count() == 0


def test_rows_of_the_fit_are_not_sorted_in_spark(spark, monkeypatch):
    """A sort in Spark evaluates the columns of its rows twice; the order is that of the ids all the same."""
    data = [(3, 1, [5, 9]), (1, 0, []), (2, 1, [2, 5, 7]), (10, 0, [9])]
    rows = spark.createDataFrame(data, "doc_id long, label int, terms array<long>").repartition(3)
    monkeypatch.setattr(type(rows), "orderBy", None)
    got, labels = terms.chosen_rows(rows, np.array([9, 2, 5]))
    assert [r.tolist() for r in got] == [[], [1, 2], [0, 2], [0]] and labels.tolist() == [0, 1, 1, 0]
    assert terms.chosen_rows(rows, np.empty(0, dtype=np.int64))[0][1].tolist() == []


def test_terms_found_and_posteriors_against_plain_code(monkeypatch):
    texts = ["Anders, anderes; an", "", None, "*** (andere) ab", "wort wort wörter"]
    chosen = np.concatenate([terms.terms_of(t) for t in texts])[::2]
    monkeypatch.setattr(terms.TermIndex, "KEPT_WORDS", 3)
    index = terms.TermIndex(np.unique(chosen))
    places = [index.find(words(t)) for t in texts]
    assert places == [np.flatnonzero(np.isin(np.unique(chosen), terms.terms_of(t))).tolist() for t in texts]
    assert terms.word_terms(b"(abcd)") == (zlib.crc32(b"wabcd"), zlib.crc32(b"p4abcd"))
    weights = np.random.default_rng(0).normal(size=(len(np.unique(chosen)), 3))
    model = mixing.Membership(np.unique(chosen), np.array([0.1, 0.2, 0.3]), weights)
    z = np.exp([model.bias + weights[p].sum(axis=0) for p in places])
    assert np.allclose(model.posteriors(places), z / z.sum(axis=1, keepdims=True), rtol=1e-12)
    assert model.posteriors([]).shape == (0, 3)


def test_terms_of_many_texts_at_once():
    """Array operations find the same places as the index."""
    letters = "aAbBcC12*(#é.,;:!?\"'()[]{}<>*#&-_ \t\n\x1c 日"
    rng = random.Random(3)
    texts = ["", None, "   ", " a ", "x" * 70 + " " + "*" * 80 + " (" + "ab" * 50 + ")", "****", "(a", "a)"]
    texts += ["".join(rng.choices(letters, k=rng.randrange(120))) for _ in range(200)]
    known = np.unique(np.concatenate([terms.terms_of(t) for t in texts]))
    for chosen in (known[::3], known, known[:0], rng.sample(known.tolist(), 300)):
        table, index = terms.TermTable(chosen), terms.TermIndex(chosen)
        for rows in (pa.array(texts), pa.array(texts)[5:90], pa.array([None], pa.string()), pa.array([], pa.string())):
            size, of, places = table.find(rows)
            assert size.tolist() == [len(words(t)) for t in rows.to_pylist()]
            assert [places[of == i].tolist() for i in range(len(rows))] == [index.find(words(t)) for t in rows.to_pylist()]


def test_member_column_reads_texts_as_arrays(spark, monkeypatch):
    """Posteriors by the column are those of plain code, bit by bit; no task looks words up one by one."""
    texts = ["Anders, anderes; an", "", None, "wort wort wörter", "an"] * 3
    chosen = np.unique(np.concatenate([terms.terms_of(t) for t in texts]))[::2]
    model = mixing.Membership(chosen, np.array([0.1, 0.2]), np.random.default_rng(0).normal(size=(len(chosen), 2)))
    index = terms.TermIndex(chosen)
    want = model.posteriors([index.find(words(t)) for t in texts])
    monkeypatch.setattr(mixing, "GROUP_BYTES", 40)
    monkeypatch.setattr(terms.TermIndex, "find", None)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(2)
    got = df.select("i", mixing.member_column(F.col("t"), model).alias("m")).orderBy("i").collect()
    assert [r.m.n_tokens for r in got] == [len(words(t)) for t in texts]
    assert [r.m.p for r in got] == want.tolist()
