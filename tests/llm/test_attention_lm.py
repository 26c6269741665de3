"""Gradients against differences, masked attention, probabilities that sum to one, counts by brute force."""

import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
from pyspark.sql import functions as F

from doseframe.llm import attention_lm as lm
from doseframe.llm import bpe
from doseframe.llm.queries import BPE_FILE, QUERIES
from doseframe.llm.text import words

ROOT = "/root/testdata/sf0.001"
RANKS = bpe.read_ranks(P.path(BPE_FILE))


def network(seed=2):
    net = lm.new_network(np.arange(3000, 0, -1).astype(float), seed)
    rng = np.random.default_rng(seed)
    net.weights["near"] += rng.normal(0, 0.5, lm.SPAN).astype(np.float32)
    return net


def windows(lengths, seed=0):
    slots = np.random.default_rng(seed).integers(0, lm.SLOTS, sum(lengths))
    ends = np.cumsum(lengths)
    return slots, lm.chunked(slots, np.concatenate(([0], ends[:-1])), ends)


def test_every_subword_is_scored_once_and_sees_its_own_text_only():
    slots, (inputs, targets, place) = windows([1, 5, 16, 17, 100])
    seen = place[place >= 0]
    assert sorted(seen) == list(range(len(slots))) and (targets[place >= 0] == slots[seen]).all()
    net = network()
    rng = np.random.default_rng(1)
    ids = [rng.integers(0, 3000, n) for n in (1, 5, 16, 17, 100)]
    together = lm.Scorer(net).log10(ids)
    apart = np.concatenate([lm.Scorer(net).log10([i]) for i in ids])
    assert np.allclose(together, apart, atol=1e-5)
    changed = [i.copy() for i in ids]
    changed[4][60:] = 7
    assert np.allclose(lm.Scorer(net).log10(changed)[:39 + 60], together[:39 + 60], atol=1e-5)


def test_sizes_of_the_model():
    """2,047 subwords have a slot of their own, and the subword 17 places back still counts."""
    net = network()
    assert len(np.unique(net.slot_of)) >= 2_048 and lm.MIX <= 0.5
    ids = np.random.default_rng(6).integers(0, 3000, 48)
    changed = ids.copy()
    changed[15] = (ids[15] + 1) % 1000
    logs = [lm.Scorer(net).log10([i])[32] for i in (ids, changed)]
    assert abs(logs[0] - logs[1]) > 1e-6


def test_probabilities_of_the_next_subword_sum_to_one():
    net = network()
    start = np.array([5, 900, 42])
    total = sum(10 ** lm.Scorer(net).log10([np.append(start, i)])[-1] for i in range(3000))
    assert abs(total - 1) < 1e-3


def test_scorer_and_training_agree():
    net = network()
    _, (inputs, _, _) = windows([40, 3])
    assert np.allclose(lm.forward(net.weights, inputs)[0], lm.Scorer(net).states(inputs), atol=1e-5)


def test_gradient():
    net = network()
    w = {k: a.astype(np.float64) for k, a in net.weights.items()}
    _, (inputs, targets, place) = windows([30, 9], 3)
    _, g = lm.gradient(w, inputs, targets, place >= 0)
    rng = np.random.default_rng(4)
    for name in w:
        spots = np.flatnonzero(np.abs(g[name].ravel()) > 1e-7)
        for at in rng.choice(spots, min(4, len(spots)), replace=False):
            values = []
            for step in (1e-5, -1e-5):
                moved = {k: a.copy() for k, a in w.items()}
                moved[name].ravel()[at] += step
                values.append(lm.gradient(moved, inputs, targets, place >= 0)[0])
            assert abs((values[0] - values[1]) / 2e-5 - g[name].ravel()[at]) < 1e-5, name


def test_training_helps():
    net = lm.new_network(np.ones(50), 1)
    text = np.tile([3, 8, 1, 30, 22, 9], 400)
    inputs, targets, place = lm.chunked(net.slot_of[text], np.array([0]), np.array([len(text)]))
    before = lm.Scorer(net).log10([text]).mean()
    after, seen = lm.train(net, iter([(inputs[a:a + 16], targets[a:a + 16], place[a:a + 16] >= 0) for a in range(0, len(inputs), 16)] * 10))
    assert seen == 10 * len(text) and lm.Scorer(after).log10([text]).mean() > before + 0.5


def brute(docs, held):
    counts, texts = Counter(), 0
    for key, text in docs:
        if not held(key):
            counts.update(words(text))
            texts += 1
    n, v = sum(counts.values()) + texts, len(counts) + (texts > 0)
    out = []
    for key, text in docs:
        c = [counts[w] for w in words(text)] + [texts]
        out.append((key, held(key), len(c), sum(x > 0 for x in c), n, sum(math.log10((x + 1) / (n + v + 1)) for x in c)))
    return out


def test_query_against_brute_force(spark, monkeypatch):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{ROOT}/documents.parquet").collect()]
    held = lambda k: zlib.crc32(str(k).encode()) % 7 == 2
    for head in (lm.HEAD_WORDS, 20):  # nearly all words by the join
        monkeypatch.setattr(lm, "HEAD_WORDS", head)
        got = sorted(QUERIES["op5_attention_lm"](spark, ROOT).collect(), key=lambda r: r.doc_id)
        for r, (key, out, n, known, total, base) in zip(got, sorted(brute(docs, held)), strict=True):
            assert (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (key, out, n, known, total)
            assert abs(r.base_score - base) < 1e-6 and r.score < 0
        if head == 20:
            assert np.allclose([r.score for r in got], scores, rtol=0.02)
        scores = [r.score for r in got]


def test_network_sees_every_training_text(spark, monkeypatch):
    """The rounds together train on each subword of every text that is not held out, once."""
    seen, plain = [], lm._round

    def counted(chunks, net):
        seen.extend(int(np.frombuffer(r.real, dtype=np.int16).sum()) for r in chunks.select("real").collect())
        return plain(chunks, net)

    monkeypatch.setattr(lm, "_round", counted)
    QUERIES["op5_attention_lm"](spark, ROOT)
    sub = lm.Subwords(RANKS, P.PATTERN)
    docs = spark.read.parquet(f"{ROOT}/documents.parquet").collect()
    want = sum(len(sub.text(words(r.text))[0]) for r in docs if zlib.crc32(str(r.doc_id).encode()) % 7 != 2)
    assert sum(seen) == want


def test_held_out_texts(spark):
    """Held-out texts are no less likely than under the word shares alone."""
    got = QUERIES["op5_attention_lm"](spark, "/root/testdata/sf0.01").where("held_out").selectExpr("sum(score) s", "sum(base_score) b").first()
    assert got.s > got.b


def test_odd_inputs(spark, save):
    rows = [(1, None, "x"), (2, "", "y"), (3, "Ab aB " * 3000, "z"), (3, "ab", "z"), (3, "ab", "z"), (None, "ab cd", "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, tail string")
    got = QUERIES["op5_attention_lm"](spark, save(documents=df)).collect()
    assert len(got) == 6 and sorted(r.n_tokens for r in got) == [1, 1, 2, 2, 3, 6001]
    assert all(r.held_out for r in got if r.doc_id is None)
    assert QUERIES["op5_attention_lm"](spark, save(documents=df.limit(0))).count() == 0
    alone = spark.createDataFrame([(None, "ab cd", "q")], "doc_id long, text string, tail string")
    r = QUERIES["op5_attention_lm"](spark, save(documents=alone)).first()
    assert (r.n_known, r.train_tokens, r.base_score) == (0, 0, 0.0) and r.score < 0


def test_scores_are_given_on_in_parts(spark, monkeypatch):
    """A task holds few scored rows at once; where it cuts them changes nothing."""
    docs = spark.createDataFrame([(i, f"one two three {i} " * (i % 5) + f"seldom{i}") for i in range(40)], "doc_id long, text string").coalesce(1)
    ask = lambda: {r["doc_id"]: r for r in lm.score(docs, "doc_id", "text", F.col("doc_id") % 7 == 2, RANKS, P.PATTERN).collect()}
    whole = ask()
    monkeypatch.setattr(lm, "BATCH_SUBWORDS", 20)
    cut = ask()
    monkeypatch.setattr(lm, "ROWS_AT_ONCE", 3)
    assert ask() == cut
    assert len(cut) == 40 and [cut[i]["n_known"] for i in range(40)] == [whole[i]["n_known"] for i in range(40)]


def test_words_of_many_texts_are_looked_up_once():
    """Ids of texts cut together are those of their words in order, an end behind each text; equal words are coded once."""
    texts = ["", None, " Ab\tab  \u00e9t\u00e9 ", "a b " * 500, "\x0c", "AB aB \u65e5\u672c"]
    sub, coded = lm.Subwords(RANKS, P.PATTERN), []
    plain, many = sub.piece, sub.many
    sub.many = lambda text: coded.append(text) or many(text)
    got = sub.texts(pa.array(texts, pa.string()))
    want = [[i for w in words(t) for i in plain(b" " + w)] + [sub.end] for t in texts]
    assert got.ids.tolist() == sum(want, []) and got.text_sizes.tolist() == [len(w) for w in want]
    assert got.many.tolist() == [len(words(t)) + 1 for t in texts]
    assert sorted("".join(coded).encode().split()) == sorted({w for t in texts for w in words(t)})
    odd = [b"a\xff", "\u00a0x\u2003\u2028".encode(), b"\xf0\x9f", "\u3000".encode(), b"<|endoftext|>"]
    for some in (odd, odd[1:2] + odd[3:]):   # words that are no UTF-8 are coded one by one
        assert lm.Subwords(RANKS, P.PATTERN).of(some) == [np.array(plain(b" " + w), dtype=np.int32).tobytes() for w in some]
    assert len(sub.texts(pa.array([], pa.string())).ids) == 0


def test_steps_are_those_of_plain_adagrad():
    """What is left out of a step, rows of the embedding that no window holds, has no slope."""
    net = network()
    _, (inputs, targets, place) = windows([40, 3, 70], 5)
    batches = [(inputs[a:a + 3].astype(np.int16), targets[a:a + 3].astype(np.int16), place[a:a + 3] >= 0) for a in range(0, len(inputs), 3)]
    w = {k: a.astype(np.float64) for k, a in net.weights.items()}
    square = {k: np.full_like(a, 1e-4) for k, a in w.items()}
    for batch in batches:
        g = lm.gradient(w, *batch)[1]
        for k in w:
            square[k] += g[k] * g[k]
            w[k] -= lm.RATE * g[k] / np.sqrt(square[k])
    got, seen = lm.train(net, iter(batches))
    assert seen == 113 and lm.Step(net.weights).slope.dtype == np.float32
    assert all(np.allclose(got.weights[k], w[k], atol=2e-3) for k in w)


def test_scores_beyond_the_range_of_exp():
    """A class whose score is 200 above the others: losses and logs stay finite and agree."""
    net = network()
    net.weights["class_bias"][3] += 200
    slots, (inputs, targets, place) = windows([40], 7)
    loss, g = lm.gradient(net.weights, inputs, targets, place >= 0)
    ids = np.array([int(np.flatnonzero(net.slot_of == s)[0]) for s in slots])
    logs = lm.Scorer(net).log10([ids]) - net.rest_log10[ids]
    assert np.isfinite(logs).all() and logs.min() < -80 and all(np.isfinite(a).all() for a in g.values())
    assert abs(loss + logs.mean() * np.log(10)) < 1e-3 * loss
