"""The stages one after the other: columns, decisions, one of each group, tokens."""

import hashlib

import numpy as np
import pandas as pd
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as cp
from doseframe.llm import bpe, mixing
from tests.llm.test_minmax import brute

ROOT = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    columns = docs.columns
    names = [n for n, _ in cp.STAGES]
    assert names == ["toxicity", "near duplicates", "mixing", "tokens"]
    clean = cp.STAGES[0][1](spark, docs, ROOT)
    assert clean.columns == columns and 0 < clean.count() < docs.count()
    rows = sorted((r.doc_id, r.text) for r in clean.collect())
    single = cp.STAGES[1][1](spark, clean, ROOT)
    component, sizes = brute(rows, 5)
    want = {key for (key, _), c, n in zip(rows, component, sizes) if c == key or not n}
    assert single.columns == columns and {r.doc_id for r in single.collect()} == want
    mixed = cp.STAGES[2][1](spark, single, ROOT)
    assert mixed.columns == columns and {r.doc_id for r in mixed.collect()} <= want
    ranks = bpe.read_ranks(P.path(cp.BPE_FILE))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = dict(rows)
    for r in cp.STAGES[3][1](spark, mixed, ROOT).collect():
        assert list(r.ids) == library.encode_ordinary(texts[r.doc_id]) and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


@pytest.mark.parametrize("poor", [0.03, 0.5])
def test_mixing_gives_every_copy(spark, monkeypatch, poor):
    """Rows of the stage are the copies drawn, and their expected tokens have the target shares."""
    rng = np.random.default_rng(8)
    p0 = {str(i): float(rng.beta(2 * poor, 2 * (1 - poor))) for i in range(4000)}
    n = {t: int(rng.integers(20, 60)) for t in p0}

    def member(text, model):
        @F.pandas_udf("n_tokens long, p array<double>")
        def of(texts: pd.Series) -> pd.DataFrame:
            return pd.DataFrame({"n_tokens": [n[t] for t in texts], "p": [[p0[t], 1 - p0[t]] for t in texts]})
        return of(text)

    monkeypatch.setattr(mixing, "fit_membership", lambda *a: None)
    monkeypatch.setattr(mixing, "member_column", member)
    monkeypatch.setattr(cp, "table", lambda *a: spark.createDataFrame([], "doc_id long, quality int"))
    docs = spark.createDataFrame([(int(t), t) for t in p0], "doc_id long, text string")
    got = cp.mix_sources(spark, docs, "").collect()
    kept = np.array([sum(n[r.text] * p0[r.text] for r in got), sum(n[r.text] * (1 - p0[r.text]) for r in got)])
    good = sum(n[t] * (1 - p0[t]) for t in p0)
    assert abs(kept[1] / good - 1) < 0.03 and abs(kept[0] / kept.sum() - cp.SHARES[0]) < 0.01


def test_odd_documents(spark, save):
    rows = [(1, None), (2, ""), (3, "a b c d e f g"), (3, "a b c d e f g"), (4, "A b c d e f g"), (None, "x"), (5, "long text " * 20000)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, 0.5) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, _rate double")
    folder = save(documents=docs, labels=spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    got = cp.run(spark, folder).collect()
    assert {r.doc_id for r in got} <= {1, 2, 3, None, 5} and len(got) == len({(r.doc_id, r.ids_sha256) for r in got})
    assert cp.run(spark, save(documents=docs.limit(0))).count() == 0


def test_clashing_columns_keep_their_values(spark, save):
    """Columns named like the stages' own helpers come out of every stage but the last as they went in."""
    extra = ["_rate", "_hash", "_rest", "_copies", "_copy", "_key", "_member", "_row"]
    rows = [(k, f"words of text number {k} and some more {k * 7} of them", *[f"{c}{k}" for c in extra]) for k in range(30)]
    rows += [rows[3], (40, rows[4][1], *rows[4][2:]), (41, None, *rows[5][2:]), (42, None, *[None] * len(extra))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} string" for c in extra))
    folder = save(documents=docs, labels=spark.createDataFrame([(k, k % 2, 0) for k in range(20)], "doc_id long, quality int, toxic int"))
    want = {tuple(r) for r in rows}
    for _, stage in cp.STAGES[:-1]:
        kept = stage(spark, docs, folder)
        assert kept.columns == docs.columns
        got = [tuple(r) for r in kept.collect()]
        assert set(got) <= want and len(got) >= 10, stage


def test_token_rows_in_small_groups(spark, monkeypatch):
    """The ids of the token stage are those of the library, however texts are grouped; nulls and empty texts have none."""
    monkeypatch.setattr(bpe, "GROUP_BYTES", 10)
    ranks = bpe.read_ranks(P.path(cp.BPE_FILE))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["", None, "short", "a longer text, with 12 words or so", "é" * 50, "short"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in bpe.tokenized(docs, ["doc_id"], "text", ranks, P.PATTERN).collect()}
    assert [rows[k].ids for k in range(6)] == [library.encode_ordinary(t or "") for t in texts]
    assert all(rows[k].n_tokens == len(rows[k].ids) for k in range(6))
