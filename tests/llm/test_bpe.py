"""Tree-reduced BPE against the reference library, exact round trips, joins at every cut."""

import hashlib

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from doseframe.llm import bpe
from doseframe.llm.queries import BPE_FILE, QUERIES

ROOT = "/root/testdata/sf0.001"
RANKS = bpe.read_ranks(P.path(BPE_FILE))
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
CASES = [
    "", " ", "\n\n  \n", "a", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa",
    "Élève naïve, straße; ñandú's 12345678901234567890", "日本語テキスト", "😀😀 é", " " * 500 + "x", "ab" * 3000, "<|endoftext|>",
    "http://a.example/?q=1&r=2#" + "z" * 4000, "\x00\x01 tab\tend",
]


@pytest.mark.parametrize("leaf", [1, 3, 16, 64])
def test_tokens_are_the_librarys(leaf):
    tokenizer = bpe.Tokenizer(RANKS, P.PATTERN, leaf)
    for text in CASES:
        ids = tokenizer.encode(text)
        assert ids == LIBRARY.encode_ordinary(text)
        assert tokenizer.decode(ids) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200), st.sampled_from([1, 2, 5, 16]))
def test_any_text(text, leaf):
    text = text.encode("utf-8", "replace").decode()
    assert bpe.Tokenizer(RANKS, P.PATTERN, leaf).encode(text) == LIBRARY.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcdehilnorst aéñ", min_size=2, max_size=120), st.data())
def test_join_at_any_cut(text, data):
    merger = bpe.Merger(RANKS)
    raw = text.encode()
    cut = data.draw(st.integers(0, len(raw)))
    assert merger.join(merger.merge(raw[:cut]), merger.merge(raw[cut:])) == merger.merge(raw)


def test_long_merge_is_the_short_one(monkeypatch):
    merger = bpe.Merger(RANKS)
    for raw in (b"a" * 95, b"abcabcabd" * 10, "éàü straße ".encode() * 6):
        short = merger.merge(raw)
        monkeypatch.setattr(bpe, "HEAP_BYTES", 1)
        assert merger.merge(raw) == short
        monkeypatch.undo()


def test_columns(spark):
    rows = [(1, "Hello world, hello", 9), (2, None, 8), (3, "", 7), (4, "été " * 3000, 6), (4, "été " * 3000, 6)]
    df = spark.createDataFrame(rows, "id long, text string, ids long")
    got = df.select("id", "text", "ids", bpe.encode_column(df.text, RANKS, P.PATTERN).alias("t"))
    got = got.withColumn("back", bpe.decode_column(got.t, RANKS)).collect()
    for r in got:
        assert r.t == LIBRARY.encode_ordinary(r.text or "") and bytes(r.back) == (r.text or "").encode()
    assert df.limit(0).select(bpe.encode_column(df.text, RANKS, P.PATTERN)).count() == 0
    assert df.select(bpe.decode_column(F.lit(None).cast("array<int>"), RANKS).alias("b")).first().b == b""


def test_query_over_the_whole_table(spark):
    got = {r.doc_id: r for r in QUERIES["op4_byte_bpe"](spark, ROOT).collect()}
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{ROOT}/documents.parquet").collect()}
    assert set(got) == set(docs)
    for key, text in docs.items():
        ids = LIBRARY.encode_ordinary(text)
        assert got[key].n_tokens == len(ids)
        assert got[key].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[key].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
