"""Ids against the whole-text tokenizer, every id in one piece, sequences without padding, balanced groups."""

import json
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from doseframe.llm import tier_packing
from doseframe.llm.queries import PACK_FILE, QUERIES
from doseframe.llm.text import table

PATH = P.path(PACK_FILE)
WHOLE = Tokenizer.from_file(PATH)
CODER = tier_packing.WordIds(open(PATH, encoding="utf-8").read())


def ids_of(text):
    return WHOLE.encode(text or "", add_special_tokens=False).ids + [2]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text(alphabet="aÉéŉĳıſŸ÷×ªÀß́̀ΣςİßK's't \t\n 　\x85\x1c12½‍가ᅡ<|endoftext|>")), max_size=4))
def test_words_are_coded_as_in_the_whole_text(texts):
    texts = [t.encode("utf-8", "replace").decode() for t in texts]
    CODER.clear()
    CODER.older = {}
    for _ in range(2):
        got = [np.frombuffer(b, tier_packing.ID).tolist() for b in CODER.encode([t.encode() for t in texts])]
        assert got == [WHOLE.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(1, 40), st.integers(1, 200)), max_size=60), st.integers(1, 30))
def test_pieces_cover_documents_and_fill_sequences(sizes, every):
    packer = tier_packing.Packer((4, 8, 16, 32), 64)
    rows = []
    for k, n in enumerate(sizes):
        packer.add(k, np.arange(n, dtype=tier_packing.ID).tobytes())
        if k % every == 0:
            rows += packer.flush()
    rows += packer.flush(True)
    parts, sequences, groups = defaultdict(list), defaultdict(list), defaultdict(set)
    for row, start, ids, sequence, offset, tier, group in rows:
        values = np.frombuffer(ids, tier_packing.ID)
        assert values.tolist() == list(range(start, start + len(values)))
        parts[row] += values.tolist()
        sequences[sequence].append((offset, len(values), tier))
        groups[group].add((sequence, tier))
    assert {k: sorted(v) for k, v in parts.items()} == {k: list(range(n)) for k, n in enumerate(sizes)}
    for pieces in sequences.values():
        filled = 0
        for offset, n, tier in sorted(pieces):
            assert offset == filled
            filled += n
        assert filled == tier and tier & (tier - 1) == 0 and tier <= 32
    for members in groups.values():
        assert len({t for _, t in members}) == 1 and sum(t for _, t in members) <= 64


def test_gaps_are_filled_whole_before_a_document_is_cut():
    packer = tier_packing.Packer((4, 8, 16), 16)
    for k, n in enumerate([13, 3, 9, 2, 5]):
        packer.add(k, np.zeros(n, tier_packing.ID).tobytes())
    rows = packer.flush(True)
    assert sorted((r[0], r[1], len(r[2]) // 4) for r in rows) == [(0, 0, 13), (1, 0, 3), (2, 0, 9), (3, 0, 2), (4, 0, 5)]
    assert len({r[3] for r in rows}) == 2


def test_groups_of_a_tier_have_nearly_equal_cost():
    rng = random.Random(2)
    packer = tier_packing.Packer((16, 32, 64), 256)
    for k in range(900):
        packer.add(k, np.zeros(min(64, int(rng.paretovariate(0.7)) + 1), tier_packing.ID).tobytes())
    cost, size = defaultdict(int), defaultdict(set)
    for row, start, ids, sequence, offset, tier, group in packer.flush(True):
        cost[tier, group] += (len(ids) // 4) ** 2
        size[tier, group].add(sequence)
    full = [c for (t, g), c in cost.items() if t == 64 and len(size[t, g]) == 4]
    assert len(full) > 5 and max(full) <= 1.25 * sum(full) / len(full)


def check(got, docs):
    by_row, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_row[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for key, texts in docs.items():
        want = sorted((len(ids_of(t)) for t in texts))
        assert sum(r.length for r in by_row[key]) == sum(want)
        assert {r.doc_tokens for r in by_row[key]} == set(want)
        if len(texts) == 1:
            ids, at = np.array(ids_of(texts[0]), dtype="<u4"), 0
            for r in sorted(by_row[key], key=lambda r: r.start):
                assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
                at += r.length
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096 and at & (at - 1) == 0
    assert set(by_row) == set(docs)


def test_query_on_given_documents(spark):
    folder = "/root/testdata/sf0.001"
    docs = defaultdict(list)
    for r in table(spark, folder, "documents").select("doc_id", "text").collect():
        docs[r.doc_id].append(r.text)
    check(QUERIES["op11_tier_packing"](spark, folder).collect(), docs)


def test_nulls_empty_long_repeated_and_clashing_columns(spark, save):
    long_text = "Straße, naïve 12 " * 6000
    rows = [(1, "Hello world"), (2, None), (3, ""), (4, long_text), (5, "x" * 9000), (6, "same"), (6, "same"), (None, "no key"), (7, "  \n")]
    df = spark.createDataFrame([(k, t, "s", 1) for k, t in rows], "doc_id long, text string, start string, ids int")
    docs = defaultdict(list)
    for k, t in rows:
        docs[k].append(t)
    check(QUERIES["op11_tier_packing"](spark, save(documents=df.repartition(2))).collect(), docs)
    assert tier_packing.pack(df.limit(0), "doc_id", "text", PATH, 2).collect() == []


def test_tiers_must_be_powers_of_two():
    with pytest.raises(ValueError):
        tier_packing.Packer((3, 8))


def test_plain_words_need_no_tokenizer(monkeypatch):
    """Plain characters of all scripts, in every class beside them, get the tokenizer's ids without a call of it."""
    texts = [f"{c}a {c}{c} a{c}1 {c}'s 'S{c} A{c}B ({c})'ll{c}" for c in tier_packing.PLAIN if ord(c) < 0x4E00]
    texts += ["".join(random.Random(k).choices(tier_packing.PLAIN, k=60)) for k in range(300)]
    texts += ["x" * 9000 + "Ünïcode" * 500, "", None, " \n", "Hello,world's 2½ don'T \x0b\x0c\r ab"]
    coder = tier_packing.WordIds(open(PATH, encoding="utf-8").read())
    monkeypatch.setattr(tier_packing.WordIds, "_learn", None)
    monkeypatch.setattr(tier_packing, "KEPT_PIECES", 50)
    for part in (texts[:400], texts[400:]):
        got = coder.encode([t if t is None else t.encode() for t in part])
        assert [np.frombuffer(b, tier_packing.ID).tolist() for b in got] == [ids_of(t)[:-1] for t in part]


def test_odd_words_keep_their_places_and_other_tokenizers_are_asked():
    """Words left to the tokenizer stand between plain ones; of a tokenizer of another make all words are left to it."""
    texts = ["plain İstanbul Σας words <|endoftext|> x<|startoftext|>y é́ end", "　 a b", "日本 हिन्दी ok", "only plain"]
    vocabulary = open(PATH, encoding="utf-8").read()
    given = json.loads(vocabulary)
    given["normalizer"]["normalizers"].pop()
    other = json.dumps(given)
    assert tier_packing.piece_ranks(vocabulary) and tier_packing.piece_ranks(other) is None
    for made in (vocabulary, other):
        whole, coder = Tokenizer.from_str(made), tier_packing.WordIds(made)
        for _ in range(2):
            got = coder.encode([t.encode() for t in texts])
            assert [np.frombuffer(b, tier_packing.ID).tolist() for b in got] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_tokens_that_their_bytes_are_not_merged_to_rule_the_ranks_out():
    """A merge that is never reached would let the ranks join what the tokenizer does not."""
    given = json.loads(open(PATH, encoding="utf-8").read())
    first = given["model"]["merges"][0]
    given["model"]["merges"] = [*given["model"]["merges"][1:], first]
    assert tier_packing.piece_ranks(json.dumps(given)) is None


def test_workers_let_go_of_the_ids_they_have_given(spark):
    """Documents stay in no worker once their pieces are given: views of their ids are what would hold them."""
    df = spark.createDataFrame([(i, f"word {i} " * 20) for i in range(2000)], "doc_id long, text string").repartition(8)
    assert tier_packing.pack(df, "doc_id", "text", PATH, 2).agg({"length": "sum"}).first()[0] > 2000

    def views(batches):
        import gc

        import pandas as pd

        for _ in batches:
            yield pd.DataFrame({"n": [sum(isinstance(x, memoryview) for x in gc.get_objects())]})

    assert max(r.n for r in spark.range(0, 16, 1, 16).mapInPandas(views, "n long").collect()) < 100
