"""Jump hashing against the published loop, and slots, nulls, repeats."""

import zlib

import pytest

from doseframe.llm import sharding
from doseframe.llm.queries import QUERIES

ROOT = "/root/testdata/sf0.001"


def jump(key, n):
    key &= 2**64 - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2**31 / ((key >> 33) + 1)))
    return b


def test_shards_are_those_of_the_loop(spark):
    keys = [0, 1, 2, 13, 26, 10**12, -1, -(2**63), 2**63 - 1, *range(100, 400)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for counts in ([1, 2], [16, 17], [100, 101], [1000]):
        rows = df.select("k", sharding.jump_shards(df.k, counts).alias("s")).collect()
        assert all(list(r.s) == [jump(r.k, n) for n in counts] for r in rows)


def test_query_over_the_whole_table(spark):
    got = QUERIES["op8_jump_shards"](spark, ROOT).collect()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{ROOT}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in got) == sorted(docs)
    slots = {}
    for r in got:
        data = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(data) + 1, zlib.crc32(data), "key")
        assert (r.shard, r.grown_shard) == (jump(r.doc_id, 16), jump(r.doc_id, 17))
        assert r.grown_shard in (r.shard, 16)
        slots.setdefault(r.shard, []).append((r.slot, r.doc_id))
    for rows in slots.values():
        rows.sort()
        assert [s for s, _ in rows] == list(range(len(rows))) and [d for _, d in rows] == sorted(d for _, d in rows)


def test_nulls_repeats_and_other_columns(spark):
    rows = [(None, "a", 1), (5, None, 2), (5, "é", 3), (5, "é", 3), (7, "", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    got = sharding.shard(df, "doc_id", "text", 1, 3).collect()
    assert sorted(r.slot for r in got) == [0, 1, 2, 3, 4] and {r.shard for r in got} == {0}
    assert sorted((r.size, r.text_crc32) for r in got if r.doc_id == 5) == [(1, 0)] + 2 * [(3, zlib.crc32("é".encode()))]
    assert sharding.shard(df.limit(0), "doc_id", "text", 4).count() == 0
    with pytest.raises(ValueError):
        sharding.jump_shards(df.doc_id, [0])


def test_no_python_in_the_plan(spark):
    df = QUERIES["op8_jump_shards"](spark, ROOT)
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
