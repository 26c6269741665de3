"""The registered queries of this subpackage, one for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from doseframe.llm import (
    ann_graph, attention_lm, bpe, exact_topk, minmax, mixing, period_runs, sharding, tier_packing, toxicity, trie_codes, url_rules,
    warc_zip,
)
from doseframe.llm.text import id_fold, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

BPE_FILE = "byte_bpe_multi_50k.tiktoken"
TOXIC_FROM = 0.3
SHARDS = 16
# Shares of the tokens of poor, good and toxic documents.
MIX_SHARES = [0.08, 0.90, 0.02]
GIVEN_RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
]
NEAREST, QUERY_EVERY = 20, 20
PACK_FILE, PACK_END = "word_bpe_49k.json", 2


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Every page's URL judged by the given rules, then by rules mined from the labels of the same ids."""
    labels = table(spark, folder, "labels")
    bad = labels.select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return url_rules.judge(table(spark, folder, "pages"), "page_id", "url", bad, GIVEN_RULES)


@query
def op2_zip_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Every page written as a WARC record into ZIP archives and read back from them."""
    return warc_zip.round_trip(table(spark, folder, "pages"), "page_id", "url", "html")


@query
def op3_minmax_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Near duplicates among all documents, on 2-word shingles."""
    found = minmax.near_duplicates(table(spark, folder, "documents"), "doc_id", "text", shingle=2, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@query
def op4_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's text encoded and decoded again, as digests."""
    ranks = bpe.read_ranks(public_tokenizers.path(BPE_FILE))
    docs = table(spark, folder, "documents")
    digest = bpe.digest_column(F.col("text"), ranks, public_tokenizers.PATTERN)
    return docs.select("doc_id", digest.alias("d")).select("doc_id", "d.n_tokens", "d.ids_sha256", "d.decoded_sha256")


@query
def op5_attention_lm(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's log probability by a model learnt outside the held-out fold."""
    ranks = bpe.read_ranks(public_tokenizers.path(BPE_FILE))
    held = id_fold(F.col("doc_id"), 7) == 2
    return attention_lm.score(table(spark, folder, "documents"), "doc_id", "text", held, ranks, public_tokenizers.PATTERN)


@query
def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's probability of the toxic label, learnt outside the held-out fold."""
    docs = table(spark, folder, "documents")
    machine = toxicity.fit(docs, toxicity.training_labels(table(spark, folder, "labels")))
    scored = docs.select(
        "doc_id", (id_fold(F.col("doc_id"), 4) == 2).alias("held_out"), toxicity.score_column(F.col("text"), machine).alias("score")
    )
    return scored.withColumn("predicted", (F.col("score") >= TOXIC_FROM).cast("int"))


@query
def op7_soft_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's rate for the target shares of poor, good and toxic tokens."""
    labels = mixing.domain_labels(table(spark, folder, "labels"))
    mixed = mixing.mix(table(spark, folder, "documents"), "doc_id", "text", labels, MIX_SHARES)
    names = [F.col("p")[i].alias(f"p_{name}") for i, name in enumerate(("poor", "good", "toxic"))]
    return mixed.select("doc_id", "n_tokens", *names, "rate", "copies")


@query
def op8_jump_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's shard of 16 and of 17."""
    return sharding.shard(table(spark, folder, "documents"), "doc_id", "text", SHARDS)


@query
def op9_exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 largest products of every twentieth vector among all others."""
    return exact_topk.top_products(table(spark, folder, "embeddings"), "vec_id", "embedding", NEAREST, QUERY_EVERY)


@query
def op10_graph_search(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest found for every twentieth vector."""
    return ann_graph.nearest(table(spark, folder, "embeddings"), "vec_id", "embedding", NEAREST, QUERY_EVERY)


@query
def op11_tier_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's tokens packed into sequences of several context sizes."""
    return tier_packing.pack(table(spark, folder, "documents"), "doc_id", "text", public_tokenizers.path(PACK_FILE), PACK_END).drop("ids")


@query
def op12_trie_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector's code of eight parts with 16 entries each, after six rounds."""
    found = trie_codes.compress(table(spark, folder, "embeddings"), "vec_id", "embedding", "label")
    return found.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


@query
def op13_period_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's periodic runs of words; every tenth document's end is first made periodic."""
    docs = table(spark, folder, "documents")
    return period_runs.digests(period_runs.find(docs, "doc_id", "text", rewrite=period_runs.repeated_tail), "doc_id")


SQL["op2_zip_warc"] = """
with p as (
  select page_id, octet_length(encode(coalesce(html, '')))::BIGINT as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
o as (select payload_digest, max(page_id) as owner from p where payload_bytes >= 1000 group by payload_digest)
select page_id, payload_bytes, payload_digest,
  case when owner is not null and owner <> page_id then 'revisit' else 'response' end as record_type,
  case when owner <> page_id then owner end as refers_to
from p left join o using (payload_digest)"""

SQL["op9_exact_topk"] = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) as e from embeddings
  where embedding is not null and list_sum(list_transform(embedding, lambda x: case when x is null or not isfinite(x) then 1 else 0 end)) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT as score
  from v q join v c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id)
select query_id, rank::INTEGER as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 20"""

SQL["op3_minmax_dedup"] = r"""
with recursive tok as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') as w
  from documents),
sh as (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 2 then [w]
    else list_transform(range(1, len(w)), lambda i: [w[i], w[i + 1]]) end) as s
  from tok),
n as (select doc_id, count(*) as n from sh group by doc_id),
ix as (select s, dense_rank() over (order by s) as k from (select distinct s from sh)),
sx as (select doc_id, k from sh join ix using (s)),
common as (
  select x.doc_id as a, y.doc_id as b, count(*) as c
  from sx x join sx y on x.k = y.k and x.doc_id < y.doc_id group by 1, 2),
links as (
  select a, b from common join n p on p.doc_id = a join n q on q.doc_id = b where 100 * c >= 80 * (p.n + q.n - c)),
both_ways as (select a, b from links union all select b, a from links),
reach as (
  select doc_id as a, doc_id as b from documents
  union select r.a, e.b from reach r join both_ways e on r.b = e.a),
low as (select a as doc_id, min(b) as component_id from reach group by 1)
select d.doc_id, coalesce(n.n, 0)::BIGINT as n_shingles, low.component_id, d.doc_id = low.component_id as kept
from documents d join low using (doc_id) left join n using (doc_id)"""


def _trie_sql(rounds: int = 6) -> str:
    """Every round in turn: c holds the entries (part, entry, c), a the nearest entry of every part of every row."""
    def nearest(t: int) -> str:
        return f"""a{t} as materialized (
  select rid, part, any_value(v) as v, min([d, entry]) as m from (
    select rid, p.part, v, entry, list_sum(list_transform(range(1, len(v) + 1), lambda i: (v[i] - c[i]) * (v[i] - c[i])))::BIGINT as d
    from p join c{t} c on c.part = p.part) group by rid, part)"""

    def moved(t: int) -> str:
        return f"""c{t + 1} as materialized (
  select c.part, c.entry, coalesce(u.c, c.c) as c from c{t} c left join (
    select part, entry, list((s - ((s % n) + n) % n) // n order by i) as c from (
      select part, m[2] as entry, i, sum(v[i])::BIGINT as s, count(*) as n
      from (select part, m, v, unnest(range(1, len(v) + 1)) as i from a{t}) group by 1, 2, 3) group by 1, 2) u
  on u.part = c.part and u.entry = c.entry)"""

    steps = ",\n".join(f"{nearest(t)},\n{moved(t)}" for t in range(rounds))
    return f"""
with k as materialized (
  select row_number() over (order by vec_id, embedding) as rid, vec_id, label,
    list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) as v from embeddings
  where embedding is not null and list_sum(list_transform(embedding, lambda x: case when x is null or not isfinite(x) then 1 else 0 end)) = 0),
p as materialized (
  select rid, part::BIGINT as part, v[part * (len(v) // 8) + 1:(part + 1) * (len(v) // 8)] as v
  from (select rid, v, unnest(range(0, 8)) as part from k)),
c0 as materialized (select part, rid - 1 as entry, v as c from p where rid <= 16),
{steps},
{nearest(rounds)},
e as (select rid, string_agg(printf('%02x', m[2]), '' order by part) as code, sum(m[1])::BIGINT as error from a{rounds} group by rid),
h as (select sha256(string_agg(array_to_string(c, ','), ',' order by part, entry)) as codebooks_sha256 from c{rounds})
select vec_id, code, error, sum(error) over (partition by label)::BIGINT as label_error, codebooks_sha256
from k join e using (rid), h"""


SQL["op12_trie_codes"] = _trie_sql()
