"""The corpus pipeline: toxicity, near duplicates, mixing to target weights, tokens.

Each stage takes what the one before kept, written as Parquet and read again. All but the last return the
columns of documents; the last returns the tokenized corpus.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from doseframe.llm import bpe, minmax, mixing, toxicity
from doseframe.llm.text import table, unused
from doseframe.session import staged

TOXIC_FROM = 0.3
SHINGLE, SIMILAR_PERCENT = 5, 80
# Token shares of poor and good documents; good ones keep the tokens they have.
SHARES, GOOD = [0.05, 0.95], 1
BPE_FILE = "byte_bpe_multi_50k.tiktoken"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold; learnt from the labels outside the held-out fold."""
    machine = toxicity.fit(docs, toxicity.training_labels(table(spark, sf_dir, "labels")))
    return docs.where(toxicity.score_column(F.col("text"), machine) < TOXIC_FROM)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest doc_id."""
    return minmax.keep_one(docs, "doc_id", "text", SHINGLE, SIMILAR_PERCENT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn at the rates that bring the token shares of poor and good ones to the target.

    Good documents are the anchor: their expected tokens stay, poor ones are thinned. A document is given as
    many rows as its draw has copies, so rates above 1, which make up for good tokens of thinned mixed documents,
    count in full.
    """
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("label"))
    model = mixing.fit_membership(docs, labels, len(SHARES))
    # The classifier reads every text once; names that no column of the documents has.
    member, rate_of, copies_of, turn = (unused(docs, name) for name in ("_member", "_rate", "_copies", "_copy"))
    scored = staged(docs.withColumn(member, mixing.member_column(F.col("text"), model)), "members")
    rates = mixing.fit_rates(scored.select(F.col(member)["n_tokens"].alias("n_tokens"), F.col(member)["p"].alias("p")), SHARES, GOOD)
    rated = scored.withColumn(rate_of, mixing.rate_column(F.col(member)["p"], rates))
    drawn = rated.withColumn(copies_of, mixing.copies_column(F.col("doc_id"), F.col(rate_of))).where(F.col(copies_of) > 0)
    return drawn.withColumn(turn, F.explode(F.sequence(F.lit(1), F.col(copies_of)))).select(docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, ids_sha256, decoded_sha256 of every document."""
    ranks = bpe.read_ranks(public_tokenizers.path(BPE_FILE))
    return bpe.tokenized(docs, ["doc_id", "lang", "source"], "text", ranks, public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("tokens", tokenize),
]

# Classifiers and rates are iterative fits: SQL cannot express them. Tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = staged(docs, name.replace(" ", "-"))
    return docs
