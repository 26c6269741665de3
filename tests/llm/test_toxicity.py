"""The factorization machine learns a pair that additive weights miss; held-out accuracy; odd inputs."""

import numpy as np

from doseframe.llm import toxicity
from doseframe.llm.queries import QUERIES, TOXIC_FROM

ROOT = "/root/testdata/sf0.01"


def test_pairs_are_learnt():
    """Label 1 only where exactly one of two terms stands (no sum of weights separates that)."""
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for _ in range(2000):
        a, b = rng.integers(0, 2, 2)
        rows.append(np.array([0] * a + [1] * b + [int(rng.integers(2, 12))], dtype=np.int64))
        labels.append(int(a != b))
    labels = np.array(labels)
    machine = toxicity.fit_machine(np.arange(12), rows, labels, np.bincount(labels).tolist())
    assert ((machine.scores(rows) > 0.5) == labels).mean() > 0.98


def test_a_pair_without_single_evidence_is_learnt_from_texts(spark):
    """Exclusive or of two words through `fit`: neither word alone differs between the labels."""
    rng = np.random.default_rng(2)
    docs, labels = [], []
    for i in range(2400):
        a, b = i & 1, i >> 1 & 1
        filler = " ".join(f"{x:04d}" for x in rng.integers(0, 60, 3))
        docs.append((i, f"{'foo' if a else 'bar'} {'sun' if b else 'sky'} {filler}"))
        labels.append((i, int(a != b)))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    machine = toxicity.fit(d, spark.createDataFrame(labels[:2000], "doc_id long, label int"))
    got = {r.doc_id: r.s for r in d.select("doc_id", toxicity.score_column(d["text"], machine).alias("s")).collect()}
    assert np.mean([(got[i] > 0.5) == label for i, label in labels[2000:]]) > 0.95


def test_held_out_documents(spark):
    got = QUERIES["op6_toxicity"](spark, ROOT)
    assert got.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    rows = {r.doc_id: r for r in got.collect()}
    assert len(rows) == spark.read.parquet(f"{ROOT}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= TOXIC_FROM) for r in rows.values())
    labels = [r for r in spark.read.parquet(f"{ROOT}/labels.parquet").collect() if rows[r.doc_id].held_out]
    right = sum(rows[r.doc_id].predicted == r.toxic for r in labels) / len(labels)
    assert right > 0.9


def test_odd_inputs(spark, save):
    docs = [(1, "you idiot", 0), (2, None, 0), (3, "", 0), (4, "nice day " * 20000, 0), (4, "nice day", 0), (None, "idiot", 1)]
    rng = np.random.default_rng(3)
    some = [" ".join(f"w{x}" for x in rng.integers(0, 200, 30)) for _ in range(80)]
    docs += [(i, f"{some[i]} idiot" if i % 2 else some[i], 0) for i in range(10, 80)]
    labels = [(i, 1, i % 2) for i in range(10, 80)] + [(None, 1, 1), (11, 1, None), (2, None, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string, score int")
    folder = save(documents=d, labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = QUERIES["op6_toxicity"](spark, folder).collect()
    assert len(got) == len(docs)
    by = {r.doc_id: r.predicted for r in got}
    assert by[1] == 1 and by[4] == 0
    empty = save(documents=d, labels=spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {r.predicted for r in QUERIES["op6_toxicity"](spark, empty).collect()} == {0}
    assert QUERIES["op6_toxicity"](spark, save(documents=d.limit(0))).count() == 0


def test_a_batch_is_scored_in_parts(spark):
    """Places of a text take some times its bytes: a task never holds those of a whole batch of Spark."""
    class Counting(toxicity.Machine):
        def scores(self, rows):
            return np.full(len(rows), len(rows), dtype=float)

    none = np.empty(0)
    docs = spark.createDataFrame([(i, "word " * 4_000) for i in range(600)] + [(600, None)], "doc_id long, text string").coalesce(1)
    got = [r.s for r in docs.select(toxicity.score_column(docs["text"], Counting(np.arange(8), 0.0, none, none)).alias("s")).collect()]
    assert len(got) == 601 and max(got) < 300
