"""Factorization machine: held-out quality, pairs that no additive model can learn, odd rows."""

import re
import zlib

import numpy as np
from cases import no_docs, odd_docs, odd_rows, remainder, table

from pyspark.sql import functions as F

from poicraft.llm import toxicity as X
from poicraft.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def test_held_out_quality(spark):
    rows = QUERIES["op6_fm_toxicity"](spark, SF).collect()
    toxic = dict(zip(table("labels", SF).doc_id, table("labels", SF).toxic))
    assert all(r.held_out == (remainder(r.doc_id, 5) == 0) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    held = [(r.score, toxic[r.doc_id]) for r in rows if r.held_out and r.doc_id in toxic]
    hit = sum(s >= 0.5 for s, y in held if y)
    wrong = sum(s >= 0.5 for s, y in held if not y)
    assert hit / sum(y for _, y in held) > 0.85 and wrong / sum(not y for _, y in held) < 0.01


def test_gradient_step_learns_a_pair():
    """The label is the exclusive or of two terms: weights alone can't express it."""
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for _ in range(800):
        a, b = (rng.random(2) < 0.5).tolist()
        rows.append([0] * a + [1] * b + [2])
        labels.append(int(a != b))
    bias, weight, factors = X.fit(rows, [[1.0] * len(r) for r in rows], np.array(labels), 3)
    machine = X.Machine({}, bias, weight, factors)

    def margin(r):
        v = machine.factors[r]
        return bias + weight[r].sum() + 0.5 * (v.sum(axis=0) @ v.sum(axis=0) - (v * v).sum())

    assert margin([0, 2]) > 0 > margin([0, 1, 2]) and margin([1, 2]) > 0 > margin([2])


def test_score_is_the_sum_over_pairs():
    rng = np.random.default_rng(2)
    words = ["idiot", "people", "fine"]
    places = {X.buckets(w)[0]: i for i, w in enumerate(words)}
    m = X.Machine(places, 0.1, rng.normal(size=3), rng.normal(size=(3, 4)))
    rows, x = m.features("Idiot! fine people, idiot")
    assert sorted(rows) == [0, 1, 2] and x == [1.0, 1.0, 1.0]
    pairs = sum(m.factors[i] @ m.factors[j] for i in range(3) for j in range(i))
    assert np.isclose(m.score("Idiot fine people"), 1 / (1 + np.exp(-(0.1 + m.weight.sum() + pairs))))


def test_odd_rows_and_empty_tables(spark):
    docs = odd_docs(spark)
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, None), (None, 1), (4, 0), (99, 1)], "doc_id bigint, toxic int")
    machine = X.train(docs, labels)
    rows = X.toxicity(docs, machine).collect()
    assert len(rows) == len(odd_rows()) and all(0 <= r.score <= 1 for r in rows)
    none = X.train(docs, labels.limit(0))
    assert {round(r.score, 9) for r in X.toxicity(docs, none).collect()} == {0.25}
    assert X.toxicity(no_docs(spark), X.train(no_docs(spark), labels)).count() == 0


def test_the_sample_is_bounded(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"word{i % 7} idiot" if i % 5 == 0 else f"word{i % 7}") for i in range(300)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(300)], "doc_id bigint, toxic int")
    seen = []
    monkeypatch.setattr(X, "fit", lambda rows, values, y, n: (seen.append(len(y)), (0.0, np.zeros(n), np.zeros((n, 2))))[1])
    X.train(docs, labels, max_train=120)
    assert seen == [120]


def pair_rows(n, seed=3):
    """The label is the exclusive or of two frequent words: neither tells anything alone."""
    rng = np.random.default_rng(seed)
    filler = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(150)]
    out = []
    for i in range(n):
        a, b = (rng.random(2) < 0.5).tolist()
        said = [str(w) for w in rng.choice(filler, 15)] + ["grouping"] * a + ["insulting"] * b
        rng.shuffle(said)
        out.append((i, " ".join(said), int(a != b)))
    return out


def test_training_learns_a_pair_that_no_word_tells(spark):
    rows = pair_rows(3600)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int").withColumn("y", F.lit("clash"))
    machine = X.train(docs, docs.filter("doc_id < 3000").select("doc_id", "toxic", F.lit("clash").alias("text")))
    got = {r.doc_id: r.score for r in X.toxicity(docs, machine).collect()}
    held = [(got[i] >= 0.5) == bool(y) for i, _, y in rows if i >= 3000]
    assert np.mean(held) > 0.9


def test_pairs_against_a_direct_count():
    rng = np.random.default_rng(5)
    x = rng.random((2500, 12)) < 0.3
    y = (x[:, 2] ^ x[:, 7]) | (rng.random(2500) < 0.05)
    got = set(X.telling_pairs([np.flatnonzero(r) for r in x], y, 12).tolist())
    p, want = y.mean(), set()
    chi = lambda m: (y[m].sum() - m.sum() * p) ** 2 / max(m.sum() * p * (1 - p), 1)
    for i in range(12):
        for j in range(i):
            joint = sum(chi((x[:, i] == a) & (x[:, j] == b)) for a in (True, False) for b in (True, False))
            alone = sum(chi(x[:, k] == a) for k in (i, j) for a in (True, False))
            want |= {i, j} if joint - alone >= X.PAIR_CHI else set()
    assert got == want == {2, 7}
    assert X.telling_pairs([], np.array([]), 0).size == 0


def test_scores_of_the_query_by_hand(spark):
    """The machine's formula over words, stems and buckets, written out."""
    docs, labels = table("documents"), table("labels")
    machine = X.train(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"),
                      spark.createDataFrame(labels[[remainder(i, 5) != 0 for i in labels.doc_id]][["doc_id", "toxic"]]))
    got = {r.doc_id: r.score for r in QUERIES["op6_fm_toxicity"](spark, "/root/testdata/sf0.001").collect()}
    for i, text in zip(docs.doc_id, docs.text):
        count = {}
        for w in set(re.findall(r"[^\W\d_]+", (text or "").lower())):
            for part in [w] + [w[:k] + "-" for k in X.STEMS if k < len(w)]:
                place = machine.places.get(zlib.crc32(part.encode()) % X.BUCKETS)
                if place is not None:
                    count[place] = count.get(place, 0) + 1
        x = {p: np.log2(1 + c) for p, c in count.items()}
        margin = machine.bias + sum(machine.weight[p] * v for p, v in x.items()) + sum(
            machine.factors[p] @ machine.factors[q] * x[p] * x[q] for p in x for q in x if p < q)
        assert abs(got[i] - 1 / (1 + np.exp(-margin))) < 1e-6


def test_a_repeated_id_takes_one_document(spark, monkeypatch):
    docs = spark.createDataFrame([(1, f"text number {i}") for i in range(500)] + [(2, "other")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, toxic int")
    seen = []
    monkeypatch.setattr(X, "fit", lambda rows, values, y, n: (seen.append(len(y)), (0.0, np.zeros(n), np.zeros((n, 2))))[1])
    X.train(docs, labels, max_train=10)
    assert seen == [2]
