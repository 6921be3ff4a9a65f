"""Decontamination: the index against exhaustive scoring, planted items, odd rows."""

import random
from collections import Counter

import pytest
from cases import no_docs, odd_docs, table
from pyspark.sql import functions as F

from poicraft.llm import decontam as D
from poicraft.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def shingles(words):
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))}


def test_query_finds_every_whole_item_and_no_other(spark):
    got = {(r.doc_id, r.item_id) for r in QUERIES["op4_bm25_decontamination"](spark, SF).collect()}
    items = {i: shingles(D.tokens(t)) for i, t in zip(table("benchmark", SF).item_id, table("benchmark", SF).text)}
    want, some = set(), set()
    for doc_id, text in zip(table("documents", SF).doc_id, table("documents", SF).text):
        own = shingles(D.tokens(text))
        for i, s in items.items():
            share = len(s & own) / len(s)
            if share >= 0.95:
                want.add((doc_id, i))
            if share >= 0.5:
                some.add((doc_id, i))
    assert want and want <= got <= some


def random_index(rng, n=70):
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(k, [vocabulary[min(299, int(rng.expovariate(0.02)))] for _ in range(rng.randint(3, 30))], ["yes"] * rng.randint(0, 2)) for k in range(n)]
    df = Counter(t for _, q, a in items for t in set(q + a))
    return D.Index(items, df, n, sum(len(q) + len(a) for _, q, a in items) / n), items, vocabulary


@pytest.mark.parametrize("seed", range(4))
def test_block_max_wand_finds_all_above_the_threshold(seed):
    rng = random.Random(seed)
    index, items, vocabulary = random_index(rng)
    texts = []
    for _ in range(40):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 200))]
        for _, q, a in rng.sample(items, 2):
            at = rng.randint(0, len(words))
            words[at:at] = [w for w in q + a if rng.random() < 0.8]
        texts.append(words)
    for threshold in (0.2, 0.5, 0.9):
        got = {}
        for i, a, _, terms, blocks in index.passages(texts, threshold):
            for b in blocks:
                for k, s in index.search(terms, b, threshold):
                    got[i, a, k] = s
        want = {}
        for i, words in enumerate(texts):
            last = max(1, (len(words) - 1) // index.stride)
            for p in range(last if words else 0):
                own = {index.term[w] for w in words[p * index.stride:(p + 2) * index.stride] if w in index.term}
                scores = Counter()
                for t in own:
                    for k, w in zip(index.ids[t], index.impacts[t]):
                        scores[k] += w
                want |= {(i, p * index.stride, k): s for k, s in scores.items() if s >= threshold - 1e-9}
        assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want)


def test_every_occurrence_lies_in_one_passage():
    rng = random.Random(5)
    index, items, vocabulary = random_index(rng)
    for k, q, a in index.items:
        words = ["zz"] * rng.randint(0, 300) + q + a + ["zz"] * rng.randint(0, 300)
        assert k in {m[0] for m in index.matches([" ".join(words)], 0.5, 0.8, 5)[0]}


def test_question_and_answer_must_both_occur(spark):
    items = spark.createDataFrame([(1, "what is the tallest mountain on the whole earth", "it is the mount everest in nepal"), (None, "x y", "z"),
                                   (2, None, None), (3, "!!!", "")], "item_id int, q string, a string")
    index = D.build_indexes(items, text="q", answer="a")
    docs = spark.createDataFrame([
        (1, "So: What is the tallest mountain on the whole Earth? It is the Mount Everest, in Nepal."),
        (2, "what is the tallest mountain on the whole earth nobody knows"), (3, "it is the mount everest in nepal")], "doc_id int, text string")
    assert [(r.doc_id, r.item_id) for r in D.contaminated(docs, index).collect()] == [(1, 1)]
    assert [r.doc_id for r in D.decontaminate(docs, index).collect()] == [2, 3]


def test_an_item_without_declared_answer_may_lose_its_last_sentence(spark):
    body = "Water boils at a lower heat on high mountains since the air there is thin. " + " ".join(f"Reason {w} follows from the one before it." for w in "abcdefgh")
    last = " So cooks need more time up there."
    items = spark.createDataFrame([(1, body + last)], "item_id int, text string")
    docs = spark.createDataFrame([
        (1, "Well, " + body + last), (2, "Well, " + body + " And so on and on."), (3, "Well, " + body + last.replace("more", "less")),
        (4, "Well, " + body[:len(body) // 2] + last), (5, "So cooks need more time up there.")], "doc_id int, text string")
    index = D.build_indexes(items)
    assert sorted(r.doc_id for r in D.contaminated(docs, index).collect()) == [1, 2, 3]
    assert sorted(r.doc_id for r in D.decontaminate(docs, index).collect()) == [4, 5]


def test_several_indexes_find_the_same(spark):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    many = D.build_indexes(items, index_bytes=3000)
    assert len(many) > 1
    pairs = lambda ix: sorted((r.doc_id, r.item_id) for r in D.contaminated(docs, ix).collect())
    assert pairs(many) == pairs(D.build_indexes(items))


def test_odd_rows_and_empty_tables(spark):
    docs = odd_docs(spark)
    items = spark.createDataFrame([(1, "The quick brown fox jumps over the lazy dog.", 5)], "item_id bigint, text string, part int")
    index = D.build_indexes(items)
    assert [(r.doc_id, r.item_id) for r in D.contaminated(docs, index).collect()] == [(1, 1), (1, 1)]
    kept = D.decontaminate(docs, index)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 2
    none = D.build_indexes(items.limit(0))
    assert none == [] and D.contaminated(docs, none).count() == 0 and D.decontaminate(docs, none).count() == docs.count()
    assert D.contaminated(docs, none).columns == D.contaminated(docs, index).columns
    assert D.contaminated(no_docs(spark), index).count() == 0
    assert D.contaminated(docs.withColumn("item_id", F.lit(0)), index).count() == 2


def test_short_items_convict_no_document(spark):
    items = spark.createDataFrame([(1, "Yes"), (2, "What is it? Yes"), (3, "One two three four. Five six seven eight nine."), (4, "Who wrote the famous old book? Nobody."),
                                   (5, None), (6, "alpha beta gamma delta epsilon zeta eta theta")], "item_id bigint, text string")
    assert {(r.item_id, r.n_tokens) for r in D.short_items(items).collect()} == {(1, 1), (2, 4), (4, 7), (5, 0)}
    docs = spark.createDataFrame([
        (1, "yes we went home today and nothing else happened"), (2, "what is it yes " * 3),
        (3, "so one two three four five six seven eight nine it was"), (4, "nine four three two eight seven one five six"),
        (5, "say alpha beta gamma delta epsilon zeta eta theta now"), (6, "epsilon zeta eta theta and then alpha beta gamma delta")], "doc_id bigint, text string")
    found = {(r.doc_id, r.item_id) for r in D.contaminated(docs, D.build_indexes(items)).collect()}
    assert found == {(3, 3), (5, 6)}


def test_a_short_answer_beside_a_verified_question(spark):
    items = spark.createDataFrame([(1, "which of the seven wonders of the world still stands today", "Giza")], "item_id bigint, q string, a string")
    docs = spark.createDataFrame([(1, "Q: Which of the seven wonders of the world still stands today? A: Giza"),
                                  (2, "Which of the seven wonders of the world still stands today? Who knows"), (3, "Giza is a place")], "doc_id bigint, text string")
    index = D.build_indexes(items, text="q", answer="a")
    assert {r.doc_id for r in D.contaminated(docs, index).collect()} == {1}
