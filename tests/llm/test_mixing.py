"""Mix of sources: targets by iteration, sums at the targets, the knapsack against brute force."""

import itertools
import random

import numpy as np
import pytest
from cases import SF, no_docs, odd_docs, odd_rows, table, words
from pyspark.sql import functions as F

from poicraft.llm import mixing as M
from poicraft.llm.queries import QUERIES


def targets(sizes):
    """By iteration: share by weight, stop those above their limit, share their excess again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, done, free = 1.5 * sum(sizes.values()), {}, set(order)
    while free:
        left = total - sum(done.values())
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            return done | share
        for s in over:
            done[s] = 2.0 * sizes[s]
            free.discard(s)
    return done


def check(rows, sizes):
    want = targets(sizes)
    longest = {s: max([r[2] for r in rows if r[1] == s], default=0) for s in sizes}
    for s in sizes:
        own = [r for r in rows if r[1] == s]
        assert all(abs(r[4] - want[s]) < 1e-6 * max(1, want[s]) and r[3] == sizes[s] for r in own)
        assert all(0 <= r[5] <= 2 * r[2] and (r[2] == 0 or r[5] % r[2] == 0) for r in own)
        assert abs(sum(r[5] for r in own) - want[s]) <= max(1, longest[s])


def test_query(spark):
    docs = table("documents")
    size = {i: len(words(t)) for i, t in zip(docs.doc_id, docs.text)}
    source = dict(zip(docs.doc_id, docs.source))
    rows = QUERIES["op8_budget_mix"](spark, SF).collect()
    assert {r.doc_id: r["size"] for r in rows} == size
    check([(r.doc_id, source[r.doc_id], r["size"], r.source_size, r.target, r.taken) for r in rows],
          {s: sum(size[i] for i in size if source[i] == s) for s in set(source.values())})
    again = QUERIES["op8_budget_mix"](spark, SF).collect()
    assert {(r.doc_id, r.taken) for r in rows} == {(r.doc_id, r.taken) for r in again}


@pytest.mark.parametrize("seed", range(30))
def test_fit_is_as_near_as_the_left_documents_allow(seed):
    rng = random.Random(seed)
    lengths = np.array(sorted(rng.sample(range(1, 60), rng.randint(1, 5))))
    counts = np.array([rng.randint(1, 4) for _ in lengths])
    all_ = int((lengths * counts).sum())
    budget = rng.randint(0, all_)
    for capacity in (1 << 16, 64):
        take = M.fit(lengths, counts, budget, budget / all_, capacity)
        assert (take >= 0).all() and (take <= counts).all()
        got = int((take * lengths).sum())
        least = np.floor(counts * (budget / all_)).astype(int)
        best = max(int((np.array(t) * lengths).sum()) for t in itertools.product(*[range(a, b + 1) for a, b in zip(least, counts)])
                   if int((np.array(t) * lengths).sum()) <= budget)
        assert got <= budget and (got == best or capacity == 64)


@pytest.mark.parametrize("n", [200, 2000, 8000])
def test_every_stretch_of_lengths_gets_its_share(n):
    """Lengths that occur once each: the share holds for short and long documents, at every size."""
    lengths, counts = np.arange(40, 40 + n), np.ones(n, np.int64)
    for share in (0.1, 0.6, 0.93):
        budget = int(lengths.sum() * share)
        take = M.fit(lengths, counts, budget, budget / int(lengths.sum()))
        assert int((take * lengths).sum()) == budget
        for part in np.array_split(take, 10):
            assert abs(part.sum() - share * len(part)) <= 4


def test_a_document_above_the_capacity():
    lengths, counts = np.array([3, 7, 200_000]), np.array([200_000, 5, 3])
    take = M.fit(lengths, counts, 700_000, 700_000 / int((lengths * counts).sum()))
    assert int((take * lengths).sum()) == 700_000 and (take <= counts).all()


def test_a_hot_length_and_repeated_rows(spark):
    docs = spark.range(3000).select(F.lit(1).cast("bigint").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("hot").alias("source"))
    docs = docs.unionByName(spark.range(60).select(F.col("id").alias("doc_id"), F.lit("a b c d e").alias("text"), F.lit("rare").alias("source")))
    rows = [(r.row.doc_id, r.row.source, r["size"], r.source_size, r.target, r.copies * r["size"]) for r in M.mix(docs).collect()]
    assert len(rows) == 3060
    check(rows, {"hot": 9000, "rare": 300})


def test_odd_rows_and_empty_table(spark):
    docs = odd_docs(spark)
    found = M.mix(docs).collect()
    rows = [(r.row.doc_id, r.row.source, r["size"], r.source_size, r.target, r.copies * r["size"]) for r in found]
    assert len(rows) == len(odd_rows()) and found[0].row.asDict().keys() == set(docs.columns)
    sizes = {}
    for _, t, _, s, _ in odd_rows():
        sizes[s] = sizes.get(s, 0) + len(words(t))
    check(rows, sizes)
    out = M.mixed(docs)
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in found)
    assert M.mix(no_docs(spark)).count() == 0 and M.mixed(no_docs(spark)).columns == docs.columns
    wordless = docs.filter("text is null or text = ''")
    assert {r.copies for r in M.mix(wordless).collect()} == {0}


def test_long_documents_are_exchanged():
    """The best sum needs a document above any fixed bound to be given back for a longer one."""
    take = M.fit(np.array([2_000_000, 3_000_000, 5_000_000]), np.array([1, 1, 1]), 4_500_001, 0.45)
    assert take.tolist() == [0, 1, 0]
