"""Exact dedup: the filter alone, batches in and out of the index against a dictionary, odd rows, SQL."""

import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from cases import SF, no_docs, odd_docs, odd_rows

from poicraft.llm import exactdedup as X
from poicraft.llm.queries import ORACLE_SQL, QUERIES


def normal(text):
    return re.sub("[\x20\x09-\x0d]+", " ", text or "")


def keys(n, seed=0):
    return np.random.default_rng(seed).integers(0, 256, (n, 32), dtype=np.uint8)


def test_filter_has_no_false_negatives():
    f = X.Cuckoo.sized(20_000)
    fp, b = f.key(keys(20_000))
    assert f.insert(fp, b) and f.has(fp, b).all()
    other = f.has(*f.key(keys(50_000, 1)))
    assert other.mean() < 0.001
    f.delete(fp[:15_000], b[:15_000])
    assert f.has(fp[15_000:], b[15_000:]).all() and f.has(fp[:15_000], b[:15_000]).mean() < 0.001
    f.delete(fp[15_000:], b[15_000:])
    assert not f.slots.any()


def test_filter_reports_overflow_and_equal_keys():
    f = X.Cuckoo(64)
    assert not f.insert(*f.key(keys(400)))
    g = X.Cuckoo(64)
    fp, b = g.key(np.repeat(keys(1), 8, axis=0))
    assert g.insert(fp, b) and not g.insert(fp[:1], b[:1])
    g.delete(fp[:7], b[:7])
    assert g.has(fp[:1], b[:1]).all()


def brute(live):
    """{text: (smallest id, rows)} of live (id, text) rows."""
    groups = defaultdict(list)
    for i, t in live:
        groups[normal(t)].append(i)
    return {t: (min((i for i in ids if i is not None), default=None), len(ids)) for t, ids in groups.items()}


def check(found, rows, live):
    want = brute(live)
    got = found.collect()
    texts = dict(rows)  # ids of a batch are distinct here
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        keep, size = want.get(normal(texts[r.doc_id]), (None, None))
        assert (r.keep_id, r.group_size) == (keep, size), r


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)


@pytest.mark.parametrize("bits", [16, 3])
def test_batches_in_and_out(spark, monkeypatch, bits):
    """With few bits nearly every hit is another text: only the content tells."""
    monkeypatch.setattr(X, "BITS", bits)
    text = lambda i: f"text \t {i % 60}" if i % 3 else f"text {i}"
    batches = [[(i, text(i)) for i in range(a, b)] for a, b in ((300, 500), (0, 300), (500, 560))]
    index, live = X.empty(spark, 3), []
    for k, rows in enumerate(batches):
        index, found = X.insert(index, frame(spark, rows), buckets=8)
        live += rows
        check(found, rows, live)
        want = brute(live)
        assert sorted(r.doc_id for r in found.filter("kept").collect()) == sorted({keep for keep, _ in want.values()} & {i for i, _ in rows})
        states = index.filters.collect()
        assert len(states) == 3 and not any(r.overflow for r in states)
        assert sum(np.count_nonzero(np.frombuffer(r.slots, np.uint16)) for r in states) == len(want)  # an entry per live text
    gone = [i for i in range(560) if i % 2 == 0 or i < 100]
    index = X.delete(index, spark.createDataFrame([(i,) for i in [*gone, 10_000, None]], "doc_id bigint"))
    live = [(i, t) for i, t in live if i not in set(gone)]
    asked = [(i, text(i)) for i in range(560)] + [(999, "never seen"), (1000, None)]
    check(X.lookup(index, frame(spark, asked)), asked, live)
    assert sum(np.count_nonzero(np.frombuffer(r.slots, np.uint16)) for r in index.filters.collect()) == len(brute(live))
    again = [(2000 + i, text(i)) for i in range(50)]
    index, found = X.insert(index, frame(spark, again))
    check(found, again, live + again)


def test_overflow_resizes_from_the_stored_keys(spark):
    rows = [(i, f"t{i}") for i in range(900)]
    index, _ = X.insert(X.empty(spark, 2), frame(spark, rows), buckets=4)
    states = index.filters.collect()
    assert all(r.buckets > 64 and not r.overflow for r in states)
    check(X.lookup(index, frame(spark, rows)), rows, rows)


def test_one_group_holds_most_rows(spark):
    rows = [(i, "the  same" if i % 4 else f"own {i}") for i in range(4000)]
    got = X.dedupe(frame(spark, rows)).collect()
    assert sum(r.kept for r in got) == 1001 and {r.group_size for r in got if r.doc_id % 4} == {3000}
    assert {r.keep_id for r in got if r.doc_id % 4} == {1}


def test_odd_rows_and_empty_table(spark):
    got = X.dedupe(odd_docs(spark)).collect()
    rows = [(i, t) for i, t, *_ in odd_rows()]
    want = brute(rows)
    assert len(got) == len(rows) and sum(r.kept for r in got) == len(want)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.keep_id, r.group_size) for r in got) == sorted((i is None, i or 0, *want[normal(t)]) for i, t in rows)
    empty = X.dedupe(no_docs(spark))
    assert empty.count() == 0 and empty.columns == ["doc_id", "digest", "keep_id", "group_size", "kept"]
    only_null = spark.createDataFrame([(None, "x"), (None, "x")], "doc_id bigint, text string")
    assert sorted((r.keep_id, r.group_size, r.kept) for r in X.dedupe(only_null).collect()) == [(None, 2, False), (None, 2, True)]


def test_oracle_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{SF}/documents.parquet')")
    want = con.execute(ORACLE_SQL["op13_exact_dedup"])
    names = [d[0] for d in want.description]
    got = sorted(tuple(r[n] for n in names) for r in QUERIES["op13_exact_dedup"](spark, SF).collect())
    assert got == sorted(want.fetchall())
