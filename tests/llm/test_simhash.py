"""SimHash near-duplicates: fingerprints and components against brute force."""

import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from cases import SF, no_docs, odd_docs, odd_rows, table, words
from pyspark.sql import functions as F

from poicraft.llm import simhash
from poicraft.llm.components import smallest_reachable
from poicraft.llm.queries import QUERIES


def plain(text):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    s = [" ".join(w[i:i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints):
    """Smallest id per fingerprint's component, from ``{id: fingerprint}``."""
    ids = sorted(prints)
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[n + 1:]:
            if bin(prints[i] ^ prints[j]).count("1") <= 4:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_query(spark):
    docs = table("documents")
    rows = {r.doc_id: r for r in QUERIES["op2_simhash_neardup"](spark, SF).collect()}
    prints = {i: plain(t) for i, t in zip(docs.doc_id, docs.text)}
    assert {i: r.fingerprint for i, r in rows.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {i: r.component_id for i, r in rows.items()} == components(prints)


@pytest.mark.parametrize("text", ["", None, "one", "a b c d", "A B C D e", "é É ß\x0bx\x1cy\xa0z w", "x " * 70000])
def test_fingerprint(text):
    assert simhash.simhash(None if text is None else text.encode()) == plain(text)


def near(rng, base, n, flips):
    out = []
    for _ in range(n):
        x = base
        for b in rng.sample(range(64), rng.randint(0, flips)):
            x ^= 1 << b
        out.append(x)
    return out


@pytest.mark.parametrize("tile,short,chunk,tasks", [(4, 3, 16, 5), (8, 2, 1 << 18, 3), (64, 128, 1 << 18, 1), (2, 1, 8, 9)])
def test_links_join_all_near_fingerprints(monkeypatch, tile, short, chunk, tasks):
    """Small tiles and chunks: keys that cross tasks and tiles lose no link."""
    rng = random.Random(tile)
    prints = [rng.getrandbits(64) for _ in range(60)] + near(rng, rng.getrandbits(64), 60, 3) + near(rng, 0, 40, 2)
    prints = {i: p for i, p in enumerate(sorted(set(prints), key=prints.index))}
    rows = []
    for i, p in prints.items():
        for part, mask in enumerate(sum(c) for c in simhash.combinations(simhash._segments(6), 2)):
            rows.append((part, (p & mask) - (1 << 64) * ((p & mask) >> 63), bin(p).count("1"), p - (1 << 64) * (p >> 63), i))
    rows.sort()
    monkeypatch.setattr(simhash, "SHORT", short)
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    edges, tiles = [], []
    cuts = sorted(rng.sample(range(1, len(rows)), tasks - 1))
    for task, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)])):
        monkeypatch.setattr(simhash, "TaskContext", SimpleNamespace(get=lambda task=task: SimpleNamespace(partitionId=lambda: task)))
        batches = [pa.RecordBatch.from_pylist([dict(zip(("part", "key", "ones", "fp", "rep"), r)) for r in rows[c:c + 7]],
                                              pa.schema([("part", pa.int32()), ("key", pa.int64()), ("ones", pa.int32()), ("fp", pa.int64()), ("rep", pa.int64())]))
                   for c in range(a, b, 7)]
        for found in simhash._scan_sorted(4, tile)(iter(batches)):
            for r in found.to_pylist():
                (tiles if r["tile"] is not None else edges).append(r)
    assert len({t["tile"] for t in tiles}) == len(tiles)
    links = [(e["a"], e["b"]) for e in edges]
    for x in tiles:
        for y in tiles:
            if (x["part"], x["key"]) == (y["part"], y["key"]) and x["tile"] < y["tile"] and y["low"] - x["high"] <= 4 and x["low"] - y["high"] <= 4:
                fa, ra, fb, rb = (np.frombuffer(z, np.int64) for z in (x["fps"], x["reps"], y["fps"], y["reps"]))
                links += simhash._compare(fa, fb, ra, rb, 4, False)
    assert all(bin(prints[a] ^ prints[b]).count("1") <= 4 for a, b in links)
    up = {i: i for i in prints}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    assert {i: find(i) for i in prints} == components(prints)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 240)] + [(5, 7), (1, 1), (None, 3), (9, 8), (8, 9)]
    got = dict(map(tuple, smallest_reachable(spark.createDataFrame(edges, "a bigint, b bigint")).collect()))
    assert got == {i: 100 for i in range(101, 161)} | {i: 5 for i in [7, *range(200, 240)]} | {9: 8}
    assert smallest_reachable(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_odd_rows_and_empty_table(spark):
    rows = [tuple(r) for r in simhash.near_duplicates(odd_docs(spark)).collect()]
    assert len(rows) == len(odd_rows())
    by = {r[0]: r for r in rows if r[0] is not None}
    assert by[2][1] == by[3][1] == 0 and by[3][2] == 2 and by[2][3] == 3  # null and empty texts, one of them without id
    assert by[7][2] == 7 and by[7][3] == 2 and by[1][3] == 2
    assert simhash.near_duplicates(no_docs(spark)).count() == 0


def test_stage_keeps_one_of_each_group(spark):
    docs = odd_docs(spark)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id for r in kept.select("doc_id").collect()), key=str)
    prints = {i: plain(t) for i, t, *_ in odd_rows() if i is not None}
    assert ids == sorted([*{c for c in components(prints).values()}, None, None], key=str)
    assert simhash.drop_near_duplicates(no_docs(spark)).count() == 0


def test_stage_keeps_the_smallest_text_of_a_repeated_id(spark):
    docs = spark.createDataFrame([(1, "b b b"), (1, "a a a"), (1, "a a a"), (2, "a a a")], "doc_id bigint, text string").select("*", F.lit(1).alias("fp"))
    assert sorted(tuple(r) for r in simhash.drop_near_duplicates(docs).collect()) == [(1, "a a a", 1)]
