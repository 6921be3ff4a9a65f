"""Byte shards: contiguous, balanced, gapless, whatever the partitions."""

import zlib

import pytest
from cases import SF, no_docs, odd_docs, odd_rows, table
from pyspark.sql import functions as F

from poicraft.llm import shards as H
from poicraft.llm.queries import QUERIES


def brute(rows, n):
    """(id, size, shard, slot) in order of id; a row belongs to the shard its first byte is in."""
    sizes = [len((t or "").encode()) + 1 for _, t in rows]
    total, at, out, slots = sum(sizes), 0, [], {}
    for (i, _), s in zip(rows, sizes):
        k = at * n // total
        out.append((i, s, k, slots.setdefault(k, 0)))
        slots[k] += 1
        at += s
    return out


def test_query(spark):
    docs = table("documents").sort_values("doc_id")
    rows = QUERIES["op10_byte_shards"](spark, SF).collect()
    got = sorted((r.doc_id, r["size"], r.shard, r.slot) for r in rows)
    assert got == brute(list(zip(docs.doc_id, docs.text)), 16)
    crc = {i: zlib.crc32(t.encode()) for i, t in zip(docs.doc_id, docs.text)}
    assert all(r.text_crc32 == crc[r.doc_id] and r.law == "bytes" and r.grown_shard is None for r in rows)


@pytest.mark.parametrize("n", [1, 3, 16, 1000])
def test_any_number_of_shards(spark, n):
    docs = spark.range(700).select((F.col("id") * 37 % 1000).alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("text"))
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    got = sorted((r.doc_id, r["size"], r.shard, r.slot) for r in H.shards(docs.repartition(9), n).collect())
    assert got == brute(rows, n)


def test_odd_rows_and_empty_table(spark):
    rows = H.shards(odd_docs(spark), 4).collect()
    assert len(rows) == len(odd_rows())
    assert sorted(r["size"] for r in rows) == sorted(len((t or "").encode()) + 1 for _, t, *_ in odd_rows())
    for k in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sum(r.shard == k for r in rows)))
    empty = H.shards(no_docs(spark))
    assert empty.count() == 0 and empty.columns == ["doc_id", "size", "text_crc32", "shard", "slot"]
