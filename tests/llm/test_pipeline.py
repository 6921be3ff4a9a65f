"""The pipeline's stages on whole tables against brute force, and on odd rows and no rows."""

import pytest
from cases import SF, no_docs, odd_docs, table
from test_decontam import shingles
from test_mixing import targets
from test_shards import brute
from test_simhash import components, plain
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from cases import words
from poicraft.llm import decontam

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = dict(zip(table("documents").doc_id, table("documents").text))
    source = dict(zip(table("documents").doc_id, table("documents").source))
    items = [shingles(decontam.tokens(t)) for t in table("benchmark").text]
    kept = dict(texts)
    ids = []
    # texts in no language, which the first stage drops; all documents of the table are in one
    strange = [(10_000 + i, "xq zvk wjx qqz kzx vwq " * 60, None, "src0", 1) for i in range(3)] + [(10_010, "", "en", "src0", 0), (10_011, None, None, None, None)]
    docs = docs.unionByName(spark.createDataFrame(strange, docs.schema))
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        rows = docs.collect()
        assert name == "shards" or docs.columns == COLUMNS
        if name == "language":
            kept = {i: t for i, t in kept.items() if any(c.isalpha() for c in t)}
            assert sorted(r.doc_id for r in rows) == sorted(kept)
        elif name == "near_duplicates":
            group = components({i: plain(t) for i, t in kept.items()})
            kept = {i: kept[i] for i in set(group.values())}
            assert sorted(r.doc_id for r in rows) == sorted(kept)
        elif name == "decontamination":
            kept = {i: t for i, t in kept.items() if not any(s <= shingles(decontam.tokens(t)) for s in items)}
            assert sorted(r.doc_id for r in rows) == sorted(kept)
        elif name == "mix":
            ids = sorted(r.doc_id for r in rows)
            size = {i: len(words(t)) for i, t in kept.items()}
            for s, goal in targets({s: sum(size[i] for i in kept if source[i] == s) for s in {source[i] for i in kept}}).items():
                got = sum(size[i] for i in ids if source[i] == s)
                assert abs(got - goal) <= max(size[i] for i in kept if source[i] == s)
            assert max(ids.count(i) for i in set(ids)) <= 2
        else:
            assert sorted((r.doc_id, r["size"], r.shard, r.slot) for r in rows) == brute([(i, texts[i]) for i in ids], 16)
        docs = spark.createDataFrame(rows, docs.schema) if name != "shards" else docs


def test_run_is_registered(spark):
    rows = __spark_entry__.queries()["pipeline"](spark, SF)
    assert rows.columns == ["doc_id", "size", "text_crc32", "shard", "slot"] and rows.count() > 0


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_odd_rows_and_empty_table(spark, name, stage):
    for docs in (odd_docs(spark), no_docs(spark), odd_docs(spark).filter("text is null")):
        docs = docs.select(*[F.col(c) for c in docs.columns])
        out = stage(spark, docs, SF)
        n = out.count()
        assert name == "shards" or out.columns == docs.columns
        if docs.isEmpty():
            assert n == 0


def test_stages_with_python_bound_their_batches(spark):
    """A batch of 10,000 documents is held several times over by the JVM and by each worker."""
    from poicraft.llm.common import BATCH_CONF, BATCH_ROWS
    before = spark.conf.get(BATCH_CONF)
    try:
        for name, stage in corpus_pipeline.STAGES[:3]:
            for rows, want in ((10_000, BATCH_ROWS), (0, BATCH_ROWS), (100, 100)):
                spark.conf.set(BATCH_CONF, str(rows))
                stage(spark, no_docs(spark), SF)
                assert int(spark.conf.get(BATCH_CONF)) == want
    finally:
        spark.conf.set(BATCH_CONF, before)
