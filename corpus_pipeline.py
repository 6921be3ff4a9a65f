"""Corpus pipeline: language ID, near-duplicate removal, benchmark decontamination,
mixing to target weights, sharding.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet in the shared folder and read back as the next stage's
``docs``. All stages but the last return the columns of ``documents``, also extra ones with
clashing names; repeated rows are rows of their own until the near-duplicates go; an empty
table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from poicraft.llm import decontam, langid, mixing, shards, simhash
from poicraft.llm.common import small_batches, stored
from poicraft.llm.queries import remainder


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that are in none of the languages learnt: null texts, texts without a
    letter, and texts far from every language, measured by the training documents of their size."""
    small_batches(spark)
    training = docs.filter(F.coalesce(remainder("doc_id", 3) != 1, F.lit(True)))
    model = langid.train(training)
    return docs.filter(langid.accepted(F.col("text"), model, langid.floors(training, model)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, the one with the smallest id. Null and
    empty texts are near copies of each other; rows without an id stay."""
    small_batches(spark)
    return simhash.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a test item of ``benchmark``; null and empty texts hold none."""
    small_batches(spark)
    return decontam.decontaminate(docs, decontam.build_indexes(spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often (0 to 2 times) as the mix of sources takes it; a null source is one
    of its own, a text without words adds nothing."""
    return mixing.mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The manifest of the shards: ``doc_id, size, text_crc32, shard, slot`` per document taken; a null
    text counts one byte, rows without an id come first."""
    return shards.shards(docs)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("mix", mix_sources),
    ("shards", shard),
]

#: No SQL: fingerprints, models and the mix's hashes are not expressible there. The
#: tests run the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
