"""Contiguous shards of near-equal bytes from global prefix sums.

Rows are range-partitioned by id and sorted; each partition adds up its own sizes
and rows. The totals of the partitions (a row per partition) give every
partition's offset, so each row's place in the whole order is known without one
task seeing all rows. The order is cut at equal targets: a row belongs to the
shard in whose stretch of bytes it begins.
"""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from poicraft.llm.common import stored, text_of

SHARDS = 16


def _running(batches):
    """Adds the partition's number and, for each row, the bytes and rows before it."""
    part, size, rows = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        own = batch.column("size").to_numpy(zero_copy_only=False)
        n = len(own)
        sums = np.cumsum(own)
        yield pa.RecordBatch.from_arrays(
            [batch.column(k) for k in ("doc_id", "size", "crc")]
            + [pa.array(np.full(n, part, np.int32)), pa.array(size + sums - own), pa.array(np.arange(rows, rows + n, dtype=np.int64))],
            names=["doc_id", "size", "crc", "part", "bytes_before", "rows_before"])
        size, rows = size + (int(sums[-1]) if n else 0), rows + n


def shards(docs: DataFrame, n_shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, size, text_crc32, shard, slot``.

    ``size`` is the text's UTF-8 bytes (a null text has none) plus one, so every row
    counts. Rows stand in order of id (null first), then of a hash of the text;
    ``slot`` numbers the rows of a shard from 0. No two shards differ by more
    than the largest row from their target.
    """
    spark = docs.sparkSession
    key = F.col(f"`{doc_id}`").cast("bigint")
    rows = docs.select(key.alias("doc_id"), (F.octet_length(text_of(text)) + 1).cast("bigint").alias("size"),
                       F.crc32(text_of(text)).alias("crc"), F.xxhash64(text_of(text)).alias("tie"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    placed = stored(ordered.mapInArrow(
        _running, "doc_id bigint, size bigint, crc bigint, part int, bytes_before bigint, rows_before bigint"), "shard-rows")
    totals = placed.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # One row per partition of the range shuffle: small whatever the table's size.
    offsets = stored(totals.select("part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_off"),
                                   F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_off"),
                                   F.sum("bytes").over(every).alias("total")), "shard-offsets")
    cut = placed.join(F.broadcast(offsets), "part").select(
        "doc_id", "size", F.col("crc").alias("text_crc32"),
        F.expr(f"int((bytes_before + bytes_off) * {int(n_shards)} div total)").alias("shard"),
        (F.col("rows_before") + F.col("rows_off")).alias("place"))
    first = cut.groupBy("shard").agg(F.min("place").alias("first"))  # a row per shard
    return cut.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("first")).alias("slot"))
