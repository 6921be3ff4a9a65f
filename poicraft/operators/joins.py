"""Lookup joins that stay balanced when one key, or the missing key, holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A lookup table is broadcast up to this size by the plan's own statistics (bytes of
# its files, or what they imply); a larger one, or one of unknown size, is shuffled.
BROADCAST_BYTES = 32 << 20
# Tasks over which the rows of any one key are spread in a shuffled lookup.
SALTS = 32


def plan_bytes(df: DataFrame) -> int:
    """Size of a frame by the optimizer's statistics; starts no job."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def lookup_join(facts: DataFrame, dim: DataFrame, fact_key: Column, dim_key: str, how: str = "left",
                source: DataFrame | None = None, broadcast_bytes: int = BROADCAST_BYTES,
                salts: int = SALTS) -> DataFrame:
    """``facts`` joined to a lookup table that is unique by ``dim_key``; builds no job.

    The table is broadcast when ``source`` (what it was derived from without adding
    rows, by default itself) is known to be small. Beyond that every lookup row is
    replicated ``salts`` times and every fact meets one copy, chosen by a hash of its
    atomic columns and its input partition: a hot key, also one whose rows are all
    equal, is spread over ``salts`` tasks, without a list of hot keys or a threshold.
    Facts without a key match nothing and are spread over all tasks.
    """
    if plan_bytes(dim if source is None else source) <= broadcast_bytes:
        return facts.join(F.broadcast(dim), fact_key == F.col(dim_key), how)
    atomic = [F.col(f"`{f.name}`") for f in facts.schema.fields
              if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    spread = F.xxhash64(F.spark_partition_id(), *atomic)
    salted = facts.withColumn("_ls", F.when(fact_key.isNull(), spread).otherwise(F.pmod(spread, F.lit(salts))))
    copies = dim.withColumn("_rs", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    joined = salted.join(copies, (fact_key == F.col(dim_key)) & (F.col("_ls") == F.col("_rs")), how)
    return joined.drop("_ls", "_rs")
