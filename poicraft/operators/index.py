"""W1 row index and O3 slices without a single-partition window."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from poicraft.operators.dedup import orderable
from poicraft.session import stored

# ``monotonically_increasing_id`` holds the partition above this many bits, the row below.
PLACE_BITS = 33


def stored_in_order(df: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """``df`` range-partitioned and sorted by ``order_by``, written once, with ``_place``: the
    partition and the row's place in it, in one number that ascends in the global order.

    Ties are ordered by a hash of the row. Rows that are equal throughout are told apart by
    the input partition they come from, the last range key, so they too spread over
    several range partitions. As the frame is stored, a lost executor renumbers nothing.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    tie = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns if orderable(kinds[c])] or [F.lit(0)])
    keys = [*order_by, "_tie", "_from"]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.withColumn("_tie", tie).withColumn("_from", F.spark_partition_id())
    ordered = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    return stored(ordered.select(*df.columns, F.monotonically_increasing_id().alias("_place")), "ordered")


def row_index(df: DataFrame, order_by: Sequence[str], name: str = "idx") -> DataFrame:
    """Global 0-based index in ascending ``order_by`` order.

    One shuffle of the rows, no join on keys and no window over them: the rows are stored in
    order (see ``stored_in_order``), and the index is a row's place in its partition plus
    the rows of the partitions before, from a table of one row per partition.
    """
    ordered = stored_in_order(df, order_by)
    part = F.shiftright("_place", PLACE_BITS)
    sizes = ordered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    # At most one row per shuffle partition, whatever the size of the input.
    return ordered.join(F.broadcast(offsets), part == F.col("_part")).select(
        *[F.col(f"`{c}`") for c in df.columns],
        (F.col("_off") + F.col("_place").bitwiseAND((1 << PLACE_BITS) - 1)).cast("bigint").alias(name))


def group_index(df: DataFrame, partition_by: Sequence[str], order_by: Sequence,
                name: str = "idx") -> DataFrame:
    """0-based index within each group (for groups of bounded size, e.g. aggregates)."""
    w = Window.partitionBy(*partition_by).orderBy(*order_by)
    return df.withColumn(name, (F.row_number().over(w) - 1).cast("bigint"))


def take_slice(df: DataFrame, order_by: Sequence, n: int) -> DataFrame:
    """O3 head: the first ``n`` rows in order (a bounded top-k, no full sort)."""
    return df.orderBy(*order_by).limit(n)


def take_tail(df: DataFrame, order_by: Sequence, start: int, name: str = "idx") -> DataFrame:
    """O3 tail / resume: every row from ordinal ``start`` on, distributed."""
    return row_index(df, order_by, name).filter(F.col(name) >= F.lit(start))
