"""Municipality counts and category shares per municipality."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: pie-slice offset per position.
EXPLODE_STEP = 0.008


def municipality_count(df: DataFrame, column: str = "municipio") -> DataFrame:
    """``(municipio, n)``."""
    return df.groupBy(F.col(column).alias("municipio")).agg(F.count(F.lit(1)).alias("n"))


def category_share(df: DataFrame, group_col: str = "municipio",
                   category_col: str = "category") -> DataFrame:
    """A7 + W2: per municipality, each category's count, position and percent share.

    One grouped aggregate replaces the per-municipality driver loop; the window
    then runs over aggregated rows (one per category), never over raw rows.
    ``idx`` is the 0-based position by count desc (ties by name), ``offset`` the
    slice offset ``idx * 0.008``, ``share`` = ``100 * n / municipality total``.
    """
    counts = df.groupBy(F.col(group_col).alias("municipio"),
                        F.col(category_col).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    g = Window.partitionBy("municipio")
    ordered = g.orderBy(F.desc("n"), F.asc_nulls_last("category"))
    idx = (F.row_number().over(ordered) - 1).cast("bigint")
    total = F.sum("n").over(g)
    return counts.select(
        "municipio", "category", "n", idx.alias("idx"),
        (F.lit(100.0) * F.col("n") / total).alias("share"),
    ).withColumn("offset", F.col("idx") * F.lit(EXPLODE_STEP))
