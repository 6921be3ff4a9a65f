"""Category cleaning, counting, top N + Other, colours and legends."""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from poicraft.functions.names import LEGEND_ABBREVIATIONS, abbreviate_label
from poicraft.functions.palette import OTHER, OTHER_COLOR, category_color, color_for_keys
from poicraft.functions.text import as_text
from poicraft.operators.dedup import dedupe_by_key
from poicraft.operators.joins import lookup_join


def clean_categories(df: DataFrame, key: str = "id", order_by: Sequence[str] = ()) -> DataFrame:
    """A8 → F6 → P1: one row per ``key`` (the smallest by ``order_by``); first category must exist and be primary.

    Adds ``category`` = first category name. Dedup runs before the category test.
    """
    df = dedupe_by_key(df, [key], order_by)
    valid = (F.size("cat_name") > 0) & F.coalesce(F.get(F.col("primary"), F.lit(0)), F.lit(False))
    return df.filter(valid).withColumn("category", F.get(F.col("cat_name"), F.lit(0)))


def category_filter(df: DataFrame, categories: Sequence[str] | DataFrame,
                    column: str = "category", bound: int | None = None) -> DataFrame:
    """keep rows whose category is listed; null is never listed.

    A literal list becomes an ``IN`` predicate (pushed into the scan when it is a
    plain column). A key table is joined: a broadcast semi join when the caller
    gives its proven row ``bound`` (e.g. the N winners of a top-N), otherwise the
    size-checked lookup join.
    """
    if isinstance(categories, DataFrame):
        keys = categories.select(F.col(categories.columns[0]).alias("_cat"))
        if bound is not None:
            return df.join(F.broadcast(keys), F.col(column) == F.col("_cat"), "left_semi")
        listed = df.filter(F.col(column).isNotNull())
        return lookup_join(listed, keys.distinct(), F.col(column), "_cat", "left_semi", keys)
    return df.filter(F.col(column).isin(list(categories)))


def category_count(df: DataFrame, column: str = "category", ordered: bool = False) -> DataFrame:
    """A1: ``(category, n)``; partial counts are combined map-side.

    ``ordered=True`` adds O1, count descending then name (a range-partitioned sort
    of one row per category).
    """
    counts = df.groupBy(F.col(column).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), F.asc_nulls_last("category")) if ordered else counts


def category_count_filtered(df: DataFrame, categories: Sequence[str],
                            column: str = "category") -> DataFrame:
    """A2: category counts restricted to a list (the filter runs before the aggregate)."""
    return category_count(category_filter(df, categories, column), column)


def top_n_other(counts: DataFrame, n: int, null_bucket: str = "Other") -> DataFrame:
    """A3: the first ``n`` categories by count, then ``Other`` with the rest.

    Ties are broken by category name. ``Other`` is always emitted (possibly 0);
    a category literally named ``Other`` and, with ``null_bucket='Other'``, the
    null category are folded into it. The winners come from a bounded top-k
    (``TakeOrderedAndProject``); the remainder is the sum of all counts minus
    the winners' counts, so both read one aggregate.
    Output ``(rank, category, n)``, rank ``n + 1`` for ``Other``.
    """
    if null_bucket not in ("Other", "keep"):
        raise ValueError("null_bucket must be 'Other' or 'keep'")
    eligible = F.col("category").isNull() | (F.col("category") != F.lit(OTHER))
    if null_bucket == "Other":
        eligible = F.col("category").isNotNull() & (F.col("category") != F.lit(OTHER))
    # Eligible categories sort first and the test runs after the limit, so both
    # branches below read the very same aggregate (one scan, a reused exchange).
    order = [F.desc("_eligible"), F.desc("n"), F.asc_nulls_last("category")]
    top = (counts.withColumn("_eligible", F.coalesce(eligible, F.lit(False)))
           .orderBy(*order).limit(n).filter(F.col("_eligible"))
           .withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("bigint")))
    # Other = every count minus the winners' counts: no join, one shared aggregate.
    rest = (counts.select("n").unionByName(top.select((-F.col("n")).alias("n")))
            .agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n"))
            .select(F.lit(n + 1).cast("bigint").alias("rank"),
                    F.lit(OTHER).alias("category"), "n"))
    return top.select("rank", "category", "n").unionByName(rest)


def legend(top: DataFrame) -> DataFrame:
    """P7 + J4: ``label = category[n]`` with the category's colour (``Other`` grey).

    The palette is a pure function of the category, so no join is needed.
    """
    color = F.when(F.col("category").isNull() | (F.col("category") == F.lit(OTHER)),
                   F.lit(OTHER_COLOR)).otherwise(category_color(F.col("category")))
    label = F.concat(as_text("category"), F.lit("["), F.col("n").cast("string"), F.lit("]"))
    return top.select("rank", label.alias("label"), color.alias("color"))


def abbreviate_legend(legend_df: DataFrame,
                      mapping: Mapping[str, str] = LEGEND_ABBREVIATIONS) -> DataFrame:
    """Abbreviated labels; when two labels collide the later one (by rank) wins."""
    short = legend_df.withColumn("label", abbreviate_label(F.col("label"), mapping))
    return (short.groupBy("label")
            .agg(F.max("rank").alias("rank"), F.max_by("color", "rank").alias("color"))
            .select("rank", "label", "color"))


def top_keys_flag(df: DataFrame, top: DataFrame, column: str = "category") -> DataFrame:
    """Adds ``_in_top``: whether the row's category is one of the top-N keys."""
    keys = F.broadcast(top.filter(F.col("category") != F.lit(OTHER))
                       .select(F.col("category").alias("_key"), F.lit(True).alias("_in_top")))
    return df.join(keys, F.col(column) == F.col("_key"), "left").drop("_key")


def color_by_top(df: DataFrame, top: DataFrame, column: str = "category") -> DataFrame:
    """Adds ``color_cat``: the palette colour of the top-N keys, grey for the others."""
    rows = top_keys_flag(df, top, column)
    return rows.withColumn("color_cat", color_for_keys(F.col(column), in_keys=F.col("_in_top"))).drop("_in_top")


def group_by_categories_colored(df: DataFrame, max_display: int,
                                keys: Sequence[str] = (), column: str = "category"):
    """A4: rows restricted to ``keys`` (when given) and coloured by the top-N palette.

    Returns ``(rows_with_color_cat, top_n_other_counts)``.
    """
    if keys:
        df = category_filter(df, keys, column)
    top = top_n_other(category_count(df, column), max_display)
    return color_by_top(df, top, column), top


def filter_categories_colored(df: DataFrame, keys: Sequence[str], apply_filter: bool = True,
                              column: str = "category") -> DataFrame:
    """A5: optional list filter, then ``color_cat`` from the palette of ``keys``."""
    if apply_filter:
        df = category_filter(df, keys, column)
    return df.withColumn("color_cat", color_for_keys(F.col(column), keys=keys))


def palette(categories: DataFrame, column: str = "category") -> DataFrame:
    """``(category, color)`` for every distinct category plus ``Other``."""
    keys = categories.select(F.col(column).alias("category")).filter(
        F.col("category").isNotNull() & (F.col("category") != F.lit(OTHER))).distinct()
    other = categories.sparkSession.createDataFrame([(OTHER, OTHER_COLOR)],
                                                    "category string, color string")
    return keys.select("category", category_color(F.col("category")).alias("color")) \
        .unionByName(other)
