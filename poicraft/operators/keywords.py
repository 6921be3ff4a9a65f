"""F1, F3, P5 and P6 with keyword and mapping lists that are tables, of any length.

A predicate per keyword makes a plan as long as the list. Here the keywords are found by
equality: each is filed under itself (one of more than ``Q`` characters under the one of
its pieces of ``Q`` characters that the fewest keywords have), the texts are broken into
their pieces of the lengths that occur in the list, and only the keywords whose piece is
in some text are joined to the rows, where ``contains`` verifies them. A piece of a
keyword's whole length meets no other keyword, so the candidates are the hits. The plan's
size does not depend on the list, no join pairs rows with keywords otherwise, and the
results equal those of the predicates, since a text that contains a keyword contains
every one of its pieces.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poicraft.functions.text import NULL_TEXT, as_text
from poicraft.operators.joins import lookup_join
from poicraft.session import stored

#: Longest piece under which a keyword is filed.
Q = 32


def _grams(text: Column, q: Column) -> Column:
    """Pieces of ``q`` characters, overlapping, in one pass over the text; of none, the empty one."""
    found = F.regexp_extract_all(text, F.concat(F.lit("(?s)(?=(.{"), q.cast("string"), F.lit("})).")), F.lit(1))
    return F.when(q == 0, F.when(text.isNotNull(), F.array(F.lit("")))).otherwise(F.array_distinct(found))


def _filed(table: DataFrame, q: int) -> DataFrame:
    """``table`` with ``piece``, under which a keyword is filed."""
    size = F.char_length("keyword")
    short = table.filter(size <= q).withColumn("piece", F.col("keyword"))
    pieces = table.filter(size > q).select("keyword", "rank", "value", F.explode(_grams(F.col("keyword"), F.lit(q))).alias("piece"))
    shared = pieces.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    rarest = pieces.join(shared, "piece").groupBy("keyword").agg(
        F.min(F.struct("n", "piece")).alias("g"), F.first("rank").alias("rank"), F.first("value").alias("value"))
    return short.unionByName(rarest.select("keyword", "rank", "value", F.col("g.piece").alias("piece")))


def keyword_table(keywords: DataFrame, keyword: str = "keyword", value: str | None = None, order_by: str | None = None,
                  fold: bool = True) -> DataFrame:
    """``keyword, rank, value``, one row per keyword (case-folded with ``fold``): that of the
    smallest ``order_by``. Null keywords are dropped; an empty one is contained in every text."""
    word = F.col(f"`{keyword}`").cast("string")
    word = F.lower(word) if fold else word
    rank = F.lit(None).cast("bigint") if order_by is None else F.col(f"`{order_by}`").cast("bigint")
    code = F.lit(None).cast("string") if value is None else F.col(f"`{value}`").cast("string")
    rows = keywords.select(word.alias("keyword"), F.struct(rank.alias("rank"), code.alias("value")).alias("v")).filter("keyword is not null")
    return rows.groupBy("keyword").agg(F.min("v").alias("v")).select("keyword", "v.rank", "v.value")


def with_hits(df: DataFrame, texts: Sequence[Column], table: DataFrame, key: Sequence[str] | None = None, q: int = Q) -> DataFrame:
    """``df`` with ``_hits``: the rows ``rank, keyword, value`` of ``table`` (see ``keyword_table``)
    whose keyword occurs in any of the texts, the smallest rank first, then the keyword.

    ``key`` names columns that identify a row; without them the rows are stored once with
    a number of their own.
    """
    if key is None:
        key = ["_row"]
        df = stored(df.withColumn("_row", F.monotonically_increasing_id()), "keyword-rows")
    name, key = list(df.columns), list(key)
    words = stored(_filed(table, q), "keyword-filed")
    lengths = [r.n for r in words.select(F.char_length("piece").alias("n")).distinct().collect()]  # q + 1 at most
    sizes = F.lit(",".join(map(str, sorted(lengths)))) if lengths else F.lit(None).cast("string")
    # A row per text and length first, so that a task holds the pieces of one length at a time.
    pieces = df.select(*[F.col(f"`{k}`") for k in key], F.explode(F.array(*texts)).alias("_text")).select(
        "*", F.explode(F.split(sizes, ",").cast("array<int>")).alias("_size")).filter(F.col("_size") <= F.char_length("_text")).select(
        *[F.col(f"`{k}`") for k in key], F.explode(_grams(F.col("_text"), F.col("_size"))).alias("_piece"))
    # The keywords whose piece is in some text: a common piece is one row per map task.
    known = stored(words.join(pieces.select(F.col("_piece").alias("piece")).distinct(), "piece", "left_semi").groupBy("piece").agg(
        F.collect_list(F.struct("rank", "keyword", "value")).alias("_words")).withColumnRenamed("piece", "_known"), "keyword-known")
    found = lookup_join(pieces, known, F.col("_piece"), "_known", "inner").groupBy(*[F.col(f"`{k}`") for k in key]).agg(
        F.flatten(F.collect_set("_words")).alias("_candidates"))
    held = lambda said: F.filter("_candidates", lambda w: F.exists(said, lambda t: t.contains(w["keyword"])))
    # The texts are put together once per row: a lambda would evaluate them for each candidate.
    verified = F.transform(F.array(F.array(*texts)), lambda said: F.array_sort(F.array_distinct(held(said))))[0]
    none = F.array().cast("array<struct<rank:bigint,keyword:string,value:string>>")
    return df.join(found, key, "left").select(*[F.col(f"`{c}`") for c in name], F.coalesce(verified, none).alias("_hits"))


def _texts(columns: Sequence[str], fold: bool, null_text: str | None) -> list[Column]:
    said = [as_text(F.col(f"`{c}`"), null_text) for c in columns]
    return [F.lower(s) if fold else s for s in said]


def any_keyword_rows(df: DataFrame, columns: Sequence[str], keywords: DataFrame, keyword: str = "keyword",
                     key: Sequence[str] | None = None, null_text: str | None = NULL_TEXT) -> DataFrame:
    """F3 with a keyword table: rows in which any keyword occurs (case-folded) in any of the columns."""
    hits = with_hits(df, _texts(columns, True, null_text), keyword_table(keywords, keyword), key)
    return hits.filter(F.size("_hits") > 0).select(*[F.col(f"`{c}`") for c in df.columns])


def all_keyword_rows(df: DataFrame, column: str, keywords: DataFrame, keyword: str = "keyword",
                     key: Sequence[str] | None = None, null_text: str | None = NULL_TEXT) -> DataFrame:
    """F1's keyword test with a table: rows whose column holds every keyword (case-folded)."""
    table = stored(keyword_table(keywords, keyword), "keyword-table")
    hits = with_hits(df, _texts([column], True, null_text), table, key)
    return hits.filter(F.size("_hits") == F.lit(table.count())).select(*[F.col(f"`{c}`") for c in df.columns])


def reduce_name_by_table(df: DataFrame, column: str, mapping: DataFrame, out: str, keyword: str = "keyword", value: str = "value",
                         order_by: str = "rank", key: Sequence[str] | None = None, null_text: str | None = NULL_TEXT) -> DataFrame:
    """P5 with a mapping table: ``out`` is the value of the first keyword (by ``order_by``, then by
    name) that is a case-sensitive substring; no match keeps the name."""
    hits = with_hits(df, _texts([column], False, null_text), keyword_table(mapping, keyword, value, order_by, fold=False), key)
    first = F.get(F.col("_hits"), F.lit(0))
    return hits.select(*[F.col(f"`{c}`") for c in df.columns],
                       F.when(F.size("_hits") > 0, first["value"]).otherwise(as_text(F.col(f"`{column}`"), null_text)).alias(out))


def abbreviate_by_table(df: DataFrame, column: str, mapping: DataFrame, out: str, keyword: str = "keyword", value: str = "value",
                        order_by: str = "rank", key: Sequence[str] | None = None) -> DataFrame:
    """P6 with a mapping table: the first keyword found in the label is replaced everywhere in it."""
    hits = with_hits(df, _texts([column], False, None), keyword_table(mapping, keyword, value, order_by, fold=False), key)
    first = F.get(F.col("_hits"), F.lit(0))
    label = F.col(f"`{column}`")
    return hits.select(*[F.col(f"`{c}`") for c in df.columns],
                       F.when(F.size("_hits") > 0, F.replace(label, first["keyword"], first["value"])).otherwise(label).alias(out))
