"""Lookup joins J1–J3."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poicraft.operators.dedup import dedupe_by_key
from poicraft.operators.joins import BROADCAST_BYTES, lookup_join

# Photo url when the venue has no photo record / a record without items.
NO_PHOTO = "_"
NO_PHOTO_ITEMS = "__"


def code_key(c) -> F.Column:
    """Code text or number → bigint join key (``'06000'`` = 6000; bad codes → null)."""
    return (F.col(c) if isinstance(c, str) else c).cast("string").try_cast("bigint")


def postal_enrich(venues: DataFrame, postal: DataFrame, code_col: str = "postalCode",
                  broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """J1 + F5: add ``municipio`` and ``d_tipo_asenta`` by postal code; drop unmatched.

    The catalogue is reduced to one row per normalised code first (see
    :func:`~poicraft.operators.joins.lookup_join` for the join strategy). Venues
    without a valid code match nothing, so they are dropped before the join.
    """
    dim = postal.select(code_key("d_codigo").alias("_code"),
                        F.col("D_mnpio").alias("municipio"), F.col("d_tipo_asenta"))
    dim = dedupe_by_key(dim.filter("_code is not null"), ["_code"]).filter(F.col("municipio").isNotNull())
    coded = venues.filter(code_key(code_col).isNotNull())
    out = lookup_join(coded, dim, code_key(code_col), "_code", "inner", postal, broadcast_bytes)
    return out.select(*[venues[c] for c in venues.columns], "municipio", "d_tipo_asenta")


def catalog_match(establishments: DataFrame, catalog: DataFrame, code_col: str = "codigo_act",
                  broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Add ``category`` = activity name by activity code; unmatched rows keep null."""
    dim = catalog.select(code_key("id_act").alias("_act"), F.col("actividad").alias("category"))
    dim = dedupe_by_key(dim.filter("_act is not null"), ["_act"])
    out = lookup_join(establishments, dim, code_key(code_col), "_act", "left", catalog, broadcast_bytes)
    return out.select(*[establishments[c] for c in establishments.columns], "category")


def photo_enrich(venues: DataFrame, photos: DataFrame, id_col: str = "id") -> DataFrame:
    """Add ``url`` and ``photo_status`` from a photo table keyed by venue id.

    ``'_'`` when the venue has no photo record, ``'__'`` when the record has no
    items, else ``prefix + user.id + suffix`` of the first item. The photo table
    is as large as the venue table, so this is a plain (shuffled) left join. Of
    several records of one venue the one with the most items, then the smallest,
    counts, so a venue stays one row.
    """
    ph = photos.select(F.col("venue_id").alias("_pid"), F.col("status").alias("photo_status"),
                       F.col("items").alias("_items"), (-F.coalesce(F.size("items"), F.lit(0))).alias("_few"))
    ph = dedupe_by_key(ph.filter("_pid is not null"), ["_pid"], ["_few"]).drop("_few")
    first = F.get(F.col("_items"), F.lit(0))
    url = (F.when(F.col("_pid").isNull(), F.lit(NO_PHOTO))
           .when(F.coalesce(F.size("_items"), F.lit(0)) <= 0, F.lit(NO_PHOTO_ITEMS))
           .otherwise(F.concat(first["prefix"], first["user"]["id"], first["suffix"])))
    out = venues.join(ph, F.col(id_col).cast("string") == F.col("_pid").cast("string"), "left")
    return out.select(*[venues[c] for c in venues.columns], url.alias("url"), "photo_status")
