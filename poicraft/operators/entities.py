"""Context entities (M1–M4), single payloads (K9) and update batches (K8)."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poicraft.functions.coords import geojson_coords
from poicraft.functions.dates import month_timestamp, timestamp_text
from poicraft.functions.text import as_text, clean_chars, clean_chars_array
from poicraft.operators.index import row_index

JSON_OPTIONS = {"ignoreNullFields": "false"}

# Entity id prefixes, entity and attribute type names, literal
# attribute values, the update action and the number of entities per batch.
VENUE_ID_PREFIX = "4sqr-"
ESTABLISHMENT_ID_PREFIX = "denue-"
POINT_OF_INTEREST = "PointOfInterest"
STRUCTURED_VALUE = "StructuredValue"
TEXT = "Text"
DATE_TIME = "DateTime"
GEO_JSON = "geo:json"
POINT = "Point"
NO_URL = "no url"
CATEGORY_LEVEL = "1"
STREET_NUMBER_SEP = "  "
STREET_PART_SEP = ", "
APPEND = "APPEND"
BATCH_SIZE = 400


def attr(kind: str, value: Column) -> Column:
    """``{"type": kind, "value": value}``."""
    return F.struct(F.lit(kind).alias("type"), value.alias("value"))


def point(coordinates: Column) -> Column:
    return attr(GEO_JSON, F.struct(F.lit(POINT).alias("type"),
                                     coordinates.alias("coordinates")))


def venue_entity(as_of: str) -> Column:
    """M1: venue row (with ``category`` and ``color_cat``) → PointOfInterest entity."""
    return F.struct(
        F.concat(F.lit(VENUE_ID_PREFIX), as_text("id")).alias("id"),
        F.lit(POINT_OF_INTEREST).alias("type"),
        attr(STRUCTURED_VALUE, F.struct(
            clean_chars("country").alias("addressCountry"),
            clean_chars_array("formattedAddress").alias("addressLocality"))).alias("address"),
        attr(TEXT, F.array(F.lit(CATEGORY_LEVEL), clean_chars("category"), F.col("color_cat"))).alias("category"),
        attr(DATE_TIME, timestamp_text(as_of)).alias("dateCreated"),
        attr(TEXT, clean_chars("category")).alias("description"),
        point(F.array(F.col("lng").cast("double"), F.col("lat").cast("double"))).alias("location"),
        attr(TEXT, clean_chars("name")).alias("name"),
        attr(TEXT, F.lit(NO_URL)).alias("url"),
    )


def _response_fields(v: Column, as_of: str) -> list:
    cats = v["categories"]
    aux = F.when(F.coalesce(F.size(cats), F.lit(0)) > 0,
                 clean_chars(F.get(cats, F.lit(0))["name"])).otherwise(clean_chars(v["name"]))
    loc = v["location"]
    return [
        F.concat(F.lit(VENUE_ID_PREFIX), as_text(v["id"])).alias("id"),
        F.lit(POINT_OF_INTEREST).alias("type"),
        attr(STRUCTURED_VALUE, F.struct(
            clean_chars(loc["state"]).alias("addressCountry"),
            clean_chars(loc["city"]).alias("addressLocality"))).alias("address"),
        attr(TEXT, F.array(F.lit(CATEGORY_LEVEL), aux)).alias("category"),
        attr(DATE_TIME, timestamp_text(as_of)).alias("dateCreated"),
        attr(TEXT, aux).alias("description"),
        point(F.array(loc["lng"].cast("double"), loc["lat"].cast("double"))).alias("location"),
        attr(TEXT, clean_chars(v["name"])).alias("name"),
    ]


def explode_venues(responses: DataFrame) -> DataFrame:
    """One row per ``response.venues`` element, as column ``v``."""
    return responses.select(F.explode(F.col("response.venues")).alias("v"))


def response_entities(responses: DataFrame, as_of: str) -> DataFrame:
    """M2: raw venue responses → entities (state → country, city → locality)."""
    v = F.col("v")
    return explode_venues(responses).select(
        F.struct(*_response_fields(v, as_of), attr(TEXT, F.lit(NO_URL)).alias("url"))
        .alias("entity"))


def photo_entities(responses: DataFrame, photos: DataFrame, as_of: str) -> DataFrame:
    """M3: M2 plus the photo url (J3) and the photo lookup status."""
    from poicraft.operators.enrich import photo_enrich

    venues = explode_venues(responses).withColumn("_vid", F.col("v.id"))
    venues = photo_enrich(venues, photos, id_col="_vid")
    v = F.col("v")
    return venues.select(F.struct(
        *_response_fields(v, as_of),
        attr(TEXT, F.col("url")).alias("url"),
        attr(TEXT, F.col("photo_status")).alias("photo_url"),
    ).alias("entity"))


def establishment_entity(category: str, kind: str) -> Column:
    """M4: establishment row (with ``reduct_cat_name``) → context entity."""
    street = F.concat(clean_chars("nom_vial"), F.lit(STREET_NUMBER_SEP), clean_chars("numero_ext"), F.lit(STREET_PART_SEP),
                      clean_chars("tipo_asent"), F.lit(STREET_PART_SEP), clean_chars("nomb_asent"))
    return F.struct(
        F.concat(F.lit(ESTABLISHMENT_ID_PREFIX), as_text("id")).alias("id"),
        F.lit(kind).alias("type"),
        attr(STRUCTURED_VALUE, F.struct(
            clean_chars("entidad").alias("addressCountry"),
            clean_chars("municipio").alias("addressRegion"),
            clean_chars("cod_postal").alias("postalCode"),
            street.alias("streetAddress"))).alias("address"),
        attr(TEXT, F.lit(str(category))).alias("category"),
        attr(TEXT, clean_chars("reduct_cat_name")).alias("subCategory"),
        attr(DATE_TIME, month_timestamp("fecha_alta")).alias("dateCreated"),
        attr(TEXT, clean_chars("nombre_act")).alias("description"),
        point(geojson_coords("longitud", "latitud")).alias("location"),
        attr(TEXT, clean_chars("nom_estab")).alias("name"),
        attr(TEXT, clean_chars("raz_social")).alias("alternateName"),
        attr(TEXT, F.col("www")).alias("dataProvider"),
        attr(TEXT, clean_chars("tipoUniEco")).alias("economyUnit"),
    )


def entity_payloads(entities: DataFrame, column: str = "entity") -> DataFrame:
    """K9: one JSON body per entity, ``(id, payload)``; nulls are kept as ``null``."""
    return entities.select(F.col(f"{column}.id").alias("id"),
                           F.to_json(F.col(column), JSON_OPTIONS).alias("payload"))


def entity_batches(entities: DataFrame, order_by: Sequence[str], size: int = BATCH_SIZE,
                   column: str = "entity") -> DataFrame:
    """K8: ``{"actionType": "APPEND", "entities": [...]}`` bodies of ``size`` entities each.

    Entities are numbered in ``order_by`` order over all range partitions (W1): place in the
    partition plus the rows before it. Batch ``b`` holds the entities ``b*size …
    b*size+size-1``, so all but the last are full and the batches are the same at any
    number of partitions. Output ``(batch_id, n, payload)``.
    """
    indexed = row_index(entities.select(*dict.fromkeys([*order_by, column])), order_by, "_idx")
    grouped = (indexed.groupBy(F.expr(f"_idx div {int(size)}").alias("batch_id"))
               .agg(F.count(F.lit(1)).alias("n"),
                    F.sort_array(F.collect_list(F.struct(F.col("_idx"), F.col(column).alias("e"))))
                    .alias("_items")))
    body = F.struct(F.lit(APPEND).alias("actionType"),
                    F.transform("_items", lambda x: x["e"]).alias("entities"))
    return grouped.select("batch_id", "n", F.to_json(body, JSON_OPTIONS).alias("payload"))
