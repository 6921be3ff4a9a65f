"""GeoJSON features: establishments (M5) and entity points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poicraft.functions.coords import geojson_coords
from poicraft.functions.text import clean_chars
from poicraft.operators.entities import POINT

# The feature type and the labels of the six address lines.
FEATURE = "Feature"
STREET_LABEL = "Calle: "
BETWEEN_LABEL = "Entre : "
BETWEEN_AND = " y "
SETTLEMENT_SEP = ": "
POSTAL_LABEL = "CP: "
MUNICIPALITY_LABEL = "Municipio: "
ENTITY_LABEL = "Entidad: "


def _geometry(coordinates: Column) -> Column:
    return F.struct(F.lit(POINT).alias("type"), coordinates.alias("coordinates"))


def establishment_feature() -> Column:
    """M5: establishment row (with ``category``, ``color_cat``) → Feature.

    Rows whose coordinates do not parse keep an empty coordinate list.
    """
    c = clean_chars
    direccion = F.array(
        F.concat(F.lit(STREET_LABEL), c("nom_vial"), F.lit(" "), c("numero_ext")),
        F.concat(F.lit(BETWEEN_LABEL), c("nom_v_e_1"), F.lit(BETWEEN_AND), c("nom_v_e_2")),
        F.concat(c("tipo_asent"), F.lit(SETTLEMENT_SEP), c("nomb_asent")),
        F.concat(F.lit(POSTAL_LABEL), c("cod_postal")),
        F.concat(F.lit(MUNICIPALITY_LABEL), c("municipio")),
        F.concat(F.lit(ENTITY_LABEL), c("entidad")),
    )
    props = F.struct(
        c("id").alias("id"), c("nom_estab").alias("nom_estab"), c("raz_social").alias("raz_social"),
        c("nombre_act").alias("nombre_act"), c("category").alias("categoria"),
        F.col("color_cat").alias("color_cat"), direccion.alias("direccion"),
        c("www").alias("sitio_web"), c("fecha_alta").alias("fecha_alta"),
    )
    return F.struct(F.lit(FEATURE).alias("type"), props.alias("properties"),
                    _geometry(geojson_coords("longitud", "latitud")).alias("geometry"))


def entity_points(entities: DataFrame, column: str = "entity") -> DataFrame:
    """M6 + F7: venue entities → point Features; entities without coordinates are skipped."""
    e = F.col(column)
    coords = e["location"]["value"]["coordinates"]
    value = e["category"]["value"]
    feature = F.struct(
        F.lit(FEATURE).alias("type"),
        F.struct(e["id"].alias("name"), F.get(value, F.lit(1)).alias("category"),
                 F.get(value, F.lit(2)).alias("color_cat"),
                 e["address"]["value"]["addressLocality"].alias("address")).alias("properties"),
        _geometry(coords).alias("geometry"),
    )
    return entities.filter(F.size(coords) > 0).select(feature.alias("feature"))
