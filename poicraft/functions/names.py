"""Category-name reduction (P5) and legend-label abbreviation."""

from __future__ import annotations

from typing import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from poicraft.functions._col import col
from poicraft.functions.text import NULL_TEXT, as_text

# Ordered activity-name substrings and the short code each maps to.
CATEGORY_SHORT_NAMES = {
    "Comercio al por menor de frutas y verduras frescas": "frutasVerduras",
    "Comercio al por menor de carnes rojas": "carnesRojas",
    "Comercio al por menor en minisupers": "minisupers",
    "Comercio al por menor de carne de aves": "carneAves",
    "Comercio al por menor de dulces y materias primas para repostería": "dulcesReposteria",
    "Comercio al por menor de cerveza": "cerveza",
    "Comercio al por menor de otros alimentos": "alimentos",
    "Comercio al por menor de bebidas no alcohólicas y hielo": "bebidasNoAlcoholicas",
    "Comercio al por menor de leche": "lacteos",
    "Comercio al por menor de artículos de mercería y bonetería": "merceriaBoneteria",
    "Comercio al por menor de paletas de hielo y helados": "helados",
    "Comercio al por menor de semillas y granos alimenticios": "semillasGranos",
    "Comercio al por menor de vinos y licores": "vinosLicores",
    "Comercio al por menor de pescados y mariscos": "pescadosMariscos",
    "Comercio al por menor en supermercados": "supermercados",
    "Comercio al por menor de blancos": "blancos",
    "Comercio al por menor de telas": "telas",
    "Comercio al por menor en tiendas departamentales": "tiendasDepartamentales",
    "Comercio al por menor de cigarros": "cigarros",
    "Comercio al por menor en tiendas de abarrotes": "abarrotes",
}

# Ordered legend-label substrings and their abbreviations.
LEGEND_ABBREVIATIONS = {
    "Comercio al por menor": "C_aP_menor",
    "Comercio al por mayor": "C_aP_mayor",
    "Restaurantes con servicio de preparación": "RcSP",
    "Servicios de preparación de otros alimentos para consumo inmediato": "SP_OA_CI",
    "Restaurantes que preparan otro tipo": "RqP_OT",
    "Departamentos y casas amueblados": "D_CA",
}


def reduce_name(c, mapping: Mapping[str, str] = CATEGORY_SHORT_NAMES,
                null_text: str | None = NULL_TEXT) -> Column:
    """P5: code of the first key (in order) that is a case-sensitive substring.

    No match keeps the name; a null name reads as ``null_text``.
    """
    text = as_text(c, null_text)
    out = None
    for key, short in mapping.items():
        hit = text.contains(F.lit(key))
        out = F.when(hit, F.lit(short)) if out is None else out.when(hit, F.lit(short))
    return text if out is None else out.otherwise(text)


def abbreviate_label(c, mapping: Mapping[str, str] = LEGEND_ABBREVIATIONS) -> Column:
    """The first key (in order) found in the label is replaced everywhere in it."""
    label = col(c)
    out = None
    for key, short in mapping.items():
        hit = label.contains(F.lit(key))
        new = F.replace(label, F.lit(key), F.lit(short))
        out = F.when(hit, new) if out is None else out.when(hit, new)
    return label if out is None else out.otherwise(label)
