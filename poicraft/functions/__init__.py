"""Column functions: each takes and returns :class:`pyspark.sql.Column`.

All of them are built-in Spark expressions, so they stay inside whole-stage
codegen and work unchanged on batch and streaming frames.
"""

from poicraft.functions.coords import (geojson_coords, haversine_m, parse_number,
                                       planar_distance, strict_coords)
from poicraft.functions.dates import month_timestamp, search_date, timestamp_text
from poicraft.functions.names import abbreviate_label, reduce_name
from poicraft.functions.palette import (OTHER, OTHER_COLOR, category_color,
                                        color_for_keys, plain_color)
from poicraft.functions.predicates import (address_keyword_pred, any_keyword_pred,
                                           first_line, street_entity_pred)
from poicraft.functions.text import as_text, clean_chars, clean_chars_array, icontains

__all__ = [
    "OTHER", "OTHER_COLOR", "abbreviate_label", "address_keyword_pred", "any_keyword_pred",
    "as_text", "category_color", "first_line", "clean_chars", "clean_chars_array", "color_for_keys",
    "geojson_coords", "haversine_m", "icontains", "month_timestamp", "parse_number",
    "plain_color", "planar_distance", "reduce_name", "search_date", "street_entity_pred",
    "strict_coords", "timestamp_text",
]
