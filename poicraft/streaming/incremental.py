"""Incremental establishment feed: new directory CSV files → entity payloads.

The filters (F2), the catalogue match (J2, a stream–static left join), the
name reduction (P5) and the entity mapping (M4/K9) are plain column
expressions, so the batch operators apply unchanged to a file stream. Key dedup
(A8) would keep every key ever seen as state, so it stays a batch step.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from poicraft.functions import reduce_name, street_entity_pred
from poicraft.functions.names import CATEGORY_SHORT_NAMES
from poicraft.operators.enrich import catalog_match
from poicraft.operators.joins import BROADCAST_BYTES
from poicraft.operators.entities import entity_payloads, establishment_entity
from poicraft.sources.readers import ESTABLISHMENT_COLUMNS


def entity_payload_stream(spark: SparkSession, source_dir: str, catalog: DataFrame,
                          keywords: Sequence[str], category: str, kind: str,
                          name_map: Mapping[str, str] = CATEGORY_SHORT_NAMES,
                          max_files_per_trigger: int | None = None,
                          columns: Sequence[str] = ESTABLISHMENT_COLUMNS,
                          broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Streaming ``(id, payload)`` for establishment CSV files landing in ``source_dir``.

    ``columns`` are the header of the files, in order; a file with another header
    fails the query instead of being read under the wrong names.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    reader = spark.readStream.schema(schema).option("header", True).option("enforceSchema", False)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    df = reader.csv(source_dir).select(*ESTABLISHMENT_COLUMNS)
    df = df.filter(street_entity_pred("nom_vial", "entidad", keywords))
    df = catalog_match(df, catalog, broadcast_bytes=broadcast_bytes)
    df = df.withColumn("reduct_cat_name", reduce_name("category", name_map))
    return entity_payloads(df.select(establishment_entity(category, kind).alias("entity")))


def start_json_sink(stream: DataFrame, path: str, checkpoint_location: str,
                    available_now: bool = True) -> StreamingQuery:
    """Append the stream to JSON files; exactly-once through the checkpoint."""
    writer = (stream.writeStream.format("json").outputMode("append")
              .option("checkpointLocation", checkpoint_location))
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start(path)
