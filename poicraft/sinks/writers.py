"""Sinks K1–K7. Every writer is a distributed Spark write and returns its path."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poicraft.operators.cells import CELL, cell
from poicraft.operators.dedup import orderable
from poicraft.sinks.publish import publish
from poicraft.sources import docdump

__all__ = ["write_collection", "write_bucketed", "write_clustered", "write_geojson", "write_feature_collection", "write_legend", "write_counts",
           "write_raw_json", "write_dual", "legend_object", "json_name"]

JSON_OPTIONS = {"ignoreNullFields": "false"}
# Formats that write files under a path; their collections are published under this name.
FILE_FORMATS = ("parquet", "orc", "json", "csv", "text", "avro", docdump.NAME)
COLLECTION = "data"
# What stands before and after the features of a collection.
COLLECTION_START, COLLECTION_END = '{"type":"FeatureCollection","features":[', "]}"
# Part files carry five digits, so names sort like numbers up to here.
MAX_PARTS = 100_000


def write_collection(df: DataFrame, path: str, fmt: str = "parquet", **options) -> str:
    """K1: overwrite a collection; errors propagate to the caller.

    Files are published atomically (``sinks.publish``): readers (``load_collection``) see the
    old collection, whole, until the new one is, also where it is derived from the old
    one. Other formats overwrite by their connector's own rules.
    """
    if fmt == docdump.NAME:
        docdump.register(df.sparkSession)

    def write(folder: str) -> None:
        df.write.format(fmt).mode("overwrite").options(**options).save(folder)

    if fmt in FILE_FORMATS:
        publish(df.sparkSession, path, {COLLECTION: write})
    else:
        write(path)
    return path


def json_name(path: str, name: str | None) -> str:
    """``path/name`` with ``.json`` appended to the name when it is missing."""
    if name is None:
        return path
    name = name if ".json" in str(name) else f"{name}.json"
    return path.rstrip("/") + "/" + name


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int, fmt: str = "parquet") -> str:
    """K1 variant: store a collection as a catalog table bucketed and sorted by ``key``.

    Two tables bucketed by their join key with the same bucket count join without
    a shuffle (e.g. venues and photo records by venue id, J3). The table lives in
    the session's warehouse, which on a cluster is shared storage.
    """
    (df.write.format(fmt).mode("overwrite").bucketBy(buckets, key).sortBy(key)
     .saveAsTable(table))
    return table


def write_clustered(df: DataFrame, path: str, lat: str = "lat", lng: str = "lng", row_group_bytes: int | None = None) -> str:
    """K1 variant: store venues in the order of a space-filling curve, with the cell column.

    Range partitions by cell, sorted within, so each row group covers a small area and
    the searches R1–R4 on the table read only the groups their cell ranges touch. Venues of
    one crowded cell spread by the hash of their columns; those without a place come first.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    tie = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns if orderable(kinds[c])])
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.withColumn(CELL, cell(lat, lng)).repartitionByRange(parts, F.col(CELL), tie).sortWithinPartitions(CELL)
    writer = placed.write.mode("overwrite")
    if row_group_bytes:
        writer = writer.option("parquet.block.size", row_group_bytes)
    writer.parquet(path)
    return path


def write_geojson(features: DataFrame, path: str, column: str = "feature",
                  name: str | None = None) -> str:
    """K2/K3 as lines: one GeoJSON Feature per line (a GeoJSON text sequence), in parallel.

    ``name`` gets ``.json`` appended when missing.
    """
    path = json_name(path, name)
    features.select(F.to_json(F.col(column), JSON_OPTIONS).alias("value")) \
        .write.mode("overwrite").text(path)
    return path


def write_feature_collection(features: DataFrame, path: str, order_by: Sequence[str], column: str = "feature",
                             name: str | None = None) -> str:
    """K2/K3: all features as one GeoJSON FeatureCollection, written in parallel.

    The part files, put together in the order of their names (``cat part-*``,
    ``hdfs dfs -getmerge``), are one JSON document with the features in ``order_by``
    order, one per line. The first part holds the opening of the collection, the last its
    end, and every range partition in between writes its own features, each behind a
    comma except the very first: the first range partition holds it, if there is any. No
    task writes more than its partition, and nothing is counted beforehand. Without
    features the collection is empty.
    """
    path = json_name(path, name)
    spark = features.sparkSession
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), MAX_PARTS - 2)
    one = lambda text: spark.range(0, 1, 1, 1).select(F.lit(text).alias("value"))
    body = F.to_json(F.col(column), JSON_OPTIONS)
    keys = [F.col(f"`{c}`").alias(f"_key{i}") for i, c in enumerate(order_by)]
    ordered = features.select(*keys, body.alias("_body"))
    by = [c for c in ordered.columns if c != "_body"] + ["_body"]  # equal keys spread by the feature itself
    ordered = ordered.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    first = F.monotonically_increasing_id() == 0
    lines = ordered.select(F.concat(F.when(first, F.lit("")).otherwise(F.lit(",")), "_body").alias("value"))
    one(COLLECTION_START).unionAll(lines).unionAll(one(COLLECTION_END)).write.mode("overwrite").text(path)
    return path


def legend_object(legend: DataFrame) -> DataFrame:
    """The legend (≤ N + 1 rows) as one JSON object ``{"label": "#color", …}`` in rank order.

    Of rows with the same label the later one (by rank) stays.
    """
    legend = legend.groupBy("label").agg(F.max("rank").alias("rank"), F.max_by("color", "rank").alias("color"))
    entries = F.sort_array(F.collect_list(F.struct("rank", "label", "color")))
    pairs = F.transform(entries, lambda x: F.struct(x["label"], x["color"]))
    return legend.agg(F.to_json(F.map_from_entries(pairs)).alias("legend"))


def write_legend(legend: DataFrame, path: str, name: str | None = None) -> str:
    """K4: the legend object as one JSON text file (the frame is bounded by N + 1 rows)."""
    path = json_name(path, name)
    legend_object(legend).coalesce(1).write.mode("overwrite").text(path)
    return path


def write_counts(counts: DataFrame, path: str) -> str:
    """K5: ``category,count`` lines, ``|`` as quote (doubled inside), no header.

    Lines are sorted by count descending, then name, across the part files in name
    order. A null category is written as an empty field.
    """
    (counts.orderBy(F.desc("n"), F.asc_nulls_last("category"))
     .select(F.col("category"), F.col("n").cast("string"))
     .write.mode("overwrite").option("header", False).option("quote", "|")
     .option("escape", "|").option("emptyValue", "").option("nullValue", "")
     .option("lineSep", "\n").csv(path))
    return path


def write_raw_json(df: DataFrame, path: str) -> str:
    """K6: rows as JSON lines."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
    return path


def write_dual(raw: DataFrame, mapped: DataFrame, base: str, run_id: str) -> dict:
    """K7: raw documents and mapped entities of a run, committed together: ``load_dual``
    shows both halves or neither. Returns the folders ``raw`` and ``mapped``."""
    return publish(raw.sparkSession, f"{base.rstrip('/')}/{run_id}", {
        "raw": lambda folder: write_raw_json(raw, folder), "mapped": lambda folder: write_raw_json(mapped, folder)})
