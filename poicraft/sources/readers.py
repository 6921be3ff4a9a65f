"""Scans S1–S10: JSON by explicit schemas, CSV by the header's names (no type inference, codes stay text)."""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from poicraft.sinks.publish import published
from poicraft.sinks.writers import COLLECTION, FILE_FORMATS
from poicraft.sources import docdump

__all__ = [
    "ESTABLISHMENT_COLUMNS", "VENUE_SCHEMA", "RESPONSE_SCHEMA", "PHOTO_SCHEMA",
    "load_establishments", "load_catalog_raw", "load_postal", "load_venues", "project_venues",
    "load_collection", "load_dual", "flatten_venues", "build_catalog", "union_parts", "find_by_array_value",
]

# The establishment columns kept from the directory CSV, in order.
ESTABLISHMENT_COLUMNS = [
    "id", "nom_estab", "raz_social", "nombre_act", "codigo_act", "nom_vial", "nom_v_e_1",
    "nom_v_e_2", "nom_v_e_3", "numero_ext", "tipo_asent", "nomb_asent", "cod_postal", "entidad",
    "municipio", "localidad", "www", "tipoUniEco", "latitud", "longitud", "fecha_alta",
]

CATEGORY = T.StructType([T.StructField("id", T.StringType()), T.StructField("name", T.StringType()),
                         T.StructField("primary", T.BooleanType())])
LOCATION = T.StructType([
    T.StructField("country", T.StringType()), T.StructField("state", T.StringType()),
    T.StructField("city", T.StringType()),
    T.StructField("formattedAddress", T.ArrayType(T.StringType())),
    T.StructField("postalCode", T.StringType()),
    T.StructField("lng", T.DoubleType()), T.StructField("lat", T.DoubleType()),
])
VENUE_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("name", T.StringType()),
    T.StructField("categories", T.ArrayType(CATEGORY)), T.StructField("location", LOCATION),
])
RESPONSE_SCHEMA = T.StructType([T.StructField("response", T.StructType([
    T.StructField("venues", T.ArrayType(VENUE_SCHEMA))]))])
PHOTO_SCHEMA = T.StructType([
    T.StructField("venue_id", T.StringType()), T.StructField("status", T.IntegerType()),
    T.StructField("items", T.ArrayType(T.StructType([
        T.StructField("prefix", T.StringType()), T.StructField("suffix", T.StringType()),
        T.StructField("user", T.StructType([T.StructField("id", T.StringType())]))]))),
])


def _csv(spark: SparkSession, paths, encoding: str = "UTF-8") -> DataFrame:
    # Header names, every value as text: no inference scan, '06000' keeps its zero.
    # Single-line records keep large files splittable across tasks. The first file's
    # header gives the names; a file of a folder with another header fails the read
    # instead of being laid under the wrong names.
    def reader():
        return (spark.read.option("header", True).option("inferSchema", False)
                .option("multiLine", False).option("encoding", encoding))

    names = reader().csv(paths).columns
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return reader().option("enforceSchema", False).schema(schema).csv(paths)


def _with_csv_suffix(path: str, file: str | None) -> str:
    if file is None:
        return path
    name = file if ".csv" in str(file) else f"{file}.csv"
    return path.rstrip("/") + "/" + name


def load_establishments(spark: SparkSession, path: str | Sequence[str],
                        file: str | None = None, encoding: str = "UTF-8") -> DataFrame:
    """Directory CSV (header) → the 21 establishment columns, all text.

    ``file`` without ``.csv`` gets the suffix appended. Every path of a list is read by
    its own header; the files within one folder must share theirs. Directory
    exports are often Latin-1: pass ``encoding='ISO-8859-1'``.
    """
    paths = path if isinstance(path, (list, tuple)) else [_with_csv_suffix(path, file)]
    parts = [_csv(spark, p, encoding).select(*ESTABLISHMENT_COLUMNS) for p in paths]
    return reduce(DataFrame.unionByName, parts)


def load_catalog_raw(spark: SparkSession, path: str, file: str | None = None,
                     encoding: str = "UTF-8") -> DataFrame:
    """Any catalogue CSV, all columns as text."""
    return _csv(spark, _with_csv_suffix(path, file), encoding)


def load_postal(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """S3: postal catalogue (``d_codigo``, ``D_mnpio``, ``d_tipo_asenta``, …) as text."""
    return _csv(spark, path, encoding)


def project_venues(docs: DataFrame) -> DataFrame:
    """The 11-column venue projection; array fields are read through the array."""
    return docs.select(
        F.col("categories.primary").alias("primary"), F.col("id"), F.col("name"),
        F.col("categories.name").alias("cat_name"), F.col("categories.id").alias("cat_id"),
        F.col("location.country").alias("country"), F.col("location.state").alias("state"),
        F.col("location.formattedAddress").alias("formattedAddress"),
        F.col("location.postalCode").alias("postalCode"),
        F.col("location.lng").alias("lng"), F.col("location.lat").alias("lat"),
    )


def load_venues(spark: SparkSession, path: str, fmt: str = "json", **options) -> DataFrame:
    """Venue documents from files, a collection of ``write_collection``, dump files of a
    document store (``docdump``), or a document-store connector (``fmt``)."""
    if fmt == docdump.NAME:
        docdump.register(spark)
    return project_venues(spark.read.format(fmt).schema(VENUE_SCHEMA).options(**options).load(_resolved(spark, path, fmt)))


def _resolved(spark: SparkSession, path: str, fmt: str) -> str:
    """The folder of a published collection's newest run; any other path as it is."""
    if fmt not in FILE_FORMATS or not isinstance(path, str) or any(c in path for c in "*?{["):
        return path
    return (published(spark, path) or {}).get(COLLECTION, path)


def load_venue_lines(spark: SparkSession, path: str) -> DataFrame:
    """S4 with the whole documents: the venue's fields and its JSON line as ``doc``."""
    line = spark.read.text(path).select(F.col("value").alias("doc"), F.from_json("value", VENUE_SCHEMA).alias("v"))
    return line.select("doc", "v.id", F.col("v.location.lat").alias("lat"), F.col("v.location.lng").alias("lng"))


def load_collection(spark: SparkSession, path: str, fmt: str = "parquet", schema=None, **options) -> DataFrame:
    """A whole stored collection, as written: the newest published run, or plain files.

    Formats that do not keep the schema (``docdump``) take it from the caller.
    """
    if fmt == docdump.NAME:
        docdump.register(spark)
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.format(fmt).options(**options).load(_resolved(spark, path, fmt))


def load_dual(spark: SparkSession, base: str, run_id: str) -> dict[str, DataFrame] | None:
    """K7 read back: ``raw`` (responses) and ``mapped`` (entities) of a run, None unless both are published."""
    folders = published(spark, f"{base.rstrip('/')}/{run_id}")
    if folders is None:
        return None
    return {"raw": spark.read.schema(RESPONSE_SCHEMA).json(folders["raw"]), "mapped": spark.read.json(folders["mapped"])}


def flatten_venues(responses: DataFrame, mapped: bool = False, as_of: str | None = None) -> DataFrame:
    """Explode ``response.venues`` to ``(id, name, location)``, or to entities."""
    if mapped:
        from poicraft.operators.entities import response_entities
        return response_entities(responses, as_of)
    v = responses.select(F.explode("response.venues").alias("v"))
    return v.select("v.id", "v.name", "v.location")


def build_catalog(spark: SparkSession, path: str, parse: str = "split") -> DataFrame:
    """Activity catalogue ``(id_act, actividad)`` from a classification text file.

    Keeps lines whose first comma field is all digits and takes the first two
    fields without double quotes. ``parse='split'`` splits naively on commas (as
    the original; a title holding a comma is cut there); ``parse='csv'`` honours
    quotes.
    """
    if parse == "csv":
        raw = spark.read.option("header", False).csv(path)
        first, second = F.col("_c0"), F.col("_c1")
    else:
        parts = F.split(F.col("value"), ",")
        raw = spark.read.text(path).select(parts.alias("p"))
        first, second = F.get(F.col("p"), F.lit(0)), F.get(F.col("p"), F.lit(1))
    return raw.filter(first.rlike("^[0-9]+$")).select(
        F.regexp_replace(first, '"', "").alias("id_act"),
        F.regexp_replace(second, '"', "").alias("actividad"))


def union_parts(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Several directory CSV parts, each by its own header, as one frame."""
    return load_establishments(spark, list(paths))


def find_by_array_value(df: DataFrame, column: str, value) -> DataFrame:
    """Rows whose array column holds ``value``."""
    return df.filter(F.array_contains(F.col(column), F.lit(value)))
