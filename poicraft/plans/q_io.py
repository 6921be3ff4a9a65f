"""Scans and sinks: each query writes a frame derived from the tables into the
shared scratch folder with our writer, reads it back with our reader and
returns what was read (so the oracle compares the round trip)."""

from __future__ import annotations

from pyspark.sql import functions as F

from poicraft.functions import street_entity_pred
from poicraft.operators import audit, categories as cat, dedup, enrich
from poicraft.operators import entities as E
from poicraft.operators.entities import explode_venues, response_entities
from poicraft.plans import bindings as B
from poicraft.plans import sqlfrag as S
from poicraft.plans.params import AS_OF, MAP_KEYWORDS, TOP_N
from poicraft.plans.q_core import EST_CAT, abbreviate_sql, est_categories, legend_sql, top_n_sql
from poicraft.plans.q_places import (EST_FEATURES_SQL, _response_sql, establishment_features_frame,
                                     flat_response)
from poicraft.plans.registry import comparable, query
from poicraft.session import scratch_path
from poicraft.sinks import writers as W
from poicraft.sources import readers as R

EST_COLS = ", ".join(R.ESTABLISHMENT_COLUMNS)
VEN_FLAT_SQL = f"""
select to_json("primary") as "primary", id, name, to_json(cat_name) as cat_name, to_json(cat_id) as cat_id,
  country, state, to_json(formattedAddress) as formattedAddress, postalCode, lng, lat from ({B.VEN_SQL})
"""


def _csv_roundtrip(spark, df, name):
    path = scratch_path(spark, name)
    df.write.option("header", True).csv(path)
    return path


@query("scan_establishments", f"select {EST_COLS} from ({B.EST_SQL})")
def q_scan_establishments(spark, sf):
    path = _csv_roundtrip(spark, B.establishments(spark, sf), "establishments")
    return R.load_establishments(spark, path)


@query("scan_catalog", B.CATALOG_SQL)
def q_scan_catalog(spark, sf):
    path = _csv_roundtrip(spark, B.activity_catalog(spark, sf), "catalog")
    return R.load_catalog_raw(spark, path)


@query("scan_postal", B.POSTAL_SQL)
def q_scan_postal(spark, sf):
    path = _csv_roundtrip(spark, B.postal_catalog(spark, sf), "postal")
    return R.load_postal(spark, path)


@query("scan_venues", VEN_FLAT_SQL)
def q_scan_venues(spark, sf):
    path = W.write_raw_json(B.venue_documents(spark, sf), scratch_path(spark, "venues"))
    return comparable(R.load_venues(spark, path, "json"))


@query("scan_document_store", VEN_FLAT_SQL)
def q_scan_document_store(spark, sf):
    """The venue documents stored as dump files and read back in several splits."""
    path = W.write_collection(B.venue_documents(spark, sf), scratch_path(spark, "venue-dump"), "docdump")
    return comparable(R.load_venues(spark, path, "docdump", splitBytes=1 << 20))


@query("scan_collection", f"select {EST_COLS} from ({B.EST_SQL})")
def q_scan_collection(spark, sf):
    path = W.write_collection(B.establishments(spark, sf), scratch_path(spark, "collection"), "json")
    return R.load_collection(spark, path, "json").select(*R.ESTABLISHMENT_COLUMNS)


@query("write_collection", VEN_FLAT_SQL)
def q_write_collection(spark, sf):
    path = W.write_collection(B.venues(spark, sf), scratch_path(spark, "venues-clean"))
    return comparable(R.load_collection(spark, path))


def _body(venue):
    """A venue document read back, value by value."""
    loc, cats = venue["location"], venue["categories"]
    return [venue["id"].alias("id"), venue["name"].alias("name"), loc["country"].alias("country"),
            loc["state"].alias("state"), loc["city"].alias("city"), F.to_json(loc["formattedAddress"]).alias("address"),
            loc["postalCode"].alias("postal_code"), loc["lng"].alias("lng"), loc["lat"].alias("lat"),
            F.to_json(cats["name"]).alias("cat_name"), F.to_json(cats["id"]).alias("cat_id"),
            F.to_json(cats["primary"]).alias("primary")]


BODY_SQL = f"""
select id, name, country, state, city, to_json(formattedAddress) as address, postalCode as postal_code, lng, lat,
  to_json(cat_name) as cat_name, to_json(cat_id) as cat_id, to_json("primary") as "primary" from ({B.VEN_SQL})
"""


@query("write_raw_json", BODY_SQL)
def q_write_raw_json(spark, sf):
    path = W.write_raw_json(B.responses(spark, sf), scratch_path(spark, "raw"))
    back = spark.read.schema(R.RESPONSE_SCHEMA).json(path)
    return explode_venues(back).select(*_body(F.col("v")))


_MAPPED_SQL = _response_sql(f", {S.lit(E.NO_URL)} as url")
_MAPPED = "address_country, address_locality, category, date_created, description, url, types"
_RAW = "country, state, city, address, postal_code, cat_name, cat_id, \"primary\""


@query("write_dual", f"""
select 'raw' as kind, id, name, lng, lat, concat_ws(chr(10), {_RAW}) as body from ({BODY_SQL})
union all
select 'mapped', id, name, lng, lat, concat_ws(chr(10), {_MAPPED}) from ({_MAPPED_SQL})
""")
def q_write_dual(spark, sf):
    raw = B.responses(spark, sf)
    mapped = response_entities(raw, AS_OF)
    paths = W.write_dual(raw, mapped, scratch_path(spark, "dual"), "run-0001")
    r = spark.read.schema(R.RESPONSE_SCHEMA).json(paths["raw"])
    m = spark.read.schema(mapped.schema).json(paths["mapped"])
    r = explode_venues(r).select(*_body(F.col("v")))
    m = m.select(*flat_response(F.col("entity"), False))

    def row(df, kind, columns):
        body = F.concat_ws("\n", *[c.strip(' "') for c in columns.split(",")])
        return df.select(F.lit(kind).alias("kind"), "id", "name", "lng", "lat", body.alias("body"))

    return row(r, "raw", _RAW).unionByName(row(m, "mapped", _MAPPED))


@query("write_geojson", f"select feature as value from ({EST_FEATURES_SQL})")
def q_write_geojson(spark, sf):
    path = W.write_geojson(establishment_features_frame(spark, sf), scratch_path(spark, "geojson"))
    return spark.read.text(path)


@query("write_feature_collection", f"""
select {S.lit(W.COLLECTION_START)} as line union all select {S.lit(W.COLLECTION_END)} union all
select case when row_number() over (order by cast(id as bigint), feature) = 1 then '' else ',' end || feature from ({EST_FEATURES_SQL})
""")
def q_write_feature_collection(spark, sf):
    features = establishment_features_frame(spark, sf).withColumn("n", F.col("id").cast("bigint"))
    path = W.write_feature_collection(features, scratch_path(spark, "collection"), ["n"])
    return spark.read.text(path).withColumnRenamed("value", "line")


EST_COUNTS = f"select category, count(*) as n from ({EST_CAT}) group by category"
ABBREV_LEGEND_SQL = abbreviate_sql(legend_sql(top_n_sql(EST_COUNTS, TOP_N)))


@query("legend_json", f"""
select '{{' || string_agg('"' || label || '":"' || color || '"', ',' order by rank) || '}}' as legend
from ({ABBREV_LEGEND_SQL})
""")
def q_legend_json(spark, sf):
    counts = cat.category_count(est_categories(spark, sf))
    lg = cat.abbreviate_legend(cat.legend(cat.top_n_other(counts, TOP_N)))
    return spark.read.text(W.write_legend(lg, scratch_path(spark, "legend"))) \
        .withColumnRenamed("value", "legend")


@query("write_counts", """
select coalesce(category, '') || ',' || cast(n as varchar) as line
from (select l.category, count(*) as n
      from documents d left join (select doc_id, 'quality_' || cast(quality as varchar) as category
                                  from labels) l on d.doc_id = l.doc_id
      group by l.category)
""")
def q_write_counts(spark, sf):
    from poicraft.plans.q_core import q_catalog_match
    counts = cat.category_count(q_catalog_match(spark, sf))
    path = W.write_counts(counts, scratch_path(spark, "counts"))
    return spark.read.text(path).withColumnRenamed("value", "line")


@query("build_catalog", "select cast(p_partkey as varchar) as id_act, p_name as actividad from part")
def q_build_catalog(spark, sf):
    part = B.table(spark, sf, "part")
    region = B.table(spark, sf, "region")
    lines = (spark.createDataFrame([('codigo,"titulo",marca',)], "value string")
             .unionByName(region.select(F.concat("r_name", F.lit(',"region",x')).alias("value")))
             .unionByName(part.select(F.concat(F.col("p_partkey").cast("string"), F.lit(',"'),
                                               "p_name", F.lit('",'), "p_brand").alias("value"))))
    path = scratch_path(spark, "activity-catalog")
    lines.write.text(path)
    return R.build_catalog(spark, path)


@query("union_parts", f"select {EST_COLS} from ({B.EST_SQL})")
def q_union_parts(spark, sf):
    est = B.establishments(spark, sf)
    trade = F.col("raz_social").isin("BUILDING", "AUTOMOBILE")
    # the parts differ in the order of their columns and in the columns we don't keep
    a = _csv_roundtrip(spark, est.filter(trade).select(F.lit("x").alias("clee"), *reversed(est.columns)), "part-a")
    b = _csv_roundtrip(spark, est.filter(~trade), "part-b")
    return R.union_parts(spark, [a, b])


@query("stage_audit", f"""
select cast(0 as bigint) as seq, 'loaded' as stage, count(*) as n from ({B.REPEATED_EST_SQL})
union all select 1, 'deduplicated', count(distinct id) from ({B.EST_SQL})
union all select 2, 'address filter', count(distinct id) from ({B.EST_SQL})
union all select 3, 'catalogue match', count(distinct id) from ({B.EST_SQL})
""")
def q_stage_audit(spark, sf):
    a = audit.StageAudit()
    df = a.mark(B.repeated_establishments(spark, sf), "loaded")
    df = a.mark(dedup.dedupe_by_key(df, ["id"]), "deduplicated")
    df = a.mark(df.filter(street_entity_pred("nom_vial", "entidad", MAP_KEYWORDS, "reference")),
                "address filter")
    df = a.mark(enrich.catalog_match(df, B.activity_catalog(spark, sf)), "catalogue match")
    df.write.format("noop").mode("overwrite").save()
    return a.table(spark)
