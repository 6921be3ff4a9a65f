"""Spatial search, mesh, nested venue documents, entities and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from poicraft.functions import reduce_name
from poicraft.operators import categories as cat, entities as ent, features as feat, mesh, spatial
from poicraft.functions.dates import MONTH_SUFFIX
from poicraft.operators import entities as E
from poicraft.operators.enrich import NO_PHOTO, NO_PHOTO_ITEMS
from poicraft.operators import features as FT
from poicraft.plans import bindings as B
from poicraft.plans import sqlfrag as S
from poicraft.plans.collect import collect_mesh
from poicraft.plans.params import (AS_OF, AS_OF_TEXT, BOX_CATEGORY, BOX_NE, BOX_SW, CENTER,
                                   LEGEND_N, MESH_RESUME, MESH_X, MESH_Y, RADIUS_M, RADIUS_QUERY, SEARCH_LIMIT,
                                   RETAIL_CATEGORY, RETAIL_KIND, SWEEP_CAP, SWEEP_NE, SWEEP_SW,
                                   VENUE_KEYS, BATCH_ENTITIES)
from poicraft.plans.q_core import EST_CAT, reduce_sql, est_categories, top_n_sql
from poicraft.plans.registry import query
from poicraft.session import scratch_path
from poicraft.sinks import writers as W
from poicraft.sources import readers as R
from poicraft.sources.readers import find_by_array_value

PTS = f"({B.POINTS_SQL})"
VEN = f"({B.VEN_SQL})"


def d(x: float) -> str:
    return f"{float(x)!r}::double"


# ---------------------------------------------------------------- R1–R4


def _box_sql(sw, ne) -> str:
    return (f"lat >= {d(sw[0])} and lat < {d(ne[0])} and lng >= {d(sw[1])} and lng < {d(ne[1])}")


@query("bbox_search", f"select id, name from {PTS} where {_box_sql(BOX_SW, BOX_NE)}")
def q_bbox_search(spark, sf):
    return spatial.bbox_search(B.points(spark, sf), BOX_SW, BOX_NE).select("id", "name")


@query("bbox_category_search", f"""
select id, name from {PTS} where {_box_sql(BOX_SW, BOX_NE)} and list_contains(cat_id, '{BOX_CATEGORY}')
""")
def q_bbox_category_search(spark, sf):
    return spatial.bbox_category_search(B.points(spark, sf), BOX_SW, BOX_NE, BOX_CATEGORY) \
        .select("id", "name")


@query("radius_search", f"""
select id from {PTS} where {S.haversine(CENTER[0], CENTER[1], 'lat', 'lng')} <= {d(RADIUS_M)}
""")
def q_radius_search(spark, sf):
    return spatial.radius_search(B.points(spark, sf), CENTER, RADIUS_M).select("id")


@query("radius_query_search", f"""
select id, name from {PTS}
where {S.haversine(CENTER[0], CENTER[1], 'lat', 'lng')} <= {d(RADIUS_M)} and {S.icontains('name', RADIUS_QUERY)}
""")
def q_radius_query_search(spark, sf):
    return spatial.radius_query_search(B.points(spark, sf), CENTER, RADIUS_M, RADIUS_QUERY) \
        .select("id", "name")


_FAR_SIDE = f"(select id, name, cat_id, lat, case when lng > 0 then lng - 180 else lng + 180 end as lng from {PTS})"


def _far_side(spark, sf):
    """The points moved half way round, so they lie about the ±180° meridian."""
    lng = F.col("lng")
    return B.points(spark, sf).withColumn("lng", F.when(lng > 0, lng - 180).otherwise(lng + 180))


@query("radius_search_antimeridian", f"""
select id, lng from {_FAR_SIDE} where {S.haversine(0.0, 179.95, 'lat', 'lng')} <= {d(RADIUS_M)} order by id limit {SEARCH_LIMIT}
""")
def q_radius_search_antimeridian(spark, sf):
    return spatial.radius_search(_far_side(spark, sf), (0.0, 179.95), RADIUS_M, limit=SEARCH_LIMIT).select("id", "lng")


@query("bbox_search_antimeridian", f"""
select id, name from {_FAR_SIDE} where lat >= -0.1 and lat < 0.1 and (lng >= 179.9 or lng < -179.9)
""")
def q_bbox_search_antimeridian(spark, sf):
    return spatial.bbox_search(_far_side(spark, sf), (-0.1, 179.9), (0.1, -179.9)).select("id", "name")


def _clustered(spark, sf):
    """The points in a clustered store, as it is read back."""
    return R.load_collection(spark, W.write_clustered(B.points(spark, sf), scratch_path(spark, "points-clustered")))


@query("clustered_bbox_search", f"""
select id, name from {PTS} where {_box_sql(BOX_SW, BOX_NE)} and list_contains(cat_id, '{BOX_CATEGORY}')
""")
def q_clustered_bbox_search(spark, sf):
    """R2 on a clustered store: the scan takes over the cell ranges of the box."""
    return spatial.bbox_category_search(_clustered(spark, sf), BOX_SW, BOX_NE, BOX_CATEGORY).select("id", "name")


@query("clustered_radius_search", f"""
select id, name from {PTS}
where {S.haversine(CENTER[0], CENTER[1], 'lat', 'lng')} <= {d(RADIUS_M)} and {S.icontains('name', RADIUS_QUERY)}
order by id limit {SEARCH_LIMIT}
""")
def q_clustered_radius_search(spark, sf):
    """R4 on a clustered store, with a limit."""
    return spatial.radius_query_search(_clustered(spark, sf), CENTER, RADIUS_M, RADIUS_QUERY, SEARCH_LIMIT).select("id", "name")


# ---------------------------------------------------------------- S11, O4, R5


MESH_SQL = f"""
with b as (select min(lat) as lat0, min(lng) as lng0, max(lat) as lat1, max(lng) as lng1 from {PTS}),
s as (select lat0, lng0, (lng1 - lng0) / {MESH_X} as dx, (lat1 - lat0) / {MESH_Y} as dy from b),
c as (select range as cell_id, range % {MESH_X} as i, range // {MESH_X} as j from range({MESH_X * MESH_Y}))
select cell_id, i, j, cast(i as varchar) || '-' || cast(j as varchar) as key,
  lat0 + cast(j as double) * dy as sw_lat, lng0 + cast(i as double) * dx as sw_lng,
  lat0 + cast(j + 1 as double) * dy as ne_lat, lng0 + cast(i + 1 as double) * dx as ne_lng
from c, s
"""


def _grid(spark, sf):
    sw, ne = mesh.extent(B.points(spark, sf))
    return mesh.mesh_grid(spark, sw, ne, MESH_X, MESH_Y)


@query("mesh_grid", MESH_SQL)
def q_mesh_grid(spark, sf):
    return _grid(spark, sf)


@query("mesh_resume", f"select * from ({MESH_SQL}) where cell_id + 1 >= {MESH_RESUME}")
def q_mesh_resume(spark, sf):
    return mesh.mesh_resume(_grid(spark, sf), MESH_RESUME)


_DX = (SWEEP_NE[1] - SWEEP_SW[1]) / MESH_X
_DY = (SWEEP_NE[0] - SWEEP_SW[0]) / MESH_Y


_SWEEP_SQL = f"""
with p as (
  select id, cast(least(floor((lng - {d(SWEEP_SW[1])}) / {d(_DX)}), {MESH_X - 1}) as bigint) as i,
             cast(least(floor((lat - {d(SWEEP_SW[0])}) / {d(_DY)}), {MESH_Y - 1}) as bigint) as j
  from {PTS}
  where lat >= {d(SWEEP_SW[0])} and lat <= {d(SWEEP_NE[0])} and lng >= {d(SWEEP_SW[1])} and lng <= {d(SWEEP_NE[1])}),
q as (select id, i, j, j * {MESH_X} + i as cell_id,
        cast(row_number() over (partition by j * {MESH_X} + i order by id) as bigint) as rank from p)
select * from q where rank <= {SWEEP_CAP}
"""


@query("mesh_sweep", _SWEEP_SQL)
def q_mesh_sweep(spark, sf):
    out = mesh.mesh_sweep(B.points(spark, sf), SWEEP_SW, SWEEP_NE, MESH_X, MESH_Y, SWEEP_CAP, ["id"])
    return out.select("id", "i", "j", "cell_id", "rank")


@query("mesh_collect_resumed", f"select id, cell_id, rank from ({_SWEEP_SQL})")
def q_mesh_collect_resumed(spark, sf):
    """E6 in two calls: the first ends after one step, the second goes on from the progress table."""
    out = scratch_path(spark, "mesh-collect")
    box = dict(sw=SWEEP_SW, ne=SWEEP_NE, nx=MESH_X, ny=MESH_Y, cap=SWEEP_CAP, step_blocks=35)
    collect_mesh(spark, B.points(spark, sf), out, most_steps=1, **box)
    return collect_mesh(spark, B.points(spark, sf), out, **box).select("id", "cell_id", "rank")


# ---------------------------------------------------------------- nested documents S7, P3, S10


@query("flatten_venues", f"""
select id, name, country, state, city, to_json(formattedAddress) as address,
  postalCode as postal_code, lng, lat from {VEN}
""")
def q_flatten_venues(spark, sf):
    from poicraft.sources.readers import flatten_venues
    v = flatten_venues(B.responses(spark, sf))
    loc = F.col("location")
    return v.select("id", "name", loc["country"].alias("country"), loc["state"].alias("state"),
                    loc["city"].alias("city"), F.to_json(loc["formattedAddress"]).alias("address"),
                    loc["postalCode"].alias("postal_code"), loc["lng"].alias("lng"),
                    loc["lat"].alias("lat"))


@query("list_categories", f"select id, unnest(cat_name) as category from {VEN}")
def q_list_categories(spark, sf):
    v = ent.explode_venues(B.responses(spark, sf))
    return v.select(F.col("v.id").alias("id"), F.explode("v.categories").alias("c")) \
        .select("id", F.col("c.name").alias("category"))


@query("find_by_array_value", f"select id from {VEN} where list_contains(cat_name, 'cat2')")
def q_find_by_array_value(spark, sf):
    return find_by_array_value(B.venues(spark, sf), "cat_name", "cat2").select("id")


# ---------------------------------------------------------------- M1, M6


def venue_entities_frame(spark, sf):
    v = cat.clean_categories(B.repeated_venues(spark, sf))
    v = cat.filter_categories_colored(v, VENUE_KEYS, apply_filter=False)
    return v.select(ent.venue_entity(AS_OF).alias("entity"))


def flat_entity(e):
    val = lambda name: e[name]["value"]
    coords = val("location")["coordinates"]
    return [e["id"].alias("id"), e["type"].alias("type"),
            val("address")["addressCountry"].alias("address_country"),
            F.to_json(val("address")["addressLocality"]).alias("address_locality"),
            F.to_json(val("category")).alias("category"),
            val("dateCreated").alias("date_created"), val("description").alias("description"),
            F.get(coords, F.lit(0)).alias("lng"), F.get(coords, F.lit(1)).alias("lat"),
            val("name").alias("name"), val("url").alias("url"), venue_types(e)]


CLEAN_VEN = f"""(select *, cat_name[1] as category from ({B.KEPT_VEN_SQL})
  where len(cat_name) > 0 and coalesce("primary"[1], false))"""


def _venue_entity_sql(src: str) -> str:
    return f"""
select {S.lit(E.VENUE_ID_PREFIX)} || {S.text('id')} as id, {S.lit(E.POINT_OF_INTEREST)} as type, {S.clean('country')} as address_country,
  to_json(list_transform(formattedAddress, lambda x: {S.clean('x')})) as address_locality,
  to_json([{S.lit(E.CATEGORY_LEVEL)}, {S.clean('category')}, {S.color_for_keys('category', VENUE_KEYS)}]) as category,
  '{AS_OF_TEXT}' as date_created, {S.clean('category')} as description, lng, lat,
  {S.clean('name')} as name, {S.lit(E.NO_URL)} as url, {S.lit(VENUE_TYPES)} as types
from {src}
"""


VENUE_TYPES = "|".join([E.STRUCTURED_VALUE, E.TEXT, E.DATE_TIME, E.TEXT, E.GEO_JSON, E.POINT, E.TEXT, E.TEXT])


def venue_types(e):
    """The type labels of an entity's attributes."""
    names = ("address", "category", "dateCreated", "description", "location")
    return F.concat_ws("|", *[e[n]["type"] for n in names], e["location"]["value"]["type"],
                       e["name"]["type"], e["url"]["type"]).alias("types")


@query("venue_entities", _venue_entity_sql(CLEAN_VEN))
def q_venue_entities(spark, sf):
    return venue_entities_frame(spark, sf).select(*flat_entity(F.col("entity")))


def flat_point(f):
    p = f["properties"]
    c = f["geometry"]["coordinates"]
    return [p["name"].alias("name"), p["category"].alias("category"), p["color_cat"].alias("color_cat"),
            F.to_json(p["address"]).alias("address"), F.get(c, F.lit(0)).alias("lng"),
            F.get(c, F.lit(1)).alias("lat")]


def _points_sql(entities_sql: str) -> str:
    return f"""
select id as name, json_extract_string(category, '$[1]') as category,
  json_extract_string(category, '$[2]') as color_cat, address_locality as address, lng, lat
from ({entities_sql})
"""


@query("entity_points", _points_sql(_venue_entity_sql(CLEAN_VEN)))
def q_entity_points(spark, sf):
    pts = feat.entity_points(venue_entities_frame(spark, sf))
    return pts.select(*flat_point(F.col("feature")))


# ---------------------------------------------------------------- M2, M3


def _response_sql(extra_cols: str = "", join: str = "") -> str:
    aux = f"case when len(cat_name) > 0 then {S.clean('cat_name[1]')} else {S.clean('name')} end"
    return f"""
select {S.lit(E.VENUE_ID_PREFIX)} || {S.text('v.id')} as id, {S.lit(E.POINT_OF_INTEREST)} as type, {S.clean('state')} as address_country,
  {S.clean('city')} as address_locality, to_json([{S.lit(E.CATEGORY_LEVEL)}, {aux}]) as category,
  '{AS_OF_TEXT}' as date_created, {aux} as description, lng, lat, {S.clean('name')} as name, {S.lit(VENUE_TYPES)} as types{extra_cols}
from {VEN} v {join}
"""


def flat_response(e, with_photo: bool):
    val = lambda name: e[name]["value"]
    coords = val("location")["coordinates"]
    cols = [e["id"].alias("id"), e["type"].alias("type"),
            val("address")["addressCountry"].alias("address_country"),
            val("address")["addressLocality"].alias("address_locality"),
            F.to_json(val("category")).alias("category"), val("dateCreated").alias("date_created"),
            val("description").alias("description"), F.get(coords, F.lit(0)).alias("lng"),
            F.get(coords, F.lit(1)).alias("lat"), val("name").alias("name"), val("url").alias("url"),
            venue_types(e)]
    if with_photo:
        cols.append(val("photo_url").alias("photo_status"))
    return cols


@query("response_entities", _response_sql(f", {S.lit(E.NO_URL)} as url"))
def q_response_entities(spark, sf):
    return ent.response_entities(B.responses(spark, sf), AS_OF) \
        .select(*flat_response(F.col("entity"), False))


@query("photo_entities", _response_sql(
    f", case when p.venue_id is null then {S.lit(NO_PHOTO)} when p.first_url is null"
    f" then {S.lit(NO_PHOTO_ITEMS)} else p.first_url end as url"
    ", p.status as photo_status",
    f"left join ({B.PHOTO_SQL}) p on v.id = p.venue_id"))
def q_photo_entities(spark, sf):
    return ent.photo_entities(B.responses(spark, sf), B.photos(spark, sf), AS_OF) \
        .select(*flat_response(F.col("entity"), True))


# ---------------------------------------------------------------- M4, K9, K8


def establishment_entities_frame(spark, sf):
    e = est_categories(spark, sf).withColumn("reduct_cat_name", reduce_name("category"))
    return e.select(F.col("id").cast("bigint").alias("_key"),
                    ent.establishment_entity(RETAIL_CATEGORY, RETAIL_KIND).alias("entity"))


def est_entity_struct_sql(mapping=None) -> str:
    from poicraft.functions.names import CATEGORY_SHORT_NAMES
    mapping = CATEGORY_SHORT_NAMES if mapping is None else mapping
    c = S.clean
    street = (f"{c('nom_vial')} || {S.lit(E.STREET_NUMBER_SEP)} || {c('numero_ext')} || {S.lit(E.STREET_PART_SEP)} || {c('tipo_asent')} || ', ' "
              f"|| {c('nomb_asent')}")
    return f"""{{'id': {S.lit(E.ESTABLISHMENT_ID_PREFIX)} || {S.text('id')}, 'type': '{RETAIL_KIND}',
  'address': {{'type': {S.lit(E.STRUCTURED_VALUE)}, 'value': {{'addressCountry': {c('entidad')},
     'addressRegion': {c('municipio')}, 'postalCode': {c('cod_postal')}, 'streetAddress': {street}}}}},
  'category': {{'type': {S.lit(E.TEXT)}, 'value': '{RETAIL_CATEGORY}'}},
  'subCategory': {{'type': {S.lit(E.TEXT)}, 'value': {c(reduce_sql('category', mapping))}}},
  'dateCreated': {{'type': {S.lit(E.DATE_TIME)}, 'value': {S.text('fecha_alta')} || {S.lit(MONTH_SUFFIX)}}},
  'description': {{'type': {S.lit(E.TEXT)}, 'value': {c('nombre_act')}}},
  'location': {{'type': {S.lit(E.GEO_JSON)}, 'value': {{'type': {S.lit(E.POINT)}, 'coordinates': {S.coords('longitud', 'latitud')}}}}},
  'name': {{'type': {S.lit(E.TEXT)}, 'value': {c('nom_estab')}}},
  'alternateName': {{'type': {S.lit(E.TEXT)}, 'value': {c('raz_social')}}},
  'dataProvider': {{'type': {S.lit(E.TEXT)}, 'value': www}},
  'economyUnit': {{'type': {S.lit(E.TEXT)}, 'value': {c('tipoUniEco')}}}}}"""


EST_ENTITIES_SQL = f"select cast(id as bigint) as k, {est_entity_struct_sql()} as entity from ({EST_CAT})"


@query("establishment_entities", f"""
select entity.id as id, entity.type as type, entity.address.value.addressCountry as address_country,
  entity.address.value.addressRegion as address_region, entity.address.value.postalCode as postal_code,
  entity.address.value.streetAddress as street_address, entity.category.value as category,
  entity.subCategory.value as sub_category, entity.dateCreated.value as date_created,
  entity.description.value as description,
  cast(len(entity.location.value.coordinates) as int) as n_coords,
  entity.location.value.coordinates[1] as lng, entity.location.value.coordinates[2] as lat,
  entity.name.value as name, entity.alternateName.value as alternate_name,
  entity.dataProvider.value as data_provider, entity.economyUnit.value as economy_unit
from ({EST_ENTITIES_SQL})
""")
def q_establishment_entities(spark, sf):
    e = F.col("entity")
    val = lambda name: e[name]["value"]
    coords = val("location")["coordinates"]
    a = val("address")
    return establishment_entities_frame(spark, sf).select(
        e["id"].alias("id"), e["type"].alias("type"), a["addressCountry"].alias("address_country"),
        a["addressRegion"].alias("address_region"), a["postalCode"].alias("postal_code"),
        a["streetAddress"].alias("street_address"), val("category").alias("category"),
        val("subCategory").alias("sub_category"), val("dateCreated").alias("date_created"),
        val("description").alias("description"), F.size(coords).alias("n_coords"),
        F.get(coords, F.lit(0)).alias("lng"), F.get(coords, F.lit(1)).alias("lat"),
        val("name").alias("name"), val("alternateName").alias("alternate_name"),
        val("dataProvider").alias("data_provider"), val("economyUnit").alias("economy_unit"))


@query("entity_payloads", f"select entity.id as id, to_json(entity) as payload from ({EST_ENTITIES_SQL})")
def q_entity_payloads(spark, sf):
    return ent.entity_payloads(establishment_entities_frame(spark, sf))


@query("entity_batches", f"""
with i as (select (row_number() over (order by k) - 1) // {BATCH_ENTITIES} as b, k, entity from ({EST_ENTITIES_SQL}))
select cast(b as bigint) as batch_id, count(*) as n,
  to_json({{'actionType': {S.lit(E.APPEND)}, 'entities': list(entity order by k)}}) as payload
from i group by b
""")
def q_entity_batches(spark, sf):
    return ent.entity_batches(establishment_entities_frame(spark, sf), ["_key"], BATCH_ENTITIES)


# ---------------------------------------------------------------- M5


def establishment_features_frame(spark, sf, rows=None):
    rows = est_categories(spark, sf) if rows is None else rows
    colored, _ = cat.group_by_categories_colored(rows, LEGEND_N)
    return colored.select("id", feat.establishment_feature().alias("feature"))


def est_feature_sql(src: str, top_sql: str) -> str:
    c = S.clean
    return f"""
select id, to_json({{'type': {S.lit(FT.FEATURE)}, 'properties': {{'id': {c('id')}, 'nom_estab': {c('nom_estab')},
    'raz_social': {c('raz_social')}, 'nombre_act': {c('nombre_act')}, 'categoria': {c('category')},
    'color_cat': case when category in (select category from ({top_sql}) where category <> 'Other')
                      then {S.color('category')} else '#A4A4A4' end,
    'direccion': [{S.lit(FT.STREET_LABEL)} || {c('nom_vial')} || ' ' || {c('numero_ext')},
                  {S.lit(FT.BETWEEN_LABEL)} || {c('nom_v_e_1')} || {S.lit(FT.BETWEEN_AND)} || {c('nom_v_e_2')},
                  {c('tipo_asent')} || {S.lit(FT.SETTLEMENT_SEP)} || {c('nomb_asent')}, {S.lit(FT.POSTAL_LABEL)} || {c('cod_postal')},
                  {S.lit(FT.MUNICIPALITY_LABEL)} || {c('municipio')}, {S.lit(FT.ENTITY_LABEL)} || {c('entidad')}],
    'sitio_web': {c('www')}, 'fecha_alta': {c('fecha_alta')}}},
  'geometry': {{'type': {S.lit(E.POINT)}, 'coordinates': {S.coords('longitud', 'latitud')}}}}}) as feature
from ({src})
"""


EST_FEATURES_SQL = est_feature_sql(
    EST_CAT, top_n_sql(f"select category, count(*) as n from ({EST_CAT}) group by category", LEGEND_N))


@query("establishment_features", EST_FEATURES_SQL)
def q_establishment_features(spark, sf):
    f = establishment_features_frame(spark, sf)
    return f.select("id", F.to_json("feature", ent.JSON_OPTIONS).alias("feature"))
