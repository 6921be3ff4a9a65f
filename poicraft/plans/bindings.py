"""Adapters from the benchmark tables to the places data model.

The benchmark ships TPC-H-like tables, not venue or establishment feeds. Each
function here derives a frame of the expected schema from those tables (row by
row, or with lookup joins), so every query's work grows with the input. The
matching DuckDB SQL lives next to it for the oracle check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from poicraft.operators.dedup import dedupe_by_key
from poicraft.sources.readers import project_venues


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _zero5(c) -> F.Column:
    return F.format_string("%05d", F.col(c))


# --- establishments: customer ⋈ nation ⋈ region -------------------------------------

def establishments(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    j = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    seg = F.col("c_mktsegment")
    return j.select(
        F.col("c_custkey").cast("string").alias("id"),
        F.col("c_name").alias("nom_estab"),
        seg.alias("raz_social"),
        F.col("r_name").alias("nombre_act"),
        F.col("c_nationkey").cast("string").alias("codigo_act"),
        F.col("c_name").alias("nom_vial"),
        F.col("n_name").alias("nom_v_e_1"),
        F.col("r_name").alias("nom_v_e_2"),
        seg.alias("nom_v_e_3"),
        F.col("c_custkey").cast("string").alias("numero_ext"),
        seg.alias("tipo_asent"),
        F.col("n_name").alias("nomb_asent"),
        _zero5("c_custkey").alias("cod_postal"),
        F.col("n_name").alias("entidad"),
        F.col("r_name").alias("municipio"),
        F.col("r_name").alias("localidad"),
        F.when(seg == "BUILDING", F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("www.example.com/?seg="), F.lower(seg))).alias("www"),
        seg.alias("tipoUniEco"),
        F.concat(F.lit("19."), F.format_string("%02d", F.col("c_nationkey"))).alias("latitud"),
        F.when(F.col("c_acctbal") < 0, F.lit("S/N"))
         .otherwise(F.col("c_acctbal").cast("string")).alias("longitud"),
        F.concat((F.col("c_nationkey") + 2000).cast("string"), F.lit("-07")).alias("fecha_alta"),
    )


EST_SQL = """
select cast(c.c_custkey as varchar) as id, c.c_name as nom_estab, c.c_mktsegment as raz_social,
  r.r_name as nombre_act, cast(c.c_nationkey as varchar) as codigo_act, c.c_name as nom_vial,
  n.n_name as nom_v_e_1, r.r_name as nom_v_e_2, c.c_mktsegment as nom_v_e_3,
  cast(c.c_custkey as varchar) as numero_ext, c.c_mktsegment as tipo_asent, n.n_name as nomb_asent,
  printf('%05d', c.c_custkey) as cod_postal, n.n_name as entidad, r.r_name as municipio,
  r.r_name as localidad,
  case when c.c_mktsegment = 'BUILDING' then null
       else 'www.example.com/?seg=' || lower(c.c_mktsegment) end as www,
  c.c_mktsegment as tipoUniEco, '19.' || printf('%02d', c.c_nationkey) as latitud,
  case when c.c_acctbal < 0 then 'S/N' else cast(c.c_acctbal as varchar) end as longitud,
  cast(c.c_nationkey + 2000 as varchar) || '-07' as fecha_alta
from customer c join nation n on c.c_nationkey = n.n_nationkey
  join region r on n.n_regionkey = r.r_regionkey
"""


def repeated_establishments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every establishment twice under its id, the second time with the next activity
    code and another street name: what the dedup (A8) meets in real exports."""
    e = establishments(spark, sf_dir)
    code = F.pmod(F.col("codigo_act").cast("int") + 1, F.lit(25)).cast("string")
    return e.unionByName(e.withColumn("codigo_act", code).withColumn("nom_vial", F.concat("nom_vial", F.lit(" bis"))))


REPEATED_EST_SQL = f"""
select * from ({EST_SQL}) union all
select * replace (cast((cast(codigo_act as int) + 1) % 25 as varchar) as codigo_act, nom_vial || ' bis' as nom_vial) from ({EST_SQL})
"""
# The survivors of the dedup by id, smallest by the flows' order.
KEPT_EST_SQL = f"""
select * from ({REPEATED_EST_SQL})
qualify row_number() over (partition by id order by codigo_act, nom_vial, entidad) = 1
"""


def activity_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id_act, actividad)`` from nation: the code is the nation key."""
    n = table(spark, sf_dir, "nation")
    return n.select(F.col("n_nationkey").cast("string").alias("id_act"),
                    F.concat(F.lit("Comercio al por menor de "), F.col("n_name")).alias("actividad"))


CATALOG_SQL = """
select cast(n_nationkey as varchar) as id_act, 'Comercio al por menor de ' || n_name as actividad
from nation
"""


def postal_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(d_codigo, D_mnpio, d_tipo_asenta)`` from labels (covers some documents)."""
    lb = table(spark, sf_dir, "labels")
    return lb.select(F.col("doc_id").cast("string").alias("d_codigo"),
                     F.concat(F.lit("Q"), F.col("quality").cast("string")).alias("D_mnpio"),
                     F.concat(F.lit("T"), F.col("toxic").cast("string")).alias("d_tipo_asenta"))


POSTAL_SQL = """
select cast(doc_id as varchar) as d_codigo, 'Q' || cast(quality as varchar) as D_mnpio,
  'T' || cast(toxic as varchar) as d_tipo_asenta
from labels
"""


# --- venues: documents ⟕ embeddings, as nested venue documents ------------------------

def venue_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested venue documents (``VENUE_SCHEMA``): one per document.

    Documents with an embedding get two categories (``cat<label>`` whose primary
    flag is the sign of the first dimension, then the source); the others get
    none. Address lines are the text lines, in French documents behind the postal
    code; coordinates are the first two embedding dimensions.
    """
    d = table(spark, sf_dir, "documents")
    e = table(spark, sf_dir, "embeddings")
    j = d.join(e, d.doc_id == e.vec_id, "left")
    e0 = F.get(F.col("embedding"), F.lit(0)).cast("double")
    e1 = F.get(F.col("embedding"), F.lit(1)).cast("double")
    has = F.col("vec_id").isNotNull()
    cats = F.array(
        F.struct(F.col("label").cast("string").alias("id"),
                 F.concat(F.lit("cat"), F.col("label").cast("string")).alias("name"),
                 (e0 >= 0).alias("primary")),
        F.struct(F.col("source").alias("id"), F.col("source").alias("name"),
                 F.lit(True).alias("primary")))
    empty = F.array().cast("array<struct<id:string,name:string,primary:boolean>>")
    return j.select(
        F.col("doc_id").cast("string").alias("id"),
        F.col("source").alias("name"),
        F.when(has, cats).otherwise(empty).alias("categories"),
        F.struct(F.col("lang").alias("country"), F.col("source").alias("state"),
                 F.col("lang").alias("city"),
                 F.split(F.when(F.col("lang") == "fr", F.concat(_zero5("doc_id"), F.lit(" "), "text"))
                         .otherwise(F.col("text")), "\n").alias("formattedAddress"),
                 _zero5("doc_id").alias("postalCode"),
                 e0.alias("lng"), e1.alias("lat")).alias("location"),
    )


def venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat 11-column venue table (S4 projection of the documents)."""
    return project_venues(venue_documents(spark, sf_dir))


def repeated_venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every venue twice under its id, the second time with a name that sorts first."""
    v = venues(spark, sf_dir)
    return v.unionByName(v.withColumn("name", F.concat(F.lit("#"), "name")))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw API-style responses ``{response: {venues: [...]}}``: the venues of three neighbouring ids."""
    docs = venue_documents(spark, sf_dir)
    page = F.floor(F.col("id").cast("bigint") / 3)
    grouped = docs.groupBy(page.alias("page")).agg(F.collect_list(F.struct(*docs.columns)).alias("venues"))
    return grouped.select(F.struct("venues").alias("response"))


VEN_SQL = """
select
  case when e.vec_id is null then []::boolean[]
       else [cast(e.embedding[1] as double) >= 0, true] end as "primary",
  cast(d.doc_id as varchar) as id, d.source as name,
  case when e.vec_id is null then []::varchar[]
       else ['cat' || cast(e.label as varchar), d.source] end as cat_name,
  case when e.vec_id is null then []::varchar[]
       else [cast(e.label as varchar), d.source] end as cat_id,
  d.lang as country, d.source as state, d.lang as city,
  string_split(case when d.lang = 'fr' then printf('%05d', d.doc_id) || ' ' || d.text else d.text end, chr(10)) as formattedAddress,
  printf('%05d', d.doc_id) as postalCode,
  cast(e.embedding[1] as double) as lng, cast(e.embedding[2] as double) as lat
from documents d left join embeddings e on e.vec_id = d.doc_id
"""


REPEATED_VEN_SQL = f"select * from ({VEN_SQL}) union all select * replace ('#' || name as name) from ({VEN_SQL})"
# The survivors of the dedup by id: of rows that agree in all else, the smallest name.
KEPT_VEN_SQL = f"select * from ({REPEATED_VEN_SQL}) qualify row_number() over (partition by id order by name) = 1"


# --- photos: the first order of each customer ----------------------------------------

def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photo records keyed by venue id (customer key): the customer's first order by
    key; an urgent order carries one photo item, any other none, and a low-priority
    order leaves the customer without a record."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    first = dedupe_by_key(o, ["o_custkey"], ["o_orderkey"])
    item = F.struct(F.lit("https://img.example/").alias("prefix"),
                    F.lit("/original.jpg").alias("suffix"),
                    F.struct(F.col("o_orderkey").cast("string").alias("id")).alias("user"))
    empty = F.array().cast("array<struct<prefix:string,suffix:string,user:struct<id:string>>>")
    return first.filter("o_orderpriority <> '5-LOW'").select(
        F.col("o_custkey").cast("string").alias("venue_id"),
        F.lit(200).alias("status"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.array(item)).otherwise(empty).alias("items"))


PHOTO_SQL = """
select cast(o_custkey as varchar) as venue_id, 200 as status,
  case when o_orderpriority = '1-URGENT'
       then 'https://img.example/' || cast(o_orderkey as varchar) || '/original.jpg' end as first_url
from (select *, row_number() over (partition by o_custkey order by o_orderkey) as rn from orders)
where rn = 1 and o_orderpriority <> '5-LOW'
"""


# --- points: embeddings as located, labelled venues ----------------------------------

def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("id"),
        F.concat(F.lit("vec"), F.col("label").cast("string")).alias("name"),
        F.array(F.col("label").cast("string")).alias("cat_id"),
        F.get(F.col("embedding"), F.lit(0)).cast("double").alias("lng"),
        F.get(F.col("embedding"), F.lit(1)).cast("double").alias("lat"),
    )


POINTS_SQL = """
select vec_id as id, 'vec' || cast(label as varchar) as name, [cast(label as varchar)] as cat_id,
  cast(embedding[1] as double) as lng, cast(embedding[2] as double) as lat
from embeddings
"""
