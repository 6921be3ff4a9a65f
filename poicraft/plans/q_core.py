"""Filters, categories, colours, counts, shares, indexes and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from poicraft.functions.predicates import first_line
from poicraft.functions import (address_keyword_pred, any_keyword_pred, clean_chars,
                                clean_chars_array, color_for_keys, geojson_coords,
                                planar_distance, reduce_name, search_date, street_entity_pred,
                                strict_coords)
from poicraft.operators import audit, categories as cat, dedup, enrich, index, keywords as kw, shares
from poicraft.plans import bindings as B
from poicraft.plans import sqlfrag as S
from poicraft.plans.params import (ADDRESS_KEYWORDS, ANY_KEYWORDS, BLANK_STREET_KEYWORDS,
                                   BRANDS, COLORED_N, NAME_MAP, SLICE_N, STREET_KEYWORDS, TAIL_FROM, TOP_N)
from poicraft.plans.registry import comparable, query

t = B.table
VEN = f"({B.VEN_SQL})"
EST = f"({B.EST_SQL})"

# ---------------------------------------------------------------- predicates F1–F4


@query("address_keyword_filter", f"""
select doc_id from documents
where split_part(text, chr(10), 1) is not null
  and not contains(split_part(text, chr(10), 1), lang)
  and {' and '.join(S.icontains("split_part(text, chr(10), 1)", k) for k in ADDRESS_KEYWORDS)}
""")
def q_address_keyword_filter(spark, d):
    docs = t(spark, d, "documents")
    # F1 tests the first address line only (its definition). Locating the first
    # newline gives the same line as splitting the whole text into lines, without
    # decoding and re-encoding every other line; no text is cut before the test.
    pred = address_keyword_pred(None, "lang", ADDRESS_KEYWORDS, line=first_line("text"))
    return docs.filter(pred).select("doc_id")


@query("street_entity_filter", f"""
select p_partkey, p_name, p_type from part
where {S.icontains('p_name', STREET_KEYWORDS[0])} and {S.icontains('p_type', STREET_KEYWORDS[1])}
""")
def q_street_entity_filter(spark, d):
    p = t(spark, d, "part")
    return p.filter(street_entity_pred("p_name", "p_type", STREET_KEYWORDS)) \
        .select("p_partkey", "p_name", "p_type")


@query("street_entity_filter_blank", "select p_partkey from part")
def q_street_entity_filter_blank(spark, d):
    p = t(spark, d, "part")
    pred = street_entity_pred("p_name", "p_type", BLANK_STREET_KEYWORDS, entity_mode="reference")
    return p.filter(pred).select("p_partkey")


@query("any_keyword_filter", f"""
select p_partkey from part
where {' or '.join(S.icontains(c, k) for k in ANY_KEYWORDS for c in ('p_name', 'p_type'))}
""")
def q_any_keyword_filter(spark, d):
    return t(spark, d, "part").filter(any_keyword_pred(["p_name", "p_type"], ANY_KEYWORDS)) \
        .select("p_partkey")


# Keywords from the tables: padded order numbers, and two letters of the parts' types.
KEYWORDS_SQL = """
select '#' || lpad(cast(o_orderkey * 7 as varchar), 9, '0') as keyword from orders
union all select substr(p_type, 2, 2) from part
"""


def order_keywords(spark, d):
    orders, part = t(spark, d, "orders"), t(spark, d, "part")
    padded = F.concat(F.lit("#"), F.lpad((F.col("o_orderkey") * 7).cast("string"), 9, "0"))
    return orders.select(padded.alias("keyword")).unionByName(part.select(F.substring("p_type", 2, 2).alias("keyword")))


@query("any_keyword_table", f"""
select c_custkey, c_name from customer
where exists (select 1 from ({KEYWORDS_SQL}) k
              where contains(lower({S.text('c_name')}), lower(k.keyword)) or contains(lower({S.text('c_mktsegment')}), lower(k.keyword)))
""")
def q_any_keyword_table(spark, d):
    """F3 with a keyword per order (15,000 at sf0.01)."""
    customers = t(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return kw.any_keyword_rows(customers, ["c_name", "c_mktsegment"], order_keywords(spark, d), key=["c_custkey"]).select("c_custkey", "c_name")


_WORDS = "select string_split(p_name, ' ')[2] as keyword, 'w' || min(p_partkey) as value, min(p_partkey) as rank from part group by 1"


@query("reduce_category_table", f"""
select p_partkey, p_name, coalesce((select arg_min(value, rank) from ({_WORDS}) w where contains({S.text('p_name')}, w.keyword)), {S.text('p_name')}) as reduct_cat_name
from part
""")
def q_reduce_category_table(spark, d):
    """P5 with a mapping table: every second word of the names, in order of first use."""
    p = t(spark, d, "part").select("p_partkey", "p_name")
    word = F.get(F.split("p_name", " "), F.lit(1))
    mapping = p.groupBy(word.alias("keyword")).agg(F.min("p_partkey").alias("rank"))
    mapping = mapping.withColumn("value", F.concat(F.lit("w"), F.col("rank").cast("string")))
    return kw.reduce_name_by_table(p, "p_name", mapping, "reduct_cat_name", key=["p_partkey"])


_BRANDS_IN = ", ".join(S.lit(b) for b in BRANDS)


@query("category_filter", f"select p_partkey, p_brand from part where p_brand in ({_BRANDS_IN})")
def q_category_filter(spark, d):
    return cat.category_filter(t(spark, d, "part"), BRANDS, "p_brand").select("p_partkey", "p_brand")


# ---------------------------------------------------------------- categories and colours


@query("clean_categories", f"""
select id, cat_name[1] as category from ({B.KEPT_VEN_SQL})
where len(cat_name) > 0 and coalesce("primary"[1], false)
""")
def q_clean_categories(spark, d):
    # only the columns the result needs enter the dedup (whole rows would drag the text along)
    venues = B.repeated_venues(spark, d).select("id", "cat_name", "primary", "name")
    return cat.clean_categories(venues).select("id", "category")


@query("color_categories", f"""
select p_partkey, p_brand, {S.color_for_keys('p_brand', BRANDS)} as color_cat from part
""")
def q_color_categories(spark, d):
    p = t(spark, d, "part")
    return p.select("p_partkey", "p_brand", color_for_keys("p_brand", keys=BRANDS).alias("color_cat"))


@query("palette", f"""
select category, {S.color('category')} as color
from (select distinct p_brand as category from part where p_brand is not null and p_brand <> 'Other')
union all select 'Other', '#A4A4A4'
""")
def q_palette(spark, d):
    return cat.palette(t(spark, d, "part"), "p_brand")


def reduce_sql(x: str, mapping) -> str:
    whens = " ".join(f"when contains({S.text(x)}, {S.lit(k)}) then {S.lit(v)}" for k, v in mapping.items())
    return f"case {whens} else {S.text(x)} end"


@query("reduce_category", f"""
select p_partkey, p_name, {reduce_sql('p_name', NAME_MAP)} as reduct_cat_name from part
""")
def q_reduce_category(spark, d):
    p = t(spark, d, "part")
    return p.select("p_partkey", "p_name", reduce_name("p_name", NAME_MAP).alias("reduct_cat_name"))


@query("category_count", "select p_brand as category, count(*) as n from part group by p_brand")
def q_category_count(spark, d):
    return cat.category_count(t(spark, d, "part"), "p_brand", ordered=True)


@query("category_count_filtered", f"""
select p_brand as category, count(*) as n from part where p_brand in ({_BRANDS_IN}) group by p_brand
""")
def q_category_count_filtered(spark, d):
    return cat.category_count_filtered(t(spark, d, "part"), BRANDS, "p_brand")


def top_n_sql(counts_sql: str, n: int) -> str:
    """(rank, category, n) of the first n categories + Other, from a (category, n) query."""
    return f"""
with c as ({counts_sql}),
t as (select category, n, row_number() over (order by n desc, category) as rk
      from c where category is not null and category <> 'Other' qualify rk <= {n})
select cast(rk as bigint) as rank, category, cast(n as bigint) as n from t
union all
select cast({n + 1} as bigint), 'Other', cast(coalesce(sum(c.n), 0) as bigint)
from c where not exists (select 1 from t where t.category = c.category)
"""


def legend_sql(top_sql: str) -> str:
    return f"""
select rank, category || '[' || cast(n as varchar) || ']' as label,
  case when category = 'Other' then '#A4A4A4' else {S.color('category')} end as color
from ({top_sql})
"""


PART_COUNTS = "select p_brand as category, count(*) as n from part group by p_brand"


@query("top_n_other", top_n_sql(PART_COUNTS, TOP_N))
def q_top_n_other(spark, d):
    return cat.top_n_other(cat.category_count(t(spark, d, "part"), "p_brand"), TOP_N)


@query("legend", legend_sql(top_n_sql(PART_COUNTS, TOP_N)))
def q_legend(spark, d):
    return cat.legend(q_top_n_other(spark, d))


def est_categories(spark, d):
    """Establishments with their activity name as ``category`` (J2 on the nation catalogue)."""
    return enrich.catalog_match(B.establishments(spark, d), B.activity_catalog(spark, d))


EST_CAT = f"""
select e.*, c.actividad as category from {EST} e
left join ({B.CATALOG_SQL}) c on try_cast(e.codigo_act as bigint) = try_cast(c.id_act as bigint)
"""
EST_COUNTS = f"select category, count(*) as n from ({EST_CAT}) group by category"


def abbreviate_sql(legend: str) -> str:
    from poicraft.functions.names import LEGEND_ABBREVIATIONS
    whens = " ".join(f"when contains(label, {S.lit(k)}) then replace(label, {S.lit(k)}, {S.lit(v)})"
                     for k, v in LEGEND_ABBREVIATIONS.items())
    return f"""
select max(rank) as rank, lbl as label, arg_max(color, rank) as color
from (select rank, case {whens} else label end as lbl, color from ({legend}))
group by lbl
"""


@query("abbreviate_legend", abbreviate_sql(legend_sql(top_n_sql(EST_COUNTS, TOP_N))))
def q_abbreviate_legend(spark, d):
    counts = cat.category_count(est_categories(spark, d))
    return cat.abbreviate_legend(cat.legend(cat.top_n_other(counts, TOP_N)))


@query("group_by_categories_colored", f"""
with f as (select * from part where p_brand in ({_BRANDS_IN})),
top as (select category from ({top_n_sql("select p_brand as category, count(*) as n from f group by p_brand", COLORED_N)})
        where category <> 'Other')
select p_partkey, p_brand,
  case when p_brand in (select category from top) then {S.color('p_brand')} else '#A4A4A4' end as color_cat
from f
""")
def q_group_by_categories_colored(spark, d):
    rows, _ = cat.group_by_categories_colored(t(spark, d, "part"), COLORED_N, BRANDS, "p_brand")
    return rows.select("p_partkey", "p_brand", "color_cat")


@query("filter_categories_colored", f"""
select p_partkey, p_brand, {S.color_for_keys('p_brand', BRANDS)} as color_cat
from part where p_brand in ({_BRANDS_IN})
""")
def q_filter_categories_colored(spark, d):
    rows = cat.filter_categories_colored(t(spark, d, "part"), BRANDS, True, "p_brand")
    return rows.select("p_partkey", "p_brand", "color_cat")


# ---------------------------------------------------------------- joins J1–J3


@query("catalog_match", """
select d.doc_id, l.category
from documents d left join (select doc_id, 'quality_' || cast(quality as varchar) as category
                            from labels) l on d.doc_id = l.doc_id
""")
def q_catalog_match(spark, d):
    docs = t(spark, d, "documents").select("doc_id")
    catalog = t(spark, d, "labels").select(
        F.col("doc_id").alias("id_act"),
        F.concat(F.lit("quality_"), F.col("quality").cast("string")).alias("actividad"))
    return enrich.catalog_match(docs, catalog, code_col="doc_id")


@query("postal_enrich", f"""
select v.id, p.D_mnpio as municipio, p.d_tipo_asenta
from {VEN} v join ({B.POSTAL_SQL}) p on try_cast(v.postalCode as bigint) = try_cast(p.d_codigo as bigint)
""")
def q_postal_enrich(spark, d):
    out = enrich.postal_enrich(B.venues(spark, d), B.postal_catalog(spark, d))
    return out.select("id", "municipio", "d_tipo_asenta")


@query("photo_enrich", f"""
select c.c_custkey, case when p.venue_id is null then {S.lit(enrich.NO_PHOTO)}
                         when p.first_url is null then {S.lit(enrich.NO_PHOTO_ITEMS)}
                         else p.first_url end as url, p.status as photo_status
from customer c left join ({B.PHOTO_SQL}) p on cast(c.c_custkey as varchar) = p.venue_id
""")
def q_photo_enrich(spark, d):
    c = t(spark, d, "customer").select("c_custkey")
    return enrich.photo_enrich(c, B.photos(spark, d), id_col="c_custkey")


# ---------------------------------------------------------------- aggregates, shares, index


@query("municipality_count", "select o_orderstatus as municipio, count(*) as n from orders group by 1")
def q_municipality_count(spark, d):
    return shares.municipality_count(t(spark, d, "orders"), "o_orderstatus")


SHARE_SQL = """
with c as (select {g} as municipio, {c} as category, count(*) as n from {src} group by 1, 2)
select municipio, category, n,
  cast(row_number() over (partition by municipio order by n desc, category) - 1 as bigint) as idx,
  100.0::double * n / sum(n) over (partition by municipio) as share,
  cast(row_number() over (partition by municipio order by n desc, category) - 1 as bigint)
    * 0.008::double as "offset"
from c
"""


@query("category_share", SHARE_SQL.format(g="o_orderstatus", c="o_orderpriority", src="orders"))
def q_category_share(spark, d):
    return shares.category_share(t(spark, d, "orders"), "o_orderstatus", "o_orderpriority")


@query("row_index", """
select o_orderkey, cast(row_number() over (order by o_orderkey) - 1 as bigint) as idx from orders
""")
def q_row_index(spark, d):
    return index.row_index(t(spark, d, "orders").select("o_orderkey"), ["o_orderkey"])


@query("dedupe_by_key", """
select event_id, ts, user_id, event_type, value, props from events
qualify row_number() over (partition by user_id order by event_id) = 1
""")
def q_dedupe_by_key(spark, d):
    return dedup.dedupe_by_key(t(spark, d, "events"), ["user_id"], ["event_id"])


_ORDER_COLS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority"


@query("take_slice", f"select {_ORDER_COLS} from orders order by o_orderkey limit {SLICE_N}")
def q_take_slice(spark, d):
    o = t(spark, d, "orders").select(*_ORDER_COLS.split(", "))
    return index.take_slice(o, ["o_orderkey"], SLICE_N)


@query("take_tail", f"""
select * from (select {_ORDER_COLS}, cast(row_number() over (order by o_orderkey) - 1 as bigint) as idx
               from orders) where idx >= {TAIL_FROM}
""")
def q_take_tail(spark, d):
    o = t(spark, d, "orders").select(*_ORDER_COLS.split(", "))
    return index.take_tail(o, ["o_orderkey"], TAIL_FROM)


@query("column_profile", """
select count(*) as n_rows, count(d.doc_id) as nn_doc_id, count(text) as nn_text, count(lang) as nn_lang,
  count(source) as nn_source, count(n_chars) as nn_n_chars, count(quality) as nn_quality,
  count(toxic) as nn_toxic, cast(7 as bigint) as n_columns
from documents d left join labels l on d.doc_id = l.doc_id
""")
def q_column_profile(spark, d):
    docs = t(spark, d, "documents")
    lb = t(spark, d, "labels")
    return audit.column_profile(docs.join(lb, "doc_id", "left"))


# ---------------------------------------------------------------- scalar functions X1–X6


@query("clean_text", f"select page_id, {S.clean('html')} as html_clean from pages")
def q_clean_text(spark, d):
    return t(spark, d, "pages").select("page_id", clean_chars("html").alias("html_clean"))


@query("clean_text_array", f"""
select doc_id, cast(len(string_split(text, chr(10))) as int) as n_lines,
  to_json(list_transform(string_split(text, chr(10)), lambda x: {S.clean('x')})) as lines_clean
from documents
""")
def q_clean_text_array(spark, d):
    lines = F.split(F.col("text"), "\n")
    return comparable(t(spark, d, "documents").select(
        "doc_id", F.size(lines).alias("n_lines"), clean_chars_array(lines).alias("lines_clean")))


def _coords_out(c):
    return [F.size(c).alias("n_coords"), F.get(c, F.lit(0)).alias("lng"), F.get(c, F.lit(1)).alias("lat")]


@query("parse_coords", f"""
select id, cast(len(c) as int) as n_coords, c[1] as lng, c[2] as lat
from (select id, {S.coords('longitud', 'latitud')} as c from {EST})
""")
def q_parse_coords(spark, d):
    c = geojson_coords("longitud", "latitud")
    return B.establishments(spark, d).select("id", *_coords_out(c))


STRICT = r"^[0-9]+\.[0-9]+$"


def _strict_ok(x: str) -> str:
    return (f"coalesce(regexp_matches(replace({x}, '-', ''), {S.lit(STRICT)}) "
            f"and try_cast({x} as double) is not null, false)")


@query("parse_coords_strict", f"""
select id, cast(len(c) as int) as n_coords, c[1] as lng, c[2] as lat
from (select id, case when {_strict_ok('longitud')} and {_strict_ok('latitud')}
                      then [try_cast(longitud as double), try_cast(latitud as double)]
                      else []::double[] end as c from {EST})
""")
def q_parse_coords_strict(spark, d):
    c = strict_coords("longitud", "latitud")
    return B.establishments(spark, d).select("id", *_coords_out(c))


@query("search_date", """
select o_orderkey, strftime(cast(o_orderdate as date) - 2, '%Y%m%d') as search_date from orders
""")
def q_search_date(spark, d):
    return t(spark, d, "orders").select("o_orderkey", search_date("o_orderdate").alias("search_date"))


@query("planar_distance", f"""
select id, sqrt((lat - 0.0::double) * (lat - 0.0::double) + (lng - 0.0::double) * (lng - 0.0::double)) as dist
from ({B.POINTS_SQL})
""")
def q_planar_distance(spark, d):
    p = B.points(spark, d)
    return p.select("id", planar_distance("lat", "lng", F.lit(0.0), F.lit(0.0)).alias("dist"))
