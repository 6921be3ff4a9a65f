"""End-to-end compositions E1–E5 (E6 is ``mesh_sweep``).

Each ``*_flow`` function is the reusable pipeline over caller-supplied frames;
the registered ``pipe_*`` queries bind it to the benchmark tables.
"""

from __future__ import annotations

from typing import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poicraft.functions import address_keyword_pred, any_keyword_pred, reduce_name, street_entity_pred
from poicraft.operators import categories as cat, dedup, enrich, entities as ent, features as feat
from poicraft.operators import shares
from poicraft.plans import bindings as B
from poicraft.plans import sqlfrag as S
from poicraft.plans.params import (AS_OF, LEGEND_N, MAP_KEYWORDS, RETAIL_CATEGORY, RETAIL_KEYWORDS,
                                   RETAIL_KIND, RETAIL_NAME_MAP, VENUE_KEYS, VENUE_KEYWORDS, VENUE_TOP_N)
from poicraft.plans.q_core import SHARE_SQL, abbreviate_sql, legend_sql, top_n_sql
from poicraft.plans.q_places import (CLEAN_VEN, est_feature_sql, _points_sql, _venue_entity_sql,
                                     est_entity_struct_sql, flat_entity, flat_point)
from poicraft.plans.registry import query
from poicraft.session import scratch_path
from poicraft.sinks import writers as W
from poicraft.sources import readers as R


# ---------------------------------------------------------------- E1 retail entities


def _mark(audit, df: DataFrame, stage: str) -> DataFrame:
    return df if audit is None else audit.mark(df, stage)


# Of establishments with one id, the smallest by these stays; whatever other columns an
# output keeps, its survivors agree in them.
SURVIVOR_ORDER = ("codigo_act", "nom_vial", "entidad")


def retail_entities_flow(establishments: DataFrame, catalog: DataFrame, keywords: Sequence[str],
                         name_map: Mapping[str, str], category: str, kind: str,
                         audit=None, store: Callable[[DataFrame], DataFrame] = lambda df: df) -> dict:
    """S1 → A8 → F2 → J2 → P5 → (A1 counts, M4 entities).

    ``store`` may write the enriched rows once (see ``session.stored``), so that
    several outputs do not each repeat the scan, dedup, filter and join.

    With a :class:`~poicraft.operators.audit.StageAudit`, row counts after each
    step are observed during the pipeline's own writes (A9).
    """
    df = _mark(audit, establishments, "loaded")
    df = _mark(audit, dedup.dedupe_by_key(df, ["id"], SURVIVOR_ORDER), "deduplicated")
    df = _mark(audit, df.filter(street_entity_pred("nom_vial", "entidad", keywords)), "address filter")
    df = enrich.catalog_match(df, catalog)
    df = store(df.withColumn("reduct_cat_name", reduce_name("category", name_map)))
    return {
        "rows": df,
        "counts": cat.category_count(df),
        "entities": df.select(F.col("id").alias("_key"),
                              ent.establishment_entity(category, kind).alias("entity")),
    }


_E1_WHERE = " and ".join(
    [S.icontains("nom_vial", k) for k in RETAIL_KEYWORDS[:-1] if k]
    + [S.icontains("entidad", RETAIL_KEYWORDS[-1])])


@query("pipe_retail_entities", f"""
select entity.id as id, to_json(entity) as payload
from (select {est_entity_struct_sql(RETAIL_NAME_MAP)} as entity
      from (select e.*, c.actividad as category from ({B.KEPT_EST_SQL}) e
            left join ({B.CATALOG_SQL}) c on try_cast(e.codigo_act as bigint) = try_cast(c.id_act as bigint)
            where {_E1_WHERE}))
""")
def q_pipe_retail_entities(spark, sf):
    out = retail_entities_flow(B.repeated_establishments(spark, sf), B.activity_catalog(spark, sf),
                               RETAIL_KEYWORDS, RETAIL_NAME_MAP, RETAIL_CATEGORY, RETAIL_KIND)
    return ent.entity_payloads(out["entities"])


# ---------------------------------------------------------------- E2 coloured map + legend


def colored_map_flow(establishments: DataFrame, catalog: DataFrame, keywords: Sequence[str],
                     max_display: int, entity_mode: str = "reference", audit=None,
                     any_keywords: Sequence[str] = (), any_columns: Sequence[str] = ("raz_social", "nombre_act"),
                     keys: Sequence[str] = (), store: Callable[[DataFrame], DataFrame] | None = None) -> dict:
    """S1 → A8 → F2 (→ F3) → J2 → A4(N, keys) → (P7 → P6 legend, M5 features).

    The legend needs only the columns of the filters and the activity code, so its
    branch takes these before the dedup; it counts codes first and looks up the names
    of the few codes. With ``store`` the enriched rows are written once instead and
    both outputs read them.
    """
    def kept(df, mark):
        df = mark(dedup.dedupe_by_key(df, ["id"], SURVIVOR_ORDER), "deduplicated")
        pred = street_entity_pred("nom_vial", "entidad", keywords, entity_mode)
        if any_keywords:
            pred = pred & any_keyword_pred(list(any_columns), any_keywords)
        return mark(df.filter(pred), "address filter")

    def marked(df, stage):
        return _mark(audit, df, stage)

    rows = enrich.catalog_match(kept(marked(establishments, "loaded"), marked), catalog)
    if store is not None:
        rows = store(rows)
        counts = cat.category_count(rows)
    else:
        need = ["id", *SURVIVOR_ORDER, *[c for c in any_columns if any_keywords and c not in SURVIVOR_ORDER]]
        codes = kept(establishments.select(*need), lambda df, _: df).groupBy("codigo_act").agg(F.count(F.lit(1)).alias("n"))
        counts = enrich.catalog_match(codes, catalog).groupBy("category").agg(F.sum("n").alias("n"))
    if keys:
        rows, counts = cat.category_filter(rows, keys), cat.category_filter(counts, keys)
    top = cat.top_n_other(counts, max_display)
    colored = cat.color_by_top(rows, top)
    return {
        "legend": cat.abbreviate_legend(cat.legend(top)),
        "features": colored.select("id", feat.establishment_feature().alias("feature")),
    }


_KEPT_CAT = f"""
select e.*, c.actividad as category from ({B.KEPT_EST_SQL}) e
left join ({B.CATALOG_SQL}) c on try_cast(e.codigo_act as bigint) = try_cast(c.id_act as bigint)
"""
_KEPT_COUNTS = f"select category, count(*) as n from ({_KEPT_CAT}) group by category"


@query("pipe_colored_map", est_feature_sql(_KEPT_CAT, top_n_sql(_KEPT_COUNTS, LEGEND_N)))
def q_pipe_colored_map(spark, sf):
    out = colored_map_flow(B.repeated_establishments(spark, sf), B.activity_catalog(spark, sf),
                           MAP_KEYWORDS, LEGEND_N)
    return out["features"].select("id", F.to_json("feature", ent.JSON_OPTIONS).alias("feature"))


@query("flagship_legend", f"select rank, label, color from ({abbreviate_sql(legend_sql(top_n_sql(_KEPT_COUNTS, 5)))})")
def q_flagship_legend(spark, sf):
    """The E2 legend with N = 5 (the ``entry`` smoke query)."""
    out = colored_map_flow(B.repeated_establishments(spark, sf), B.activity_catalog(spark, sf),
                           MAP_KEYWORDS, 5)
    return out["legend"]


# ---------------------------------------------------------------- E3 / E4 venue maps


# Of venues with one id, the smallest by these stays. A slice of the address to its first
# line sorts the same way as far as the filters read it.
VENUE_SURVIVOR_ORDER = ("primary", "cat_name", "postalCode", "formattedAddress")


def venue_map_flow(venues: DataFrame, postal: DataFrame, keywords: Sequence[str],
                   keys: Sequence[str], max_display: int, as_of: str) -> dict:
    """S5 → clean → J1 → F1 → A2 → A3(N) → A5 → M1 → M6, with the legend.

    The counts need neither names nor places nor more than the first address line,
    so their branch drops these before the dedup.
    """
    def kept(df):
        df = enrich.postal_enrich(cat.clean_categories(df, order_by=VENUE_SURVIVOR_ORDER), postal)
        return df.filter(address_keyword_pred("formattedAddress", "postalCode", keywords))

    slim = kept(venues.select("id", "primary", "cat_name", "postalCode",
                              F.slice("formattedAddress", 1, 1).alias("formattedAddress")))
    counts = cat.category_count_filtered(slim, keys) if keys else cat.category_count(slim)
    top = cat.top_n_other(counts, max_display)
    rows = kept(venues)
    winners = top.filter(F.col("category") != "Other").select("category")
    rows = cat.category_filter(rows, winners, bound=max_display) if keys else rows
    rows = cat.color_by_top(rows, top)
    entities = rows.select(ent.venue_entity(as_of).alias("entity"))
    return {"entities": entities, "points": feat.entity_points(entities), "legend": cat.legend(top)}


_E3_TOP = top_n_sql(f"""select category, count(*) as n from E3F
  where category in ({', '.join(S.lit(k) for k in VENUE_KEYS)}) group by category""", VENUE_TOP_N)


@query("pipe_venue_map", f"""
with E3F as (select v.* from {CLEAN_VEN} v
             join ({B.POSTAL_SQL}) p on try_cast(v.postalCode as bigint) = try_cast(p.d_codigo as bigint)
             where len(formattedAddress) > 0
               and not contains(coalesce(formattedAddress[1], 'None'), coalesce(postalCode, 'None'))
               and {' and '.join(S.icontains('formattedAddress[1]', k) for k in VENUE_KEYWORDS)}),
T as (select category from ({_E3_TOP}) where category <> 'Other'),
R as (select * from E3F where category in (select category from T))
{_points_sql(_venue_entity_sql('R').replace(S.color_for_keys('category', VENUE_KEYS), "case when category in (select category from T) then " + S.color('category') + " else '#A4A4A4' end"))}
""")
def q_pipe_venue_map(spark, sf):
    out = venue_map_flow(B.repeated_venues(spark, sf), B.postal_catalog(spark, sf), VENUE_KEYWORDS, VENUE_KEYS,
                         VENUE_TOP_N, AS_OF)
    return out["points"].select(*flat_point(F.col("feature")))


def venue_categories_flow(venues: DataFrame, postal: DataFrame, keys: Sequence[str],
                          as_of: str) -> DataFrame:
    """S5 → clean → A5(keys) → J1 → M1."""
    df = cat.filter_categories_colored(cat.clean_categories(venues), keys, True)
    df = enrich.postal_enrich(df, postal)
    return df.select(ent.venue_entity(as_of).alias("entity"))


@query("pipe_venue_categories", _venue_entity_sql(f"""(select v.* from {CLEAN_VEN} v
  join ({B.POSTAL_SQL}) p on try_cast(v.postalCode as bigint) = try_cast(p.d_codigo as bigint)
  where v.category in ({', '.join(S.lit(k) for k in VENUE_KEYS)}))"""))
def q_pipe_venue_categories(spark, sf):
    ents = venue_categories_flow(B.repeated_venues(spark, sf), B.postal_catalog(spark, sf), VENUE_KEYS, AS_OF)
    return ents.select(*flat_entity(F.col("entity")))


# ---------------------------------------------------------------- E5 clean collection + shares


def clean_collection_flow(spark, venues: DataFrame, postal: DataFrame, keys: Sequence[str],
                          path: str) -> DataFrame:
    """clean → F4 → J1 → K1 (stored collection) → S6 → W2 shares by municipality."""
    df = cat.category_filter(cat.clean_categories(venues), keys)
    df = enrich.postal_enrich(df, postal)
    W.write_collection(df, path)  # the cleaned venues, whole
    # parquet pruning: the shares read only municipio and category back
    return shares.category_share(R.load_collection(spark, path))


@query("pipe_clean_collection", SHARE_SQL.format(g="municipio", c="category", src=f"""(
  select p.D_mnpio as municipio, v.category from {CLEAN_VEN} v
  join ({B.POSTAL_SQL}) p on try_cast(v.postalCode as bigint) = try_cast(p.d_codigo as bigint)
  where v.category in ({', '.join(S.lit(k) for k in VENUE_KEYS)}))"""))
def q_pipe_clean_collection(spark, sf):
    return clean_collection_flow(spark, B.repeated_venues(spark, sf), B.postal_catalog(spark, sf), VENUE_KEYS,
                                 scratch_path(spark, "venues-collection"))
