"""Plan properties that matter at scale."""

import pytest

import __spark_entry__ as E
from poicraft.plans.evidence import physical_plan as plan, written_plans
from poicraft.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_evaluation_and_no_pair_joins(spark, name):
    with written_plans() as plans:
        plans.append(plan(QUERIES[name](spark, SF)))
    for p in plans:
        assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p
        assert "BroadcastNestedLoopJoin" not in p and "CartesianProduct" not in p


def test_written_frames_are_seen(spark):
    with written_plans() as plans:
        QUERIES["pipe_clean_collection"](spark, SF)
    assert any("Join" in p for p in plans)


def test_legend_branch_shuffles_only_its_columns(spark):
    text = plan(QUERIES["flagship_legend"](spark, SF))
    assert "codigo_act" in text and "numero_ext" not in text and "fecha_alta" not in text


def test_dimension_joins_broadcast(spark):
    for name in ("postal_enrich", "establishment_entities"):
        assert "BroadcastHashJoin" in plan(E.queries()[name](spark, SF))


def test_per_cell_cap_limits_before_shuffle(spark):
    df = E.queries()["mesh_sweep"](spark, SF)
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in text and "Partial" in text


def test_dedup_aggregates_partially(spark):
    text = plan(E.queries()["dedupe_by_key"](spark, SF))
    assert "partial_min" in text


def test_filters_reach_the_scan(spark):
    df = E.queries()["category_filter"](spark, SF)
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(p_brand" in text or "PushedFilters: [IsNotNull(p_brand), In(p_brand" in text


def test_box_search_pushes_into_a_stored_venue_table(spark):
    from poicraft.operators import spatial
    from poicraft.plans import bindings as B
    from poicraft.session import scratch_path
    path = scratch_path(spark, "points")
    B.points(spark, SF).drop("cat_id").write.parquet(path)
    venues = spark.read.parquet(path)
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    text = spatial.bbox_search(venues, (0.0, 0.0), (0.1, 0.1))._jdf.queryExecution() \
        .executedPlan().toString()
    assert "GreaterThanOrEqual(lat,0.0)" in text and "LessThan(lng,0.1)" in text
    near = spatial.radius_search(venues, (0.0, 0.0), 10_000.0)._jdf.queryExecution() \
        .executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(lat,-0.08" in near and "LessThanOrEqual(lng,0.08" in near


def test_bucketed_photo_join_has_no_shuffle(spark):
    from poicraft.operators.enrich import photo_enrich
    from poicraft.plans import bindings as B
    from poicraft.sinks.writers import write_bucketed
    venues = B.venues(spark, SF).select("id", "name")
    photos = B.photos(spark, SF)
    write_bucketed(venues, "bucketed_venues", "id", 8)
    write_bucketed(photos, "bucketed_photos", "venue_id", 8)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = photo_enrich(spark.table("bucketed_venues"), spark.table("bucketed_photos"))
        text = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in text and "Exchange" not in text
        assert out.count() == venues.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
