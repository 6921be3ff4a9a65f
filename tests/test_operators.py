"""Table operators on inline frames."""

import json

import pytest
from pyspark.sql import functions as F

from poicraft.operators import categories as cat, dedup, enrich, entities as ent, index, mesh, shares, spatial


def test_t5_dedup_deterministic_and_null_keys(spark):
    df = spark.createDataFrame([("1", "b"), ("1", "a"), (None, "z"), (None, "y"), ("2", "c")],
                               "id string, category string")
    out = sorted((r.id or "", r.category) for r in dedup.dedupe_by_key(df, ["id"]).collect())
    assert out == [("", "y"), ("1", "a"), ("2", "c")]
    ordered = dedup.dedupe_by_key(df, ["id"], ["category"]).filter("id = '1'").first()
    assert ordered.category == "a"


def test_clean_categories_t2(spark):
    df = spark.createDataFrame([
        ("1", ["A"], [True]), ("2", [], []), ("3", None, None), ("4", ["B", "C"], [False, True]),
        ("5", ["D"], [True]), ("5", ["E"], [True]),
    ], "id string, cat_name array<string>, primary array<boolean>")
    out = sorted((r.id, r.category) for r in cat.clean_categories(df).collect())
    assert out == [("1", "A"), ("5", "D")]


def test_top_n_other_t8_t9_t10(spark):
    counts = spark.createDataFrame([("a", 5), ("b", 3), ("c", 3), ("Other", 2), (None, 4), ("d", 1)],
                                   "category string, n bigint")
    got = [(r.rank, r.category, r.n) for r in cat.top_n_other(counts, 2).orderBy("rank").collect()]
    assert got == [(1, "a", 5), (2, "b", 3), (3, "Other", 3 + 2 + 4 + 1)]
    few = cat.top_n_other(counts.filter("category = 'a'"), 5).orderBy("rank").collect()
    assert [(r.category, r.n) for r in few] == [("a", 5), ("Other", 0)]


def test_legend_labels_and_collisions(spark):
    top = spark.createDataFrame([(1, "Comercio al por menor x", 5), (2, "Other", 1)],
                                "rank bigint, category string, n bigint")
    lg = {r.label: r.color for r in cat.legend(top).collect()}
    assert lg["Other[1]"] == "#A4A4A4" and "Comercio al por menor x[5]" in lg
    short = {r.label for r in cat.abbreviate_legend(cat.legend(top)).collect()}
    assert short == {"C_aP_menor x[5]", "Other[1]"}
    clash = spark.createDataFrame([(1, "k", "#1"), (2, "k", "#2")], "rank bigint, label string, color string")
    assert cat.abbreviate_legend(clash).first().color == "#2"


def test_group_by_categories_colored_top_palette(spark):
    df = spark.createDataFrame([(i, c) for i, c in enumerate("aaabbc")], "id int, category string")
    rows, top = cat.group_by_categories_colored(df, 2)
    colors = {r.category: r.color_cat for r in rows.collect()}
    assert colors["c"] == "#A4A4A4" and colors["a"] != "#A4A4A4" and colors["b"] != "#A4A4A4"
    assert {(r.category, r.n) for r in top.collect()} == {("a", 3), ("b", 2), ("Other", 1)}


def test_t3_code_join(spark):
    venues = spark.createDataFrame([("v1", "06000"), ("v2", "6000"), ("v3", "x1"), ("v4", None)],
                                   "id string, postalCode string")
    postal = spark.createDataFrame([("6000", "Cuauhtémoc", "Colonia"), ("06000", "Dup", "Colonia")],
                                   "d_codigo string, D_mnpio string, d_tipo_asenta string")
    out = sorted((r.id, r.municipio) for r in enrich.postal_enrich(venues, postal).collect())
    assert [i for i, _ in out] == ["v1", "v2"] and len({m for _, m in out}) == 1


def test_catalog_match_keeps_unmatched(spark):
    est = spark.createDataFrame([("1", "461110"), ("2", "999")], "id string, codigo_act string")
    catalog = spark.createDataFrame([("461110", "Comercio al por menor de abarrotes")],
                                    "id_act string, actividad string")
    out = dict((r.id, r.category) for r in enrich.catalog_match(est, catalog).collect())
    assert out == {"1": "Comercio al por menor de abarrotes", "2": None}


def test_photo_enrich_cases(spark):
    from poicraft.sources.readers import PHOTO_SCHEMA
    venues = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    photos = spark.createDataFrame([("b", 200, []), ("c", 200, [("p/", "/s", ("u1",))])], PHOTO_SCHEMA)
    out = dict((r.id, r.url) for r in enrich.photo_enrich(venues, photos).collect())
    assert out == {"a": "_", "b": "__", "c": "p/u1/s"}


def test_row_index_and_batches(spark):
    df = spark.range(0, 1003, 1, 7).select((F.col("id") * 3).alias("k"))
    idx = index.row_index(df.repartition(5), ["k"])
    got = sorted((r.k, r.idx) for r in idx.collect())
    assert got == [(3 * i, i) for i in range(1003)]
    ents = df.select(F.col("k").alias("_key"), F.struct(F.col("k").alias("id")).alias("entity"))
    b = {r.batch_id: r.n for r in ent.entity_batches(ents, ["_key"], size=400).collect()}
    assert b == {0: 400, 1: 400, 2: 203}
    plan = ent.entity_batches(ents, ["_key"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # rows per partition; entities by batch


@pytest.mark.parametrize("parts", [8, 400])
def test_batches_are_full_at_any_number_of_partitions(spark, parts):
    ents = spark.range(0, 5201, 1, 9).select(((F.col("id") * 7919) % 5201).alias("_key"), F.struct(F.col("id").cast("string").alias("id")).alias("entity"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {r.batch_id: (r.n, r.payload) for r in ent.entity_batches(ents, ["_key"]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert [got[b][0] for b in sorted(got)] == [400] * 13 + [1]
    ids = [e["id"] for b in sorted(got) for e in json.loads(got[b][1])["entities"]]
    assert ids == [r.entity.id for r in ents.orderBy("_key").collect()]


def test_identical_rows_spread_over_range_partitions(spark):
    df = spark.range(0, 8000, 1, 8).select(F.when(F.col("id") % 2 == 0, F.lit(5)).otherwise(F.col("id")).cast("bigint").alias("k"))
    ordered = index.stored_in_order(df, ["k"])
    sizes = [r["count"] for r in ordered.groupBy(F.shiftright("_place", index.PLACE_BITS)).count().collect()]
    assert sum(sizes) == 8000 and max(sizes) < 2500  # half of the rows are the same
    got = sorted((r.idx, r.k) for r in index.row_index(df, ["k"]).collect())
    assert [i for i, _ in got] == list(range(8000)) and [k for _, k in got] == sorted(r.k for r in df.collect())


def test_row_index_shuffles_the_rows_once(spark):
    from poicraft.plans.evidence import physical_plan, written_plans
    df = spark.range(0, 1000, 1, 4).select((F.col("id") % 10).alias("k"), F.col("id").cast("string").alias("v"))
    with written_plans() as plans:
        out = physical_plan(index.row_index(df, ["k"]))
    assert len(plans) == 1 and plans[0].count("Exchange") == 1 and "rangepartitioning" in plans[0]
    assert "SortMergeJoin" not in out and out.count("Exchange hashpartitioning") == 1  # the rows per partition
    assert "Window" in out.split("BroadcastExchange", 1)[1] and "Window" not in out.split("BroadcastExchange", 1)[0]


def test_row_index_of_equal_rows_and_nulls(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (2, None), (1, "c")], "k int, v string")
    got = sorted((r.idx, r.k, r.v) for r in index.row_index(df, ["k"]).collect())
    assert [i for i, _, _ in got] == [0, 1, 2, 3, 4] and [k for _, k, _ in got] == [None, 1, 1, 1, 2]


def test_category_share(spark):
    df = spark.createDataFrame([("m1", "a"), ("m1", "a"), ("m1", "b"), ("m2", "a")],
                               "municipio string, category string")
    out = {(r.municipio, r.category): (r.n, r.idx, round(r.share, 6), r.offset)
           for r in shares.category_share(df).collect()}
    assert out[("m1", "a")] == (2, 0, round(200 / 3, 6), 0.0)
    assert out[("m1", "b")] == (1, 1, round(100 / 3, 6), 0.008)
    assert out[("m2", "a")][2] == 100.0


def test_mesh_grid_and_sweep(spark):
    g = mesh.mesh_grid(spark)
    assert g.count() == 4200 and mesh.mesh_resume(g).count() == 1057
    first = g.filter("cell_id = 61").first()
    assert (first.i, first.j, first.key) == (1, 1, "1-1")
    pts = spark.createDataFrame([(i, 0.05, 0.05) for i in range(10)] + [(99, 1.0, 1.0), (98, 2.0, 0.0)],
                                "id int, lat double, lng double")
    sw = mesh.mesh_sweep(pts, (0.0, 0.0), (1.0, 1.0), 10, 10, 3)
    got = sorted((r.id, r.cell_id) for r in sw.collect())
    assert got == [(0, 0), (1, 0), (2, 0), (99, 99)]


def test_row_index_spreads_a_repeated_key(spark):
    df = spark.range(0, 3000, 1, 6).select(F.lit(1).alias("k"), F.col("id"))
    idx = index.row_index(df, ["k"])
    assert sorted(r.idx for r in idx.collect()) == list(range(3000))


def test_salted_lookup_join_equals_plain_join(spark):
    from poicraft.operators.joins import lookup_join
    facts = spark.range(0, 5000, 1, 4).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 50).alias("code"))
    dim = spark.range(0, 40).select(F.col("id").alias("k"), F.concat(F.lit("n"), F.col("id")).alias("name"))
    facts = facts.withColumn("code", F.when(F.col("id") % 5 != 0, F.col("code")))
    salted = lookup_join(facts, dim, F.col("code"), "k", broadcast_bytes=-1, salts=8)
    plain = facts.join(dim, F.col("code") == F.col("k"), "left")
    rows = lambda d: sorted((r.id, r.code, r.k, r.name) for r in d.select("id", "code", "k", "name").collect())
    assert rows(salted) == rows(plain) and salted.count() == 5000


def test_catalog_match_without_broadcast_matches(spark):
    est = spark.createDataFrame([(str(i), str(i % 3)) for i in range(300)], "id string, codigo_act string")
    catalog = spark.createDataFrame([("0", "a"), ("1", "b"), ("00", "dup")], "id_act string, actividad string")
    big = enrich.catalog_match(est, catalog, broadcast_bytes=-1)
    small = enrich.catalog_match(est, catalog)
    assert sorted(map(tuple, big.collect())) == sorted(map(tuple, small.collect()))


def test_t8_keep_null_bucket_in_legend(spark):
    counts = spark.createDataFrame([("a", 5), (None, 4), ("b", 1)], "category string, n bigint")
    top = cat.top_n_other(counts, 2, null_bucket="keep")
    got = sorted((r.rank, r.category, r.n) for r in top.collect())
    assert got == [(1, "a", 5), (2, None, 4), (3, "Other", 1)]
    labels = {r.label: r.color for r in cat.legend(top).collect()}
    assert labels["None[4]"] == "#A4A4A4" and labels["Other[1]"] == "#A4A4A4"


def test_category_filter_with_key_table(spark):
    df = spark.createDataFrame([(i, c) for i, c in enumerate("aaabbcd")] + [(99, None)],
                               "id int, category string")
    keys = spark.createDataFrame([("a",), ("c",), ("a",)], "k string")
    want = sorted(r.id for r in df.filter(F.col("category").isin("a", "c")).collect())
    assert sorted(r.id for r in cat.category_filter(df, keys).collect()) == want
    assert sorted(r.id for r in cat.category_filter(df, keys, bound=3).collect()) == want
    assert cat.category_filter(df, keys).columns == ["id", "category"]


def test_lookup_joins_start_no_job(spark):
    est = spark.createDataFrame([("1", "S/N"), ("2", "5")], "id string, codigo_act string")
    catalog = spark.createDataFrame([("5", "x")], "id_act string, actividad string")
    sc = spark.sparkContext
    sc.setJobGroup("lookup-build", "")
    for bound in (-1, 1 << 62):
        enrich.catalog_match(est, catalog, broadcast_bytes=bound)
    jobs = sc.statusTracker().getJobIdsForGroup("lookup-build")
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) == 0


def test_missing_codes_are_spread(spark):
    est = spark.range(0, 8000, 1, 16).select(
        F.col("id").cast("string").alias("id"), F.when(F.col("id") % 2 == 0, "S/N").otherwise(F.col("id").cast("string")).alias("codigo_act"))
    catalog = spark.range(8000).select(F.col("id").cast("string").alias("id_act"), F.lit("a").alias("actividad"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = enrich.catalog_match(est, catalog, broadcast_bytes=-1)
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(sizes) == 8000 and max(sizes) < 2 * 8000 / 8


def test_photo_enrich_keeps_one_row_per_venue(spark):
    from poicraft.sources.readers import PHOTO_SCHEMA
    venues = spark.createDataFrame([("a",), ("b",)], "id string")
    photos = spark.createDataFrame([("a", 200, []), ("a", 200, [("p/", "/s", ("u1",))]), ("b", 404, None)], PHOTO_SCHEMA)
    out = sorted((r.id, r.url) for r in enrich.photo_enrich(venues, photos).collect())
    assert out == [("a", "p/u1/s"), ("b", "__")]


def test_dedupe_with_a_map_column(spark):
    df = spark.createDataFrame([(1, "b", {"x": 1}), (1, "a", {"x": 2}), (2, "c", None)], "k int, v string, m map<string,int>")
    got = sorted((r.k, r.v, r.m) for r in dedup.dedupe_by_key(df, ["k"]).collect())
    assert got == [(1, "a", {"x": 2}), (2, "c", None)]


def test_dedupe_order_holds_for_fewer_columns(spark):
    df = spark.createDataFrame([(1, "z", "a"), (1, "y", "b"), (2, "x", "c")], "k int, v string, w string")
    whole = {r.k: r.w for r in dedup.dedupe_by_key(df, ["k"], ["w"]).collect()}
    few = {r.k: r.w for r in dedup.dedupe_by_key(df.select("k", "w"), ["k"], ["w"]).collect()}
    assert whole == few == {1: "a", 2: "c"}


def test_searches_across_the_antimeridian(spark):
    pts = spark.createDataFrame([(1, 0.0, -179.95), (2, 0.0, 179.99), (3, 0.0, 0.0), (4, 0.0, 178.0), (5, 0.0, -178.0)],
                                "id int, lat double, lng double")
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(spatial.radius_search(pts, (0.0, 179.99), 20_000.0)) == [1, 2]
    assert ids(spatial.radius_search(pts, (0.0, -179.99), 20_000.0)) == [1, 2]
    assert ids(spatial.bbox_search(pts, (-1.0, 179.0), (1.0, -179.0))) == [1, 2]
    assert ids(spatial.bbox_search(pts, (-1.0, -1.0), (1.0, 1.0))) == [3]


def test_legend_label_collision(spark):
    from poicraft.sinks.writers import legend_object
    lg = spark.createDataFrame([(1, "None[4]", "#1"), (2, "None[4]", "#2")], "rank bigint, label string, color string")
    assert legend_object(lg).first().legend == '{"None[4]":"#2"}'


def test_category_share_puts_null_last(spark):
    df = spark.createDataFrame([("m", None), ("m", "a")], "municipio string, category string")
    assert {r.category: r.idx for r in shares.category_share(df).collect()} == {"a": 0, None: 1}
