"""Streaming adapter and sinks, written to fresh scratch folders and read back."""

import json

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from poicraft.operators import entities as ent
from poicraft.plans import bindings as B
from poicraft.session import scratch_path
from poicraft.sinks import writers as W
from poicraft.streaming import entity_payload_stream, start_json_sink

SF = "/root/testdata/sf0.001"


def test_stream_matches_batch(spark):
    est = B.establishments(spark, SF)
    src = scratch_path(spark, "stream-src")
    est.repartition(3).write.option("header", True).csv(src)
    catalog = B.activity_catalog(spark, SF)
    kw = ["", "nation_1"]
    stream = entity_payload_stream(spark, src, catalog, kw, "c", "k", max_files_per_trigger=1)
    out = scratch_path(spark, "stream-out")
    q = start_json_sink(stream, out, scratch_path(spark, "stream-ckpt"))
    q.awaitTermination(300)
    got = sorted(r.payload for r in spark.read.json(out).collect())
    # a catalogue beyond the broadcast bound: plain stream-static join, same result
    big = entity_payload_stream(spark, src, catalog, kw, "c", "k", broadcast_bytes=-1)
    out_big = scratch_path(spark, "stream-out-big")
    start_json_sink(big, out_big, scratch_path(spark, "stream-ckpt-big")).awaitTermination(300)
    assert sorted(r.payload for r in spark.read.json(out_big).collect()) == got

    from poicraft.functions import reduce_name, street_entity_pred
    from poicraft.operators.enrich import catalog_match
    df = catalog_match(est.filter(street_entity_pred("nom_vial", "entidad", kw)), catalog)
    df = df.withColumn("reduct_cat_name", reduce_name("category"))
    want = sorted(r.payload for r in ent.entity_payloads(
        df.select(ent.establishment_entity("c", "k").alias("entity"))).collect())
    assert got == want and len(got) > 0


def test_counts_csv_quoting(spark):
    counts = spark.createDataFrame([("a,b", 2), ("x|y", 1), (None, 3), ("plain", 4)],
                                   "category string, n bigint")
    path = W.write_counts(counts, scratch_path(spark, "counts"))
    lines = sorted(r.value for r in spark.read.text(path).collect())
    assert lines == [",3", "plain,4", "|a,b|,2", "|x||y|,1"]


def test_legend_object_in_rank_order(spark):
    lg = spark.createDataFrame([(2, "b[1]", "#2"), (1, "a[5]", "#1"), (3, "Other[0]", "#A4A4A4")],
                               "rank bigint, label string, color string")
    path = W.write_legend(lg, scratch_path(spark, "legend"))
    text = spark.read.text(path).first().value
    assert list(json.loads(text).items()) == [("a[5]", "#1"), ("b[1]", "#2"), ("Other[0]", "#A4A4A4")]


def test_geojson_lines_keep_nulls(spark):
    df = spark.createDataFrame([("1", None)], "id string, www string")
    feats = df.select(F.struct(F.lit("Feature").alias("type"),
                               F.struct("id", "www").alias("properties")).alias("feature"))
    path = W.write_geojson(feats, scratch_path(spark, "geo"))
    obj = json.loads(spark.read.text(path).first().value)
    assert obj == {"type": "Feature", "properties": {"id": "1", "www": None}}


def test_json_name_and_points_skip_missing_coordinates(spark):
    assert W.json_name("/x/", "legend") == "/x/legend.json"
    assert W.json_name("/x", "a.json") == "/x/a.json"
    from poicraft.operators.features import entity_points
    e = spark.createDataFrame(
        [("a", ["1", "Bar", "#000000"], [1.0, 2.0]), ("b", ["1", "Bar", "#000000"], [])],
        "id string, cat array<string>, coords array<double>")
    ents = e.select(F.struct(
        F.col("id"),
        F.struct(F.col("cat").alias("value")).alias("category"),
        F.struct(F.struct(F.lit(None).cast("array<string>").alias("addressLocality")).alias("value")).alias("address"),
        F.struct(F.struct(F.col("coords").alias("coordinates")).alias("value")).alias("location"),
    ).alias("entity"))
    pts = entity_points(ents).collect()
    assert len(pts) == 1 and pts[0].feature.properties.name == "a"
    assert pts[0].feature.properties.category == "Bar"


def test_stream_with_other_columns(spark):
    est = B.establishments(spark, SF).withColumn("clee", F.lit("x"))
    est = est.select(*reversed(est.columns))
    src = scratch_path(spark, "stream-cols")
    est.repartition(2).write.option("header", True).csv(src)
    catalog = B.activity_catalog(spark, SF)
    stream = entity_payload_stream(spark, src, catalog, ["", ""], "c", "k", columns=est.columns)
    out = scratch_path(spark, "stream-cols-out")
    start_json_sink(stream, out, scratch_path(spark, "stream-cols-ckpt")).awaitTermination(300)
    assert spark.read.json(out).count() == est.count()
    wrong = entity_payload_stream(spark, src, catalog, ["", ""], "c", "k")
    with pytest.raises(StreamingQueryException):
        start_json_sink(wrong, scratch_path(spark, "stream-bad-out"),
                        scratch_path(spark, "stream-bad-ckpt")).awaitTermination(300)


def test_counts_file_is_sorted_and_batches_keep_key_order(spark):
    counts = spark.createDataFrame([("b", 2), ("a", 2), ("c", 9), (None, 1)], "category string, n bigint")
    path = W.write_counts(counts.repartition(3), scratch_path(spark, "sorted-counts"))
    import glob
    files = sorted(glob.glob(path.replace("file:", "") + "/part-*"))
    lines = [ln.rstrip("\n") for f in files for ln in open(f) if ln.strip()]
    assert lines == ["c,9", "a,2", "b,2", ",1"]
    ents = spark.range(0, 900, 1, 5).select(F.col("id").alias("_key"),
                                            F.struct(F.col("id").cast("string").alias("id")).alias("entity"))
    first = ent.entity_batches(ents, ["_key"]).filter("batch_id = 0").first()
    ids = [int(e["id"]) for e in json.loads(first.payload)["entities"]]
    assert ids == list(range(400)) and json.loads(first.payload)["actionType"] == "APPEND"


@pytest.mark.parametrize("rows, parts", [(0, 8), (1, 8), (7, 8), (3000, 8), (500, 40), (50, 1)])
def test_feature_collection_is_one_document(spark, rows, parts):
    import glob
    features = spark.range(0, rows, 1, 6).select(
        ((F.col("id") * 7) % max(rows, 1)).alias("k"), F.struct(F.lit("Feature").alias("type"), F.struct(
            F.concat(F.lit('a "b", ]}\n'), F.col("id").cast("string")).alias("name"), F.lit(None).cast("string").alias("www")).alias("properties")).alias("feature"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        path = W.write_feature_collection(features, scratch_path(spark, "fc"), ["k"], name="map")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    files = sorted(glob.glob(path.replace("file:", "") + "/part-*"))
    got = json.loads("".join(open(f).read() for f in files))
    want = [json.loads(r.j) for r in features.orderBy("k").select(F.to_json("feature", {"ignoreNullFields": "false"}).alias("j")).collect()]
    assert path.endswith("map.json") and got == {"type": "FeatureCollection", "features": want}
    if rows > 1000:
        assert len(files) == parts + 2  # header, a file per range partition, end
        lines = W.write_geojson(features, scratch_path(spark, "fc-lines"))
        assert sorted(map(json.dumps, want)) == sorted(json.dumps(json.loads(r.value)) for r in spark.read.text(lines).collect())


def test_feature_collection_of_equal_keys_spreads(spark):
    import glob
    features = spark.range(0, 4000, 1, 4).select(F.lit(1).alias("k"), F.struct(F.col("id").cast("string").alias("id")).alias("feature"))
    path = W.write_feature_collection(features, scratch_path(spark, "fc-hot"), ["k"])
    sizes = [sum(1 for _ in open(f)) for f in glob.glob(path.replace("file:", "") + "/part-*")]
    assert sum(sizes) == 4002 and max(sizes) < 1500
