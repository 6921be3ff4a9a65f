"""Readers: explicit schemas, catalogue extraction, nested venue documents."""

from pyspark.sql import functions as F

from poicraft.operators import index
from poicraft.plans import bindings as B
from poicraft.session import scratch_path
from poicraft.sources import readers as R

SF = "/root/testdata/sf0.001"


def test_t4_csv_codes_stay_text(spark):
    path = scratch_path(spark, "est")
    row = {c: f"v_{c}" for c in R.ESTABLISHMENT_COLUMNS}
    row.update(cod_postal="01000", fecha_alta="2010-07", codigo_act="046111", extra="x")
    spark.createDataFrame([row]).write.option("header", True).csv(path)
    got = R.load_establishments(spark, path).first()
    assert (got.cod_postal, got.fecha_alta, got.codigo_act) == ("01000", "2010-07", "046111")
    assert R.load_establishments(spark, path).columns == R.ESTABLISHMENT_COLUMNS


def test_build_catalog_split_and_csv(spark):
    path = scratch_path(spark, "activity-catalog")
    lines = ['id,"title"', '461110,"Comercio al por menor, abarrotes",x', '"461",quoted', "46x,bad"]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    naive = sorted(tuple(r) for r in R.build_catalog(spark, path).collect())
    quoted = sorted(tuple(r) for r in R.build_catalog(spark, path, parse="csv").collect())
    assert naive == [("461110", "Comercio al por menor")]
    assert ("461110", "Comercio al por menor, abarrotes") in quoted


def test_flatten_venues_raw_and_mapped(spark):
    resp = B.responses(spark, SF)
    raw = R.flatten_venues(resp)
    assert raw.columns == ["id", "name", "location"]
    mapped = R.flatten_venues(resp, mapped=True, as_of="2019-05-23 12:00:00")
    first = mapped.select("entity.id", "entity.url.value").first()
    assert first[0].startswith("4sqr-") and first[1] == "no url"
    assert mapped.count() == raw.count() == B.table(spark, SF, "documents").count()


def test_group_index_and_head_slice(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), ("b", 2)], "g string, v int")
    gi = sorted((r.g, r.v, r.idx) for r in index.group_index(df, ["g"], ["v"]).collect())
    assert gi == [("a", 1, 0), ("a", 3, 1), ("b", 2, 0)]
    head = [r.v for r in index.take_slice(df, [F.desc("v")], 2).collect()]
    assert head == [3, 2]


def test_latin1_establishment_csv(spark):
    import os
    path = scratch_path(spark, "latin1")
    os.makedirs(path.replace("file:", ""), exist_ok=True)
    header = ",".join(R.ESTABLISHMENT_COLUMNS)
    row = ",".join(["1", "Panadería Ñandú"] + ["x"] * (len(R.ESTABLISHMENT_COLUMNS) - 2))
    with open(path.replace("file:", "") + "/part.csv", "wb") as f:
        f.write((header + "\n" + row + "\n").encode("latin-1"))
    got = R.load_establishments(spark, path, encoding="ISO-8859-1").first()
    assert got.nom_estab == "Panadería Ñandú"
