"""Document dumps (S5, K1): codec, splits, round trips through the collection sink and reader."""

import glob
import os
import struct

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from poicraft.plans import bindings as B
from poicraft.session import scratch_path
from poicraft.sinks import writers as W
from poicraft.sources import docdump as D, readers as R

SF = "/root/testdata/sf0.001"
SCHEMA = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("n", T.LongType()), T.StructField("x", T.DoubleType()), T.StructField("ok", T.BooleanType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("at", T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lines", T.ArrayType(T.StructType([T.StructField("s", T.StringType())])))])),
])
DOCS = [
    {"id": "a", "n": 1, "x": 1.5, "ok": True, "tags": ["é", None, ""], "at": {"lat": -0.5, "lines": [{"s": "😀"}, None, {"s": None}]}},
    {"id": None, "n": -(2 ** 62), "x": None, "ok": False, "tags": [], "at": None},
    {"id": "c", "n": None, "x": float("inf"), "ok": None, "tags": None, "at": {"lat": None, "lines": None}},
]


def plain(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def write_file(folder, docs, raw=()):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/dump.bson", "wb") as f:
        for d in docs:
            f.write(D.encode(d))
        for d in raw:
            f.write(d)


def test_codec_and_types(tmp_path, spark):
    D.register(spark)
    write_file(f"{tmp_path}/a", DOCS)
    assert plain(spark.read.format("docdump").schema(SCHEMA).load(f"{tmp_path}/a")) == DOCS
    # elements as other writers store them: object ids, 32-bit numbers, dates, fields that the schema lacks
    body = (b"\x07id\0" + bytes(range(12)) + b"\x10n\0" + struct.pack("<i", 7) + b"\x10x\0" + struct.pack("<i", 3) + b"\x09when\0" + struct.pack("<q", 5)
            + b"\x05raw\0" + struct.pack("<i", 3) + b"\0abc" + b"\x02ok\0" + struct.pack("<i", 4) + b"yes\0" + b"\x01tags\0" + struct.pack("<d", 1.0))
    write_file(f"{tmp_path}/b", [], [struct.pack("<i", len(body) + 5) + body + b"\0"])
    got = plain(spark.read.format("docdump").schema(SCHEMA).load(f"{tmp_path}/b/dump.bson"))
    assert got == [{"id": bytes(range(12)).hex(), "n": 7, "x": 3.0, "ok": None, "tags": None, "at": None}]


@pytest.mark.parametrize("index", [True, False])
def test_splits_of_one_file(tmp_path, spark, index):
    D.register(spark)
    docs = [{"id": f"doc {i}" + "x" * (i % 300), "n": i} for i in range(2000)]
    write_file(f"{tmp_path}/d", docs)
    if index:
        offsets, at = [], 0
        for d in docs:
            offsets.append(at)
            at += len(D.encode(d))
        open(f"{tmp_path}/d/dump.bson.idx", "wb").write(struct.pack(f"<{len(offsets)}q", *offsets))
    df = spark.read.format("docdump").schema("id string, n long").option("splitBytes", 20_000).load(f"{tmp_path}/d")
    per = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    assert len(per) > 10 and sum(per) == 2000
    assert sorted(r.n for r in df.collect()) == list(range(2000))
    assert df.filter("id = 'doc 0'").first().n == 0


def test_collections_round_trip_and_overwrite(spark):
    docs = B.venue_documents(spark, SF)
    path = W.write_collection(docs, scratch_path(spark, "dump"), "docdump")
    want = sorted(map(str, plain(R.project_venues(docs))))
    assert sorted(map(str, plain(R.load_venues(spark, path, "docdump", splitBytes=50_000)))) == want
    assert sorted(map(str, plain(R.load_collection(spark, path, "docdump", R.VENUE_SCHEMA)))) == sorted(map(str, plain(docs)))
    W.write_collection(docs.limit(3), path, "docdump")
    assert R.load_venues(spark, path, "docdump").count() == 3
    with pytest.raises(Exception, match="task lost"):
        W.write_collection(docs.withColumn("name", F.raise_error(F.lit("task lost"))), path, "docdump")
    assert R.load_venues(spark, path, "docdump").count() == 3
    W.write_collection(docs.limit(0), path, "docdump")
    assert R.load_venues(spark, path, "docdump").count() == 0


def test_overwrite_of_a_plain_folder(tmp_path, spark):
    D.register(spark)
    for n in (50, 7):
        spark.range(0, n, 1, 4).write.format("docdump").mode("overwrite").save(f"{tmp_path}/p")
        assert spark.read.format("docdump").schema("id long").load(f"{tmp_path}/p").count() == n
    spark.range(5).write.format("docdump").mode("append").save(f"{tmp_path}/p")
    assert spark.read.format("docdump").schema("id long").load(f"{tmp_path}/p").count() == 12
    assert not glob.glob(f"{tmp_path}/p/*.tmp")
