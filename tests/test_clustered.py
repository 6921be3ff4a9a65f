"""The clustered venue store: cell ranges cover their boxes, searches equal the plain ones, scans are pruned."""

import math
import random

import pytest
from pyspark.sql import functions as F

from poicraft.operators import cells, spatial
from poicraft.session import scratch_path
from poicraft.sinks import writers as W


def number(lat, lng):
    y, x = cells._step(lat, -90.0, 180.0), cells._step(lng, -180.0, 360.0)
    bits = [(y >> k & 1, x >> k & 1) for k in range(cells.BITS - 1, -1, -1)]
    return int("".join(f"{a}{b}" for a, b in bits), 2)


def test_cell_numbers(spark):
    rng = random.Random(1)
    points = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(300)]
    points += [(-90.0, -180.0), (90.0, 180.0), (0.0, 0.0), (1000.0, -1000.0), (19.4326, -99.1332)]
    df = spark.createDataFrame([*points, (None, 1.0), (1.0, None)], "lat double, lng double")
    got = df.withColumn("c", cells.cell()).collect()
    assert all(r.c is None if r.lat is None or r.lng is None else r.c == number(r.lat, r.lng) for r in got)


@pytest.mark.parametrize("most", [1, 5, 32, 200])
def test_ranges_cover_and_tighten(most):
    rng = random.Random(most)
    for _ in range(100):
        lat, lng, h, w = rng.uniform(-89, 88), rng.uniform(-179, 178), 10 ** rng.uniform(-5, 1), 10 ** rng.uniform(-5, 1)
        boxes = [((lat, lng), (lat + h, lng + w))]
        if rng.random() < 0.3:
            boxes.append(((lat, -180.0), (lat + h, -180 + w)))
        ranges = cells.cell_ranges(boxes, most)
        assert 0 < len(ranges) <= most and all(a <= b for a, b in ranges) and all(x[1] + 1 < y[0] for x, y in zip(ranges, ranges[1:]))
        for sw, ne in boxes:
            for _ in range(20):
                c = number(rng.uniform(sw[0], ne[0]), rng.uniform(sw[1], ne[1]))
                assert any(a <= c <= b for a, b in ranges)
    box = [((19.30, -99.20), (19.35, -99.15))]
    area = lambda n: sum(b - a + 1 for a, b in cells.cell_ranges(box, n))
    assert area(32) < 2 * area(200) and area(32) * 50 < area(1)
    assert cells.cell_ranges([((1.0, 1.0), (0.0, 0.0))]) == []


@pytest.fixture(scope="module")
def venues(spark):
    k = F.col("id")
    plain = spark.range(0, 60_000, 1, 4).select(
        k, F.concat(F.lit("v"), (k % 7).cast("string")).alias("name"), F.array((k % 5).cast("string")).alias("cat_id"),
        (F.rand(1) * 180 - 90).alias("lat"), (F.rand(2) * 360 - 180).alias("lng"))
    plain = plain.unionByName(plain.limit(3).withColumns({"lat": F.lit(None).cast("double"), "lng": F.lit(0.0)}))
    path = scratch_path(spark, "venues-plain")
    plain.write.parquet(path)
    plain = spark.read.parquet(path)
    stored = spark.read.parquet(W.write_clustered(plain, scratch_path(spark, "venues-clustered"), row_group_bytes=16_384))
    return plain, stored


SEARCHES = [
    lambda v: spatial.bbox_search(v, (10.0, 20.0), (12.0, 23.0)),
    lambda v: spatial.bbox_search(v, (-5.0, 178.0), (5.0, -178.0)),
    lambda v: spatial.bbox_category_search(v, (-10.0, -20.0), (0.0, 0.0), "3"),
    lambda v: spatial.radius_search(v, (48.85, 2.35), 300_000.0),
    lambda v: spatial.radius_search(v, (0.0, 179.9), 500_000.0),
    lambda v: spatial.radius_search(v, (89.5, 10.0), 400_000.0),
    lambda v: spatial.radius_query_search(v, (-33.0, 151.0), 600_000.0, "V3", limit=5),
    lambda v: spatial.bbox_search(v, (-90.0, -180.0), (90.0, 180.0)),
    lambda v: spatial.bbox_search(v, (2.0, 3.0), (1.0, 4.0)),
]


@pytest.mark.parametrize("search", SEARCHES)
def test_same_rows_as_the_plain_search(venues, search):
    plain, stored = venues
    want = sorted(r.id for r in search(plain).select("id").collect())
    assert sorted(r.id for r in search(stored).select("id").collect()) == want


def rows_scanned(df):
    """Rows that came out of the file scan, after row groups were skipped."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaf = plan.collectLeaves().head()
    return leaf.metrics().apply("numOutputRows").value()


def test_a_small_search_reads_a_small_share(spark, venues):
    plain, stored = venues
    assert stored.count() == plain.count() == 60_003 and math.isclose(stored.agg(F.sum("lat")).first()[0], plain.agg(F.sum("lat")).first()[0])
    for search in (lambda v: spatial.bbox_search(v, (10.0, 20.0), (12.0, 23.0)), lambda v: spatial.radius_search(v, (48.85, 2.35), 200_000.0)):
        assert rows_scanned(search(plain)) > 50_000
        assert 0 < rows_scanned(search(stored)) < 3_000


def test_a_crowded_cell_spreads(spark):
    df = spark.range(0, 20_000, 1, 4).select("id", F.when(F.col("id") % 3 == 0, F.lit(1.0)).otherwise(F.rand(3) * 90).alias("lat"), F.lit(2.0).alias("lng"))
    stored = spark.read.parquet(W.write_clustered(df, scratch_path(spark, "crowded")))
    sizes = [r["count"] for r in stored.groupBy(F.input_file_name()).count().collect()]
    assert sum(sizes) == 20_000 and max(sizes) < 5_000
