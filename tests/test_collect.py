"""Resumable collection (E6, O4): a broken run and its continuation give what an unbroken one gives."""

import pytest
from pyspark.sql import functions as F

from poicraft.operators import mesh
from poicraft.plans import collect as C
from poicraft.session import scratch_path

BOX = dict(sw=(0.0, 0.0), ne=(7.0, 6.0), nx=6, ny=14, cap=3, block_cells=6, step_blocks=3)


def venues(spark):
    k = F.col("id")
    return spark.range(0, 900, 1, 4).select(
        k, F.when(k % 3 == 0, F.lit(1.3)).otherwise((k % 71) / 10.0).alias("lat"), F.when(k % 3 == 0, F.lit(2.2)).otherwise((k % 59) / 10.0).alias("lng"),
        F.array(F.concat(F.lit("cat"), (k % 4).cast("string"))).alias("cat_id")).filter("lat < 4 or lat > 5.1")


def by_block(spark, out):
    """Rows of every block's folder, as stored."""
    rows = {}
    for r in spark.read.parquet(f"{out}/{C.SWEEP}").collect():
        rows.setdefault(r.block, []).append((r.cell_id, r["rank"], r.id, r.lat, r.lng, tuple(r.cat_id)))
    return {b: sorted(v) for b, v in rows.items()}


def whole(spark):
    out = scratch_path(spark, "collect-whole")
    C.collect_mesh(spark, venues(spark), out, **BOX)
    return by_block(spark, out)


def test_unbroken_run_equals_the_sweep(spark):
    out = scratch_path(spark, "collect")
    got = C.collect_mesh(spark, venues(spark), out, **BOX)
    want = mesh.mesh_sweep(venues(spark), BOX["sw"], BOX["ne"], 6, 14, 3)
    key = lambda df: sorted((r.cell_id, r["rank"], r.id) for r in df.collect())
    assert key(got) == key(want)
    cells = {r.cell_id: r.n for r in C.progress(spark, out).collect()}
    assert sorted(cells) == list(range(84)) and sum(cells.values()) == want.count() and 0 in cells.values()


@pytest.mark.parametrize("where", ["before", "after"])
def test_broken_run_goes_on(spark, monkeypatch, where):
    """The third step fails before or after its files are written."""
    out, calls, record, first = scratch_path(spark, "collect-broken"), [], C._record, mesh.first_of_cells

    def failing(step):
        def run(*args):
            calls.append(1)
            if len(calls) == 3:
                raise RuntimeError("executor lost")
            return step(*args)
        return run

    target = (C, "_record", record) if where == "after" else (C.mesh, "first_of_cells", first)
    with monkeypatch.context() as m:
        m.setattr(target[0], target[1], failing(target[2]))
        with pytest.raises(RuntimeError):
            C.collect_mesh(spark, venues(spark), out, **BOX)
    done = {r.block for r in C.progress(spark, out).collect()}
    assert done == set(range(6))  # two steps of three blocks
    got = C.collect_mesh(spark, venues(spark), out, **BOX)
    assert by_block(spark, out) == whole(spark)
    assert got.count() == sum(map(len, whole(spark).values()))
    again = C.collect_mesh(spark, venues(spark), out, **BOX)  # nothing is left to do
    assert by_block(spark, out) == whole(spark) and again.count() == got.count()


def test_a_task_that_fails_in_a_step_leaves_no_progress(spark):
    out = scratch_path(spark, "collect-task")
    bad = venues(spark).withColumn("lat", F.when(F.col("id") == 700, F.raise_error(F.lit("task lost")).cast("double")).otherwise(F.col("lat")))
    with pytest.raises(Exception, match="task lost"):
        C.collect_mesh(spark, bad, out, **BOX)
    assert C.progress(spark, out).count() == 0
    C.collect_mesh(spark, venues(spark), out, **BOX)
    assert by_block(spark, out) == whole(spark)


def test_start_ordinal_and_no_venues(spark):
    out = scratch_path(spark, "collect-start")
    got = C.collect_mesh(spark, venues(spark), out, start=40, **BOX)
    assert min(r.cell_id for r in got.collect()) >= 39 and C.progress(spark, out).count() == 84 - 39
    C.collect_mesh(spark, venues(spark), out, **BOX)  # the cells before are still pending
    assert by_block(spark, out) == whole(spark)
    empty = C.collect_mesh(spark, venues(spark).limit(0), scratch_path(spark, "collect-empty"), **BOX)
    assert empty.count() == 0
