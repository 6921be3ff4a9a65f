"""Atomic publication (K1, K7): a broken write leaves what was there, readers see whole runs."""

import pytest
from pyspark.sql import functions as F

from poicraft.plans import bindings as B
from poicraft.session import scratch_path
from poicraft.sinks import publish as P, writers as W
from poicraft.sources import readers as R

SF = "/root/testdata/sf0.001"


def numbers(spark, n, tag="x"):
    return spark.range(0, n, 1, 4).select("id", F.lit(tag).alias("tag"))


def broken(df, at=5):
    """The same rows, but the task of one of them fails."""
    return df.withColumn("tag", F.when(F.col("id") == at, F.raise_error(F.lit("task lost"))).otherwise(F.col("tag")))


@pytest.mark.parametrize("fmt", ["parquet", "json"])
def test_a_failed_overwrite_leaves_the_old_collection(spark, fmt):
    path = scratch_path(spark, "atomic")
    W.write_collection(numbers(spark, 10, "old"), path, fmt)
    with pytest.raises(Exception, match="task lost"):
        W.write_collection(broken(numbers(spark, 10, "new")), path, fmt)
    assert {(r.id, r.tag) for r in R.load_collection(spark, path, fmt).collect()} == {(i, "old") for i in range(10)}
    W.write_collection(numbers(spark, 20, "new"), path, fmt)
    assert {(r.id, r.tag) for r in R.load_collection(spark, path, fmt).collect()} == {(i, "new") for i in range(20)}


def test_a_collection_may_be_derived_from_itself(spark):
    path = scratch_path(spark, "self")
    W.write_collection(numbers(spark, 10), path)
    for _ in range(3):
        old = R.load_collection(spark, path)
        W.write_collection(old.unionAll(old), path)
    assert R.load_collection(spark, path).count() == 80


def test_an_open_reader_keeps_its_run_and_old_runs_go(spark):
    path = scratch_path(spark, "kept")
    W.write_collection(numbers(spark, 3), path)
    reader = R.load_collection(spark, path)
    W.write_collection(numbers(spark, 4), path)
    assert reader.count() == 3 and R.load_collection(spark, path).count() == 4
    with pytest.raises(Exception, match="task lost"):
        W.write_collection(broken(numbers(spark, 10)), path)
    for n in range(5, 9):
        W.write_collection(numbers(spark, n), path)
    assert R.load_collection(spark, path).count() == 8
    assert len(P._listed(spark, f"{path}/{P.RUNS}")) == len(P._numbers(spark, path)) == P.KEEP


def test_the_second_of_two_writers_of_a_number_fails(spark):
    path = scratch_path(spark, "race")

    def late(folder):
        numbers(spark, 2, "late").write.parquet(folder)
        W.write_collection(numbers(spark, 2, "first"), path)  # commits meanwhile

    with pytest.raises(Exception, match="exists"):
        P.publish(spark, path, {W.COLLECTION: late})
    assert {r.tag for r in R.load_collection(spark, path).collect()} == {"first"}


def test_dual_shows_both_halves_or_neither(spark):
    from poicraft.operators.entities import response_entities
    base = scratch_path(spark, "dual")
    raw = B.responses(spark, SF)
    mapped = response_entities(raw, "2019-05-23 12:00:00")
    with pytest.raises(Exception, match="task lost"):
        W.write_dual(raw, mapped.withColumn("x", F.raise_error(F.lit("task lost"))), base, "run-1")
    assert R.load_dual(spark, base, "run-1") is None
    W.write_dual(raw, mapped, base, "run-1")
    both = R.load_dual(spark, base, "run-1")
    assert both["raw"].count() == raw.count() and both["mapped"].count() == mapped.count() > 0


def test_plain_files_and_globs_are_read_as_they_are(spark):
    path = scratch_path(spark, "plain")
    numbers(spark, 5).write.parquet(f"{path}/a")
    numbers(spark, 6).write.parquet(f"{path}/b")
    assert R.load_collection(spark, f"{path}/a").count() == 5 and R.load_collection(spark, f"{path}/*").count() == 11
