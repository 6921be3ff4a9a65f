"""E6 as a resumable job: progress is data, not an ordinal kept by hand.

The mesh is cut into blocks of consecutive cells. The venues are dealt to their blocks once
(published, so a broken run leaves nothing half written); then blocks are swept step by step. A step
writes its blocks' cells by dynamic partition overwrite and only then records them in
``progress``, a table with a row per finished cell. A run on the same folder takes the
cells that are not in it (an anti join), whatever the run before got to: blocks that were
written but not recorded are simply written again, with the same rows.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from poicraft.operators import mesh
from poicraft.operators.dedup import orderable
from poicraft.sinks.publish import publish, published

ASSIGNED, PROGRESS, SWEEP = "assigned", "progress", "sweep"
# Cells of a block, by default a row of the city's mesh, and blocks swept in one step.
BLOCK_CELLS = mesh.CITY_NX
STEP_BLOCKS = 16

PROGRESS_SCHEMA = "cell_id bigint, n bigint, block bigint"


def _block(cells: int):
    return F.expr(f"cell_id div {int(cells)}")


def progress(spark: SparkSession, out: str) -> DataFrame:
    """``cell_id, n, block`` of every cell whose venues are written."""
    folder = published(spark, f"{out}/{PROGRESS}")
    return spark.createDataFrame([], PROGRESS_SCHEMA) if folder is None else spark.read.schema(PROGRESS_SCHEMA).parquet(folder["cells"])


def pending_cells(grid: DataFrame, done: DataFrame) -> DataFrame:
    """The cells of the grid that no run has finished."""
    return grid.join(done.select("cell_id"), "cell_id", "left_anti")


def _deal(venues: DataFrame, folder: str, sw, ne, nx: int, ny: int, lat: str, lng: str, cells: int) -> None:
    """Venues with their cell, stored by block; a crowded block spreads over several files."""
    kinds = {f.name: f.dataType for f in venues.schema.fields}
    tie = F.xxhash64(*[F.col(f"`{c}`") for c in venues.columns if orderable(kinds[c])])
    parts = int(venues.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = mesh.assign_cells(venues, sw, ne, nx, ny, lat, lng).withColumn("block", _block(cells))
    placed.repartitionByRange(parts, F.col("block"), tie).write.partitionBy("block").parquet(folder)


def collect_mesh(spark: SparkSession, venues: DataFrame, out: str, sw: mesh.Point = mesh.CITY_SW, ne: mesh.Point = mesh.CITY_NE,
                 nx: int = mesh.CITY_NX, ny: int = mesh.CITY_NY, cap: int = mesh.CELL_CAP, order_by: Sequence[str] = ("id",),
                 lat: str = "lat", lng: str = "lng", start: int = 0, block_cells: int = BLOCK_CELLS,
                 step_blocks: int = STEP_BLOCKS, most_steps: int | None = None) -> DataFrame:
    """Every cell's first ``cap`` venues under ``out``, from the ``start``-th cell on; continues
    what an earlier call on ``out`` left (its venues and parameters must be the same).

    Returns what has been collected so far: the venues with ``i, j, cell_id, rank, block``.
    ``most_steps`` ends the call early.
    """
    grid = mesh.mesh_resume(mesh.mesh_grid(spark, sw, ne, nx, ny), start).select("cell_id", _block(block_cells).alias("block"))
    # Blocks, not cells or venues: as many as the mesh has rows.
    blocks = [r.block for r in pending_cells(grid, progress(spark, out)).select("block").distinct().orderBy("block").collect()]
    dealt = published(spark, f"{out}/{ASSIGNED}")
    if dealt is None:
        dealt = publish(spark, f"{out}/{ASSIGNED}", {"venues": lambda folder: _deal(venues, folder, sw, ne, nx, ny, lat, lng, block_cells)})
    schema = mesh.assign_cells(venues, sw, ne, nx, ny, lat, lng).withColumn("block", _block(block_cells)).schema
    assigned = spark.read.schema(schema).parquet(dealt["venues"])
    steps = [blocks[k:k + step_blocks] for k in range(0, len(blocks), step_blocks)]
    for step in steps if most_steps is None else steps[:most_steps]:
        found = mesh.first_of_cells(mesh.mesh_resume(assigned.filter(F.col("block").isin(step)), start), cap, order_by)
        (found.repartition("block", F.pmod("cell_id", F.lit(8))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("block").parquet(f"{out}/{SWEEP}"))
        _record(spark, out, grid.filter(F.col("block").isin(step)), f"{out}/{SWEEP}")
    return collected(spark, out, schema.add("rank", T.LongType()))


def _record(spark: SparkSession, out: str, cells: DataFrame, sweep: str) -> None:
    """Adds the cells of a step, also the empty ones, to the progress table."""
    written = spark.read.schema(PROGRESS_SCHEMA).parquet(sweep).groupBy("cell_id").agg(F.count(F.lit(1)).alias("n"))
    now = cells.join(written, "cell_id", "left").select("cell_id", F.coalesce("n", F.lit(0)).alias("n"), "block")
    every = progress(spark, out).unionByName(now)  # a row per cell of the mesh
    publish(spark, f"{out}/{PROGRESS}", {"cells": lambda folder: every.coalesce(1).write.parquet(folder)})


def collected(spark: SparkSession, out: str, schema) -> DataFrame:
    """The venues of the finished cells."""
    done = progress(spark, out).select("cell_id")
    return spark.read.schema(schema).parquet(f"{out}/{SWEEP}").join(done, "cell_id", "left_semi").select(*schema.names)
