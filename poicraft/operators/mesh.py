"""S11 mesh of cells over a bounding box, O4 resume, R5 capped sweep."""

from __future__ import annotations

from typing import Sequence, Tuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

Point = Tuple[float, float]  # [lat, lng]

# The collection box ([lat, lng] corners), its cells along lng and
# lat, the venues requested per cell and the resume ordinal of the original run.
CITY_SW: Point = (19.269080, -99.255295)
CITY_NE: Point = (19.562263, -99.014593)
CITY_NX, CITY_NY = 60, 70
CELL_CAP = 200
RESUME_CELL = 3144


def extent(df: DataFrame, lat: str = "lat", lng: str = "lng") -> Tuple[Point, Point]:
    """South-west and north-east corners of the points (one distributed aggregate)."""
    row = df.agg(F.min(lat), F.min(lng), F.max(lat), F.max(lng)).first()
    return (row[0], row[1]), (row[2], row[3])


def mesh_grid(spark: SparkSession, sw: Point = CITY_SW, ne: Point = CITY_NE,
              nx: int = CITY_NX, ny: int = CITY_NY) -> DataFrame:
    """``nx`` × ``ny`` cells, row-major (j outer, i inner), as a distributed range.

    ``dx = (ne.lng - sw.lng) / nx`` and ``dy = (ne.lat - sw.lat) / ny``; cell
    ``cell_id = j * nx + i`` spans ``[sw + (i, j) * d, sw + (i + 1, j + 1) * d]``;
    ``key = 'i-j'`` as in the original string keys.
    """
    dx = (float(ne[1]) - float(sw[1])) / nx
    dy = (float(ne[0]) - float(sw[0])) / ny
    lat0, lng0 = float(sw[0]), float(sw[1])
    cells = spark.range(nx * ny).withColumnRenamed("id", "cell_id")
    i = F.col("cell_id") % F.lit(nx)
    j = F.floor(F.col("cell_id") / F.lit(nx)).cast("bigint")
    cells = cells.select("cell_id", i.alias("i"), j.alias("j"))
    return cells.select(
        "cell_id", "i", "j",
        F.concat(F.col("i").cast("string"), F.lit("-"), F.col("j").cast("string")).alias("key"),
        (F.lit(lat0) + F.col("j").cast("double") * F.lit(dy)).alias("sw_lat"),
        (F.lit(lng0) + F.col("i").cast("double") * F.lit(dx)).alias("sw_lng"),
        (F.lit(lat0) + (F.col("j") + 1).cast("double") * F.lit(dy)).alias("ne_lat"),
        (F.lit(lng0) + (F.col("i") + 1).cast("double") * F.lit(dx)).alias("ne_lng"),
    )


def mesh_resume(grid: DataFrame, start: int = RESUME_CELL) -> DataFrame:
    """Cells from the ``start``-th on, counted from 1 (``cell_id`` counts from 0).

    Takes the grid or a sweep, any frame with a ``cell_id``.
    """
    return grid.filter(F.col("cell_id") >= F.lit(start - 1))


def assign_cells(df: DataFrame, sw: Point, ne: Point, nx: int, ny: int,
                 lat: str = "lat", lng: str = "lng") -> DataFrame:
    """Cell of each point by arithmetic (an equi key, no range join).

    Cells are half-open ``[sw, ne)``; the outer top/right edge belongs to the
    last cell. Points outside the box are dropped.
    """
    dx = (float(ne[1]) - float(sw[1])) / nx
    dy = (float(ne[0]) - float(sw[0])) / ny
    lat0, lng0, lat1, lng1 = float(sw[0]), float(sw[1]), float(ne[0]), float(ne[1])
    inside = ((F.col(lat) >= lat0) & (F.col(lat) <= lat1)
              & (F.col(lng) >= lng0) & (F.col(lng) <= lng1))
    i = F.least(F.floor((F.col(lng) - F.lit(lng0)) / F.lit(dx)), F.lit(nx - 1)).cast("bigint")
    j = F.least(F.floor((F.col(lat) - F.lit(lat0)) / F.lit(dy)), F.lit(ny - 1)).cast("bigint")
    return df.filter(inside).withColumn("i", i).withColumn("j", j) \
        .withColumn("cell_id", F.col("j") * F.lit(nx) + F.col("i"))


def first_of_cells(cells: DataFrame, cap: int = CELL_CAP, order_by: Sequence[str] = ("id",)) -> DataFrame:
    """The first ``cap`` venues of every cell by ``order_by``, with their ``rank`` from 1.

    ``row_number() <= cap`` lets Spark insert a partial per-group limit before
    the shuffle (WindowGroupLimit), so a dense cell sends at most ``cap`` rows per
    input partition instead of all its rows.
    """
    w = Window.partitionBy("cell_id").orderBy(*order_by)
    return cells.withColumn("rank", F.row_number().over(w).cast("bigint")) \
        .filter(F.col("rank") <= F.lit(cap))


def mesh_sweep(df: DataFrame, sw: Point = CITY_SW, ne: Point = CITY_NE, nx: int = CITY_NX,
               ny: int = CITY_NY, cap: int = CELL_CAP, order_by: Sequence[str] = ("id",),
               lat: str = "lat", lng: str = "lng") -> DataFrame:
    """Every cell's first ``cap`` venues by ``order_by``."""
    return first_of_cells(assign_cells(df, sw, ne, nx, ny, lat, lng), cap, order_by)
