"""Map clusters and extents."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediacat.functions.geo import FINEST_CELL, GRID_DEGREES, grid_precision
from mediacat.operators.filters import in_bounds

# Fixed value: from this zoom on every file is its own marker.
SINGLE_ZOOM = 16
# Up to this zoom each grid halves that of the zoom before.
NESTED_ZOOM = min(SINGLE_ZOOM - 1, math.floor(math.log2(GRID_DEGREES / FINEST_CELL)))


def map_clusters(
    media: DataFrame, south: float, west: float, north: float, east: float, zoom: int
) -> DataFrame:
    """cluster_lat, cluster_lon, count, representative_id, path, filename per grid cell.

    Grouping is on the whole-number cell index and combines map-side, so hot cells cost
    nothing extra: one pass, whatever the box and zoom. The representative is the least id; a
    repeated id gives the least path with the file name of that row.
    """
    rows = in_bounds(media, south, west, north, east)
    if zoom >= SINGLE_ZOOM:
        return rows.select(
            F.col("latitude").alias("cluster_lat"),
            F.col("longitude").alias("cluster_lon"),
            F.lit(1).cast("bigint").alias("count"),
            F.col("id").alias("representative_id"),
            "path",
            "filename",
        )
    p = grid_precision(zoom)
    cell = [
        F.round(F.col("latitude") / p).cast("bigint").alias("__y"),
        F.round(F.col("longitude") / p).cast("bigint").alias("__x"),
    ]
    cells = rows.groupBy(*cell).agg(F.count("*").alias("count"), F.min(F.struct("id", "path", "filename")).alias("__rep"))
    return _clusters(cells, p)


def _clusters(cells: DataFrame, p: float) -> DataFrame:
    return cells.select(
        (F.col("__y") * p).alias("cluster_lat"),
        (F.col("__x") * p).alias("cluster_lon"),
        "count",
        F.col("__rep.id").alias("representative_id"),
        "__rep.path",
        "__rep.filename",
    )


def map_pyramid(media: DataFrame, zoom: int = NESTED_ZOOM) -> DataFrame:
    """Half cells of the grid of ``zoom``, from which ``pyramid_clusters`` gives every coarser zoom.

    A half cell is floor(2 * |x| / p) with the sign of x. Grids halve from zoom to zoom, so half
    cells nest: a coarser one is the quotient by a power of two, and the cell that x is
    rounded to, half away from zero, is (half cell + 1) div 2. ``zoom`` is at most NESTED_ZOOM. Columns: y, x, south, west (signs),
    count, rep (id, path, filename). One row per half cell in use, however many files.
    """
    p = grid_precision(zoom)
    rows = in_bounds(media, -90, -180, 90, 180)
    half = {n: F.floor(F.abs(F.col(c)) / p * 2).cast("bigint") for n, c in (("y", "latitude"), ("x", "longitude"))}
    signs = {"south": F.col("latitude") < 0, "west": F.col("longitude") < 0}
    return rows.withColumns(half | signs).groupBy("y", "x", "south", "west").agg(
        F.count("*").alias("count"), F.min(F.struct("id", "path", "filename")).alias("rep")
    )


def pyramid_clusters(pyramid: DataFrame, zoom: int, built: int = NESTED_ZOOM) -> DataFrame:
    """The clusters of ``map_clusters`` over the whole world at a zoom up to that of the pyramid.

    ``built`` is the zoom of ``map_pyramid``. A pyramid is read instead of the files, once it is
    stored: its rows are cells, not files.
    """
    if not 0 <= zoom <= built:
        raise ValueError(f"zoom must lie between 0 and {built}")
    p = grid_precision(zoom)
    nested = round(p / grid_precision(built))

    def cell(half: str, negative: str):
        own = F.expr(f"({half} div {nested} + 1) div 2")
        return F.when(F.col(negative), -own).otherwise(own)

    cells = pyramid.groupBy(cell("y", "south").alias("__y"), cell("x", "west").alias("__x")).agg(
        F.sum("count").alias("count"), F.min("rep").alias("__rep")
    )
    return _clusters(cells, p)


def bounds(df: DataFrame, lat: str = "latitude", lon: str = "longitude", pad: float = 0.1) -> DataFrame:
    """One row: south, west, north, east, widened on each side by a share of the extent."""
    ends = df.agg(
        F.min(lat).alias("s"), F.max(lat).alias("n"), F.min(lon).alias("w"), F.max(lon).alias("e")
    )
    dy, dx = (F.col("n") - F.col("s")) * pad, (F.col("e") - F.col("w")) * pad
    return ends.select(
        (F.col("s") - dy).alias("south"),
        (F.col("w") - dx).alias("west"),
        (F.col("n") + dy).alias("north"),
        (F.col("e") + dx).alias("east"),
    )
