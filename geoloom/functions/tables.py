"""Table functions for SQL: cells of an envelope, parts of a geometry, tiles of a raster."""

from __future__ import annotations

import math

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..kernel import model


class Cells:
    """``geo_cells(xmin, ymin, xmax, ymax, size)`` -> the grid cells that an envelope covers."""

    def eval(self, xmin: float, ymin: float, xmax: float, ymax: float, size: float):
        if None in (xmin, ymin, xmax, ymax, size):
            return
        for cx in range(math.floor(xmin / size), math.floor(xmax / size) + 1):
            for cy in range(math.floor(ymin / size), math.floor(ymax / size) + 1):
                yield cx, cy


class Dump:
    """``geo_dump(geom)`` -> the simple parts of a geometry, numbered from 1."""

    def eval(self, geom: bytes):
        if geom is not None:
            for n, p in enumerate(model.simple_parts(model.from_wkb(geom)), 1):
                yield n, bytes(model.to_wkb(p))


class RasterTiles:
    """``raster_tiles(width, height, size)`` -> pixel tiles of a raster."""

    def eval(self, width: int, height: int, size: int):
        for y in range(0, height, size):
            for x in range(0, width, size):
                yield x, y, min(size, width - x), min(size, height - y)


def register_table_functions(spark: SparkSession) -> list[str]:
    spark.udtf.register("geo_cells", udtf(Cells, returnType="cx bigint, cy bigint"))
    spark.udtf.register("geo_dump", udtf(Dump, returnType="part int, geom binary"))
    spark.udtf.register("raster_tiles", udtf(RasterTiles, returnType="x int, y int, width int, height int"))
    return ["geo_cells", "geo_dump", "raster_tiles"]
