"""Operators that blend tables of tiles."""

import numpy as np
from pyspark.sql import functions as F

from geoloom.operators import raster as R


def test_tables_of_tiles_are_not_broadcast(spark):
    pixels = spark.range(4000).select(F.lit(1).alias("band"), (F.col("id") / 20).cast("int").alias("y"), (F.col("id") % 20).cast("int").alias("x"), (F.col("id") * 31 % 256).cast("double").alias("v"))
    for out in (R.clahe(pixels, 10, 8.0), R.dodging(pixels, 10)):
        joins = [x for x in out._jdf.queryExecution().executedPlan().toString().splitlines() if "BroadcastHashJoin" in x and "_y0" in x]
        assert not joins


def test_clahe_of_one_tile(spark):
    v = np.random.default_rng(2).integers(0, 40, 400)
    rows = [(1, int(i // 20), int(i % 20), float(x)) for i, x in enumerate(v)]
    n = np.bincount(v, minlength=256)
    clip = int(400 * 2.0 / 256)
    n = np.minimum(n, clip) + np.maximum(n - clip, 0).sum() // 256
    cdf = np.cumsum(n)
    least = cdf[cdf > 0][0]
    table = np.floor(np.clip((cdf - least) * (255.0 / (400 - least + 1)), 0, 255))
    got = {(r.y, r.x): r.v for r in R.clahe(spark.createDataFrame(rows, "band int, y int, x int, v double"), 20, 2.0).collect()}
    assert got == {(y, x): table[int(p)] for _, y, x, p in rows}
