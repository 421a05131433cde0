"""Resampling by blocks equals the weighted mean of one table, whatever the borders of the blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.operators import raster as R


@pytest.mark.parametrize(("method", "new"), [("cubicspline", (90, 50)), ("lanczos", (31, 17)), ("bilinear", (20, 61))])
def test_blocks_equal_one_table(spark, monkeypatch, method, new):
    monkeypatch.setattr(R, "BLOCK", 16)
    h, w = 45, 30
    v = np.random.default_rng(4).random((h, w))
    radius, kernel = R.KERNELS[method]

    def matrix(n, size):
        out = np.zeros((n, size))
        for t in range(n):
            c, wide = (t + 0.5) * size / n - 0.5, max(1.0, size / n)
            k = np.arange(int(c - radius * wide) - 2, int(c + radius * wide) + 3)
            x = kernel((k - c) / wide)
            np.add.at(out[t], np.clip(k, 0, size - 1), x / x.sum())
        return out

    want = matrix(new[0], h) @ v @ matrix(new[1], w).T
    pixels = spark.createDataFrame([(1, int(y), int(x), float(v[y, x])) for y in range(h) for x in range(w)], "band int, y int, x int, v double")
    out = R.resample(pixels, w, h, new[1], new[0], method, ("band",))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" in plan and "Join" not in plan
    got = {(r.y, r.x): r.v for r in out.collect()}
    assert len(got) == new[0] * new[1]
    assert all(abs(got[y, x] - want[y, x]) < 1e-12 for y in range(new[0]) for x in range(new[1]))
