"""Raster operators on pixel tables.

A raster is a DataFrame of pixels: ``y, x`` (0-based, row 0 on top), one column for each band in the wide form or
``band, v`` in the long form.  Several rasters share a table through key columns, named in ``by``.  Statistics are
small aggregates joined back; focal operators gather neighbours with one shuffle on blocks with halos.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.colors import to_byte

BLOCK = 256


def melt(pixels: DataFrame, bands: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """Wide to long: ``(by, band, y, x, v)``, bands counted from 1."""
    values = F.explode(F.array(*[F.struct(F.lit(n).alias("band"), F.col(c).cast("double").alias("v")) for n, c in enumerate(bands, 1)]))
    return pixels.select(*by, "y", "x", values.alias("_b")).select(*by, "_b.band", "y", "x", "_b.v")


def widen(pixels: DataFrame, count: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Long to wide: ``b1..bn``; the bands are named, so no pass over the data finds them."""
    picks = [F.max(F.when(F.col("band") == n, F.col("v"))).alias(f"b{n}") for n in range(1, count + 1)]
    return pixels.groupBy(*by, "y", "x").agg(*picks)


def from_arrays(rows: DataFrame, row_col: str, array_col: str) -> DataFrame:
    """Pixels of a table that holds one array of values for each raster row."""
    return rows.select(F.col(row_col).cast("int").alias("y"), F.posexplode(array_col).alias("x", "v")).withColumn("v", F.col("v").cast("double"))


def region(pixels: DataFrame, x: int, y: int, width: int, height: int) -> DataFrame:
    """Pixels of a window; the ranges reach the scan."""
    return pixels.where((F.col("x") >= x) & (F.col("x") < x + width) & (F.col("y") >= y) & (F.col("y") < y + height))


# --- statistics ----------------------------------------------------------------------------------------------


def statistics(pixels: DataFrame, v: str = "v", by: tuple[str, ...] = (), nodata: float | None = None, share: float | None = None) -> DataFrame:
    """``min, max, mean, stddev`` (population) and ``n`` of the valid values; ``share`` samples for a quick look."""
    rows = pixels.sample(share, 7) if share else pixels
    c = F.col(v).cast("double")
    ok = c.isNotNull() & ~F.isnan(c) & (F.lit(True) if nodata is None else c != nodata)
    rows = rows.where(ok)
    return rows.groupBy(*by).agg(F.min(c).alias("min"), F.max(c).alias("max"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("stddev"), F.count("*").alias("n"))


def histogram(pixels: DataFrame, v: str, low: float, high: float, buckets: int) -> DataFrame:
    """``(bin, n)`` over equal bins of [low, high], empty ones included; the top end is in the last bin."""
    c = F.col(v).cast("double")
    at = F.least(F.floor((c - low) / ((high - low) / buckets)), F.lit(buckets - 1)).cast("int")
    found = pixels.where((c >= low) & (c <= high) & ~F.isnan(c)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    bins = pixels.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bin"))
    return bins.join(F.broadcast(found), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def byte_histogram(pixels: DataFrame, by: tuple[str, ...] = ("band",), v: str = "v") -> DataFrame:
    """``(by, bin, n)`` of the values 0..255 that occur."""
    return pixels.groupBy(*by, F.col(v).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def cumulative(hist: DataFrame, by: tuple[str, ...] = ("band",)) -> DataFrame:
    """``cdf`` (counts), ``total`` and ``share`` (0..1) of a histogram of at most 256 bins a key."""
    w = Window.partitionBy(*by)
    upto = w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    out = hist.withColumns({"cdf": F.sum("n").over(upto), "total": F.sum("n").over(w)})
    return out.withColumn("share", F.col("cdf") / F.col("total"))


def dense(hist: DataFrame, by: tuple[str, ...] = ("band",)) -> DataFrame:
    """A byte histogram with all 256 bins for each key."""
    keys = hist.select(*by).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(255))))
    return keys.join(hist, [*by, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def color_statistics(pixels: DataFrame, bands: tuple[str, str, str] = ("b1", "b2", "b3")) -> DataFrame:
    """One row: mean, population standard deviation, least and greatest of red, green and blue."""
    if len(bands) < 3:
        raise ValueError("colour statistics need three bands")
    aggs = []
    for name, b in zip("rgb", bands, strict=False):
        c = F.col(b).cast("double")
        aggs += [F.avg(c).alias(f"mean_{name}"), F.stddev_pop(c).alias(f"std_{name}"), F.min(c).alias(f"min_{name}"), F.max(c).alias(f"max_{name}")]
    return pixels.agg(*aggs)


def _few(table: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """A table with a row (or 256) for each value of ``by``: broadcast where that is a band at most, else as Spark sees fit."""
    return F.broadcast(table) if set(by) <= {"band"} else table


def normalize(pixels: DataFrame, low: float, high: float, v: str = "v", by: tuple[str, ...] = ()) -> DataFrame:
    """Values stretched from their own range to [low, high]; NaN stays and doesn't count; no range, no change."""
    c = F.col(v)
    s = pixels.where(~F.isnan(c)).groupBy(*by).agg(F.min(c).alias("_lo"), F.max(c).alias("_hi"))
    joined = pixels.join(_few(s, by), list(by), "left") if by else pixels.crossJoin(F.broadcast(s))
    span = F.col("_hi") - F.col("_lo")
    out = F.when(F.isnan(c) | span.isNull() | (span == 0), c).otherwise((c - F.col("_lo")) / F.when(span == 0, 1.0).otherwise(span) * (high - low) + low)
    return joined.withColumn(v, out).drop("_lo", "_hi")


# --- focal ---------------------------------------------------------------------------------------------------


def _blocks(pixels: DataFrame, half: int, by: tuple[str, ...], block: int) -> DataFrame:
    """Pixels dealt to the blocks that need them: their own, and those whose halo they are in."""
    span = lambda c: F.sequence(F.floor((F.col(c) - half) / block), F.floor((F.col(c) + half) / block))
    return pixels.withColumn("_by", F.explode(span("y"))).withColumn("_bx", F.explode(span("x")))


def focal(pixels: DataFrame, half: int, f: Callable[[np.ndarray], np.ndarray], by: tuple[str, ...] = (), block: int = BLOCK, whole: bool = False) -> DataFrame:
    """``(by, y, x, v)`` with ``f`` applied to every block with its halo of ``half`` pixels.

    ``f`` maps a 2-D array (NaN where there is no pixel) to one of the same shape.  Unless ``whole``, pixels
    within ``half`` of the raster's edge keep their value.  Each pixel goes to the few blocks that see it, so the
    shuffle grows with the pixels alone and a block's memory is fixed.
    """
    size = pixels.groupBy(*by).agg(F.max("y").alias("_h"), F.max("x").alias("_w"))
    rows = pixels.select(*by, "y", "x", F.col("v").cast("double").alias("v"))
    dealt = _blocks(rows, half, by, block)
    dealt = dealt.join(_few(size, by), list(by)) if by else dealt.crossJoin(F.broadcast(size))
    kinds = {n: t for n, t in rows.dtypes}
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in by), "y int, x int, v double"])

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        by_, bx_ = int(frame["_by"].iloc[0]), int(frame["_bx"].iloc[0])
        y0, x0 = by_ * block - half, bx_ * block - half
        grid = np.full((block + 2 * half, block + 2 * half), np.nan)
        ys, xs = frame["y"].to_numpy() - y0, frame["x"].to_numpy() - x0
        grid[ys, xs] = frame["v"].to_numpy()
        with np.errstate(all="ignore"):
            out = f(grid)
        mine = (ys >= half) & (ys < half + block) & (xs >= half) & (xs < half + block)
        y, x, v = frame["y"].to_numpy()[mine], frame["x"].to_numpy()[mine], frame["v"].to_numpy()[mine]
        found = out[ys[mine], xs[mine]]
        if not whole:
            h, w = int(frame["_h"].iloc[0]), int(frame["_w"].iloc[0])
            inner = (y >= half) & (x >= half) & (y <= h - half) & (x <= w - half)
            found = np.where(inner, found, v)
        return pd.DataFrame({**{k: frame[k].to_numpy()[mine] for k in by}, "y": y.astype("int32"), "x": x.astype("int32"), "v": found})

    return dealt.groupBy(*by, "_by", "_bx").applyInPandas(run, schema)


def _windows(grid: np.ndarray, half: int) -> np.ndarray:
    padded = np.pad(grid, half, constant_values=np.nan)
    return np.lib.stride_tricks.sliding_window_view(padded, (2 * half + 1, 2 * half + 1)).reshape(*grid.shape, -1)


def _reduce(kind: str, half: int) -> Callable[[np.ndarray], np.ndarray]:
    def f(grid: np.ndarray) -> np.ndarray:
        out = np.empty_like(grid)
        for at in range(0, len(grid), 32):
            rows = grid[max(0, at - half) : at + 32 + half]
            w = _windows(rows, half)[min(at, half) : min(at, half) + len(grid[at : at + 32])]
            seen = ~np.isnan(w)
            if kind == "gaussian":
                d = np.arange(-half, half + 1) ** 2
                sigma = (2 * half + 1) / 6.0
                k = np.exp(-(d[:, None] + d[None]) / (2 * sigma * sigma)).ravel()
                total = np.where(seen, w, 0) @ k
                out[at : at + 32] = total / (seen @ k)
            elif kind == "mean":
                out[at : at + 32] = np.where(seen, w, 0).sum(-1) / seen.sum(-1)
            else:
                fill = {"min": np.inf, "max": -np.inf}.get(kind)
                if fill is not None:
                    r = getattr(np.where(seen, w, fill), kind)(-1)
                else:
                    s = np.sort(w, -1)  # NaN last
                    n = seen.sum(-1)[..., None]
                    pick = lambda k: np.take_along_axis(s, np.maximum(k, 0), -1)[..., 0]  # noqa: E731,B023
                    r = (pick((n - 1) // 2) + pick(n // 2 - (n > 0) * 0)) / 2
                out[at : at + 32] = np.where(seen.any(-1), r, np.nan)
        return out

    return f


def _stencil(kernels: list[list[list[float]]]) -> Callable[[np.ndarray], np.ndarray]:
    """Magnitude of 3 x 3 kernels' responses (the response itself for one); NaN counts as nothing."""

    def f(grid: np.ndarray) -> np.ndarray:
        p = np.pad(np.nan_to_num(grid), 1)
        found = []
        for k in kernels:
            found.append(sum(k[i][j] * p[i : i + grid.shape[0], j : j + grid.shape[1]] for i in range(3) for j in range(3) if k[i][j]))
        return found[0] if len(found) == 1 else np.sqrt(sum(x * x for x in found))

    return f


SOBEL = [[[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]], [[-1, -2, -1], [0, 0, 0], [1, 2, 1]]]
LAPLACE = [[[0, 1, 0], [1, -4, 1], [0, 1, 0]]]
FILTERS = ("mean", "median", "min", "max", "gaussian", "sobel", "laplace")


def apply_filter(pixels: DataFrame, kind: str, size: int = 3, by: tuple[str, ...] = (), block: int = BLOCK) -> DataFrame:
    """One of ``FILTERS`` over an odd window; pixels within half a window of the edge keep their value."""
    if kind not in FILTERS:
        raise ValueError(f"unknown filter {kind}")
    if size % 2 == 0 or size < 1 or kind in ("sobel", "laplace") and size < 3:
        raise ValueError("the window must be odd, and 3 at least for sobel and laplace")
    f = _stencil(SOBEL) if kind == "sobel" else _stencil(LAPLACE) if kind == "laplace" else _reduce(kind, size // 2)
    return focal(pixels, size // 2, f, by, block)


def wallis(pixels: DataFrame, mean: float, std: float, c: float, b: float, window: int = 31, by: tuple[str, ...] = (), block: int = BLOCK) -> DataFrame:
    """Wallis filter: local mean and deviation (edge-clamped windows) drawn towards the targets; bytes."""
    window = window if window > 0 else 31
    half = (window + (window % 2 == 0)) // 2
    c, b = min(max(c, 0.0), 1.0), min(max(b, 0.0), 1.0)

    def f(grid: np.ndarray) -> np.ndarray:
        seen = ~np.isnan(grid)
        sums = []
        for a in (seen.astype(float), np.where(seen, grid, 0), np.where(seen, grid, 0) ** 2):
            s = np.pad(np.pad(a, half).cumsum(0).cumsum(1), ((1, 0), (1, 0)))
            k = 2 * half + 1
            sums.append(s[k:, k:] - s[:-k, k:] - s[k:, :-k] + s[:-k, :-k])
        m = sums[1] / sums[0]
        var = sums[2] / sums[0] - m * m
        sd = np.maximum(np.where(var > 0, np.sqrt(np.maximum(var, 0)), 1.0), 1.0)
        return np.floor(np.clip((grid - m) * (c * std / sd) + b * mean + (1 - b) * m, 0, 255))

    return focal(pixels, half, f, by, block, whole=True)


# --- radiometry ----------------------------------------------------------------------------------------------


def apply_lut(pixels: DataFrame, lut: DataFrame, by: tuple[str, ...] = ("band",)) -> DataFrame:
    """Values replaced by ``lut(by, bin, to)``, at most 256 rows a key; others stay."""
    table = lut.select(*by, F.col("bin").alias("_bin"), "to")
    return pixels.withColumn("_bin", F.col("v").cast("int")).join(_few(table, by), [*by, "_bin"], "left").withColumn(
        "v", F.coalesce(F.col("to").cast("double"), "v")
    ).drop("_bin", "to")


def auto_levels_lut(pixels: DataFrame, clip_percent: float = 0.5, by: tuple[str, ...] = ("band",)) -> DataFrame:
    """Linear stretch between the first values beyond ``clip_percent`` of the pixels at either end."""
    hist = byte_histogram(pixels, by)
    c = cumulative(hist, by).withColumn("clip", F.floor(F.col("total") * clip_percent / 100.0))
    ends = c.groupBy(*by).agg(
        F.min(F.when(F.col("cdf") > F.col("clip"), F.col("bin"))).alias("lo"),
        F.max(F.when(F.col("total") - F.col("cdf") + F.col("n") > F.col("clip"), F.col("bin"))).alias("hi"),
    )
    ends = ends.withColumns({"lo": F.coalesce("lo", F.lit(0)), "hi": F.coalesce("hi", F.lit(255))})
    ends = ends.withColumn("hi", F.when(F.col("hi") <= F.col("lo"), F.col("lo") + 1).otherwise(F.col("hi")))
    out = F.when(F.col("bin") <= F.col("lo"), 0).when(F.col("bin") >= F.col("hi"), 255).otherwise(
        F.floor((F.col("bin") - F.col("lo")) * (255.0 / (F.col("hi") - F.col("lo"))))
    )
    return hist.join(ends, list(by)).select(*by, "bin", out.cast("int").alias("to"))


def equalize_lut(pixels: DataFrame, by: tuple[str, ...] = ("band",)) -> DataFrame:
    c = cumulative(byte_histogram(pixels, by), by).withColumn("least", F.min("cdf").over(Window.partitionBy(*by)))
    room = F.col("total") - F.col("least")
    out = F.when(F.col("cdf") <= F.col("least"), 0).otherwise(
        to_byte((F.col("cdf") - F.col("least")) * (255.0 / F.when(room == 0, 1).otherwise(room)))
    )
    return c.select(*by, "bin", out.cast("int").alias("to"))


def match_lut(source: DataFrame, reference: DataFrame, by: tuple[str, ...] = ("band",)) -> DataFrame:
    """For each source value the first reference value whose cumulative share is nearest: 256 x 256 rows a band."""
    s = cumulative(byte_histogram(source, by), by).select(*by, "bin", "share")
    r = cumulative(dense(byte_histogram(reference, by), by), by).select(*by, F.col("bin").alias("to"), F.col("share").alias("_r"))
    best = F.min(F.struct(F.abs(F.col("share") - F.col("_r")).alias("d"), F.col("to")))
    return s.join(_few(r, by), list(by)).groupBy(*by, "bin").agg(best.alias("b")).select(*by, "bin", F.col("b.to").alias("to"))


def white_balance(pixels: DataFrame, bands: tuple[str, ...] = ("b1", "b2", "b3")) -> DataFrame:
    """Grey world: each of three bands scaled to the mean of their means; fewer bands stay as they are."""
    if len(bands) < 3:
        return pixels
    means = pixels.agg(*[F.avg(F.col(b).cast("double")).alias(f"_{b}") for b in bands[:3]])
    joined = pixels.crossJoin(F.broadcast(means))  # one row
    grey = sum((F.col(f"_{b}") for b in bands[1:3]), F.col(f"_{bands[0]}")) / 3.0
    scaled = {b: to_byte(F.col(b) * F.when(F.col(f"_{b}") > 0, grey / F.col(f"_{b}")).otherwise(1.0)) for b in bands[:3]}
    return joined.withColumns(scaled).drop(*[f"_{b}" for b in bands[:3]])


def mean_std_match(pixels: DataFrame, target: DataFrame, strength: float = 1.0, by: tuple[str, ...] = ("band",)) -> DataFrame:
    """Bands drawn to the mean and deviation in ``target(by, mean, stddev)`` by ``strength`` from 0 to 1."""
    own = statistics(pixels, by=by).select(*by, F.col("mean").alias("_m"), F.col("stddev").alias("_s"))
    both = own.join(target.select(*by, F.col("mean").alias("_tm"), F.col("stddev").alias("_ts")), list(by))
    ratio = F.when(F.col("_s") > 0, F.col("_ts") / F.when(F.col("_s") > 0, F.col("_s")).otherwise(1.0)).otherwise(1.0)
    both = both.withColumn("_k", 1.0 + (ratio - 1.0) * strength).withColumn("_o", (F.col("_tm") - F.col("_m") * F.col("_k")) * strength)
    return pixels.join(_few(both.select(*by, "_k", "_o"), by), list(by)).withColumn("v", to_byte(F.col("v") * F.col("_k") + F.col("_o")).cast("double")).drop("_k", "_o")


def moment_match(pixels: DataFrame, reference: DataFrame, by: tuple[str, ...] = ("band",)) -> DataFrame:
    return mean_std_match(pixels, statistics(reference, by=by), 1.0, by)


def regression_balance(pixels: DataFrame, reference: DataFrame, x: int, y: int, width: int, height: int, by: tuple[str, ...] = ("band",)) -> DataFrame:
    """A line fitted over the overlap (zeros left out, more than 10 pixels) and applied to all; slope 0.5..2, offset -50..50."""
    a = region(pixels, x, y, width, height).where("v <> 0")
    b = region(reference, x, y, width, height).where("v <> 0").select(*by, "y", "x", F.col("v").alias("_r"))
    fit = a.join(b, [*by, "y", "x"]).groupBy(*by).agg(F.regr_slope("_r", "v").alias("_a"), F.regr_intercept("_r", "v").alias("_b"), F.count("*").alias("_n"))
    good = (F.col("_n") > 10) & F.col("_a").isNotNull()
    hold = lambda c, lo, hi: F.least(F.greatest(c, F.lit(lo)), F.lit(hi))
    fit = fit.select(*by, hold(F.when(good, F.col("_a")).otherwise(1.0), 0.5, 2.0).alias("_a"), hold(F.when(good, F.col("_b")).otherwise(0.0), -50.0, 50.0).alias("_b"))
    out = F.col("v") * F.coalesce("_a", F.lit(1.0)) + F.coalesce("_b", F.lit(0.0))
    return pixels.join(_few(fit, by), list(by), "left").withColumn("v", to_byte(out).cast("double")).drop("_a", "_b")


def _between_tiles(pixels: DataFrame, size: int, across: Column, down: Column) -> DataFrame:
    """The four tiles around each pixel (centres half a tile in) and its weights between them."""
    fx, fy = F.col("x") / float(size) - 0.5, F.col("y") / float(size) - 0.5
    hold = lambda c, n: F.least(F.greatest(c, F.lit(0)), n - 1).cast("int")
    return pixels.withColumns({
        "_x0": hold(F.floor(fx), across), "_x1": hold(F.floor(fx) + 1, across), "_y0": hold(F.floor(fy), down), "_y1": hold(F.floor(fy) + 1, down),
        "_wx": F.when(fx < 0, 0.0).otherwise(fx - F.floor(fx)), "_wy": F.when(fy < 0, 0.0).otherwise(fy - F.floor(fy)),
    })


def _blend(table: DataFrame, pixels: DataFrame, value: Callable[[Column], Column] = lambda v: v) -> DataFrame:
    """Bilinear mixture ``_mix`` of ``value`` of a table's ``_t`` at the four tiles of ``(band, _ty, _tx)``.

    The table's corners meet first, so pixels are joined once.  Tables of tiles grow with the raster and their size in
    memory is far beyond that of the scan they come from, so they are merged, never broadcast.
    """
    def corner(n: int, y: str, x: str) -> DataFrame:
        return table.select("band", F.col("_ty").alias(y), F.col("_tx").alias(x), F.col("_t").alias(f"_v{n}"))

    step = F.explode(F.array(F.lit(0), F.lit(1)))
    quads = corner(0, "_y0", "_x0").withColumn("_dx", step).withColumn("_dy", step)
    quads = quads.withColumns({"_x1": F.col("_x0") + F.col("_dx"), "_y1": F.col("_y0") + F.col("_dy")}).drop("_dx", "_dy")
    for n, (ty, tx) in enumerate((("_y0", "_x1"), ("_y1", "_x0"), ("_y1", "_x1")), 1):
        quads = quads.join(corner(n, ty, tx).hint("merge"), ["band", ty, tx])
    out = pixels.join(quads.hint("merge"), ["band", "_y0", "_x0", "_y1", "_x1"], "left")
    v0, v1, v2, v3 = (value(F.col(f"_v{n}")) for n in range(4))
    top = v0 * (1 - F.col("_wx")) + v1 * F.col("_wx")
    low = v2 * (1 - F.col("_wx")) + v3 * F.col("_wx")
    return out.withColumn("_mix", top * (1 - F.col("_wy")) + low * F.col("_wy"))


def _extent(pixels: DataFrame, size: int) -> tuple[DataFrame, Column, Column]:
    e = pixels.agg((F.floor(F.max("x") / size) + 1).alias("_nx"), (F.floor(F.max("y") / size) + 1).alias("_ny"))
    return pixels.crossJoin(F.broadcast(e)), F.col("_nx"), F.col("_ny")  # one row


def dodging(pixels: DataFrame, block: int = 128, strength: float = 1.0) -> DataFrame:
    """Block means, interpolated between block centres, drawn to the whole band's mean by ``strength``."""
    block = block if block > 0 else 128
    tile = {"_ty": F.floor(F.col("y") / block).cast("int"), "_tx": F.floor(F.col("x") / block).cast("int")}
    means = pixels.withColumns(tile).groupBy("band", "_ty", "_tx").agg(F.avg("v").alias("_t"))
    whole = pixels.groupBy("band").agg(F.avg("v").alias("_all"))
    sized, nx, ny = _extent(pixels, block)
    out = _blend(means, _between_tiles(sized, block, nx, ny)).join(F.broadcast(whole), "band")
    return out.select("band", "y", "x", to_byte(F.col("v") + (F.col("_all") - F.col("_mix")) * strength).cast("double").alias("v"))


def _clipped_tables(clip_limit: float):
    """UDF of a tile's histogram (``bin * 2**40 + n`` for each value that occurs): its equalised table of 256 bytes."""

    @F.pandas_udf("array<smallint>")
    def run(hist: pd.Series) -> pd.Series:
        out = []
        for h in hist:
            h = np.asarray(h, np.int64)
            n = np.zeros(256, np.int64)
            n[h >> 40] = h & ((1 << 40) - 1)
            size = int(n.sum())
            clip = math.floor(size * clip_limit / 256.0)
            n = np.minimum(n, clip) + int(np.maximum(n - clip, 0).sum()) // 256
            cdf = np.cumsum(n)
            least = int(cdf[cdf > 0][0]) if cdf[-1] > 0 else 0
            out.append(np.clip((cdf - least) * (255.0 / (size - least + 1)), 0.0, 255.0).astype(np.int16))
        return pd.Series(out, dtype=object)

    return run


def clahe(pixels: DataFrame, tile: int = 64, clip_limit: float = 2.0) -> DataFrame:
    """Contrast-limited equalisation: a clipped histogram's table for each tile, mixed between four tiles.

    As in the engine this follows, a tile whose ``clip_limit * pixels`` is below 256 has a limit of 0 and maps all to 0.
    """
    tile, clip_limit = tile if tile > 0 else 64, clip_limit if clip_limit > 0 else 2.0
    spot = {"_ty": F.floor(F.col("y") / tile).cast("int"), "_tx": F.floor(F.col("x") / tile).cast("int")}
    keys = ("band", "_ty", "_tx")
    hist = byte_histogram(pixels.withColumns(spot), keys).where("bin between 0 and 255")
    packed = F.collect_list(F.shiftleft(F.col("bin").cast("long"), 40) + F.col("n"))
    lut = hist.groupBy(*keys).agg(packed.alias("_h")).select(*keys, _clipped_tables(clip_limit)(F.col("_h")).alias("_t"))
    sized, nx, ny = _extent(pixels.withColumn("_bin", F.col("v").cast("int")), tile)
    out = _blend(lut, _between_tiles(sized, tile, nx, ny), lambda t: F.get(t, F.col("_bin")))
    return out.select("band", "y", "x", to_byte(F.col("_mix")).cast("double").alias("v"))


def gradient_blend(left: DataFrame, right: DataFrame, left_width: int, overlap_x: int, overlap_width: int, blend: int) -> DataFrame:
    """Two rasters side by side: left of the overlap the first, right of the blend the second, smoothstep between."""
    shift = left_width - overlap_width
    a = left.select("band", "y", "x", F.col("v").alias("_a"))
    b = right.select("band", "y", (F.col("x") + shift).alias("x"), F.col("v").alias("_b"))
    t = (F.col("x") - overlap_x) / float(blend)
    s = t * t * (3.0 - 2.0 * t)
    va, vb = F.coalesce("_a", F.lit(0.0)), F.coalesce("_b", F.lit(0.0))
    v = F.when(F.col("x") < overlap_x, va).when(F.col("x") >= overlap_x + blend, vb).otherwise(va * (1 - s) + vb * s)
    return a.join(b, ["band", "y", "x"], "full").select("band", "y", "x", to_byte(v).cast("double").alias("v"))


def color_correction_target(stats: DataFrame) -> DataFrame:
    """Targets that remove a colour cast: each band's mean becomes the mean of the means, its deviation stays."""
    grey = stats.agg(F.avg("mean").alias("_g"))
    return stats.crossJoin(F.broadcast(grey)).select("band", F.when(F.col("mean") > 0, F.col("_g")).otherwise(F.col("mean")).alias("mean"), "stddev")


METHODS = ("histogram", "mean_std", "moment", "wallis", "regression", "dodging")


def color_balance(pixels: DataFrame, reference: DataFrame | None, method: str, *, strength: float = 0.8, overlap: tuple[int, int, int, int] | None = None) -> DataFrame:
    """One of ``METHODS``; those that need a reference or an overlap raise without it."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method}")
    if method in ("histogram", "mean_std", "moment", "regression") and reference is None:
        raise ValueError(f"{method} needs a reference")
    if method == "histogram":
        return apply_lut(pixels, match_lut(pixels, reference))
    if method == "mean_std":
        return mean_std_match(pixels, statistics(reference, by=("band",)), strength)
    if method == "moment":
        return moment_match(pixels, reference)
    if method == "wallis":
        return wallis(pixels, 127.0, 40.0, 0.8, 0.9, by=("band",))
    if method == "dodging":
        return dodging(pixels, 128, strength)
    if overlap is None:
        raise ValueError("regression needs an overlap")
    return regression_balance(pixels, reference, *overlap)


def smart_balance(pixels: DataFrame, reference: DataFrame, overlap: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Large differences (mean 50, deviation 30) take histogram matching, an overlap over 100 x 100 regression, else mean and deviation."""
    a = statistics(pixels, by=("band",)).select("band", F.col("mean").alias("_m"), F.col("stddev").alias("_s"))
    gap = a.join(statistics(reference, by=("band",)), "band").agg(F.max(F.abs(F.col("_m") - F.col("mean"))), F.max(F.abs(F.col("_s") - F.col("stddev")))).first()
    if (gap[0] or 0) > 50 or (gap[1] or 0) > 30:
        return color_balance(pixels, reference, "histogram")
    if overlap and overlap[2] > 100 and overlap[3] > 100:
        return color_balance(pixels, reference, "regression", overlap=overlap)
    return color_balance(pixels, reference, "mean_std", strength=0.9)


# --- geometry of rasters -------------------------------------------------------------------------------------


def tiler(spark, width: int, height: int, tile_w: int, tile_h: int, overlap_x: int = 0, overlap_y: int = 0, start: int = 0, prefix: str = "tile") -> DataFrame:
    """Pixel tiles ``(name, index, row, col, x, y, width, height)``; tiles under a quarter of the size are left out."""
    step_x, step_y = tile_w - overlap_x, tile_h - overlap_y
    if step_x <= 0 or step_y <= 0:
        raise ValueError("the overlap must be smaller than the tile")
    cols, rows = -(-width // step_x), -(-height // step_y)
    t = spark.range(rows * cols).select(F.floor(F.col("id") / cols).cast("int").alias("row"), (F.col("id") % cols).cast("int").alias("col"))
    t = t.withColumns({"x": F.col("col") * step_x, "y": F.col("row") * step_y})
    t = t.withColumns({"width": F.least(F.lit(tile_w), F.lit(width) - F.col("x")), "height": F.least(F.lit(tile_h), F.lit(height) - F.col("y"))})
    # Left-out rows are the last ones, so a kept tile's number follows from its row and column.
    kept_cols = [c for c in range(cols) if min(tile_w, width - c * step_x) >= tile_w // 4]
    t = t.where((F.col("width") >= tile_w // 4) & (F.col("height") >= tile_h // 4))
    index = F.col("row") * len(kept_cols) + F.col("col") + start
    return t.select(F.format_string(prefix + "_%d_r%d_c%d", index, "row", "col").alias("name"), index.cast("int").alias("index"), "row", "col", "x", "y", "width", "height")


def mosaic(rasters: DataFrame, order: str | Column = "raster", nodata: float | None = None) -> DataFrame:
    """Pixels of several rasters on one grid: of the valid values at a place, the last in ``order`` stays.

    Rows are ``(raster, band, y, x, v)`` in mosaic coordinates; one partial aggregate, one shuffle.
    """
    c = F.col("v")
    ok = c.isNotNull() & ~F.isnan(c)
    if nodata is not None:
        ok = ok & (F.abs(c - nodata) > 1e-10)
    by = order if isinstance(order, Column) else F.col(order)
    return rasters.where(ok).groupBy("band", "y", "x").agg(F.max_by("v", by).alias("v"))


def mosaic_priority(rasters: DataFrame, priorities: dict[int, int] | None, nodata: float | None = None) -> DataFrame:
    """Higher priority wins, then the later raster; without a priority for every raster it is a plain mosaic."""
    if not priorities:
        return mosaic(rasters, nodata=nodata)
    table = F.create_map(*[F.lit(x) for p in priorities.items() for x in p])
    return mosaic(rasters, F.struct(F.try_element_at(table, F.col("raster")), F.col("raster")), nodata)


def align(pixels: DataFrame, gt: tuple[float, float, float, float], origin: tuple[float, float], res: tuple[float, float]) -> DataFrame:
    """Pixels moved to the grid of a mosaic: ``gt`` is (left, top, pixel width, pixel height) of the raster."""
    left, top, pw, ph = gt
    x = F.round((left + F.col("x") * pw - origin[0]) / res[0]).cast("int")
    y = F.round((origin[1] - (top - F.col("y") * ph)) / res[1]).cast("int")
    return pixels.withColumns({"x": x, "y": y})


def mosaic_info(headers: DataFrame) -> DataFrame:
    """Extent, finest resolution and size of a mosaic of ``headers(left, top, right, bottom, res_x, res_y, bands)``."""
    e = headers.agg(
        F.min("left").alias("left"), F.min("bottom").alias("bottom"), F.max("right").alias("right"), F.max("top").alias("top"),
        F.min("res_x").alias("res_x"), F.min("res_y").alias("res_y"), F.min("bands").alias("bands"), F.count("*").alias("rasters"),
        (F.min("bands") == F.max("bands")).alias("same_bands"),
    )
    return e.withColumns({
        "width": F.ceil((F.col("right") - F.col("left")) / F.col("res_x")).cast("int"),
        "height": F.ceil((F.col("top") - F.col("bottom")) / F.col("res_y")).cast("int"),
    })


def resampled_size(width: int, height: int, *, size: tuple[int, int] | None = None, resolution: tuple[float, float] | None = None, pixel: tuple[float, float] = (1.0, 1.0), factor: float | None = None) -> tuple[int, int]:
    """New size; a size goes before a resolution and that before a factor; truncated, 1 at least."""
    if size and size[0] > 0 and size[1] > 0:
        w, h = size
    elif resolution and resolution[0] > 0 and resolution[1] > 0:
        w, h = int(width * pixel[0] / resolution[0]), int(height * pixel[1] / resolution[1])
    elif factor and factor > 0:
        w, h = int(width * factor), int(height * factor)
    else:
        raise ValueError("a size, a resolution or a factor is needed")
    return max(1, w), max(1, h)


def _cubic(t: np.ndarray, a: float = -0.5) -> np.ndarray:
    t = np.abs(t)
    return np.where(t <= 1, (a + 2) * t**3 - (a + 3) * t**2 + 1, np.where(t < 2, a * t**3 - 5 * a * t**2 + 8 * a * t - 4 * a, 0))


def _spline(t: np.ndarray) -> np.ndarray:
    t = np.abs(t)
    return np.where(t <= 1, 2 / 3 - t**2 + t**3 / 2, np.where(t < 2, (2 - t) ** 3 / 6, 0))


KERNELS: dict[str, tuple[int, Callable[[np.ndarray], np.ndarray]]] = {
    "bilinear": (1, lambda t: np.maximum(1 - np.abs(t), 0)),
    "cubic": (2, _cubic),
    "cubicspline": (2, _spline),
    "lanczos": (3, lambda t: np.where(np.abs(t) < 3, np.sinc(t) * np.sinc(t / 3), 0)),
}


def _resample_blocks(
    pixels: DataFrame, scale: tuple[float, float], size: tuple[int, int], new: tuple[int, int], radius: int, kernel: Callable[[np.ndarray], np.ndarray], by: tuple[str, ...]
) -> DataFrame:
    """:func:`resample` by blocks of target pixels, in both directions at once."""
    block = [max(16, int(BLOCK / max(1.0, s))) for s in scale]
    dealt = pixels.select(*by, "y", "x", F.col("v").cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    for c, s, n, b in zip("yx", scale, new, block, strict=True):
        reach = radius * max(1.0, s) + 1
        low, high = (F.floor((F.col(c) + d + 0.5) / s - 0.5) for d in (-reach, reach))
        low, high = F.greatest(low, F.lit(0)), F.least(high + 1, F.lit(n - 1))
        dealt = dealt.where(high >= low).withColumn(f"_b{c}", F.explode(F.sequence(F.floor(low / b), F.floor(high / b))))
    kinds = dict(dealt.dtypes)

    def weights(first: int, axis: int) -> tuple[int, np.ndarray]:
        """First source index and weights (targets of the block by sources); beyond a border the border pixel counts."""
        s, n = scale[axis], size[axis]
        wide = max(1.0, s)
        at = (np.arange(first, min(first + block[axis], new[axis])) + 0.5) * s - 0.5
        low, high = math.floor(at[0] - radius * wide), math.ceil(at[-1] + radius * wide)
        k = np.arange(low, high + 1)
        w = kernel((k - at[:, None]) / wide)
        w[np.abs(k - at[:, None]) > radius * wide + 1] = 0
        w /= w.sum(1, keepdims=True)
        start, end = max(low, 0), min(high, n - 1)
        out = np.zeros((len(at), end - start + 1))
        np.add.at(out, (slice(None), np.clip(k, start, end) - start), w)
        return start, out

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = int(frame["_by"].iloc[0]) * block[0], int(frame["_bx"].iloc[0]) * block[1]
        (ys, wy), (xs, wx) = weights(y0, 0), weights(x0, 1)
        y, x, v = frame["y"].to_numpy() - ys, frame["x"].to_numpy() - xs, frame["v"].to_numpy()
        seen = (y >= 0) & (y < wy.shape[1]) & (x >= 0) & (x < wx.shape[1])
        total, many = np.zeros((2, wy.shape[1], wx.shape[1]))
        np.add.at(total, (y[seen], x[seen]), v[seen])
        np.add.at(many, (y[seen], x[seen]), 1.0)
        some = (wy != 0).astype(float) @ (many > 0) @ (wx != 0).astype(float).T > 0
        with np.errstate(all="ignore"):
            found = (wy @ total @ wx.T) / (wy @ many @ wx.T)
        ty, tx = np.nonzero(some)
        return pd.DataFrame({**{k: [frame[k].iloc[0]] * len(ty) for k in by}, "y": (ty + y0).astype("int32"), "x": (tx + x0).astype("int32"), "v": found[ty, tx]})

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in by), "y int, x int, v double"])
    return dealt.groupBy(*by, "_by", "_bx").applyInPandas(run, schema)


def resample(pixels: DataFrame, width: int, height: int, new_width: int, new_height: int, method: str = "nearest", by: tuple[str, ...] = ()) -> DataFrame:
    """``(by, y, x, v)`` at the new size.

    Nearest turns into index arithmetic: each source pixel lists the target pixels it covers.  The others give each
    target pixel a weighted mean of the source pixels under a kernel: source pixels are dealt to the blocks of targets
    that see them, so a task's memory is that of a block.  Far reductions are one explode and one aggregate instead.
    """
    sx, sy = width / new_width, height / new_height
    if method == "nearest":
        def span(c: str, s: float, n: int):
            low = F.ceil(F.col(c) / s - 0.5)
            high = F.ceil((F.col(c) + 1) / s - 0.5) - 1
            return F.when(high >= low, F.sequence(F.greatest(low, F.lit(0)), F.least(high, F.lit(n - 1)))).otherwise(F.array().cast("array<bigint>"))

        out = pixels.withColumn("_y", F.explode(span("y", sy, new_height))).withColumn("_x", F.explode(span("x", sx, new_width)))
        return out.select(*by, F.col("_y").cast("int").alias("y"), F.col("_x").cast("int").alias("x"), "v")
    radius, kernel = KERNELS[method]
    if max(sx, sy) <= 8:
        return _resample_blocks(pixels, (sy, sx), (height, width), (new_height, new_width), radius, kernel, by)

    def weights(s: float, n: int, size: int) -> DataFrame:
        """Weights of source index by target index: a table of one dimension."""
        wide = max(1.0, s)
        at = (np.arange(n) + 0.5) * s - 0.5
        rows = []
        for t, c in enumerate(at):
            k = np.arange(math.floor(c - radius * wide), math.ceil(c + radius * wide) + 1)
            w = kernel((k - c) / wide)
            k, w = np.clip(k, 0, size - 1)[w != 0], w[w != 0]
            sums: dict[int, float] = {}
            for i, x in zip(k.tolist(), (w / w.sum()).tolist(), strict=True):
                sums[i] = sums.get(i, 0.0) + x
            rows += [(t, i, x) for i, x in sums.items()]
        return pixels.sparkSession.createDataFrame(rows, "t int, s int, w double")

    wy = weights(sy, new_height, height).select(F.col("t").alias("_y"), F.col("s").alias("y"), F.col("w").alias("_wy"))
    wx = weights(sx, new_width, width).select(F.col("t").alias("_x"), F.col("s").alias("x"), F.col("w").alias("_wx"))
    ok = pixels.where(~F.isnan("v"))
    half = ok.join(wx, "x").groupBy(*by, "y", F.col("_x").alias("x")).agg(F.sum(F.col("v") * F.col("_wx")).alias("_v"), F.sum("_wx").alias("_w"))
    full = half.join(wy, "y").groupBy(*by, F.col("_y").alias("y"), "x").agg(F.sum(F.col("_v") * F.col("_wy")).alias("_v"), F.sum(F.col("_w") * F.col("_wy")).alias("_w"))
    return full.select(*by, "y", "x", (F.col("_v") / F.col("_w")).alias("v"))


def overview_levels(width: int, height: int) -> list[int]:
    """2, 4, 8 ... while the smaller side stays over 256, and one more."""
    out, factor = [], 2
    while min(width, height) // factor > 256:
        out.append(factor)
        factor *= 2
    return [*out, factor]


def overview(pixels: DataFrame, factor: int, how: str = "average", by: tuple[str, ...] = ()) -> DataFrame:
    """Pixels at 1/factor of the size: average, nearest, mode, min or max of each square."""
    cell = [F.floor(F.col("y") / factor).cast("int").alias("y"), F.floor(F.col("x") / factor).cast("int").alias("x")]
    if how == "nearest":
        return pixels.where((F.col("y") % factor == 0) & (F.col("x") % factor == 0)).select(*by, *cell, "v")
    agg = {"average": F.avg("v"), "mode": F.mode("v"), "min": F.min("v"), "max": F.max("v")}[how]
    return pixels.where(~F.isnan("v")).groupBy(*by, *cell).agg(agg.alias("v"))


def transform_origin(x: Column, y: Column, dx: float, dy: float, scale: float, degrees: float) -> tuple[Column, Column]:
    """Four-parameter similarity."""
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    return dx + scale * (x * c - y * s), dy + scale * (x * s + y * c)


def transform_helmert(x: Column, y: Column, tx: float, ty: float, rz_seconds: float, ppm: float) -> tuple[Column, Column]:
    """Seven parameters in the plane: shifts, rotation about z in seconds of arc, scale in parts per million."""
    return transform_origin(x, y, tx, ty, 1.0 + ppm * 1e-6, rz_seconds / 3600.0)


# --- palettes ------------------------------------------------------------------------------------------------


def palette_to_rgba(pixels: DataFrame, palette: DataFrame) -> DataFrame:
    """Four bands from ``palette(idx, c1, c2, c3, c4)``, 256 rows at most."""
    p = F.broadcast(palette.select(F.col("idx").alias("v"), "c1", "c2", "c3", "c4"))
    return pixels.withColumn("v", F.col("v").cast("int")).join(p, "v", "left").select("y", "x", F.col("c1").alias("r"), F.col("c2").alias("g"), F.col("c3").alias("b"), F.col("c4").alias("a"))


def top_colors(pixels: DataFrame, count: int) -> DataFrame:
    """The ``count`` most frequent colours at six bits a channel, ties to the smaller code: ``(idx, r, g, b, n)``."""
    if not 1 <= count <= 256:
        raise ValueError("a palette has 1 to 256 colours")
    code = sum((F.shiftleft(F.shiftright(F.col(c).cast("int"), 2), 12 - 6 * i) for i, c in enumerate("gb", 1)), F.shiftleft(F.shiftright(F.col("r").cast("int"), 2), 12))
    top = pixels.groupBy(code.alias("code")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "code").limit(count)
    part = lambda k: F.shiftleft(F.shiftright(F.col("code"), k).bitwiseAND(F.lit(63)), 2)
    idx = F.row_number().over(Window.orderBy(F.desc("n"), "code")) - 1  # 256 rows at most
    return top.select(idx.alias("idx"), part(12).alias("r"), part(6).alias("g"), part(0).alias("b"), "n")


def rgb_to_palette(pixels: DataFrame, count: int) -> DataFrame:
    """Index of the nearest of the ``count`` top colours, the first of equals."""
    p = top_colors(pixels, count)
    table = p.agg(F.sort_array(F.collect_list(F.struct("idx", "r", "g", "b"))).alias("_p"))  # 256 entries at most
    far = lambda e: (e["r"] - F.col("r")) ** 2 + (e["g"] - F.col("g")) ** 2 + (e["b"] - F.col("b")) ** 2
    best = F.array_min(F.transform("_p", lambda e: F.struct(far(e).alias("d"), e["idx"].alias("idx"))))
    return pixels.crossJoin(F.broadcast(table)).select("y", "x", best["idx"].alias("v"))


def ramp_palette(spark, colors: list[tuple[int, int, int]]) -> DataFrame:
    """256 entries, evenly between the given colours."""
    n = len(colors) - 1
    rows = []
    for i in range(256):
        at = i / 255 * n
        k = min(int(at), n - 1) if n else 0
        t = at - k
        a, b = colors[k], colors[min(k + 1, n)]
        rows.append((i, *(int(a[j] + (b[j] - a[j]) * t) for j in range(3)), 255))
    return spark.createDataFrame(rows, "idx int, c1 int, c2 int, c3 int, c4 int")


def estimate_tiles(spark, minx: float, miny: float, maxx: float, maxy: float, zmin: int, zmax: int) -> DataFrame:
    """Number of tiles over Web Mercator bounds: ``(z, n)``."""
    from ..functions.tiles import tile_range

    z = spark.range(zmin, zmax + 1).select(F.col("id").cast("int").alias("z"))
    x0, y0, x1, y1 = tile_range(F.lit(float(minx)), F.lit(float(miny)), F.lit(float(maxx)), F.lit(float(maxy)), F.col("z"))
    return z.select("z", ((x1 - x0 + 1).cast("long") * (y1 - y0 + 1)).alias("n"))
