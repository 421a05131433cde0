"""Rasters and polygons, map projections and tiles, and the bands of a raster."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..kernel import crs, model, planar
from ..sources import codecs

CELL = 64


def pixel_to_world(gt: tuple[float, ...], x: Column, y: Column) -> tuple[Column, Column]:
    """World coordinates of pixel positions (centres are at .5) under a six-number geotransform."""
    return gt[0] + x * gt[1] + y * gt[2], gt[3] + x * gt[4] + y * gt[5]


def world_to_pixel(gt: tuple[float, ...], x: Column, y: Column) -> tuple[Column, Column]:
    """Inverse of :func:`pixel_to_world`."""
    d = gt[1] * gt[5] - gt[2] * gt[4]
    dx, dy = x - gt[0], y - gt[3]
    return (dx * gt[5] - dy * gt[2]) / d, (dy * gt[1] - dx * gt[4]) / d


def inside(px: np.ndarray, py: np.ndarray, g: model.Geometry) -> np.ndarray:
    """Which points lie in the polygons of a geometry, by the even-odd rule over all rings."""
    hit = np.zeros(len(px), bool)
    for kind, rings in model.simple_parts(g):
        if kind != model.POLYGON:
            continue
        odd = np.zeros(len(px), bool)
        for r in rings:
            for (x0, y0), (x1, y1) in zip(r[:-1], r[1:], strict=True):
                if y0 == y1:
                    continue
                cross = (y0 > py) != (y1 > py)
                odd ^= cross & (px < (x1 - x0) * (py - y0) / (y1 - y0) + x0)
        hit |= odd
    return hit


def clip_by_features(pixels: DataFrame, layer: DataFrame, name: str, gt: tuple[float, ...] | None = None) -> DataFrame:
    """``(name, band, y, x, v)``: the pixels whose centre lies in each feature.

    Pixels and features meet in cells of 64 x 64 pixels; in a cell a feature tests all its pixels at once.  Without a
    geotransform features are in pixel coordinates.
    """
    g = G.with_envelope(layer.select(name, "geom")).where("xmin is not null")
    if gt is not None:
        corners = [world_to_pixel(gt, F.col(x), F.col(y)) for x in ("xmin", "xmax") for y in ("ymin", "ymax")]
        span = {"_x0": F.least(*[c[0] for c in corners]), "_x1": F.greatest(*[c[0] for c in corners]), "_y0": F.least(*[c[1] for c in corners]), "_y1": F.greatest(*[c[1] for c in corners])}
    else:
        span = {"_x0": F.col("xmin"), "_x1": F.col("xmax"), "_y0": F.col("ymin"), "_y1": F.col("ymax")}
    g = g.withColumns(span)
    at = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / CELL), F.floor(F.col(hi) / CELL)))
    g = g.withColumn("_cx", at("_x0", "_x1")).withColumn("_cy", at("_y0", "_y1")).select(name, "geom", "_cx", "_cy", "_x0", "_x1", "_y0", "_y1")
    p = pixels.select("band", "y", "x", "v", F.floor(F.col("x") / CELL).alias("_cx"), F.floor(F.col("y") / CELL).alias("_cy"))
    near = "x + 0.5 >= _x0 and x + 0.5 <= _x1 and y + 0.5 >= _y0 and y + 0.5 <= _y1"
    pairs = p.join(g, ["_cx", "_cy"]).where(near).select(name, "band", "y", "x", "v", "geom")
    use = gt or (0.0, 1.0, 0.0, 0.0, 0.0, 1.0)
    schema = pairs.drop("geom").schema

    def run(frames):
        known: dict = {}
        for frame in frames:
            x, y = frame["x"].to_numpy() + 0.5, frame["y"].to_numpy() + 0.5
            wx, wy = use[0] + x * use[1] + y * use[2], use[3] + x * use[4] + y * use[5]
            keep = np.zeros(len(frame), bool)
            codes, texts = pd.factorize(frame["geom"])
            for k, data in enumerate(texts):
                if data not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[data] = model.from_wkb(data)
                rows = np.flatnonzero(codes == k)
                keep[rows] = inside(wx[rows], wy[rows], known[data])
            yield frame[keep].drop(columns="geom")

    return pairs.mapInPandas(run, schema)


def reproject(pixels: DataFrame, gt: tuple[float, ...], source: int, target: int, target_gt: tuple[float, ...], width: int, height: int) -> DataFrame:
    """``(band, y, x, v)`` on a grid of another coordinate system, by the nearest source pixel.

    Each target pixel works out its source pixel, and one equi-join fetches the value.
    """
    crs.lookup(source), crs.lookup(target)
    grid = pixels.sparkSession.range(width * height).select(F.floor(F.col("id") / width).cast("int").alias("y"), (F.col("id") % width).cast("int").alias("x"))

    def run(frames):
        a, b = crs.lookup(source), crs.lookup(target)
        d = gt[1] * gt[5] - gt[2] * gt[4]
        for frame in frames:
            cx, cy = frame["x"].to_numpy() + 0.5, frame["y"].to_numpy() + 0.5
            wx, wy = target_gt[0] + cx * target_gt[1] + cy * target_gt[2], target_gt[3] + cx * target_gt[4] + cy * target_gt[5]
            with np.errstate(all="ignore"):
                sx, sy = crs.from_lonlat(a, *crs.to_lonlat(b, wx, wy))
                px, py = ((sx - gt[0]) * gt[5] - (sy - gt[3]) * gt[2]) / d, ((sy - gt[3]) * gt[1] - (sx - gt[0]) * gt[4]) / d
            ok = np.isfinite(px) & np.isfinite(py) & (np.abs(px) < 2**31) & (np.abs(py) < 2**31)
            yield frame[ok].assign(_x=np.floor(px[ok]).astype("int32"), _y=np.floor(py[ok]).astype("int32"))

    at = grid.mapInPandas(run, "y int, x int, _x int, _y int")
    return at.join(pixels.select("band", F.col("y").alias("_y"), F.col("x").alias("_x"), "v"), ["_y", "_x"]).select("band", "y", "x", "v")


def transformed_geotransform(gt: tuple[float, ...], dx: float, dy: float, scale: float, degrees: float) -> tuple[float, ...]:
    """The geotransform after a four-parameter similarity; pixels stay as they are."""
    import math

    c, s = scale * math.cos(math.radians(degrees)), scale * math.sin(math.radians(degrees))
    turn = lambda x, y: (x * c - y * s, x * s + y * c)
    (x0, y0), (a, d), (b, e) = turn(gt[0], gt[3]), turn(gt[1], gt[4]), turn(gt[2], gt[5])
    return (dx + x0, a, b, dy + y0, d, e)


def define_projection(headers: DataFrame, epsg: int) -> DataFrame:
    """Headers with another coordinate system; metadata only."""
    crs.lookup(epsg)
    return headers.withColumn("epsg", F.lit(epsg))


# --- bands ---------------------------------------------------------------------------------------------------


def pick_bands(pixels: DataFrame, order: list[int]) -> DataFrame:
    """The bands of ``order`` as bands 1, 2, ...; a band may come twice."""
    if not order:
        raise ValueError("no bands")
    table = F.array(*[F.struct(F.lit(b).alias("was"), F.lit(n).alias("now")) for n, b in enumerate(order, 1)])
    moved = pixels.where(F.col("band").isin(*order)).withColumn("_m", F.explode(F.filter(table, lambda e: e["was"] == F.col("band"))))
    return moved.withColumn("band", F.col("_m.now")).drop("_m")


def add_band(pixels: DataFrame, band: int, value: Column | float) -> DataFrame:
    """One more band of every pixel, from a number or from a column over band 1."""
    first = pixels.where("band = 1")
    v = value if isinstance(value, Column) else F.lit(float(value))
    return pixels.where(F.col("band") != band).unionByName(first.withColumn("v", v).withColumn("band", F.lit(band)))


def remove_band(pixels: DataFrame, band: int) -> DataFrame:
    """Without a band; those after it move up."""
    return pixels.where(F.col("band") != band).withColumn("band", F.when(F.col("band") > band, F.col("band") - 1).otherwise(F.col("band")))


def set_band_metadata(headers: DataFrame, band: int, **values: str) -> DataFrame:
    """Key/value pairs of a band, in a map column ``band_metadata`` under ``band.key``."""
    new = F.create_map(*[F.lit(x) for k, v in values.items() for x in (f"{band}.{k}", str(v))])
    old = F.col("band_metadata") if "band_metadata" in headers.columns else F.create_map().cast("map<string,string>")
    kept = F.map_filter(old, lambda k, _: ~k.isin(*[f"{band}.{k}" for k in values]))
    return headers.withColumn("band_metadata", F.map_concat(kept, new))


def scaled(pixels: DataFrame, scale: float = 1.0, offset: float = 0.0) -> DataFrame:
    """Values under a band's scale and offset."""
    return pixels.withColumn("v", F.col("v") * scale + offset)


def block_of(x: Column, y: Column, width: int, height: int, block_w: int, block_h: int) -> Column:
    """Number of the block a pixel is in, row by row; the last ones may be ragged."""
    del height
    return (F.floor(y / block_h) * (-(-width // block_w)) + F.floor(x / block_w)).cast("int")


# --- tiles and canvases --------------------------------------------------------------------------------------


def paste(tiles: DataFrame, width: int, height: int) -> DataFrame:
    """``(raster, content)``: PNG canvases of encoded tiles ``(raster, tile, x, y)``; later rows by (y, x) cover earlier ones."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        canvas = np.zeros((height, width, 4), np.uint8)
        for r in frame.sort_values(["y", "x"]).itertuples(index=False):
            img = codecs.read_png(bytes(r.tile))
            if img.ndim == 2:
                img = np.repeat(img[:, :, None], 3, 2)
            if img.shape[2] == 3:
                img = np.concatenate([img, np.full((*img.shape[:2], 1), 255, np.uint8)], 2)
            y0, x0, y1, x1 = max(r.y, 0), max(r.x, 0), min(r.y + img.shape[0], height), min(r.x + img.shape[1], width)
            if y0 < y1 and x0 < x1:
                canvas[y0:y1, x0:x1] = img[y0 - r.y : y1 - r.y, x0 - r.x : x1 - r.x]
        return pd.DataFrame([(frame["raster"].iloc[0], codecs.write_png(canvas))], columns=["raster", "content"])

    kind = tiles.schema["raster"].dataType.simpleString()
    return tiles.select("raster", "tile", "x", "y").groupBy("raster").applyInPandas(run, f"raster {kind}, content binary")


def lookup_tile(tiles: DataFrame, z: int, x: int, y: int) -> bytes | None:
    """One tile of a ``(z, x, y, tile)`` table; a table laid out by z reads little for it."""
    r = tiles.where((F.col("z") == z) & (F.col("x") == x) & (F.col("y") == y)).select("tile").first()
    return bytes(r["tile"]) if r else None


class ColorPipeline:
    """Steps over a raster, one after the other; the first error stops the rest and is raised by ``result``."""

    def __init__(self, pixels: DataFrame):
        self.pixels, self.error = pixels, None

    def then(self, step: Callable[..., DataFrame], *args, **kw) -> ColorPipeline:
        if self.error is None:
            try:
                self.pixels = step(self.pixels, *args, **kw)
            except Exception as e:  # noqa: BLE001  kept for result()
                self.error = e
        return self

    def result(self) -> DataFrame:
        if self.error is not None:
            raise self.error
        return self.pixels


def balance_many(rasters: dict[str, DataFrame], reference: DataFrame, method: str, **kw) -> dict[str, DataFrame | None]:
    """The same colour balance for several rasters; None for one that can't be balanced."""
    from .raster import color_balance

    out: dict[str, DataFrame | None] = {}
    for name, px in rasters.items():
        try:
            out[name] = color_balance(px, reference, method, **kw)
        except ValueError:
            out[name] = None
    return out


def polygon_area_in_pixels(g: bytes, gt: tuple[float, ...]) -> float:
    return planar.area(model.from_wkb(g)) / abs(gt[1] * gt[5] - gt[2] * gt[4])


def read_tile(pixels: DataFrame, gt: tuple[float, ...], width: int, height: int, z: int, x: int, y: int, size: int = 256) -> DataFrame:
    """``(band, py, px, v)``: a Web Mercator tile of a raster in EPSG:3857 by bilinear interpolation.

    Only the source pixels that the tile needs are read.  Pixels outside of the raster are left out.  A raster of one band
    gives three equal ones, one of two bands none, and of more than four the first three count.
    """
    edge = 20037508.342789244
    side = 2 * edge / 2**z / size
    at = pixels.sparkSession.range(size).select(F.col("id").cast("int").alias("n"))
    cols = at.select(F.col("n").alias("px"), (((F.lit(-edge + x * size * side) + (F.col("n") + 0.5) * side) - gt[0]) / gt[1] - 0.5).alias("_x"))
    rows = at.select(F.col("n").alias("py"), (((F.lit(edge - y * size * side) - (F.col("n") + 0.5) * side) - gt[3]) / gt[5] - 0.5).alias("_y"))

    def taps(axis: DataFrame, place: str, source: str, n: int, weight: str) -> DataFrame:
        inside = axis.where((F.col(place) >= -0.5) & (F.col(place) < n - 0.5))
        low = F.floor(place)
        share = F.col(place) - low
        both = F.explode(F.array(F.struct(low.alias("s"), (1 - share).alias("w")), F.struct((low + 1).alias("s"), share.alias("w")))).alias("_t")
        out = inside.select(axis.columns[0], both).select(axis.columns[0], F.least(F.greatest(F.col("_t.s"), F.lit(0)), F.lit(n - 1)).cast("int").alias(source), F.col("_t.w").alias("w"))
        return out.groupBy(axis.columns[0], source).agg(F.sum("w").alias(weight)).where(F.col(weight) > 0)

    wx, wy = F.broadcast(taps(cols, "_x", "x", width, "_wx")), F.broadcast(taps(rows, "_y", "y", height, "_wy"))  # 2 * size rows each
    met = pixels.where(~F.isnan("v")).join(wx, "x").join(wy, "y")
    w = F.col("_wx") * F.col("_wy")
    out = met.groupBy("band", "py", "px").agg((F.sum(F.col("v") * w) / F.sum(w)).alias("v"))
    bands = pixels.agg(F.max("band")).first()[0] or 0
    if bands == 1:
        return out.select(F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("band"), "py", "px", "v")
    return out.where(F.lit(bands > 2) & (F.col("band") <= (3 if bands != 4 else 4)))
