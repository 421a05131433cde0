"""Layers, tiles and rasters to files and databases.

Formats that are one file are written by the driver from a stream of rows (``toLocalIterator``), partition after
partition; anything large belongs in Parquet, which executors write in parallel.
"""

from __future__ import annotations

import json
import os
import re
import sqlite3
import tempfile
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as G
from ..functions import tiles as tile_math
from ..kernel import crs, model
from ..operators.layers import unique_field_names
from . import codecs, types


def _features(layer: DataFrame) -> Iterable[tuple[dict, model.Geometry | None]]:
    for r in layer.toLocalIterator(prefetchPartitions=True):
        d = r.asDict()
        g = d.pop("geom")
        yield d, None if g is None else model.from_wkb(g)


def _put(layer: DataFrame, path: str, data: bytes) -> None:
    """Bytes to a path of any file system that Spark knows."""
    spark = layer.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        for at in range(0, len(data), 1 << 20):
            out.write(bytearray(data[at : at + (1 << 20)]))
    finally:
        out.close()


def geojson_lines(layer: DataFrame) -> DataFrame:
    """One feature a row, as text; written in parallel with ``write.text``."""
    names = [c for c in layer.columns if c != "geom"]
    props = F.to_json(F.struct(*names), {"ignoreNullFields": "false"}) if names else F.lit("{}")
    geometry = F.coalesce(G.as_geojson(F.col("geom")), F.lit("null"))
    return layer.select(F.concat(F.lit('{"type":"Feature","properties":'), props, F.lit(',"geometry":'), geometry, F.lit("}")).alias("value"))


def write_geojson(layer: DataFrame, path: str) -> None:
    """A FeatureCollection in one file."""
    rows = ",\n".join(r[0] for r in geojson_lines(layer).toLocalIterator(prefetchPartitions=True))
    _put(layer, path, ('{"type":"FeatureCollection","features":[\n' + rows + "\n]}\n").encode())


def write_shapefile(layer: DataFrame, path: str, epsg: int | None = None, encoding: str = "UTF-8") -> list[str]:
    """.shp, .shx, .dbf, .cpg and .prj; field names are made fit and unique.  Returns the field names."""
    base = path[:-4] if path.lower().endswith(".shp") else path
    fields = [f for f in layer.schema if f.name != "geom"]
    names = unique_field_names([f.name for f in fields])
    kinds = []
    for n, f in zip(names, fields, strict=True):
        kind = types.of_spark(f.dataType)
        width, decimals = types.SHP_WIDTHS.get(types.DIALECTS["shp"].get(kind, kind), (254, 0))
        kinds.append((n, {"Integer": "N", "Integer64": "N", "Real": "N", "Date": "D"}.get(kind, "C"), width, decimals))
    rows, shapes = [], []
    for d, g in _features(layer):
        values = []
        for f, k in zip(fields, kinds, strict=True):
            v = d[f.name]
            values.append(v if v is None or k[1] in "ND" else json.dumps(v) if isinstance(v, (list, dict)) else v.hex() if isinstance(v, (bytes, bytearray)) else str(v))
        rows.append(values)
        shapes.append(g)
    shp, shx = codecs.write_shp(shapes)
    for ext, data in (("shp", shp), ("shx", shx), ("dbf", codecs.write_dbf(kinds, rows, encoding)), ("cpg", encoding.encode())):
        _put(layer, f"{base}.{ext}", data)
    if epsg:
        _put(layer, f"{base}.prj", crs.wkt(crs.lookup(epsg)).encode())
    return names


def split_families(layer: DataFrame, drop: tuple[str, ...] = ("ogc_fid", "gid")) -> dict[str, DataFrame]:
    """The layer by family of geometry (point, line, polygon, unknown), without a database's own columns."""
    rows = layer.drop(*[c for c in layer.columns if c.lower() in drop]).withColumn("_f", G.wkb_family(F.col("geom")))
    found = sorted(r["_f"] for r in rows.select("_f").distinct().collect())
    return {f: rows.where(F.col("_f") == f).drop("_f") for f in found}


def write_kml(layer: DataFrame, path: str, name: str = "layer") -> None:
    data = codecs.write_kml(list(_features(layer)), name)
    _put(layer, path, codecs.kmz_of_kml(data) if path.lower().endswith(".kmz") else data)


def write_dxf(layer: DataFrame, path: str) -> None:
    _put(layer, path, codecs.write_dxf(list(_features(layer))).encode())


def write_layer(layer: DataFrame, path: str, **options) -> None:
    """By extension; Parquet in parallel, the other formats as one file."""
    from .readers import sniff

    kind = sniff(path)
    if kind == "parquet":
        layer.write.mode("overwrite").parquet(path)
    elif kind == "gdb":
        raise ValueError("file geodatabases aren't written")
    else:
        {"shp": write_shapefile, "geojson": write_geojson, "kml": write_kml, "kmz": write_kml, "dxf": write_dxf}[kind](layer, path, **options)


def convert(spark, source: str, target: str, **options) -> None:
    """One file format to another."""
    from .readers import read_layer

    write_layer(read_layer(spark, source), target, **options)


# --- databases -----------------------------------------------------------------------------------------------


def postgis_table(layer: DataFrame, schema: str, table: str, geom_type: str = "Geometry", srid: int = 4490) -> list[str]:
    """Statements that replace a table: drop, create with a serial key, index on the geometry."""
    quote = lambda x: '"' + x.replace('"', '""') + '"'
    kinds = {"Integer": "INTEGER", "Integer64": "BIGINT", "Real": "DOUBLE PRECISION", "String": "TEXT", "Date": "DATE", "DateTime": "TIMESTAMP", "Binary": "BYTEA"}
    cols = [f"{quote(f.name)} {kinds.get(types.of_spark(f.dataType), 'TEXT')}" for f in layer.schema if f.name.lower() not in ("id", "geom")]
    full = f"{quote(schema)}.{quote(table)}"
    return [
        f"DROP TABLE IF EXISTS {full} CASCADE",
        f"CREATE TABLE {full} (id SERIAL PRIMARY KEY, {', '.join([*cols, f'geom geometry({geom_type}, {srid})'])})",
        f"CREATE INDEX {quote('idx_' + table + '_geom')} ON {full} USING GIST (geom)",
    ]


def write_jdbc(layer: DataFrame, url: str, table: str, *, batch: int = 1000, mode: str = "append", **options) -> None:
    """Rows over JDBC with hexadecimal WKB, which a geometry column takes; executors insert in batches."""
    rows = layer.drop(*[c for c in layer.columns if c.lower() == "id"]).withColumn("geom", G.wkb_hex(F.col("geom")))
    rows.write.format("jdbc").option("url", url).option("dbtable", table).option("batchsize", batch).option("stringtype", "unspecified").options(**options).mode(mode).save()


def write_in_batches(layer: DataFrame, insert, *, batch: int = 1000) -> DataFrame:
    """Rows handed to ``insert(list of tuples)`` on the executors, batch by batch; a batch that fails goes row by row.

    ``insert`` must be repeatable, as a retried task sends its rows again.  Returns the rejected rows and their errors.
    """
    schema = T.StructType([*layer.schema.fields, T.StructField("_error", T.StringType())])
    names = layer.columns

    def run(frames):
        for frame in frames:
            rows = list(frame.itertuples(index=False, name=None))
            bad = []
            for at in range(0, len(rows), batch):
                part = rows[at : at + batch]
                try:
                    insert(part)
                except Exception:  # noqa: BLE001  a driver's own errors
                    for r in part:
                        try:
                            insert([r])
                        except Exception as e:  # noqa: BLE001
                            bad.append((*r, str(e)))
            yield pd.DataFrame(bad, columns=[*names, "_error"])

    return layer.mapInPandas(run, schema)


# --- tiles and rasters ---------------------------------------------------------------------------------------


def encode_tiles(pixels: DataFrame, size: int = 256) -> DataFrame:
    """``(z, x, y, tile)``: PNG of the pixels ``(z, tx, ty, px, py, r, g, b[, a])`` of each tile; black is transparent."""
    bands = ["r", "g", "b"] + ["a"] * ("a" in pixels.columns)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        img = np.zeros((size, size, 4), np.uint8)
        ys, xs = frame["py"].to_numpy(), frame["px"].to_numpy()
        for k, b in enumerate("rgb"):
            img[ys, xs, k] = frame[b].to_numpy()
        img[ys, xs, 3] = frame["a"].to_numpy() if "a" in frame else 255
        img[(img[:, :, :3] == 0).all(2), 3] = 0
        f = frame.iloc[0]
        return pd.DataFrame([(int(f["z"]), int(f["tx"]), int(f["ty"]), codecs.write_png(img))], columns=["z", "x", "y", "tile"])

    return pixels.select("z", "tx", "ty", "px", "py", *bands).groupBy("z", "tx", "ty").applyInPandas(run, "z int, x int, y int, tile binary")


def tile_pixels(points: DataFrame, z: int, size: int = 256) -> DataFrame:
    """Tile and pixel numbers of rows with ``lon, lat``: ``(z, tx, ty, px, py)`` beside the other columns."""
    import math

    zoom = z + int(round(math.log2(size)))
    x, y = tile_math.lonlat_to_tile(F.col("lon"), F.col("lat"), F.lit(zoom))
    return points.withColumns({"_x": x, "_y": y}).select(
        *[c for c in points.columns if c not in ("lon", "lat")], F.lit(z).alias("z"), F.floor(F.col("_x") / size).cast("int").alias("tx"),
        F.floor(F.col("_y") / size).cast("int").alias("ty"), (F.col("_x") % size).alias("px"), (F.col("_y") % size).alias("py"),
    )


def terrain_tiles(heights: DataFrame, encoding: str = "mapbox", size: int = 256) -> DataFrame:
    """PNG tiles of ``(z, tx, ty, px, py, h)`` as terrain colours; places without a height are 0 metres."""
    r, g, b = tile_math.terrain_rgb(F.col("h"), encoding)
    return encode_tiles(heights.select("z", "tx", "ty", "px", "py", r.alias("r"), g.alias("g"), b.alias("b")), size)


def mbtiles_metadata(name: str, minzoom: int, maxzoom: int, bounds: tuple[float, float, float, float], kind: str = "baselayer", format: str = "png") -> dict[str, str]:
    w, s, e, n = bounds
    return {
        "name": name, "type": kind, "version": "1.0.0", "description": name, "format": format, "minzoom": str(minzoom), "maxzoom": str(maxzoom),
        "bounds": f"{w},{s},{e},{n}", "center": f"{(w + e) / 2},{(s + n) / 2},{(minzoom + maxzoom) // 2}",
    }


def write_mbtiles(tiles: DataFrame, path: str, metadata: dict[str, str], scheme: str = "xyz", batch: int = 500) -> int:
    """An MBTiles file of ``(z, x, y, tile)``; rows are XYZ unless ``scheme`` is tms.  Returns the number of tiles."""
    handle, local = tempfile.mkstemp(suffix=".mbtiles")
    os.close(handle)
    n = 0
    try:
        with sqlite3.connect(local) as db:
            db.execute("CREATE TABLE metadata (name text, value text)")
            db.execute("CREATE TABLE tiles (zoom_level integer, tile_column integer, tile_row integer, tile_data blob)")
            db.execute("CREATE UNIQUE INDEX tile_index ON tiles (zoom_level, tile_column, tile_row)")
            db.executemany("INSERT INTO metadata VALUES (?, ?)", sorted(metadata.items()))
            held = []
            for r in tiles.select("z", "x", "y", "tile").toLocalIterator(prefetchPartitions=True):
                row = (1 << r["z"]) - 1 - r["y"] if scheme == "tms" else r["y"]
                held.append((r["z"], r["x"], row, bytes(r["tile"])))
                if len(held) == batch:
                    db.executemany("INSERT OR REPLACE INTO tiles VALUES (?, ?, ?, ?)", held)
                    n, held = n + len(held), []
            db.executemany("INSERT OR REPLACE INTO tiles VALUES (?, ?, ?, ?)", held)
            n += len(held)
        db.close()
        with open(local, "rb") as f:
            _put(tiles, path, f.read())
    finally:
        os.unlink(local)
    return n


def encode_rasters(pixels: DataFrame, kind: str = "Byte", geo: tuple[float, ...] | None = None, epsg: int | None = None, nodata: float | None = None) -> DataFrame:
    """``(raster, content)``: a GeoTIFF of the pixels ``(raster, band, y, x, v)`` of each raster, in one task each."""
    dtype = np.dtype(codecs.DTYPES[kind])

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        h, w, n = int(frame["y"].max()) + 1, int(frame["x"].max()) + 1, int(frame["band"].max())
        out = np.full((n, h, w), nodata or 0, dtype)
        v = frame["v"].to_numpy()
        if dtype.kind in "ui":
            info = np.iinfo(dtype)
            v = np.clip(np.nan_to_num(v), info.min, info.max)
        out[frame["band"].to_numpy() - 1, frame["y"].to_numpy(), frame["x"].to_numpy()] = v
        return pd.DataFrame([(frame["raster"].iloc[0], codecs.write_tiff(out, geo, epsg, nodata))], columns=["raster", "content"])

    raster = pixels.schema["raster"].dataType.simpleString()
    return pixels.groupBy("raster").applyInPandas(run, f"raster {raster}, content binary")


def write_files(contents: DataFrame, folder: str, extension: str) -> int:
    """Each ``(name, content)`` row as a file; names are made fit for file systems."""
    n = 0
    for name, content in contents.toLocalIterator(prefetchPartitions=True):
        _put(contents, f"{folder.rstrip('/')}/{re.sub(r'[^0-9A-Za-z_.-]', '_', str(name))}.{extension}", bytes(content))
        n += 1
    return n
