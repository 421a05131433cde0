"""Layers and rasters from files and databases, as DataFrames.

Files are read through Spark (``binaryFile``, ``text``), so any storage that Spark reaches will do, and decoded
by one Arrow-batched function for each format; a folder of files is read in parallel, a file in one task.
"""

from __future__ import annotations

import json
import os

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as G
from ..kernel import model
from . import codecs, types

FORMATS = {".shp": "shp", ".geojson": "geojson", ".json": "geojson", ".kml": "kml", ".kmz": "kmz", ".dxf": "dxf", ".gdb": "gdb", ".parquet": "parquet"}


def sniff(path: str) -> str:
    """Format of a path by its extension."""
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    if ext not in FORMATS:
        raise ValueError(f"unknown format {ext or path!r}")
    return FORMATS[ext]


def read_layer(spark: SparkSession, path: str, layer: str | None = None, format: str | None = None, **options) -> DataFrame:
    """A layer of any readable format; ``layer`` picks one of several in a folder."""
    kind = format or sniff(path)
    if layer and kind == "shp" and not path.lower().endswith(".shp"):
        path = f"{path.rstrip('/')}/{layer}.shp"
    if kind == "gdb":
        raise ValueError("file geodatabases are closed binaries; export them to GeoJSON, Shapefile or Parquet first")
    if kind == "parquet":
        return spark.read.parquet(path)
    return {"shp": read_shapefile, "geojson": read_geojson, "kml": read_kml, "kmz": read_kml, "dxf": read_dxf}[kind](spark, path, **options)


def _binary(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    r = spark.read.format("binaryFile")
    return (r.option("pathGlobFilter", glob) if glob else r).load(path)


_DBF = {"C": T.StringType(), "D": T.DateType(), "L": T.BooleanType(), "F": T.DoubleType()}


def read_shapefile(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """A shapefile (or a folder of them with one schema): ``fid``, its fields and ``geom``.

    The encoding comes from the .cpg file, else it is GBK.  The schema is that of the first .dbf's header.
    """
    base = path[:-4] if path.lower().endswith(".shp") else path.rstrip("/") + "/*"
    files = _binary(spark, base + ".*", "*.{shp,dbf,cpg,SHP,DBF,CPG}")
    stem = F.regexp_replace("path", "\\.[A-Za-z]+$", "")
    ext = F.lower(F.regexp_extract("path", "\\.([A-Za-z]+)$", 1))
    sets = files.groupBy(stem.alias("stem")).agg(*[F.max(F.when(ext == e, F.col("content"))).alias(e) for e in ("shp", "dbf", "cpg")])
    first = sets.where("dbf is not null").orderBy("stem").select(F.substring("dbf", 1, 32 * 257).alias("head"), "cpg").first()
    if first is None:
        raise ValueError(f"no shapefile at {path}")
    head = bytearray(bytes(first["head"]))
    head[4:8] = b"\0\0\0\0"  # the fields alone
    name = encoding or (bytes(first["cpg"]).decode("ascii", "ignore").strip() if first["cpg"] else "") or "gbk"
    fields, _ = codecs.read_dbf(bytes(head), name)
    kinds = [T.StructField(n, _DBF.get(k) or (T.DoubleType() if d else T.IntegerType() if w < 10 else T.LongType())) for n, k, w, d in fields]
    schema = T.StructType([T.StructField("fid", T.LongType()), *kinds, T.StructField("geom", T.BinaryType())])

    def run(frames):
        for frame in frames:
            for r in frame.itertuples(index=False):
                code = encoding or (bytes(r.cpg).decode("ascii", "ignore").strip() if r.cpg is not None else "") or "gbk"
                shapes = codecs.read_shp(bytes(r.shp))
                _, rows = codecs.read_dbf(bytes(r.dbf), code)
                for at in range(0, len(shapes), 5000):
                    part = [(i + at, *row, None if g is None else model.to_wkb(g)) for i, (row, g) in enumerate(zip(rows[at : at + 5000], shapes[at : at + 5000], strict=False))]
                    yield pd.DataFrame(part, columns=schema.names, dtype=object)

    return sets.where("shp is not null and dbf is not null").mapInPandas(run, schema)


def read_geojson(spark: SparkSession, path: str, first_row_schema: bool = False) -> DataFrame:
    """A FeatureCollection, or one feature a line: properties as columns and ``geom``.

    The schema is inferred from all features; ``first_row_schema`` takes the first alone: whole numbers are longs,
    booleans integers, the rest strings.
    """
    text = spark.read.text(path, wholetext=True).select("value") if not path.lower().endswith((".jsonl", ".geojsonl", ".geojsons")) else spark.read.text(path)
    kind = F.get_json_object("value", "$.type")
    many = F.from_json(F.get_json_object("value", "$.features"), "array<string>")
    feature = text.select(F.explode(F.when(kind == "FeatureCollection", many).otherwise(F.array("value"))).alias("f"))
    parts = feature.select(F.get_json_object("f", "$.properties").alias("p"), F.get_json_object("f", "$.geometry").alias("g"))
    if first_row_schema:
        row = parts.select("p").first()
        found = json.loads(row["p"] or "{}") if row else {}

        def of(v):
            return T.IntegerType() if isinstance(v, bool) else T.LongType() if isinstance(v, int) or isinstance(v, float) and v.is_integer() else T.DoubleType() if isinstance(v, float) else T.StringType()

        schema = T.StructType([T.StructField(k, of(v)) for k, v in found.items()])
    else:
        schema = _infer(parts)
    geom = G.geom_from_geojson(F.col("g")).alias("geom")
    if not schema.fields:
        return parts.select(geom)
    return parts.select(F.from_json("p", schema).alias("p"), geom).select("p.*", "geom")


def _infer(parts: DataFrame) -> T.StructType:
    """Schema of all properties: each name's common type, nested values as text."""
    pairs = parts.where("p is not null").select(F.posexplode(F.json_object_keys("p")).alias("i", "k"), F.try_parse_json("p").cast("map<string,variant>").alias("m"))
    kinds = pairs.groupBy("k").agg(F.schema_of_variant_agg(F.try_element_at("m", "k")).alias("t"), F.min("i").alias("i")).orderBy("i", "k").collect()
    out = []
    for r in kinds:
        t = r["t"].upper()
        whole, real = t in ("BIGINT", "INT", "SMALLINT", "TINYINT"), t.startswith(("DOUBLE", "DECIMAL", "FLOAT"))
        out.append(T.StructField(r["k"], T.LongType() if whole else T.DoubleType() if real else T.BooleanType() if t == "BOOLEAN" else T.StringType()))
    return T.StructType(out)


def _features(spark: SparkSession, path: str, decode, fields: list[str]) -> DataFrame:
    schema = T.StructType([*(T.StructField(f, T.StringType()) for f in fields), T.StructField("geom", T.BinaryType())])

    def run(frames):
        for frame in frames:
            for data in frame["content"]:
                rows = [(*(f.get(n) for n in fields), None if g is None else model.to_wkb(g)) for f, g in decode(bytes(data))]
                yield pd.DataFrame(rows, columns=schema.names, dtype=object)

    return _binary(spark, path).select("content").mapInPandas(run, schema)


def read_kml(spark: SparkSession, path: str, fields: list[str] | None = None) -> DataFrame:
    """Placemarks of KML or zipped KML; fields are found unless named."""
    decode = (lambda b: codecs.read_kml(codecs.kml_of_kmz(b) if b[:2] == b"PK" else b))
    if fields is None:

        def names(frames):
            for frame in frames:
                seen = dict.fromkeys(k for data in frame["content"] for f, _ in decode(bytes(data)) for k in f)
                yield pd.DataFrame({"k": list(seen)})

        found = _binary(spark, path).select("content").mapInPandas(names, "k string").distinct().collect()
        fields = sorted((r["k"] for r in found), key=lambda k: (k not in ("name", "description"), k))
    return _features(spark, path, decode, fields)


def read_dxf(spark: SparkSession, path: str) -> DataFrame:
    return _features(spark, path, lambda b: codecs.read_dxf(b.decode("utf-8", "replace")), ["Layer"])


def layer_info(layer: DataFrame) -> dict:
    """Fields with their layer types, the geometry kinds and the number of features."""
    kinds = layer.groupBy(G.geometry_type(F.col("geom")).alias("k")).agg(F.count("*").alias("n")).collect()
    return {
        "fields": [(f.name, types.of_spark(f.dataType)) for f in layer.schema if f.name != "geom"],
        "geometry": sorted(r["k"] for r in kinds), "count": sum(r["n"] for r in kinds),
    }


def list_layers(spark: SparkSession, path: str) -> DataFrame:
    """``(layer, format, path)`` of the layers in a folder."""
    files = _binary(spark, path.rstrip("/") + "/*", "*.{shp,geojson,json,kml,kmz,dxf}").select("path")
    ext = F.concat(F.lit("."), F.lower(F.regexp_extract("path", "\\.([A-Za-z]+)$", 1)))
    table = F.create_map(*[F.lit(x) for p in FORMATS.items() for x in p])
    return files.select(F.regexp_extract("path", "([^/]+)\\.[A-Za-z]+$", 1).alias("layer"), F.try_element_at(table, ext).alias("format"), "path")


def from_records(spark: SparkSession, records: list[dict], geom: str = "geom") -> DataFrame:
    """Records with hexadecimal WKB; the schema comes from the first one."""
    first = records[0] if records else {}
    rows = [(*(r.get(k) for k in first if k != geom), bytes.fromhex(r[geom]) if r.get(geom) else None) for r in records]
    kinds = {bool: T.IntegerType(), int: T.LongType(), float: T.DoubleType()}
    schema = T.StructType([*(T.StructField(k, kinds.get(type(v), T.StringType())) for k, v in first.items() if k != geom), T.StructField("geom", T.BinaryType())])
    return spark.createDataFrame([tuple(int(v) if isinstance(v, bool) else v for v in r) for r in rows], schema)


# --- databases -----------------------------------------------------------------------------------------------


def postgis_query(schema: str, table: str, columns: list[str], geom: str = "geom", where: str | None = None) -> str:
    """The sub-select that a PostGIS scan reads: the geometry as WKB beside the other columns."""
    quote = lambda x: '"' + x.replace('"', '""') + '"'
    names = ", ".join([*(quote(c) for c in columns if c != geom), f"ST_AsBinary({quote(geom)}) AS geom"])
    return f"(SELECT {names} FROM {quote(schema)}.{quote(table)}{f' WHERE {where}' if where else ''}) t"


def read_postgis(spark: SparkSession, url: str, table: str, columns: list[str], *, schema: str = "public", geom: str = "geom", where: str | None = None, partition: tuple[str, int, int, int] | None = None, **options) -> DataFrame:
    """A table over JDBC; filters and columns of later steps reach the database.

    ``partition`` (column, lowest, highest, parts) reads in parallel.
    """
    r = spark.read.format("jdbc").option("url", url).option("dbtable", postgis_query(schema, table, columns, geom, where)).options(**options)
    if partition:
        c, low, high, n = partition
        r = r.option("partitionColumn", c).option("lowerBound", low).option("upperBound", high).option("numPartitions", n)
    return r.load()


def table_structure(spark: SparkSession, url: str, table: str, **options) -> list[tuple[str, str, bool]]:
    """``(column, layer type, nullable)`` of a database table; no rows are read."""
    schema = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options).load().schema
    return [(f.name, types.of_spark(f.dataType), f.nullable) for f in schema]


def tile_predicates(geom: str, srid: int, bounds: tuple[float, float, float, float], n: int) -> list[str]:
    """One WHERE clause for each tile of an n x n grid, for ``spark.read.jdbc(predicates=...)``: a partition each."""
    x0, y0, x1, y1 = bounds
    w, h = (x1 - x0) / n, (y1 - y0) / n
    return [f'"{geom}" && ST_MakeEnvelope({x0 + c * w!r}, {y0 + r * h!r}, {x0 + (c + 1) * w!r}, {y0 + (r + 1) * h!r}, {srid})' for r in range(n) for c in range(n)]


# --- rasters -------------------------------------------------------------------------------------------------


def read_raster(spark: SparkSession, path: str) -> DataFrame:
    """Pixels of GeoTIFF or PNG files: ``path, band, y, x, v``, one raster a task."""

    def run(frames):
        for frame in frames:
            for p, data in zip(frame["path"], frame["content"], strict=True):
                bands = _bands(bytes(data))
                for n, b in enumerate(bands, 1):
                    for y in range(0, b.shape[0], 64):
                        block = b[y : y + 64]
                        ys, xs = divmod(pd.RangeIndex(block.size).to_numpy(), block.shape[1])
                        yield pd.DataFrame({"path": p, "band": n, "y": ys + y, "x": xs, "v": block.ravel().astype("f8")})

    return _binary(spark, path).select("path", "content").mapInPandas(run, "path string, band int, y int, x int, v double")


def _bands(data: bytes):
    if data[:4] == b"\x89PNG":
        p = codecs.read_png(data)
        return [p] if p.ndim == 2 else [p[:, :, i] for i in range(p.shape[2])]
    return list(codecs.read_tiff(data)[0])


def raster_header(spark: SparkSession, path: str) -> DataFrame:
    """``path, width, height, bands, type, gt, epsg, nodata, has_geo``; pixel space where there is no geotransform."""

    def run(frames):
        for frame in frames:
            rows = []
            for p, data in zip(frame["path"], frame["content"], strict=True):
                data = bytes(data)
                bands, head = (_bands(data), {}) if data[:4] == b"\x89PNG" else codecs.read_tiff(data)
                h, w = bands[0].shape
                geo = head.get("geo")
                rows.append((p, w, h, len(bands), head.get("type", "Byte"), list(geo or (0.0, 1.0, 0.0, float(h), 0.0, -1.0)), head.get("epsg"), head.get("nodata"), geo is not None))
            yield pd.DataFrame(rows, columns=["path", "width", "height", "bands", "type", "gt", "epsg", "nodata", "has_geo"])

    schema = "path string, width int, height int, bands int, type string, gt array<double>, epsg int, nodata double, has_geo boolean"
    return _binary(spark, path).select("path", "content").mapInPandas(run, schema)
