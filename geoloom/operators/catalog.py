"""Catalogue of layers: metadata, feature datasets, relationships and removal, on Spark's own catalogue.

A layer is a table and a feature dataset a namespace; metadata live in table properties, so they travel with the
table.  The XML form that geodatabases keep is written and read by plain functions.
"""

from __future__ import annotations

import json
import re
import uuid
import xml.etree.ElementTree as ET
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..kernel import crs
from ..sources import types

PREFIX = "geoloom."
RELATIONS = "item_relationships"


@dataclass
class LayerMetadata:
    """What is known of a layer beside its rows."""

    name: str
    alias: str = ""
    geometry: str = "Unknown"
    srid: int | None = None
    extent: tuple[float, float, float, float] | None = None
    fields: list[dict] = field(default_factory=list)
    item: str = ""

    @classmethod
    def of(cls, name: str, layer: DataFrame, **more) -> LayerMetadata:
        fields = [{"name": f.name, "type": types.of_spark(f.dataType), "alias": f.metadata.get("alias", f.name), "width": f.metadata.get("width") or 0, "nullable": f.nullable} for f in layer.schema if f.name != "geom"]
        return cls(name, more.pop("alias", name), fields=fields, item=more.pop("item", "{" + str(uuid.uuid4()).upper() + "}"), **more)


def _quote(name: str) -> str:
    return ".".join("`" + x.replace("`", "``") + "`" for x in name.split("."))


def _text(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def create_dataset(spark: SparkSession, name: str, srid: int | None = None) -> None:
    """A feature dataset: a namespace with its coordinate system."""
    spark.sql(f"CREATE NAMESPACE IF NOT EXISTS {_quote(name)}" + (f" WITH DBPROPERTIES ('{PREFIX}srid' = '{srid}')" if srid else ""))


def list_datasets(spark: SparkSession) -> list[str]:
    return [d.name for d in spark.catalog.listDatabases()]


def drop_dataset(spark: SparkSession, name: str, cascade: bool = False) -> None:
    spark.sql(f"DROP NAMESPACE IF EXISTS {_quote(name)}" + " CASCADE" * cascade)


def save_layer(layer: DataFrame, name: str, mode: str = "error", metadata: LayerMetadata | None = None) -> LayerMetadata:
    """Rows as a Parquet table, metadata as its properties."""
    layer.write.mode(mode).format("parquet").saveAsTable(name)
    found = metadata or LayerMetadata.of(name, layer)
    write_metadata(layer.sparkSession, name, found)
    return found


def write_metadata(spark: SparkSession, name: str, metadata: LayerMetadata) -> None:
    spark.sql(f"ALTER TABLE {_quote(name)} SET TBLPROPERTIES ('{PREFIX}metadata' = {_text(json.dumps(asdict(metadata)))})")


def read_metadata(spark: SparkSession, name: str) -> LayerMetadata:
    """Metadata of a table; what it has none of is worked out from its schema."""
    rows = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {_quote(name)}").collect()}
    if f"{PREFIX}metadata" not in rows:
        return LayerMetadata.of(name, spark.table(name))
    d = json.loads(rows[f"{PREFIX}metadata"])
    d["extent"] = tuple(d["extent"]) if d["extent"] else None
    return LayerMetadata(**d)


def set_alias(spark: SparkSession, name: str, alias: str, fields: dict[str, str] | None = None) -> None:
    m = read_metadata(spark, name)
    m.alias = alias
    for f in m.fields:
        f["alias"] = (fields or {}).get(f["name"], f["alias"])
    write_metadata(spark, name, m)


def refresh_extent(spark: SparkSession, name: str) -> LayerMetadata:
    """The extent worked out from the rows and stored."""
    from ..functions.geometry import with_envelope

    m = read_metadata(spark, name)
    e = with_envelope(spark.table(name)).agg(F.min("xmin"), F.min("ymin"), F.max("xmax"), F.max("ymax")).first()
    m.extent = tuple(e) if e[0] is not None else None
    write_metadata(spark, name, m)
    return m


def list_layers(spark: SparkSession, dataset: str | None = None) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables(dataset) if t.name != RELATIONS and not t.isTemporary)


def layer_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def drop_layer(spark: SparkSession, name: str) -> None:
    if not layer_exists(spark, name):
        raise ValueError(f"there is no layer {name}")
    spark.sql(f"DROP TABLE {_quote(name)}")


def drop_layers(spark: SparkSession, names: list[str], continue_on_error: bool = False) -> dict[str, str]:
    """Drop several; the errors by name where they don't stop the rest."""
    errors = {}
    for n in names:
        try:
            drop_layer(spark, n)
        except ValueError as e:
            if not continue_on_error:
                raise
            errors[n] = str(e)
    return errors


def relate(spark: SparkSession, origin: str, target: str, kind: str = "DatasetInFeatureDataset", dataset: str = "default") -> None:
    """An edge between two items; repeated edges are one."""
    table = f"{dataset}.{RELATIONS}"
    row = spark.createDataFrame([(origin, target, kind)], "origin string, target string, kind string")
    if layer_exists(spark, table):
        row = row.join(spark.table(table), ["origin", "target", "kind"], "left_anti")
    row.write.mode("append").format("parquet").saveAsTable(table)


def relations(spark: SparkSession, dataset: str = "default") -> DataFrame:
    table = f"{dataset}.{RELATIONS}"
    return spark.table(table) if layer_exists(spark, table) else spark.createDataFrame([], "origin string, target string, kind string")


# --- XML -----------------------------------------------------------------------------------------------------

FIELD_TYPES = {
    "Integer": "esriFieldTypeInteger", "Integer64": "esriFieldTypeDouble", "Real": "esriFieldTypeDouble", "String": "esriFieldTypeString",
    "Date": "esriFieldTypeDate", "DateTime": "esriFieldTypeDate", "Binary": "esriFieldTypeBlob", "Time": "esriFieldTypeString",
}
GEOMETRY_TYPES = {
    "Point": "esriGeometryPoint", "MultiPoint": "esriGeometryMultipoint", "LineString": "esriGeometryPolyline", "MultiLineString": "esriGeometryPolyline",
    "Polygon": "esriGeometryPolygon", "MultiPolygon": "esriGeometryPolygon",
}


def to_xml(m: LayerMetadata) -> str:
    """Definition of a feature class."""
    root = ET.Element("DEFeatureClassInfo")

    def put(parent: ET.Element, name: str, text) -> ET.Element:
        e = ET.SubElement(parent, name)
        e.text = None if text is None else str(text)
        return e

    put(root, "CatalogPath", "\\" + m.name)
    put(root, "Name", m.name)
    put(root, "DatasetType", "esriDTFeatureClass")
    put(root, "AliasName", m.alias)
    put(root, "ShapeType", GEOMETRY_TYPES.get(m.geometry, "esriGeometryAny"))
    put(root, "ShapeFieldName", "SHAPE")
    array = ET.SubElement(ET.SubElement(root, "GPFieldInfoExs"), "Fields")
    for f in m.fields:
        e = ET.SubElement(array, "GPFieldInfoEx")
        put(e, "Name", f["name"])
        put(e, "AliasName", f["alias"])
        put(e, "FieldType", FIELD_TYPES.get(f["type"], "esriFieldTypeString"))
        put(e, "IsNullable", str(bool(f["nullable"])).lower())
        if f["width"]:
            put(e, "Length", f["width"])
    if m.extent:
        box = ET.SubElement(root, "Extent")
        for tag, v in zip(("XMin", "YMin", "XMax", "YMax"), m.extent, strict=True):
            put(box, tag, repr(float(v)))
    if m.srid:
        ref = ET.SubElement(root, "SpatialReference")
        try:
            put(ref, "WKT", crs.wkt(crs.lookup(m.srid)))
        except ValueError:
            pass
        put(ref, "WKID", m.srid)
    return ET.tostring(root, encoding="unicode")


def from_xml(text: str) -> LayerMetadata:
    """Metadata of a definition; text that isn't well formed is searched for what can be told."""
    try:
        root = ET.fromstring(text)
    except ET.ParseError:
        pick = lambda tag: (re.search(rf"<{tag}>([^<]*)</{tag}>", text) or [None, ""])[1]
        return LayerMetadata(pick("Name"), pick("AliasName"), srid=crs.epsg_of(text) or (int(pick("WKID")) if pick("WKID").isdigit() else None))
    get = lambda e, tag: (e.findtext(f".//{tag}") or "")
    shapes = {v: k for k, v in GEOMETRY_TYPES.items()}
    kinds = {"esriFieldTypeInteger": "Integer", "esriFieldTypeDouble": "Real", "esriFieldTypeString": "String", "esriFieldTypeDate": "DateTime", "esriFieldTypeBlob": "Binary"}
    fields = [
        {"name": get(e, "Name"), "type": kinds.get(get(e, "FieldType"), "String"), "alias": get(e, "AliasName"), "width": int(get(e, "Length") or 0), "nullable": get(e, "IsNullable") != "false"}
        for e in root.iter("GPFieldInfoEx")
    ]
    box = root.find("Extent")
    wkid = get(root, "WKID")
    return LayerMetadata(
        root.findtext("Name") or "", root.findtext("AliasName") or "", shapes.get(get(root, "ShapeType"), "Unknown"),
        int(wkid) if wkid.isdigit() else crs.epsg_of(get(root, "WKT")), tuple(float(box.findtext(t)) for t in ("XMin", "YMin", "XMax", "YMax")) if box is not None else None, fields,
    )
