"""Field types: PostgreSQL names, layer types and Spark types, in one table."""

from __future__ import annotations

import re

from pyspark.sql import types as T

#: PostgreSQL type -> (layer type, default width).
POSTGRES = {
    "smallint": ("Integer", 0), "int2": ("Integer", 0), "integer": ("Integer", 0), "int": ("Integer", 0), "int4": ("Integer", 0), "serial": ("Integer", 0),
    "boolean": ("Integer", 0), "bool": ("Integer", 0), "bigint": ("Integer64", 0), "int8": ("Integer64", 0), "bigserial": ("Integer64", 0),
    "real": ("Real", 0), "float4": ("Real", 0), "double precision": ("Real", 0), "float8": ("Real", 0), "numeric": ("Real", 0), "decimal": ("Real", 0), "money": ("Real", 0),
    "varchar": ("String", 254), "character varying": ("String", 254), "char": ("String", 254), "character": ("String", 254), "bpchar": ("String", 254),
    "text": ("String", 2147483647), "uuid": ("String", 36), "date": ("Date", 0), "time": ("Time", 0), "timestamp": ("DateTime", 0), "timestamptz": ("DateTime", 0),
    "timestamp without time zone": ("DateTime", 0), "timestamp with time zone": ("DateTime", 0), "bytea": ("Binary", 0),
}
INCOMPATIBLE = ("json", "jsonb", "array", "hstore", "xml", "geometry", "geography")
SPARK = {
    "Integer": T.IntegerType(), "Integer64": T.LongType(), "Real": T.DoubleType(), "String": T.StringType(), "Date": T.DateType(),
    "Time": T.StringType(), "DateTime": T.TimestampNTZType(), "Binary": T.BinaryType(), "IntegerList": T.ArrayType(T.IntegerType()),
    "RealList": T.ArrayType(T.DoubleType()), "StringList": T.ArrayType(T.StringType()),
}
#: Where a target format can't hold a type: ``gdb`` has no 64-bit integers, file writers no binaries or lists.
DIALECTS = {
    "plain": {}, "gdb": {"Integer64": "Real", "Binary": "String", "IntegerList": "String", "RealList": "String", "StringList": "String"},
    "shp": {"Binary": "String", "Time": "String", "DateTime": "String", "IntegerList": "String", "RealList": "String", "StringList": "String"},
}
SHP_WIDTHS = {"Integer": (10, 0), "Integer64": (20, 0), "Real": (24, 15), "String": (254, 0), "Date": (8, 0)}


def split_type(name: str) -> tuple[str, int, int]:
    """``numeric(10,2)`` -> ("numeric", 10, 2)."""
    m = re.match(r"\s*([a-z0-9_ ]+?)\s*(?:\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\))?(\s+with(?:out)? time zone)?\s*$", name.lower())
    if not m:
        return name.lower().strip(), 0, 0
    return m[1] + (m[4] or ""), int(m[2] or 0), int(m[3] or 0)


def from_postgres(name: str, dialect: str = "plain") -> tuple[str, int, int, bool]:
    """``(layer type, width, precision, compatible)``; unknown types become strings."""
    base, width, precision = split_type(name)
    if name.endswith("[]") or base in INCOMPATIBLE:
        return "String", 254, 0, False
    kind, default = POSTGRES.get(base, ("String", 254))
    return DIALECTS[dialect].get(kind, kind), width or default, precision, True


def of_spark(kind: T.DataType) -> str:
    """Layer type of a Spark type; booleans are integers, what has no counterpart is a string."""
    if isinstance(kind, (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType)):
        return "Integer"
    if isinstance(kind, T.LongType):
        return "Integer64"
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "Real"
    if isinstance(kind, T.DateType):
        return "Date"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return "DateTime"
    if isinstance(kind, T.BinaryType):
        return "Binary"
    if isinstance(kind, T.ArrayType):
        return {"Integer": "IntegerList", "Integer64": "IntegerList", "Real": "RealList"}.get(of_spark(kind.elementType), "StringList")
    return "String"


def lossy(name: str, dialect: str = "plain") -> bool:
    """Whether values can lose digits: numerics become doubles, 64-bit integers too where the format lacks them."""
    base, _, _ = split_type(name)
    kind = POSTGRES.get(base, ("String", 0))[0]
    return base in ("numeric", "decimal", "money") or DIALECTS[dialect].get(kind) == "Real" and kind == "Integer64"


def geometry_compatible(source: str, target: str) -> bool:
    """A kind fits itself, its Multi form, and unknown."""
    s, t = source.lower(), target.lower()
    return t in ("unknown", "geometry", "geometrycollection") or s == t or t == "multi" + s
