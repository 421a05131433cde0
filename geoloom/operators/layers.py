"""Layer operators: fields, filters, identifiers, aggregates and edits.

A layer is a DataFrame with a WKB column ``geom`` and, where joins need them, ``xmin, ymin, xmax, ymax``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import geometry as G
from ..storage import materialize

# --- fields --------------------------------------------------------------------------------------------------


def add_field(layer: DataFrame, name: str, kind: str, default=None, width: int | None = None, nullable: bool = True) -> DataFrame:
    """A new field with a default; its width is kept as metadata.  An existing name is an error."""
    if name.lower() in (c.lower() for c in layer.columns):
        raise ValueError(f"field {name} exists")
    if default is None and not nullable:
        raise ValueError(f"field {name} needs a default")
    out = layer.withColumn(name, F.lit(default).cast(kind))
    return out.withMetadata(name, {"width": width}) if width else out


def drop_field(layer: DataFrame, name: str) -> DataFrame:
    if name not in layer.columns:
        raise ValueError(f"there is no field {name}")
    return layer.drop(name)


def drop_fields_like(layer: DataFrame, pattern: str) -> DataFrame:
    """Every field whose lower-cased name contains the lower-cased pattern goes."""
    return layer.drop(*[c for c in layer.columns if pattern.lower() in c.lower()])


def map_fields(layer: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None, rename: dict[str, str] | None = None, keep: tuple[str, ...] = ("geom",)) -> DataFrame:
    """Fields chosen and renamed; a list of names to include goes before one to exclude."""
    names = [c for c in layer.columns if c in keep or (c in include if include else c not in (exclude or []))]
    return layer.select(*[F.col(c).alias((rename or {}).get(c, c)) for c in names])


def copy_fields(source: DataFrame, target: T.StructType) -> DataFrame:
    """Rows of ``source`` in the schema of ``target``: equal names are cast, missing ones are null."""
    return source.select(*[(F.col(f.name) if f.name in source.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in target])


STRATEGIES = ("table1", "table2", "prefer1", "prefer2", "prefix")


def merge_fields(a: list[str], b: list[str], strategy: str, prefix: str = "l2_") -> list[tuple[str, str, str]]:
    """Output fields of a two-layer overlay as ``(side, field, name)``; names compare without case."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy}")
    taken, other = {x.lower() for x in a}, {x.lower() for x in b}
    if strategy == "table1":
        return [("a", x, x) for x in a]
    if strategy == "table2":
        return [("b", x, x) for x in b]
    if strategy == "prefer1":
        return [("a", x, x) for x in a] + [("b", x, x) for x in b if x.lower() not in taken]
    if strategy == "prefer2":
        return [("b", x, x) for x in b] + [("a", x, x) for x in a if x.lower() not in other]
    return [("a", x, x) for x in a] + [("b", x, prefix + x) for x in b]


def map_features(layer: DataFrame, f, schema: T.StructType | str) -> DataFrame:
    """``f(row as a dict) -> dict or None`` for every feature; None leaves it out.  Rows come and go in Arrow batches."""
    import pandas as pd

    names = T.StructType.fromDDL(schema).names if isinstance(schema, str) else schema.names

    def run(frames):
        for frame in frames:
            found = [x for x in map(f, frame.to_dict("records")) if x is not None]
            yield pd.DataFrame([[x.get(n) for n in names] for x in found], columns=names, dtype=object)

    return layer.mapInPandas(run, schema)


# --- identifiers ---------------------------------------------------------------------------------------------


def with_row_id(layer: DataFrame, name: str, order_by: list[str | Column]) -> DataFrame:
    """Dense numbers 1..n in the order of ``order_by``, without putting all rows in one task.

    Rows are dealt by range, sorted and written with their place in the range; counts of the ranges (one small row each)
    give the offsets.  Borders of ranges come from a sample that differs from run to run, so the places are never made twice.
    """
    parts = layer.repartitionByRange(*order_by).sortWithinPartitions(*order_by).withColumn("_p", F.spark_partition_id()).withColumn(
        "_i", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)
    )
    parts = materialize(parts, "ranges")
    counts = parts.groupBy("_p").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parts.join(F.broadcast(counts.select("_p", before.alias("_before"))), "_p").withColumn(name, F.col("_before") + F.col("_i") + 1).drop("_p", "_i", "_before")


def ensure_object_id(layer: DataFrame, order_by: list[str], name: str = "OBJECTID") -> DataFrame:
    """An object id added unless there is one under any spelling of the name."""
    return layer if name.lower() in (c.lower() for c in layer.columns) else with_row_id(layer, name, order_by)


# --- filters -------------------------------------------------------------------------------------------------


def meets(x0, y0, x1, y1) -> Column:
    """Whether envelopes meet a rectangle, borders included; min/max statistics of the scan can prune on it."""
    return (F.col("xmin") <= x1) & (F.col("xmax") >= x0) & (F.col("ymin") <= y1) & (F.col("ymax") >= y0)


def filter_extent(layer: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    return layer.where(meets(x0, y0, x1, y1))


def filter_geometry(layer: DataFrame, wkb: bytes) -> DataFrame:
    """Features that intersect a geometry: first by envelope, then exactly."""
    from ..kernel import model

    e = model.envelope(model.from_wkb(wkb))
    return layer.limit(0) if e is None else layer.where(meets(*e)).where(G.intersects(F.col("geom"), F.lit(wkb)))


def on_border(x0: float, y0: float, x1: float, y1: float, margin: float) -> Column:
    """Envelopes that aren't within a tile shrunk by ``margin``."""
    return ~((F.col("xmin") > x0 + margin) & (F.col("xmax") < x1 - margin) & (F.col("ymin") > y0 + margin) & (F.col("ymax") < y1 - margin))


# --- aggregates ----------------------------------------------------------------------------------------------


def extent(*layers: DataFrame) -> DataFrame:
    """One row with the envelope of all layers."""
    rows = None
    for x in layers:
        e = x.select("xmin", "ymin", "xmax", "ymax")
        rows = e if rows is None else rows.unionAll(e)
    return rows.agg(F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"))


def extent_wkt(*layers: DataFrame) -> DataFrame:
    """The envelope as a closed ring, from the lower left along the x axis."""
    corner = [("xmin", "ymin"), ("xmax", "ymin"), ("xmax", "ymax"), ("xmin", "ymax"), ("xmin", "ymin")]
    cells = [F.concat(F.col(x).cast("string"), F.lit(" "), F.col(y).cast("string")) for x, y in corner]
    return extent(*layers).select(F.concat(F.lit("POLYGON (("), F.concat_ws(",", *cells), F.lit("))")).alias("wkt"))


def count_valid(layer: DataFrame) -> DataFrame:
    """``(valid, invalid)``; null geometries count as neither."""
    ok = G.is_valid(F.col("geom"))
    return layer.where("geom is not null").select(ok.alias("ok")).agg(F.count_if("ok").alias("valid"), F.count_if(~F.col("ok")).alias("invalid"))


def append(target: DataFrame, *sources: DataFrame) -> DataFrame:
    """Rows of all layers, fields by name."""
    for s in sources:
        target = target.unionByName(s, allowMissingColumns=True)
    return target


def tile_index(x: Column, y: Column, bounds: tuple[float, float, float, float], n: int) -> Column:
    """Number of an n x n grid's cell, row 0 at the lowest y; the upper borders belong to the last cells."""
    x0, y0, x1, y1 = bounds
    at = lambda v, lo, hi: F.least(F.greatest(F.floor((v - lo) / ((hi - lo) / n)), F.lit(0)), F.lit(n - 1))
    return (at(y, y0, y1) * n + at(x, x0, x1)).cast("int")


# --- edits ---------------------------------------------------------------------------------------------------


@dataclass
class Edited:
    """A layer after an edit, and how many rows it touched."""

    layer: DataFrame
    count: int


def delete_where(layer: DataFrame, condition: str | Column) -> Edited:
    """Rows without those that meet the condition; none meeting it is an error."""
    c = F.expr(condition) if isinstance(condition, str) else condition
    hit = F.coalesce(c, F.lit(False))
    n = layer.where(hit).count()
    if not n:
        raise ValueError("no row meets the condition")
    return Edited(layer.where(~hit), n)


def delete_by_id(layer: DataFrame, object_id: int, name: str = "OBJECTID") -> Edited:
    return delete_where(layer, F.col(name) == object_id)


def insert(target: DataFrame, source: DataFrame, *, strict: bool = False, skip_invalid: bool = False, source_srid: int = 4326, target_srid: int = 4326) -> DataFrame:
    """``source`` appended in the schema of ``target``; geometries are moved to its system, failed ones left out."""
    if strict and (missing := [c for c in source.columns if c not in target.columns]):
        raise ValueError(f"the target has no {missing}")
    moved = source
    if source_srid != target_srid:
        moved = moved.withColumn("_g", G.transform(F.col("geom"), source_srid, target_srid)).where("_g is not null or geom is null").withColumn("geom", F.col("_g")).drop("_g")
    if skip_invalid:
        moved = moved.where(G.is_valid(F.col("geom")))
    return target.unionByName(copy_fields(moved, target.schema))


def sync_field(target: DataFrame, source: DataFrame, key: str, fields: dict[str, str], *, order_by: str | None = None, update_nulls: bool = False) -> DataFrame:
    """``target`` with fields taken from ``source`` by key: ``{source field: target field}``.

    Of rows with one key the last by ``order_by`` (else the greatest) counts; nulls overwrite only if asked to.
    """
    last = F.max_by(F.struct(*fields), F.col(order_by) if order_by else F.struct(*fields)).alias("_s")
    s = source.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(last)
    joined = target.join(s, target[key] == F.col("_k"), "left")
    for a, b in fields.items():
        value = F.col(f"_s.{a}")
        change = F.col("_k").isNotNull() if update_nulls else value.isNotNull()
        joined = joined.withColumn(b, F.when(change, value).otherwise(F.col(b)) if b in target.columns else value)
    return joined.drop("_k", "_s")


def sync_counts(target: DataFrame, source: DataFrame, key: str, field: str, update_nulls: bool = False) -> DataFrame:
    """``(updated, skipped, missing)`` rows of a :func:`sync_field`."""
    s = source.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.max(field).alias("_v"))
    j = target.join(s, target[key] == F.col("_k"), "left")
    found = F.col("_k").isNotNull()
    change = found if update_nulls else F.col("_v").isNotNull()
    return j.agg(F.count_if(change).alias("updated"), F.count_if(found & ~change).alias("skipped"), F.count_if(~found).alias("missing"))


def import_layer(source: DataFrame, *, allow_null: bool = False, skip_invalid: bool = True, source_srid: int = 4326, target_srid: int | None = None, on_error: str = "skip") -> tuple[DataFrame, DataFrame]:
    """``(rows to write, counts)``: null geometries are skipped unless allowed, invalid ones repaired or skipped,
    failed transformations skipped, kept raw, or an error (``skip``, ``raw``, ``fail``)."""
    if on_error not in ("skip", "raw", "fail"):
        raise ValueError(f"unknown policy {on_error}")
    g = F.col("geom")
    rows = source.withColumn("_ok", F.when(g.isNull(), F.lit(None)).otherwise(G.is_valid(g)))
    rows = rows.withColumn("_fixed", F.when(F.col("_ok"), g).otherwise(G.make_valid(g)))
    rows = rows.withColumn("_good", F.col("_ok") | (F.octet_length("_fixed") > 9))
    moved = F.col("_fixed") if target_srid in (None, source_srid) else G.transform(F.col("_fixed"), source_srid, target_srid)
    rows = rows.withColumn("_moved", moved)
    lost = g.isNotNull() & F.col("_moved").isNull() & F.col("_fixed").isNotNull()
    if on_error == "fail":
        rows = rows.withColumn("_moved", F.when(lost, F.raise_error(F.lit("a geometry can't be transformed"))).otherwise(F.col("_moved")))
    elif on_error == "raw":
        rows = rows.withColumn("_moved", F.when(lost, F.col("_fixed")).otherwise(F.col("_moved")))
    fate = F.when(g.isNull(), "inserted" if allow_null else "skipped").when(lost & F.lit(on_error == "skip"), "failed")
    fate = fate.when(F.coalesce("_good", F.lit(False)), "inserted").otherwise("skipped" if skip_invalid else "inserted")
    rows = rows.withColumn("_fate", fate)
    counts = rows.agg(F.count("*").alias("total"), *[F.count_if(F.col("_fate") == x).alias(x) for x in ("inserted", "failed", "skipped")])
    return rows.where("_fate = 'inserted'").withColumn("geom", F.col("_moved")).drop("_ok", "_fixed", "_good", "_moved", "_fate"), counts


# --- names ---------------------------------------------------------------------------------------------------


def sanitize_field_name(name: str, width: int = 10) -> str:
    """A name for a dBase table: blanks, hyphens and dots become underscores, ``f_`` goes before a digit."""
    out = re.sub(r"[ \-.]", "_", name)
    if out[:1].isdigit():
        out = "f_" + out
    while len(out.encode()) > width:
        out = out[:-1]
    return out


def sanitize_column(c: Column, width: int = 10) -> Column:
    """:func:`sanitize_field_name` for a column of ASCII names."""
    out = F.translate(c, " -.", "___")
    return F.substring(F.when(F.rlike(out, F.lit("^[0-9]")), F.concat(F.lit("f_"), out)).otherwise(out), 1, width)


def unique_field_names(names: list[str], width: int = 10) -> list[str]:
    """Sanitised names, numbered where the cut makes them equal."""
    out: list[str] = []
    for n in names:
        base = s = sanitize_field_name(n, width)
        k = 1
        while s.lower() in (x.lower() for x in out):
            tail = f"_{k}"
            s, k = base[: width - len(tail)] + tail, k + 1
        out.append(s)
    return out
