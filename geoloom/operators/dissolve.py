"""Dissolve, self-overlap and containment."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as G
from ..kernel import model, planar
from ..storage import materialize
from .layers import with_row_id
from .overlay import BOX, _met, members_by, prepared, prepared_pairs, union_by, with_geometry


def dissolve(layer: DataFrame, fields: list[str], order_by: str, *, grid: float = 0.0) -> DataFrame:
    """One feature for each value of ``fields``; other fields come from the group's first row by ``order_by``.

    Groups are real column values: null is its own group and no two groups share a key.
    """
    if not fields or (missing := [f for f in fields if f not in layer.columns]):
        raise ValueError(f"unknown or no group fields: {fields and missing}")
    others = [c for c in layer.columns if c not in (*fields, *BOX, "geom")]
    first = layer.groupBy(*fields).agg(F.min_by(F.struct(*others), F.col(order_by)).alias("_f")) if others else layer.select(*fields).distinct()
    merged = union_by(layer, fields).select(*[F.col(f).alias(f"_k_{f}") for f in fields], "geom")
    same = None
    for f in fields:
        c = F.col(f).eqNullSafe(F.col(f"_k_{f}"))
        same = c if same is None else same & c
    geom = G.snap(F.col("geom"), F.lit(float(grid))) if grid > 0 else F.col("geom")
    return first.join(merged, same).select(*fields, *[F.col(f"_f.{c}").alias(c) for c in others], geom.alias("geom"))


def dissolve_field(layer: DataFrame, field: str) -> DataFrame:
    """One feature for each value of one field, which is all that is kept of the fields."""
    return union_by(layer, [field])


def union_layer(layer: DataFrame) -> DataFrame:
    """One feature of the whole layer, none for an empty one."""
    return union_by(layer.where("geom is not null"), []).where("geom is not null")


def self_overlap(layer: DataFrame, key: str, size: float | None = None) -> DataFrame:
    """Features less their common parts, and each common part once, with the fields of the smaller key."""
    rest, common = self_overlap_parts(layer, key, size)
    return rest.unionByName(common)


def self_overlap_parts(layer: DataFrame, key: str, size: float | None = None) -> tuple[DataFrame, DataFrame]:
    """``(features less their common parts, each common part once)``.

    Features of one shape are common to one another as a whole, so nothing is left of them, and only the one with the
    smallest key can give its fields to a common part.
    """
    layer = prepared(layer)
    own = layer.rows.groupBy("_row").agg(F.min_by(F.struct(*layer.fields), key).alias("_f"), F.min(key).alias("_low"), F.max(key).alias("_high"))
    shapes = materialize(layer.shapes.join(own, "_row"), "owned")
    met = with_geometry(prepared_pairs(layer, layer, size, where=F.col("a__row") < F.col("b__row")), shapes, shapes)
    met = met.where("a__low < b__high or b__low < a__high").withColumn("_first", (F.col("a__low") < F.col("b__high")) & ((F.col("a__low") <= F.col("b__low")) | (F.col("b__low") >= F.col("a__high"))))
    met = met.withColumns({c: F.when(F.col("_first"), F.col(f"a_{c}")).otherwise(F.col(f"b_{c}")) for c in ("_f", "_low")})
    common = materialize(met.withColumn("_g", G.common_area("a_geom", "b_geom")).where("_g is not null").select("a__row", "b__row", "_f", "_low", "_g"), "common")
    twins = shapes.where("_low < _high").select("_f", "_low", G.common_area("geom", "geom").alias("_g")).where("_g is not null")
    once = common.select("_f", "_low", "_g").unionByName(twins).withColumn("_t", G.as_wkt(F.col("_g"))).groupBy("_t").agg(F.min_by(F.struct("_f", "_g"), "_low").alias("_r"))
    cuts = common.select(F.explode(F.array("a__row", "b__row")).alias("_row"), F.col("_g").alias("geom"))
    single = shapes.where("_low = _high or _low is null")
    rest = single.join(members_by(cuts, ["_row"]), "_row", "left").select("_row", G.rest_of_all("geom", "_members").alias("geom")).where("geom is not null")
    return layer.meets(rest).select(*layer.fields, "geom"), once.select("_r._f.*", F.col("_r._g").alias("geom")).select(*layer.fields, "geom")


def containment(layer: DataFrame, key: str, size: float | None = None, boxes: bool = False) -> DataFrame:
    """``(key, parent, level)``: the smallest larger polygon around each, and how many are around it.

    Containers of a polygon are found by one grid join; those of nested polygons form a chain, so the level is their
    number and the parent the one with the least area (then the greatest key).  ``boxes`` compares envelopes alone.
    """
    if not boxes:
        return _nested(layer.select(key, "geom"), key, size).select(key, "parent", "level")
    g = layer.select(key, *BOX)
    shapes = g.groupBy(*BOX).agg(F.count("*").alias("_n"), F.max(key).alias("_top")).withColumn("area", (F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin")))
    best = _nearest(_met(shapes, shapes, size).where(INSIDE).where("b_area > a_area"), BOX)
    return g.join(best, list(BOX), "left").select(key, "parent", F.coalesce("level", F.lit(0)).alias("level"))


INSIDE = "a_xmin >= b_xmin and a_xmax <= b_xmax and a_ymin >= b_ymin and a_ymax <= b_ymax"


def _nearest(pairs: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """For each shape ``a`` the feature of least area (then greatest key) among the shapes ``b``, and the number of their features."""
    return pairs.groupBy(*[F.col(f"a_{k}").alias(k) for k in keys]).agg(
        F.min_by("b__top", F.struct("b_area", -F.col("b__top"))).alias("parent"), F.sum("b__n").cast("int").alias("level")
    )


def _nested(layer: DataFrame, key: str, size: float | None) -> DataFrame:
    """All fields and the geometry of each feature, with ``parent`` and ``level``; shapes are compared, not features."""
    layer = prepared(layer)
    own = layer.rows.groupBy("_row").agg(F.count("*").alias("_n"), F.max(key).alias("_top"))
    shapes = materialize(layer.shapes.join(own, "_row").withColumn("area", G.area(F.col("geom"))), "areas")
    pairs = with_geometry(prepared_pairs(layer, layer, size, where=F.expr(INSIDE)), shapes, shapes).where("b_area > a_area")
    pairs = pairs.withColumn("_in", G.contains.asNondeterministic()(F.col("b_geom"), F.col("a_geom"))).where("_in")
    found = shapes.select("_row", "geom").join(_nearest(pairs, ("_row",)), "_row", "left")
    return layer.meets(found).select(*layer.fields, "geom", "parent", F.coalesce("level", F.lit(0)).alias("level"))


@F.pandas_udf(T.BinaryType())
def _with_holes(outer: pd.Series, holes: pd.Series) -> pd.Series:
    out = []
    for g, hs in zip(outer, holes, strict=True):
        shell = [p for p in model.simple_parts(model.from_wkb(g)) if p[0] == model.POLYGON][0][1][0]
        rings = [r for h in (hs if hs is not None else []) for p in model.simple_parts(model.from_wkb(h)) if p[0] == model.POLYGON for r in [p[1][0]]]
        out.append(model.to_wkb((model.POLYGON, [shell, *rings])))
    return pd.Series(out, dtype=object)


def donuts(layer: DataFrame, key: str, *, simplify: float = 0.0, size: float | None = None) -> DataFrame:
    """Polygons at an even depth with the ones directly inside as holes; those at an odd depth as they are.

    Only outer rings count.  ``simplify`` is applied first.
    """
    g = layer.drop(*BOX).withColumn("geom", G.exterior(F.col("geom")))
    if simplify > 0:
        g = g.withColumn("geom", G.simplify(F.col("geom"), simplify, True))
    nodes = materialize(_nested(g, key, size), "nodes")
    holes = nodes.where("parent is not null and level % 2 = 1").groupBy(F.col("parent").alias("_p")).agg(F.collect_list("geom").alias("_h"))
    out = nodes.join(holes, F.col(key) == F.col("_p"), "left")
    geom = F.when(F.col("level") % 2 == 0, _with_holes(F.col("geom"), F.coalesce("_h", F.array().cast("array<binary>")))).otherwise(F.col("geom"))
    return out.withColumn("geom", geom).drop("_p", "_h", "parent")


def rank_by_area(layer: DataFrame, key: str) -> DataFrame:
    """``rank`` from the largest area down, ties by key; for ordering, not for a sort of all rows in one task."""
    return with_row_id(layer.withColumn("area", G.area(F.col("geom"))), "rank", [F.desc("area"), F.col(key)])


def longest_part(line_wkb: bytes) -> bytes:
    return model.to_wkb(planar.longest_part(model.from_wkb(line_wkb)))
