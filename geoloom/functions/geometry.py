"""Geometry functions on WKB columns.

Header facts (type, family, hex) are plain expressions; everything else is an Arrow-batched UDF over the kernel.
``null`` follows the rules of the engine: predicates give false (disjoint and empty true), measures 0, distance -1.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..kernel import crs, model, planar
from ..kernel.calls import lift as _lift
from ..kernel.calls import memory as _memory
from ..kernel.calls import name as _name
from ..kernel.calls import read as _read
from ..kernel.calls import write as _write

BOUNDS = T.StructType([T.StructField(n, T.DoubleType()) for n in ("xmin", "ymin", "xmax", "ymax")])


def _one(f: Callable, kind) -> Callable[[Column], Column]:
    """UDF of one geometry; a worker remembers results, so that repeated geometries are computed once."""
    name = _name()

    @F.pandas_udf(kind)
    def run(g: pd.Series) -> pd.Series:
        known = _memory(name)
        return pd.Series([known[x] if x in known else known.keep(x, f(_read(x))) for x in g], dtype=object)

    return run


def _two(f: Callable, kind) -> Callable[[Column, Column], Column]:
    name = _name()

    @F.pandas_udf(kind)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        parsed: dict = {}
        known = _memory(name)

        def read(x):
            if x not in parsed:
                if len(parsed) > 10_000:
                    parsed.clear()
                parsed[x] = _read(x)
            return parsed[x]

        return pd.Series([known[k] if k in known else known.keep(k, f(read(k[0]), read(k[1]))) for k in zip(a, b, strict=True)], dtype=object)

    return run


def _with(f: Callable, kind) -> Callable:
    """UDF of a geometry and one number column."""
    name = _name()

    @F.pandas_udf(kind)
    def run(g: pd.Series, v: pd.Series) -> pd.Series:
        known = _memory(name)
        return pd.Series([known[k] if k in known else known.keep(k, f(_read(k[0]), k[1])) for k in zip(g, v, strict=True)], dtype=object)

    return run


# --- header facts, native ------------------------------------------------------------------------------------


def wkb_type(g: Column) -> Column:
    """Type code of WKB in either byte order without flags and dimensions; 0 for null and for less than five bytes."""
    h = F.hex(g)
    little = F.concat(F.substring(h, 9, 2), F.substring(h, 7, 2), F.substring(h, 5, 2), F.substring(h, 3, 2))
    code = F.conv(F.when(F.substring(h, 1, 2) == "01", little).otherwise(F.substring(h, 3, 8)), 16, 10).cast("long")
    plain = code.bitwiseAND(F.lit(0x0FFFFFFF)) % 1000
    return F.when(F.octet_length(g) >= 5, plain).otherwise(0).cast("int")


def wkb_family(g: Column) -> Column:
    """point, line, polygon or unknown; Multi* belongs to its single kind."""
    t = wkb_type(g)
    return F.when(t.isin(1, 4), "point").when(t.isin(2, 5), "line").when(t.isin(3, 6), "polygon").otherwise("unknown")


def is_valid_wkb(hex_text: Column) -> Column:
    """Whether hexadecimal text has a WKB header: byte order 0 or 1 and a known type."""
    fine = F.rlike(hex_text, F.lit("^([0-9A-Fa-f]{2}){5,}$"))
    raw = F.when(fine, F.unhex(hex_text))
    return F.coalesce(fine & F.substring(hex_text, 1, 2).isin("00", "01") & wkb_type(raw).between(1, 7), F.lit(False))


def wkb_hex(g: Column) -> Column:
    return F.lower(F.hex(g))


_NAMES = {k: v for k, v in model.NAMES.items()}


def geometry_type(g: Column) -> Column:
    t = wkb_type(g)
    out = None
    for code, name in _NAMES.items():
        out = F.when(t == code, name) if out is None else out.when(t == code, name)
    return out.otherwise("Unknown")


def point(x: Column, y: Column) -> Column:
    """Little-endian WKB point, without a UDF where Spark can lay out doubles."""
    return _make_point(x, y)


@F.pandas_udf(T.BinaryType())
def _make_point(x: pd.Series, y: pd.Series) -> pd.Series:
    import struct

    return pd.Series([None if pd.isna(a) or pd.isna(b) else struct.pack("<BIdd", 1, 1, a, b) for a, b in zip(x, y, strict=True)], dtype=object)


@F.pandas_udf(T.BinaryType())
def _make_box(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    import struct

    return pd.Series([
        None if pd.isna(p) or pd.isna(q) or pd.isna(r) or pd.isna(s) else struct.pack("<BIIIdddddddddd", 1, 3, 1, 5, p, q, r, q, r, s, p, s, p, q)
        for p, q, r, s in zip(a, b, c, d, strict=True)
    ], dtype=object)


@F.pandas_udf(T.BinaryType())
def make_line(points: pd.Series) -> pd.Series:
    """LineString of an array of ``[x, y]`` arrays."""
    return pd.Series([None if p is None or len(p) == 0 else model.to_wkb((model.LINE, model.ring([list(q) for q in p]))) for p in points], dtype=object)


@F.pandas_udf(T.BinaryType())
def make_polygon(rings: pd.Series) -> pd.Series:
    """Polygon of an array of rings, the outer first; rings are closed."""
    out = []
    for rs in rings:
        g = None if rs is None or len(rs) == 0 else planar.close_rings((model.POLYGON, [model.ring([list(q) for q in r]) for r in rs]))
        out.append(None if g is None else model.to_wkb(g))
    return pd.Series(out, dtype=object)


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Rectangle as a WKB polygon."""
    return _make_box(x0, y0, x1, y1)


# --- codecs --------------------------------------------------------------------------------------------------

@F.pandas_udf(T.BinaryType())
def geom_from_wkt(s: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else _write(model.from_wkt(x)) for x in s], dtype=object)


@F.pandas_udf(T.BinaryType())
def geom_from_geojson(s: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else _write(model.from_geojson(x)) for x in s], dtype=object)


as_wkt = _one(lambda g: None if g is None else model.to_wkt(g), T.StringType())
as_geojson = _one(lambda g: None if g is None else model.to_geojson(g), T.StringType())
as_wkb = _one(_write, T.BinaryType())

@F.pandas_udf(BOUNDS)
def envelope(g: pd.Series) -> pd.DataFrame:
    rows = [model.envelope(_read(x)) if x is not None else None for x in g]
    return pd.DataFrame([r or (None,) * 4 for r in rows], columns=BOUNDS.names, dtype="float64")


# --- measures and predicates ---------------------------------------------------------------------------------

area = _one(lambda g: float(planar.area(g)), T.DoubleType())
length = _one(lambda g: float(planar.length(g)), T.DoubleType())
num_points = _one(planar.point_count, T.IntegerType())
dimension = _one(planar.dimension, T.IntegerType())
distance = _two(lambda a, b: float(planar.distance(a, b)), T.DoubleType())
is_valid = _one(planar.is_valid, T.BooleanType())
is_simple = _one(planar.is_simple, T.BooleanType())
is_empty = _one(model.is_empty, T.BooleanType())
is_ring = _one(lambda g: g is not None and g[0] == model.LINE and len(g[1]) > 3 and bool((g[1][0] == g[1][-1]).all()) and planar.is_simple(g), T.BooleanType())


def _predicate(f: Callable) -> Callable[[Column, Column], Column]:
    return _two(lambda a, b: a is not None and b is not None and bool(f(a, b)), T.BooleanType())


intersects = _predicate(planar.intersects)
contains = _predicate(planar.contains)
within = _predicate(planar.within)
touches = _predicate(planar.touches)
crosses = _predicate(planar.crosses)
overlaps = _predicate(planar.overlaps)
equals = _predicate(planar.equals)
disjoint = _two(lambda a, b: a is None or b is None or not planar.intersects(a, b), T.BooleanType())
wkt_equal = _two(lambda a, b: a is not None and b is not None and model.to_wkt(a) == model.to_wkt(b), T.BooleanType())

# --- shapes --------------------------------------------------------------------------------------------------


centroid = _one(_lift(planar.centroid), T.BinaryType())
convex_hull = _one(_lift(planar.convex_hull), T.BinaryType())
boundary = _one(_lift(planar.boundary), T.BinaryType())
make_valid = _one(_lift(planar.make_valid), T.BinaryType())
close_rings = _one(_lift(planar.close_rings), T.BinaryType())
#: Not deterministic by declaration: a filter on the result doesn't make Spark compute it twice.
to_multi_polygon = _one(lambda g: _write(planar.polygonal(g)), T.BinaryType()).asNondeterministic()
exterior = _one(_lift(lambda g: model.build([(model.POLYGON, [p[1][0]]) for p in model.simple_parts(g) if p[0] == model.POLYGON])), T.BinaryType())
longest_line = _one(_lift(planar.longest_part), T.BinaryType())
auto_distance = _one(lambda g: None if g is None else float(planar.auto_distance(g)), T.DoubleType())
segmentize = _with(_lift(planar.segmentize), T.BinaryType())
snap = _with(_lift(planar.snap_to_grid), T.BinaryType())


def remove_duplicate_points(g: Column, strict: bool = True) -> Column:
    """A copy, as the engine this follows does; with ``strict=False`` repeated points go."""
    return g if strict else _one(_lift(planar.remove_repeated), T.BinaryType())(g)


def buffer(g: Column, d, quad_segs: int = 30) -> Column:
    d = d if isinstance(d, Column) else F.lit(float(d))
    return _with(_lift(lambda g, d: planar.buffer(g, d, quad_segs)), T.BinaryType())(g, d)


def buffer_auto(g: Column, ratio: float = 1.5, quad_segs: int = 30) -> Column:
    return _one(_lift(lambda g: planar.buffer_auto(g, ratio, quad_segs)), T.BinaryType())(g)


def simplify(g: Column, tolerance: float, preserve: bool = False) -> Column:
    return _one(_lift(lambda g: planar.simplify(g, tolerance, preserve)), T.BinaryType())(g)


def _set_operation(how: str) -> Callable[[Column, Column], Column]:
    return _two(lambda a, b: None if a is None or b is None else _write(planar.overlay(a, b, how)), T.BinaryType())


#: A little-endian polygon of one ring of five points, as WKB.
_BOX = np.dtype([("order", "u1"), ("kind", "<u4"), ("rings", "<u4"), ("points", "<u4"), ("xy", "<f8", (5, 2))])
_BOX_HEAD = np.array((1, 3, 1, 5, np.zeros((5, 2))), _BOX)


def _boxes(col: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Which values are axis-parallel rectangles, and the bounds of all (NaN where they aren't)."""
    fits = np.fromiter((x is not None and len(x) == _BOX.itemsize for x in col), bool, len(col))
    bounds = np.full((len(col), 4), np.nan)
    raw = np.frombuffer(b"".join(bytes(x) for x in col[fits]), _BOX)
    xy, step = raw["xy"], np.diff(raw["xy"], axis=1)
    ok = (raw["order"] == 1) & (raw["kind"] == 3) & (raw["rings"] == 1) & (raw["points"] == 5)
    ok &= ((step != 0).sum(2) == 1).all(1) & (xy[:, 0] == xy[:, 4]).all(1) & (step[:, 0] + step[:, 2] == 0).all(1)
    at = np.flatnonzero(fits)[ok]
    bounds[at, :2], bounds[at, 2:] = xy[ok].min(1), xy[ok].max(1)
    return ~np.isnan(bounds[:, 0]), bounds


def _multi(g) -> bytes | None:
    return _write(planar.polygonal(g))


def _common_boxes(a: pd.Series, b: pd.Series) -> tuple[np.ndarray, list]:
    """Pairs of rectangles, and their common ones as MultiPolygons (None where they don't overlap); whole columns."""
    (is_a, p), (is_b, q) = _boxes(a), _boxes(b)
    both = np.flatnonzero(is_a & is_b)
    out: list = [None] * len(a)
    low, high = np.maximum(p[both, :2], q[both, :2]), np.minimum(p[both, 2:], q[both, 2:])
    some = (low < high).all(1)
    made = np.repeat(_BOX_HEAD, int(some.sum()))
    made["xy"] = np.stack([low[some], np.stack([high[some, 0], low[some, 1]], 1), high[some], np.stack([low[some, 0], high[some, 1]], 1), low[some]], 1)
    raw, n, head = made.tobytes(), _BOX.itemsize, b"\x01\x06\x00\x00\x00\x01\x00\x00\x00"
    for k, i in enumerate(both[some].tolist()):
        out[i] = head + raw[k * n : (k + 1) * n]
    return is_a & is_b, out


def _areal(how: str):
    """Overlay of two columns as MultiPolygons, null where nothing polygonal is left.

    Not deterministic by declaration, so that a filter on the result doesn't make Spark compute it twice.
    """

    @F.pandas_udf(T.BinaryType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        done, out = _common_boxes(a, b) if how == "intersection" else (np.zeros(len(a), bool), [None] * len(a))
        known: dict = {}

        def read(x):
            if x not in known:
                if len(known) > 10_000:
                    known.clear()
                known[x] = _read(x)
            return known[x]

        for i in np.flatnonzero(~done).tolist():
            x, y = a.iloc[i], b.iloc[i]
            if x is not None and y is not None:
                out[i] = _multi(planar.overlay(read(x), read(y), how))
        return pd.Series(out, dtype=object)

    return run.asNondeterministic()


common_area = _areal("intersection")


@F.pandas_udf(T.BinaryType())
def union_list(members: pd.Series) -> pd.Series:
    """Union of each array of geometries; members that aren't valid are repaired first."""
    return pd.Series([_union_of(m) for m in members], dtype=object)


def _union_of(members) -> bytes | None:
    members = [x for x in members if x is not None] if members is not None else []
    if len(members) < 2:
        parts = [_read(x) for x in members]
        return _write(parts[0] if planar.is_box(parts[0]) or planar.is_valid(parts[0]) else planar.make_valid(parts[0])) if parts else None
    parts = [_read(x) for x in dict.fromkeys(members)]
    parts = [p if planar.is_box(p) or planar.is_valid(p) else planar.make_valid(p) for p in parts]
    return _write(parts[0] if len(parts) == 1 else planar.union_all(parts))


def _against(how: str):
    """Overlay of a geometry with the union of an array of others, as :func:`_areal`.

    Rectangles among the others are cut to the geometry's bounds first; one that covers these settles the matter.
    """

    @F.pandas_udf(T.BinaryType())
    def run(a: pd.Series, others: pd.Series) -> pd.Series:
        known: dict = {}

        def read(x):
            if x not in known:
                if len(known) > 10_000:
                    known.clear()
                g = _read(x)
                b = planar.is_box(g)
                known[x] = b, g if b or planar.is_valid(g) else planar.make_valid(g)
            return known[x]

        def one(g, members):
            low_x, low_y, high_x, high_y = bounds = model.envelope(g)
            boxes, shapes = set(), []
            for m in dict.fromkeys(members):
                b, shape = read(m)
                if b:
                    cut = max(b[0], low_x), max(b[1], low_y), min(b[2], high_x), min(b[3], high_y)
                    if cut == bounds:
                        return g if how == "intersection" else None
                    if cut[0] < cut[2] and cut[1] < cut[3]:
                        boxes.add(cut)
                else:
                    shapes.append(shape)
            inner = lambda p, q: p[0] >= q[0] and p[1] >= q[1] and p[2] <= q[2] and p[3] <= q[3]
            if len(boxes) <= 64:
                boxes = [p for p in boxes if not any(p != q and inner(p, q) for q in boxes)]
            shapes += [model.box(*p) for p in sorted(boxes)]
            if not shapes:
                return None if how == "intersection" else g
            return planar.overlay(g, shapes[0] if len(shapes) == 1 else planar.union_all(shapes), how)

        out = []
        for x, members in zip(a, others, strict=True):
            g = _read(x) if x is not None else None
            if g is None or model.is_empty(g):
                out.append(None)
                continue
            members = [m for m in members if m is not None] if members is not None else []
            out.append(_multi(one(g, members) if members else None if how == "intersection" else g))
        return pd.Series(out, dtype=object)

    return run.asNondeterministic()


common_with_all = _against("intersection")
rest_of_all = _against("difference")


def prepared(valid: bool, grid: float):
    """UDF of a geometry: itself, repaired and snapped if asked for, and its bounds, in one go."""
    kind = T.StructType([T.StructField("geom", T.BinaryType()), *BOUNDS.fields])

    @F.pandas_udf(kind)
    def run(g: pd.Series) -> pd.DataFrame:
        rows = []
        plain, bounds = _boxes(g)
        for x, fits, at in zip(g, plain, bounds.tolist(), strict=True):
            if fits and grid <= 0:
                rows.append((x, *at))
                continue
            shape = _read(x) if x is not None else None
            if shape is not None and valid:
                shape = planar.make_valid(shape)
            if shape is not None and grid > 0:
                shape = planar.snap_to_grid(shape, grid)
            at = model.envelope(shape) if shape is not None else None
            rows.append((_write(shape) if valid or grid > 0 else x, *at) if at else (None,) * 5)
        return pd.DataFrame(rows, columns=kind.names).astype(dict.fromkeys(BOUNDS.names, "float64"))

    return run.asNondeterministic()


intersection = _set_operation("intersection")
difference = _set_operation("difference")
union = _set_operation("union")
sym_difference = _set_operation("symdifference")


def line_minus_boundary(line: Column, polygon: Column, tolerance: float = 0.0) -> Column:
    """The longest piece of a line that doesn't run along a polygon's border."""

    def f(a, b):
        return None if a is None or b is None else _write(planar.longest_part(planar.line_difference(a, b, tolerance)))

    return _two(f, T.BinaryType())(line, polygon)


def transform(g: Column, source: int, target: int) -> Column:
    """Coordinates from one EPSG code to another; null where a point has no image."""

    def f(g):
        try:
            return None if g is None else _write(crs.transform(g, source, target))
        except ValueError:
            return None

    crs.lookup(source), crs.lookup(target)
    return _one(f, T.BinaryType())(g)


@F.pandas_udf(T.BinaryType())
def union_agg(g: pd.Series) -> bytes:
    """Union of a group, for SQL; members that aren't valid are repaired first."""
    return _union_of(list(g))


def with_envelope(layer: DataFrame, geom: str = "geom") -> DataFrame:
    """``xmin, ymin, xmax, ymax`` beside the geometry; scans can prune on them once they are stored."""
    return layer.withColumn("_e", envelope(F.col(geom))).select(*[c for c in layer.columns if c not in BOUNDS.names], "_e.*")


def register_functions(spark) -> list[str]:
    """Publish the functions for SQL under ``geo_`` names."""
    scalar = {
        "area": area, "length": length, "distance": distance, "intersects": intersects, "contains": contains, "within": within,
        "touches": touches, "crosses": crosses, "overlaps": overlaps, "equals": equals, "disjoint": disjoint, "is_valid": is_valid,
        "is_simple": is_simple, "is_empty": is_empty, "centroid": centroid, "convex_hull": convex_hull, "boundary": boundary,
        "make_valid": make_valid, "intersection": intersection, "difference": difference, "union": union, "sym_difference": sym_difference,
        "from_wkt": geom_from_wkt, "as_wkt": as_wkt, "from_geojson": geom_from_geojson, "as_geojson": as_geojson, "envelope": envelope,
        "point": _make_point, "box": _make_box, "union_agg": union_agg, "num_points": num_points,
    }
    for name, f in scalar.items():
        spark.udf.register(f"geo_{name}", f)
    return [f"geo_{n}" for n in scalar]
