"""Geometry values and their codecs: WKB and EWKB, WKT, GeoJSON.

A geometry is a tuple ``(kind, parts)``: Point ``[x, y]`` or None when empty; LineString an (n, 2) array; Polygon a
list of closed (n, 2) rings, the outer first; Multi* and collections a list of geometries.  Further ordinates are
dropped when a geometry is read.
"""

from __future__ import annotations

import json
import re
import struct

import numpy as np

POINT, LINE, POLYGON, MULTIPOINT, MULTILINE, MULTIPOLYGON, COLLECTION = range(1, 8)
NAMES = {
    POINT: "Point", LINE: "LineString", POLYGON: "Polygon", MULTIPOINT: "MultiPoint", MULTILINE: "MultiLineString",
    MULTIPOLYGON: "MultiPolygon", COLLECTION: "GeometryCollection",
}
KINDS = {v.upper(): k for k, v in NAMES.items()}
MULTI_OF = {POINT: MULTIPOINT, LINE: MULTILINE, POLYGON: MULTIPOLYGON}
SINGLE_OF = {v: k for k, v in MULTI_OF.items()}
Geometry = tuple


def ring(points) -> np.ndarray:
    return np.asarray(points, np.float64).reshape(-1, 2)


def polygon(*rings) -> Geometry:
    return (POLYGON, [ring(r) for r in rings])


def box(x0: float, y0: float, x1: float, y1: float) -> Geometry:
    return polygon([(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)])


def simple_parts(g: Geometry) -> list[Geometry]:
    """The points, lines and polygons that a geometry consists of; empty ones are left out."""
    if g is None:
        return []
    kind, parts = g
    if kind == POINT:
        return [g] if parts is not None else []
    if kind in (LINE, POLYGON):
        return [g] if len(parts) else []
    return [s for p in parts for s in simple_parts(p)]


def is_empty(g: Geometry | None) -> bool:
    return g is None or not simple_parts(g)


def build(parts: list[Geometry], kind: int | None = None) -> Geometry:
    """One geometry of simple parts: the part itself, a Multi* of one kind, or a collection."""
    if not parts:
        return (kind or COLLECTION, None if kind == POINT else [])
    kinds = {p[0] for p in parts}
    if len(kinds) == 1:
        k = kinds.pop()
        return parts[0] if len(parts) == 1 and kind is None else (MULTI_OF[k], parts)
    return (COLLECTION, parts)


def to_multi(g: Geometry | None, target: int = MULTIPOLYGON) -> Geometry | None:
    """The parts of ``g`` that belong to the family of ``target``; None if there are none."""
    found = [p for p in simple_parts(g) if p[0] == SINGLE_OF[target]]
    return (target, found) if found else None


def coordinates(g: Geometry) -> np.ndarray:
    out = [p[1] if p[0] == LINE else np.concatenate(p[1]) if p[0] == POLYGON else ring([p[1]]) for p in simple_parts(g)]
    return np.concatenate(out) if out else np.zeros((0, 2))


def map_coordinates(g: Geometry, f) -> Geometry:
    """``g`` with ``f`` applied to its (n, 2) coordinate arrays."""
    kind, parts = g
    if kind == POINT:
        return (kind, None if parts is None else f(ring([parts]))[0])
    if kind == LINE:
        return (kind, f(parts) if len(parts) else parts)
    if kind == POLYGON:
        return (kind, [f(r) for r in parts])
    return (kind, [map_coordinates(p, f) for p in parts])


def envelope(g: Geometry) -> tuple[float, float, float, float] | None:
    c = coordinates(g)
    return (*c.min(0).tolist(), *c.max(0).tolist()) if len(c) else None


# --- WKB -----------------------------------------------------------------------------------------------------


def from_wkb(data: bytes) -> Geometry:
    """WKB or EWKB of either byte order; SRID and Z/M ordinates are read over."""
    g, _ = _read(memoryview(bytes(data)), 0)
    return g


def _read(b: memoryview, at: int):
    order = "<" if b[at] == 1 else ">"
    (code,) = struct.unpack_from(order + "I", b, at + 1)
    at += 5
    dims = 2 + bool(code & 0x80000000) + bool(code & 0x40000000)
    if code & 0x20000000:
        at += 4
    kind = code & 0x0FFFFFFF
    dims += {1: 1, 2: 1, 3: 2}.get(kind // 1000, 0)
    kind %= 1000

    def points(n: int, at: int):
        return np.frombuffer(b, order + "f8", n * dims, at).reshape(n, dims)[:, :2].astype(np.float64), at + 8 * n * dims

    if kind == POINT:
        p, at = points(1, at)
        return (POINT, None if np.isnan(p).any() else p[0]), at
    (n,) = struct.unpack_from(order + "I", b, at)
    at += 4
    if kind == LINE:
        p, at = points(n, at)
        return (LINE, p), at
    parts = []
    for _ in range(n):
        if kind == POLYGON:
            (m,) = struct.unpack_from(order + "I", b, at)
            p, at = points(m, at + 4)
        else:
            p, at = _read(b, at)
        parts.append(p)
    if kind not in NAMES:
        raise ValueError(f"unknown geometry type {kind}")
    return (kind, parts), at


def to_wkb(g: Geometry) -> bytes:
    kind, parts = g
    head = b"\x01" + struct.pack("<I", kind)
    if kind == POINT:
        return head + np.asarray([np.nan, np.nan] if parts is None else parts, "<f8").tobytes()
    if kind == LINE:
        return head + struct.pack("<I", len(parts)) + np.asarray(parts, "<f8").tobytes()
    if kind == POLYGON:
        return head + struct.pack("<I", len(parts)) + b"".join(struct.pack("<I", len(r)) + np.asarray(r, "<f8").tobytes() for r in parts)
    return head + struct.pack("<I", len(parts)) + b"".join(map(to_wkb, parts))


# --- WKT -----------------------------------------------------------------------------------------------------


def _num(x: float) -> str:
    return str(int(x)) if float(x).is_integer() and abs(x) < 1e15 else repr(float(x))


def _text(points) -> str:
    return "(" + ",".join(f"{_num(x)} {_num(y)}" for x, y in points) + ")"


def to_wkt(g: Geometry) -> str:
    kind, parts = g
    name = NAMES[kind].upper()
    if parts is None or not len(parts):
        return f"{name} EMPTY"
    if kind == POINT:
        return f"{name} {_text([parts])}"
    if kind == LINE:
        return f"{name} {_text(parts)}"
    if kind == POLYGON:
        return f"{name} ({','.join(map(_text, parts))})"
    inner = [to_wkt(p) for p in parts]
    return f"{name} ({','.join(inner if kind == COLLECTION else [x[x.index(' ') + 1 :] for x in inner])})"


def from_wkt(text: str) -> Geometry:
    tokens = re.findall(r"[A-Za-z]+|[(),]|[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?", re.sub(r"^\s*SRID=\d+;", "", text))
    at = 0

    def take(expected: str | None = None) -> str:
        nonlocal at
        token = tokens[at]
        if expected is not None and token != expected:
            raise ValueError(f"expected {expected} but found {token}")
        at += 1
        return token

    def listed(item):
        take("(")
        out = [item()]
        while tokens[at] == ",":
            take()
            out.append(item())
        take(")")
        return out

    def position():
        out = []
        while tokens[at] not in (",", ")"):
            out.append(float(take()))
        return out[:2]

    def bare_or_wrapped():
        return listed(position)[0] if tokens[at] == "(" else position()

    def geometry() -> Geometry:
        kind = KINDS[take().upper()]
        if tokens[at].upper() in ("Z", "M", "ZM"):
            take()
        if tokens[at].upper() == "EMPTY":
            take()
            return (kind, None if kind == POINT else ring([]) if kind == LINE else [])
        return (kind, body(kind))

    def body(kind: int):
        if kind == POINT:
            return np.asarray(listed(position)[0])
        if kind == LINE:
            return ring(listed(position))
        if kind == POLYGON:
            return [ring(r) for r in listed(lambda: listed(position))]
        if kind == MULTIPOINT:
            return [(POINT, np.asarray(p)) for p in listed(bare_or_wrapped)]
        if kind == COLLECTION:
            return listed(geometry)
        return listed(lambda: (SINGLE_OF[kind], body(SINGLE_OF[kind])))

    out = geometry()
    if at != len(tokens):
        raise ValueError(f"unexpected {tokens[at]}")
    return out


# --- GeoJSON -------------------------------------------------------------------------------------------------


def from_geojson(value) -> Geometry | None:
    """A geometry object, as text or parsed; None for null."""
    if isinstance(value, str):
        value = json.loads(value)
    if value is None:
        return None
    kind = KINDS[value["type"].upper()]
    if kind == COLLECTION:
        return (kind, [from_geojson(x) for x in value["geometries"]])
    c = value["coordinates"]
    flat = lambda ps: ring([p[:2] for p in ps])
    if kind == POINT:
        return (kind, np.asarray(c[:2], np.float64) if c else None)
    if kind == LINE:
        return (kind, flat(c))
    if kind == POLYGON:
        return (kind, [flat(r) for r in c])
    if kind == MULTIPOINT:
        return (kind, [(POINT, np.asarray(p[:2], np.float64)) for p in c])
    if kind == MULTILINE:
        return (kind, [(LINE, flat(p)) for p in c])
    return (kind, [(POLYGON, [flat(r) for r in p]) for p in c])


def to_geojson(g: Geometry) -> str:
    def coords(g: Geometry):
        kind, parts = g
        if kind == POINT:
            return [] if parts is None else [float(v) for v in parts]
        if kind == LINE:
            return [[float(x), float(y)] for x, y in parts]
        if kind == POLYGON:
            return [[[float(x), float(y)] for x, y in r] for r in parts]
        return [coords(p) for p in parts]

    def obj(g: Geometry):
        if g[0] == COLLECTION:
            return {"type": NAMES[g[0]], "geometries": [obj(p) for p in g[1]]}
        return {"type": NAMES[g[0]], "coordinates": coords(g)}

    return json.dumps(obj(g), separators=(",", ":"))
