"""File formats as plain functions over bytes: Shapefile, dBase, KML, DXF, PNG, TIFF."""

from __future__ import annotations

import datetime as dt
import io
import math
import struct
import xml.etree.ElementTree as ET
import zipfile
import zlib

import numpy as np

from ..kernel import model, planar
from ..kernel.model import LINE, MULTILINE, MULTIPOINT, MULTIPOLYGON, POINT, POLYGON, Geometry

# --- Shapefile -----------------------------------------------------------------------------------------------

SHP_TYPES = {POINT: 1, MULTIPOINT: 8, LINE: 3, MULTILINE: 3, POLYGON: 5, MULTIPOLYGON: 5}


def read_shp(data: bytes) -> list[Geometry | None]:
    """Geometries of a .shp file; Z and M are read over."""
    out, at = [], 100
    while at + 12 <= len(data):
        (words,) = struct.unpack_from(">i", data, at + 4)
        body = data[at + 8 : at + 8 + 2 * words]
        at += 8 + 2 * words
        (kind,) = struct.unpack_from("<i", body, 0)
        base = kind % 10
        if kind == 0:
            out.append(None)
        elif base == 1:
            out.append((POINT, np.frombuffer(body, "<f8", 2, 4).copy()))
        elif base == 8:
            (n,) = struct.unpack_from("<i", body, 36)
            out.append((MULTIPOINT, [(POINT, p) for p in np.frombuffer(body, "<f8", 2 * n, 40).reshape(-1, 2).copy()]))
        else:
            parts, n = struct.unpack_from("<ii", body, 36)
            starts = [*np.frombuffer(body, "<i4", parts, 44), n]
            pts = np.frombuffer(body, "<f8", 2 * n, 44 + 4 * parts).reshape(-1, 2).copy()
            rings = [pts[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]
            out.append(_rings_to_polygons(rings) if base == 5 else model.build([(LINE, r) for r in rings]))
    return out


def _rings_to_polygons(rings: list[np.ndarray]) -> Geometry:
    """Clockwise rings are shells; each other ring goes into the smallest shell around it."""
    shells = sorted(([r] for r in rings if planar.signed_area(r) <= 0), key=lambda s: -planar.signed_area(s[0]))
    for h in (r for r in rings if planar.signed_area(r) > 0):
        home = next((s for s in shells if planar.locate_ring(planar._inner(h), s[0]) != planar.OUT), None)
        if home is None:
            shells.append([h])
        else:
            home.append(h)
    return model.build([(POLYGON, s) for s in shells]) if shells else (POLYGON, [])


def write_shp(geometries: list[Geometry | None]) -> tuple[bytes, bytes]:
    """``(.shp, .shx)`` of geometries of one family."""
    kinds = {SHP_TYPES[g[0]] for g in geometries if g is not None and not model.is_empty(g)}
    if len(kinds - {1}) > 1 or 1 in kinds and kinds - {1, 8}:
        raise ValueError("a shapefile holds one family of geometries")
    kind = 8 if kinds == {1, 8} else next(iter(kinds), 0)
    records, bounds = [], []
    for g in geometries:
        if g is None or model.is_empty(g):
            records.append(struct.pack("<i", 0))
            continue
        parts, box = model.simple_parts(g), model.envelope(g)
        bounds.append(box)
        if kind == 1:
            records.append(struct.pack("<idd", 1, *parts[0][1]))
        elif kind == 8:
            records.append(struct.pack("<i4di", 8, *box, len(parts)) + b"".join(struct.pack("<dd", *p[1]) for p in parts))
        else:
            rings = [p[1] for p in parts] if kind == 3 else [r if (planar.signed_area(r) < 0) == (n == 0) else r[::-1] for p in parts for n, r in enumerate(p[1])]
            starts = np.cumsum([0, *(len(r) for r in rings[:-1])]).astype("<i4")
            records.append(struct.pack("<i4dii", kind, *box, len(rings), sum(map(len, rings))) + starts.tobytes() + np.concatenate(rings).astype("<f8").tobytes())
    whole = [f(b[i] for b in bounds) for i, f in enumerate((min, min, max, max))] if bounds else [0.0] * 4

    def header(size: int) -> bytes:
        return struct.pack(">7i", 9994, 0, 0, 0, 0, 0, size // 2) + struct.pack("<2i8d", 1000, kind, *whole, 0, 0, 0, 0)

    shp, shx, at = [], [], 100
    for n, r in enumerate(records, 1):
        shp.append(struct.pack(">ii", n, len(r) // 2) + r)
        shx.append(struct.pack(">ii", at // 2, len(r) // 2))
        at += 8 + len(r)
    return header(at) + b"".join(shp), header(100 + 8 * len(shx)) + b"".join(shx)


def read_dbf(data: bytes, encoding: str = "gbk") -> tuple[list[tuple[str, str, int, int]], list[list]]:
    """``(fields, rows)``; fields are (name, type letter, width, decimals).  Deleted rows are left out."""
    count, head, width = struct.unpack_from("<IHH", data, 4)
    fields, at = [], 32
    while data[at] != 0x0D:
        fields.append((data[at : at + 11].split(b"\0")[0].decode(encoding, "replace"), chr(data[at + 11]), data[at + 16], data[at + 17]))
        at += 32
    rows = []
    for i in range(count):
        row = data[head + i * width : head + (i + 1) * width]
        if row[:1] == b"*":
            continue
        pos, values = 1, []
        for _, kind, size, decimals in fields:
            raw = row[pos : pos + size]
            pos += size
            text = raw.decode(encoding, "replace").strip(" \0")
            if kind in "NF":
                try:
                    values.append((float(text) if decimals or kind == "F" else int(text)) if text else None)
                except ValueError:
                    values.append(None)
            elif kind == "D":
                values.append(dt.date(int(text[:4]), int(text[4:6]), int(text[6:8])) if len(text) == 8 and text.isdigit() and text != "00000000" else None)
            elif kind == "L":
                values.append({"T": True, "Y": True, "F": False, "N": False}.get(text.upper()))
            else:
                values.append(text or None)
        rows.append(values)
    return fields, rows


def write_dbf(fields: list[tuple[str, str, int, int]], rows: list[list], encoding: str = "utf-8") -> bytes:
    width = 1 + sum(f[2] for f in fields)
    today = dt.date.today()
    out = io.BytesIO()
    out.write(struct.pack("<4BIHH20x", 3, today.year - 1900, today.month, today.day, len(rows), 33 + 32 * len(fields), width))
    for name, kind, size, decimals in fields:
        out.write(struct.pack("<11sc4xBB14x", name.encode(encoding)[:10], kind.encode(), size, decimals))
    out.write(b"\r")
    for row in rows:
        out.write(b" ")
        for (_, kind, size, decimals), v in zip(fields, row, strict=True):
            if kind in "NF":
                text = "" if v is None or isinstance(v, float) and not math.isfinite(v) else f"{v:.{decimals}f}" if decimals else str(int(v))
                out.write(text[:size].rjust(size).encode("ascii"))
            elif kind == "D":
                out.write((v.strftime("%Y%m%d") if v else "").ljust(size).encode("ascii"))
            elif kind == "L":
                out.write({None: b"?", True: b"T", False: b"F"}[v])
            else:
                raw = b"" if v is None else str(v).encode(encoding)[:size]
                out.write(raw.decode(encoding, "ignore").encode(encoding).ljust(size))
    out.write(b"\x1a")
    return out.getvalue()


# --- KML -----------------------------------------------------------------------------------------------------


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def read_kml(data: bytes) -> list[tuple[dict[str, str], Geometry | None]]:
    """``(fields, geometry)`` of each placemark: name, description and extended data."""
    out = []
    for mark in (e for e in ET.fromstring(data).iter() if _local(e.tag) == "Placemark"):
        fields, geometry = {}, None
        for e in mark:
            tag = _local(e.tag)
            if tag in ("name", "description"):
                fields[tag] = (e.text or "").strip()
            elif tag == "ExtendedData":
                for x in e.iter():
                    if _local(x.tag) == "Data":
                        fields[x.get("name")] = next((v.text or "" for v in x if _local(v.tag) == "value"), "")
                    elif _local(x.tag) == "SimpleData":
                        fields[x.get("name")] = x.text or ""
            elif tag in ("Point", "LineString", "LinearRing", "Polygon", "MultiGeometry"):
                geometry = _kml_geometry(e)
        out.append((fields, geometry))
    return out


def _kml_geometry(e: ET.Element) -> Geometry:
    tag = _local(e.tag)

    def points(x: ET.Element):
        text = next(c.text or "" for c in x.iter() if _local(c.tag) == "coordinates")
        return model.ring([[float(v) for v in p.split(",")[:2]] for p in text.split()])

    if tag == "Point":
        return (POINT, points(e)[0])
    if tag in ("LineString", "LinearRing"):
        return (LINE, points(e))
    if tag == "Polygon":
        sides = {s: [points(x) for x in e if _local(x.tag) == s] for s in ("outerBoundaryIs", "innerBoundaryIs")}
        return (POLYGON, sides["outerBoundaryIs"] + sides["innerBoundaryIs"])
    return model.build([_kml_geometry(c) for c in e if _local(c.tag) in ("Point", "LineString", "Polygon", "MultiGeometry", "LinearRing")])


def write_kml(features: list[tuple[dict, Geometry | None]], name: str = "layer") -> bytes:
    root = ET.Element("kml", xmlns="http://www.opengis.net/kml/2.2")
    doc = ET.SubElement(root, "Document")
    ET.SubElement(doc, "name").text = name

    def put(parent: ET.Element, g: Geometry) -> None:
        coords = lambda e, c: setattr(ET.SubElement(e, "coordinates"), "text", " ".join(f"{float(x)!r},{float(y)!r}" for x, y in c))
        kind, parts = g
        if kind == POINT:
            coords(ET.SubElement(parent, "Point"), [parts])
        elif kind == LINE:
            coords(ET.SubElement(parent, "LineString"), parts)
        elif kind == POLYGON:
            p = ET.SubElement(parent, "Polygon")
            for n, r in enumerate(parts):
                coords(ET.SubElement(ET.SubElement(p, "innerBoundaryIs" if n else "outerBoundaryIs"), "LinearRing"), r)
        else:
            m = ET.SubElement(parent, "MultiGeometry")
            for x in parts:
                put(m, x)

    for fields, g in features:
        mark = ET.SubElement(doc, "Placemark")
        if fields.get("name") is not None:
            ET.SubElement(mark, "name").text = str(fields["name"])
        rest = {k: v for k, v in fields.items() if k != "name" and v is not None}
        if rest:
            data = ET.SubElement(mark, "ExtendedData")
            for k, v in rest.items():
                ET.SubElement(ET.SubElement(data, "Data", name=k), "value").text = str(v)
        if g is not None and not model.is_empty(g):
            put(mark, g)
    return b'<?xml version="1.0" encoding="UTF-8"?>\n' + ET.tostring(root)


def kml_of_kmz(data: bytes) -> bytes:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return z.read(next(n for n in sorted(z.namelist(), key=lambda n: (n != "doc.kml", n)) if n.lower().endswith(".kml")))


def kmz_of_kml(kml: bytes) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("doc.kml", kml)
    return out.getvalue()


# --- DXF -----------------------------------------------------------------------------------------------------


def read_dxf(text: str) -> list[tuple[dict[str, str], Geometry]]:
    """Points, lines and polylines of the entities section, with their layer; closed polylines are polygons."""
    lines = text.splitlines()
    pairs = [(int(lines[i].strip() or 0), lines[i + 1].strip()) for i in range(0, len(lines) - 1, 2)]
    out, entity, inside = [], None, False

    def close():
        if not entity:
            return
        kind, f, pts = entity["kind"], {"Layer": entity["layer"]}, entity["points"]
        if kind == "POINT" and pts:
            out.append((f, (POINT, np.array(pts[0]))))
        elif kind == "LINE" and len(pts) > 1:
            out.append((f, (LINE, model.ring(pts[:2]))))
        elif kind in ("LWPOLYLINE", "POLYLINE") and len(pts) > 1:
            shut = entity["flags"] & 1
            out.append((f, (POLYGON, [model.ring([*pts, pts[0]])]) if shut and len(pts) > 2 else (LINE, model.ring(pts))))

    for code, value in pairs:
        if code == 0:
            if value == "VERTEX" and entity and entity["kind"] == "POLYLINE":
                entity["vertex"] = True
                continue
            if value == "SEQEND":
                continue
            close()
            entity = None
            if inside and value in ("POINT", "LINE", "LWPOLYLINE", "POLYLINE"):
                entity = {"kind": value, "layer": "0", "points": [], "flags": 0, "vertex": value != "POLYLINE"}
        elif code == 2 and value in ("ENTITIES", "BLOCKS", "HEADER", "TABLES", "OBJECTS", "CLASSES"):
            inside = value == "ENTITIES"
        elif entity:
            if code == 8:
                entity["layer"] = value
            elif code == 70 and not (entity["kind"] == "POLYLINE" and entity["points"]):
                entity["flags"] = int(value)
            elif code in (10, 11) and entity["vertex"]:
                entity["points"].append([float(value), 0.0])
            elif code in (20, 21) and entity["points"] and entity["vertex"]:
                entity["points"][-1][1] = float(value)
    close()
    return out


def write_dxf(features: list[tuple[dict, Geometry | None]]) -> str:
    out = ["0", "SECTION", "2", "ENTITIES"]
    for f, g in features:
        layer = str(f.get("Layer") or "0")
        for kind, p in model.simple_parts(g):
            if kind == POINT:
                out += ["0", "POINT", "8", layer, "10", repr(float(p[0])), "20", repr(float(p[1]))]
            else:
                for r in [p] if kind == LINE else p:
                    pts = r[:-1] if kind == POLYGON else r
                    out += ["0", "LWPOLYLINE", "8", layer, "90", str(len(pts)), "70", str(int(kind == POLYGON))]
                    for x, y in pts:
                        out += ["10", repr(float(x)), "20", repr(float(y))]
    return "\n".join([*out, "0", "ENDSEC", "0", "EOF", ""])


# --- PNG -----------------------------------------------------------------------------------------------------


def write_png(pixels: np.ndarray) -> bytes:
    """8-bit grey (h, w), RGB (h, w, 3) or RGBA (h, w, 4)."""
    p = np.ascontiguousarray(pixels, np.uint8)
    h, w = p.shape[:2]
    depth = 1 if p.ndim == 2 else p.shape[2]
    raw = b"".join(b"\0" + row.tobytes() for row in p)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 2: 4, 3: 2, 4: 6}[depth], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def read_png(data: bytes) -> np.ndarray:
    at, idat, palette, head = 8, b"", None, None
    while at < len(data):
        (n,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        at += 12 + n
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            idat += body
    w, h, bits, kind, _, _, interlaced = head
    if bits != 8 or interlaced:
        raise ValueError("only plain 8-bit images are read")
    depth = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
    raw, step = zlib.decompress(idat), w * depth
    rows, before = [], np.zeros(step, int)
    for y in range(h):
        how = raw[y * (step + 1)]
        row = np.frombuffer(raw, np.uint8, step, y * (step + 1) + 1).astype(int)
        if how == 2:
            row = (row + before) & 255
        elif how:
            for i in range(step):
                a, b, c = (row[i - depth] if i >= depth else 0), before[i], (before[i - depth] if i >= depth else 0)
                if how == 1:
                    guess = a
                elif how == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min(((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c)))[2]
                row[i] = (row[i] + guess) & 255
        rows.append(row)
        before = row
    out = np.array(rows, np.uint8).reshape(h, w, depth)
    return palette[out[:, :, 0]] if kind == 3 else out[:, :, 0] if depth == 1 else out


# --- TIFF ----------------------------------------------------------------------------------------------------

DTYPES = {"Byte": "u1", "UInt16": "u2", "UInt32": "u4", "Int16": "i2", "Int32": "i4", "Float32": "f4", "Float64": "f8"}


def write_tiff(bands: np.ndarray, geo: tuple[float, ...] | None = None, epsg: int | None = None, nodata: float | None = None, compress: bool = True) -> bytes:
    """Little-endian TIFF of (bands, h, w), band after band, one strip a band; ``geo`` is a six-number geotransform."""
    b = bands if bands.ndim == 3 else bands[None]
    count, h, w = b.shape
    kind = b.dtype.newbyteorder("<")
    strips = [x.astype(kind).tobytes() for x in b]
    if compress:
        strips = [zlib.compress(s) for s in strips]
    tags: list[tuple[int, int, list]] = [
        (256, 4, [w]), (257, 4, [h]), (258, 3, [b.dtype.itemsize * 8] * count), (259, 3, [8 if compress else 1]), (262, 3, [1]), (277, 3, [count]),
        (278, 4, [h]), (284, 3, [2]), (339, 3, [{"u": 1, "i": 2, "f": 3}[b.dtype.kind]] * count),
    ]
    if geo:
        tags += [(33550, 12, [geo[1], -geo[5], 0.0]), (33922, 12, [0.0, 0.0, 0.0, geo[0], geo[3], 0.0])]
    if epsg:
        geographic = epsg in (4326, 4490)
        tags.append((34735, 3, [1, 1, 0, 3, 1024, 0, 1, 2 if geographic else 1, 1025, 0, 1, 1, 2048 if geographic else 3072, 0, 1, epsg]))
    if nodata is not None:
        tags.append((42113, 2, list(f"{nodata:g}\0".encode())))
    tags += [(273, 4, [0] * count), (279, 4, [len(s) for s in strips])]
    tags.sort()
    letters = {2: "B", 3: "H", 4: "I", 12: "d"}
    at = 8 + 2 + 12 * len(tags) + 4
    places = {}
    for tag, t, values in tags:
        size = struct.calcsize(f"<{len(values)}{letters[t]}")
        if size > 4:
            places[tag] = at
            at += size + size % 2
    starts = []
    for s in strips:
        starts.append(at)
        at += len(s)
    out = [struct.pack("<2sHI", b"II", 42, 8), struct.pack("<H", len(tags))]
    extra = []
    for tag, t, values in tags:
        values = starts if tag == 273 else values
        raw = struct.pack(f"<{len(values)}{letters[t]}", *values)
        if tag in places:
            out.append(struct.pack("<HHII", tag, t, len(values), places[tag]))
            extra.append(raw + b"\0" * (len(raw) % 2))
        else:
            out.append(struct.pack("<HHI", tag, t, len(values)) + raw.ljust(4, b"\0"))
    return b"".join([*out, struct.pack("<I", 0), *extra, *strips])


def read_tiff(data: bytes) -> tuple[np.ndarray, dict]:
    """``(bands, h, w)`` and the header ``{geo, epsg, nodata}``; strips or tiles, plain or deflated, chunky or planar."""
    o = {b"II": "<", b"MM": ">"}[data[:2]]
    (at,) = struct.unpack_from(o + "I", data, 4)
    (n,) = struct.unpack_from(o + "H", data, at)
    tags = {}
    for i in range(n):
        tag, t, count = struct.unpack_from(o + "HHI", data, at + 2 + 12 * i)
        letter = {1: "B", 2: "B", 3: "H", 4: "I", 11: "f", 12: "d", 16: "Q"}.get(t)
        if letter is None:
            continue
        size = struct.calcsize(f"{o}{count}{letter}")
        pos = at + 2 + 12 * i + 8
        if size > 4:
            (pos,) = struct.unpack_from(o + "I", data, pos)
        tags[tag] = struct.unpack_from(f"{o}{count}{letter}", data, pos)
    w, h, count = tags[256][0], tags[257][0], tags.get(277, (1,))[0]
    kind = np.dtype(o + {1: "u", 2: "i", 3: "f"}[tags.get(339, (1,))[0]] + str(tags.get(258, (8,))[0] // 8))
    packing, planar_ = tags.get(259, (1,))[0], tags.get(284, (1,))[0] == 2
    if packing not in (1, 8, 32946):
        raise ValueError(f"compression {packing} isn't read")
    deep = 1 if planar_ else count
    tw, th = (tags[322][0], tags[323][0]) if 322 in tags else (w, min(tags.get(278, (h,))[0], h))
    offsets, sizes = tags.get(324, tags.get(273)), tags.get(325, tags.get(279))
    across, down = -(-w // tw), -(-h // th)
    out = np.zeros((count, h, w), kind.newbyteorder("="))
    for i, (start, size) in enumerate(zip(offsets, sizes, strict=True)):
        raw = data[start : start + size]
        raw = zlib.decompress(raw) if packing != 1 else raw
        band, k = divmod(i, across * down) if planar_ else (0, i)
        y, x = k // across * th, k % across * tw
        rows = len(raw) // (tw * deep * kind.itemsize)
        block = np.frombuffer(raw, kind, rows * tw * deep).reshape(rows, tw, deep)
        if tags.get(317, (1,))[0] == 2:
            block = np.cumsum(block, axis=1, dtype=block.dtype)
        hh, ww = min(rows, h - y), min(tw, w - x)
        for d in range(deep):
            out[band + d, y : y + hh, x : x + ww] = block[:hh, :ww, d]
    geo = None
    if 33550 in tags and 33922 in tags:
        sx, sy = tags[33550][:2]
        i, j, _, x, y, _ = tags[33922][:6]
        geo = (x - i * sx, sx, 0.0, y + j * sy, 0.0, -sy)
    keys = tags.get(34735, ())
    epsg = next((keys[k + 3] for k in range(4, len(keys), 4) if keys[k] in (3072, 2048)), None)
    nodata = float(bytes(tags[42113]).rstrip(b"\0")) if 42113 in tags else None
    return out, {"geo": geo, "epsg": epsg, "nodata": nodata, "type": next((k for k, v in DTYPES.items() if np.dtype(v) == kind.newbyteorder("=")), kind.name)}
