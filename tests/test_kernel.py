"""Geometry kernel: hand-made cases, and laws over random shapes."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from geoloom.kernel import crs
from geoloom.kernel.model import LINE, POINT, POLYGON, box, build, from_geojson, from_wkb, from_wkt, polygon, ring, to_geojson, to_multi, to_wkb, to_wkt
from geoloom.kernel.planar import (
    area, auto_distance, boundary, buffer, buffer_auto, centroid, close_rings, contains, convex_hull, crosses, distance, equals, intersects, is_simple, is_valid, length,
    line_difference, longest_part, make_valid, overlaps, overlay, remove_repeated, segmentize, simplify, snap_to_grid, touches, union_all, within,
)

ELL = polygon([(0, 0), (4, 0), (4, 1), (1, 1), (1, 4), (0, 4), (0, 0)])
HOLED = polygon([(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)], [(2, 2), (2, 4), (4, 4), (4, 2), (2, 2)])
BOW = polygon([(0, 0), (2, 2), (2, 0), (0, 2), (0, 0)])
at = lambda x, y: (POINT, np.array([x, y], float))
line = lambda *p: (LINE, ring(p))


def star(seed, n, cx=0.0, cy=0.0):
    rng = np.random.default_rng(seed)
    t = 2 * math.pi * np.arange(n) / n
    r = 0.2 + rng.random(n)
    p = np.stack([cx + r * np.cos(t), cy + r * np.sin(t)], 1)
    return polygon([*p, p[0]])


def test_measures():
    assert area(ELL) == 7 and length(ELL) == 16 and area(HOLED) == 96 and area(None) == 0
    assert centroid(box(0, 0, 2, 4))[1].tolist() == [1, 2]
    assert centroid(line((0, 0), (4, 0)))[1].tolist() == [2, 0] and centroid(build([at(0, 0), at(2, 2)]))[1].tolist() == [1, 1]
    assert distance(box(0, 0, 1, 1), box(4, 5, 6, 6)) == 5 and distance(None, ELL) == -1 and distance(HOLED, at(3, 3)) == 1


def test_shared_edges_and_corners():
    a, b = box(0, 0, 1, 1), box(1, 0, 2, 1)
    assert overlay(a, b, "intersection") == (POLYGON, []) and len(overlay(a, b, "union")[1]) == 1
    assert touches(a, b) and not overlaps(a, b) and intersects(a, b)
    c = box(1, 1, 2, 2)
    assert touches(a, c) and area(overlay(a, c, "union")) == 2
    assert equals(a, a) and area(overlay(a, a, "difference")) == 0 and area(overlay(a, a, "symdifference")) == 0
    assert to_wkt(overlay(box(0, 0, 4, 4), box(1, 1, 2, 2), "difference")) == "POLYGON ((0 0,4 0,4 4,0 4,0 0),(1 1,1 2,2 2,2 1,1 1))"


def test_predicates():
    assert contains(HOLED, box(5, 5, 6, 6)) and not contains(HOLED, box(2.5, 2.5, 3, 3)) and not intersects(HOLED, at(3, 3))
    assert within(at(1, 1), HOLED) and touches(at(2, 3), HOLED) and crosses(line((-1, 1), (11, 1)), HOLED)
    assert crosses(line((0, 0), (2, 2)), line((0, 2), (2, 0))) and not crosses(line((0, 0), (1, 1)), line((1, 1), (2, 0)))
    assert touches(line((0, 0), (1, 1)), line((1, 1), (2, 0))) and overlaps(line((0, 0), (2, 0)), line((1, 0), (3, 0)))
    assert within(line((1, 0), (2, 0)), line((0, 0), (3, 0))) and not intersects(line((0, 0), (1, 0)), line((0, 1), (1, 1)))


def test_validity():
    assert is_valid(ELL) and is_valid(HOLED) and not is_valid(BOW) and not is_valid(None)
    fixed = make_valid(BOW)
    assert is_valid(fixed) and area(fixed) == 2 and len(fixed[1]) == 2
    spike = polygon([(0, 0), (4, 0), (4, 4), (2, 4), (2, 6), (2, 4), (0, 4), (0, 0)])
    assert area(make_valid(spike)) == 16 and is_valid(make_valid(spike))
    assert is_simple(line((0, 0), (1, 1), (2, 0))) and not is_simple(line((0, 0), (2, 2), (2, 0), (0, 2)))


def test_shapes():
    assert area(convex_hull(ELL)) == 11.5 and convex_hull(build([at(0, 0), at(1, 1)]))[0] == LINE
    assert length(boundary(HOLED)) == 48 and boundary(line((0, 0), (1, 1)))[0] == 4
    assert area(buffer(at(0, 0), 1)) == pytest.approx(60 * math.sin(math.pi / 60), rel=1e-9)
    assert area(buffer(box(0, 0, 4, 4), -1)) == pytest.approx(4) and area(buffer(at(0, 0), -1)) == 0
    assert area(buffer(line((0, 0), (3, 0)), 1, 8)) == pytest.approx(6 + 16 * math.sin(math.pi / 16), rel=1e-9)
    grown = buffer_auto(HOLED)
    assert area(grown) > 96 and len(grown[1]) == 2 and auto_distance(box(0, 0, 10, 10)) > 0
    wavy = line(*[(x, 0.01 * (x % 2)) for x in range(9)])
    assert to_wkt(simplify(wavy, 0.1)) == "LINESTRING (0 0,8 0)" and is_valid(simplify(star(3, 40), 0.5, True))
    assert to_wkt(segmentize(line((0, 0), (3, 0)), 1)) == "LINESTRING (0 0,1 0,2 0,3 0)"
    assert len(remove_repeated(line((0, 0), (0, 0), (1, 1)))[1]) == 2 and len(close_rings(polygon([(0, 0), (1, 0), (1, 1)]))[1][0]) == 4
    assert to_wkt(snap_to_grid(box(0.01, 0.02, 0.99, 1.01), 1.0)) in ("POLYGON ((0 0,1 0,1 1,0 1,0 0))",) and snap_to_grid(ELL, 0) is ELL
    left = longest_part(line_difference(line((-5, 0), (0, 0), (4, 0), (6, 0)), ELL))
    assert to_wkt(left) in ("LINESTRING (-5 0,0 0)", "LINESTRING (0 0,-5 0)")
    assert to_multi(build([at(0, 0), ELL]))[0] == 6 and to_multi(at(0, 0)) is None


def test_codecs():
    for text in ("POINT (1 2)", "POINT EMPTY", "LINESTRING (0 0,1.5 2)", "MULTIPOINT ((0 0),(1 1))", "MULTILINESTRING ((0 0,1 1),(2 2,3 3))", "POLYGON EMPTY",
                 "MULTIPOLYGON (((0 0,1 0,1 1,0 0)),((2 2,3 2,3 3,2 2)))", "GEOMETRYCOLLECTION (POINT (1 2),LINESTRING (0 0,1 1))"):
        g = from_wkt(text)
        assert to_wkt(from_wkb(to_wkb(g))) == text
        if "EMPTY" not in text:
            assert to_wkt(from_geojson(to_geojson(g))) == text
    big = bytes.fromhex("0020000001000010E63FF00000000000004000000000000000")
    little_z = bytes.fromhex("01E9030000000000000000F03F00000000000000400000000000000840")
    assert to_wkt(from_wkb(big)) == "POINT (1 2)" == to_wkt(from_wkb(little_z))
    assert to_wkt(from_wkt("SRID=4326;POINT Z (1 2 3)")) == "POINT (1 2)"
    with pytest.raises(ValueError):
        from_wkt("POINT (1 2) x")


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(3, 16), st.integers(3, 16), st.floats(-1, 1), st.floats(-1, 1))
def test_overlay_laws(seed, n, m, cx, cy):
    a, b = star(seed, n), star(seed + 1, m, cx, cy)
    i, u, d, s, e = (area(overlay(x, y, h)) for x, y, h in ((a, b, "intersection"), (a, b, "union"), (a, b, "difference"), (a, b, "symdifference"), (b, a, "difference")))
    assert i + d == pytest.approx(area(a), abs=1e-8) and i + e == pytest.approx(area(b), abs=1e-8)
    assert u == pytest.approx(i + d + e, abs=1e-8) and s == pytest.approx(d + e, abs=1e-8)
    rest = overlay(a, b, "difference")
    assert area(overlay(rest, b, "intersection")) == pytest.approx(0, abs=1e-8)
    assert area(union_all([rest, b])) == pytest.approx(u, abs=1e-8) and area(union_all([a, a, b])) == pytest.approx(u, abs=1e-8)
    assert is_valid(overlay(a, b, "union")) or u == 0


def test_union_of_many():
    boxes = [box(i, 0, i + 1.5, 1) for i in range(150)]
    assert area(union_all(boxes)) == pytest.approx(150.5) and len(union_all(boxes)[1]) == 1 and area(union_all([])) == 0


@settings(max_examples=60, deadline=None)
@given(st.floats(74, 136), st.floats(-80, 80))
def test_projections_return(lon, lat):
    p = (POINT, np.array([lon, lat]))
    for code in (3857, 32650 if lat >= 0 else 32750, crs.cgcs2000_by_longitude(lon).epsg):
        near = crs.lookup(code)
        if near.kind == "tm" and abs(lon - near.meridian) > 20:
            continue
        back = crs.transform(crs.transform(p, 4326, code), code, 4326)
        assert back[1] == pytest.approx([lon, lat], abs=1e-9)


def test_known_projections():
    x, y = crs.transform(at(9, 0), 4326, 32632)[1]
    assert (x, y) == pytest.approx((500000, 0), abs=1e-6)
    x, y = crs.transform(at(12.0, 45.0), 4326, 32632)[1]
    assert (x, y) == pytest.approx((736446.0261, 4987329.5048), abs=0.01)
    assert crs.lookup(4513).easting == 25_500_000 and crs.lookup(4549).meridian == 120 and crs.cgcs2000_by_longitude(120).epsg == 4549
    assert crs.epsg_of(crs.wkt(crs.lookup(4549))) == 4549
    with pytest.raises(ValueError):
        crs.cgcs2000_by_longitude(60)
