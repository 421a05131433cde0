"""Convex polygons of few corners: cut by one another, edge by edge, without an arrangement.

Only clear cases are settled here: a corner lies on an edge's line or well off it, and what is left is one convex
polygon.  For all others the functions give None, and the arrangement of :mod:`planar` decides.
"""

from __future__ import annotations

import math

from .model import POLYGON, Geometry, ring

MOST = 64  # corners
FLAT = 1e-7  # least sine of a corner
CLEAR = 256.0  # grid steps from a line that are off it beyond doubt


def corners(g: Geometry | None) -> list | None:
    """The corners of a convex polygon without holes, counter-clockwise; None for anything else."""
    if g is None or g[0] != POLYGON or len(g[1]) != 1 or not 4 <= len(g[1][0]) <= MOST + 1:
        return None
    r = g[1][0].tolist()
    if r[0] != r[-1]:
        return None
    p = r[:-1]
    left = turns = 0
    px, py = p[0][0] - p[-1][0], p[0][1] - p[-1][1]
    for i in range(len(p)):
        (x0, y0), (x1, y1) = p[i], p[i + 1 - len(p)]
        dx, dy = x1 - x0, y1 - y0
        cross = px * dy - py * dx
        if not abs(cross) > FLAT * math.hypot(px, py) * math.hypot(dx, dy):
            return None
        left += cross > 0
        # once around, the direction changes between right and left twice; upright edges count as what they turn from
        turns += (px > 0 or px == 0 and py < 0) != (dx > 0 or dx == 0 and dy < 0)
        px, py = dx, dy
    if turns != 2 or left not in (0, len(p)):
        return None
    return p if left else p[::-1]


def _cut(p: list, a: list, b: list, grid: float):
    """The parts of a convex polygon left and right of a line, None where there is none; False if a corner is unclear."""
    ux, uy = b[0] - a[0], b[1] - a[1]
    n = math.hypot(ux, uy)
    off = []
    for x, y in p:
        d = (ux * (y - a[1]) - uy * (x - a[0])) / n
        if abs(d) <= 0.5 * grid:
            d = 0.0
        elif not abs(d) > CLEAR * grid:
            return False
        off.append(d)
    if min(off) >= 0:
        return p, None
    if max(off) <= 0:
        return None, p
    inner, outer = [], []
    for i, d in enumerate(off):
        q, e = p[i + 1 - len(p)], off[i + 1 - len(p)]
        if d >= 0:
            inner.append(p[i])
        if d <= 0:
            outer.append(p[i])
        if d * e < 0:
            t = d / (d - e)
            x = [round((p[i][k] + t * (q[k] - p[i][k])) / grid) * grid for k in (0, 1)]
            inner.append(x)
            outer.append(x)
    return inner, outer


def overlay(a: Geometry | None, b: Geometry | None, how: str, grid: float) -> Geometry | None:
    """Intersection or difference of two convex polygons, if it is clear and in one piece."""
    if how not in ("intersection", "difference") or (p := corners(a)) is None or (q := corners(b)) is None:
        return None
    p, q = ([[round(x / grid) * grid, round(y / grid) * grid] for x, y in s] for s in (p, q))
    for s in (p, q):
        if min(math.dist(s[i - 1], s[i]) for i in range(len(s))) <= CLEAR * grid:
            return None
    left, rest = p, []
    for i in range(len(q)):
        found = _cut(left, q[i - 1], q[i], grid)
        if found is False:
            return None
        left, outer = found
        if outer is not None:
            rest.append(outer)
        if left is None:
            break
    if how == "intersection":
        found = left
    elif left is None:
        found = p
    elif len(rest) > 1:
        return None
    else:
        found = rest[0] if rest else None
    return (POLYGON, [ring([*found, found[0]])]) if found else (POLYGON, [])
