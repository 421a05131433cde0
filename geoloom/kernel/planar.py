"""Measures, noded overlay, relations and shapes of planar geometries.

Overlay works on a noded arrangement: all segments are rounded to a grid and split where they meet; a vertical ray from
the middle of every piece gives the winding numbers on its two sides; the pieces that separate result from rest
are linked into rings.  Rounding to a power-of-two grid keeps shared borders shared.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

from . import convex
from .model import COLLECTION, LINE, MULTIPOLYGON, POINT, POLYGON, Geometry, build, coordinates, envelope, ring, simple_parts

IN, ON, OUT = 0, 1, 2


# --- measures ------------------------------------------------------------------------------------------------


def signed_area(r: np.ndarray) -> float:
    if len(r) < 3:
        return 0.0
    x, y = r[:, 0] - r[0, 0], r[:, 1] - r[0, 1]
    return float(np.sum(x * np.roll(y, -1) - np.roll(x, -1) * y) / 2)


def area(g: Geometry | None) -> float:
    """Planar area, holes subtracted; 0 for null."""
    return float(sum(abs(signed_area(p[1][0])) - sum(abs(signed_area(h)) for h in p[1][1:]) for p in simple_parts(g) if p[0] == POLYGON))


def path_length(r: np.ndarray) -> float:
    return float(np.hypot(*np.diff(r, axis=0).T).sum()) if len(r) > 1 else 0.0


def length(g: Geometry | None) -> float:
    """Length of lines and of polygon rings; 0 for null."""
    return float(sum(path_length(p[1]) if p[0] == LINE else sum(map(path_length, p[1])) for p in simple_parts(g) if p[0] != POINT))


def point_count(g: Geometry | None) -> int:
    return len(coordinates(g)) if g is not None else 0


def dimension(g: Geometry | None) -> int:
    return max(({POINT: 0, LINE: 1, POLYGON: 2}[p[0]] for p in simple_parts(g)), default=-1)


def centroid(g: Geometry) -> Geometry:
    """Weighted by area, else by length, else the mean of the points."""
    parts = simple_parts(g)
    total, at = 0.0, np.zeros(2)
    top = dimension(g)
    for kind, p in parts:
        if kind == POLYGON and top == 2:
            for n, r in enumerate(p):
                o, q = r[0], r - r[0]
                cross = q[:-1, 0] * q[1:, 1] - q[1:, 0] * q[:-1, 1]
                a = cross.sum() / 2
                if a == 0:
                    continue
                c = o + ((q[:-1] + q[1:]) * cross[:, None]).sum(0) / (6 * a)
                w = abs(a) if n == 0 else -abs(a)
                total, at = total + w, at + w * c
        elif kind == LINE and top == 1:
            d = np.hypot(*np.diff(p, axis=0).T)
            total, at = total + d.sum(), at + (((p[1:] + p[:-1]) / 2) * d[:, None]).sum(0)
        elif kind == POINT and top == 0:
            total, at = total + 1, at + p
    if total == 0:
        c = coordinates(g)
        return (POINT, c.mean(0) if len(c) else None)
    return (POINT, at / total)


# --- segments ------------------------------------------------------------------------------------------------


def grid_of(*gs: Geometry | None) -> float:
    """A power of two about 2**-40 of the largest coordinate."""
    c = [coordinates(g) for g in gs if g is not None]
    top = max([float(np.abs(x).max()) for x in c if len(x)], default=1.0) or 1.0
    return 2.0 ** (math.frexp(top)[1] - 40)


def ring_segments(g: Geometry | None, grid: float, oriented: bool = True) -> np.ndarray:
    """(n, 4) segments of all polygon rings; outer rings counter-clockwise and holes clockwise if ``oriented``."""
    out = []
    for kind, p in simple_parts(g) if g is not None else []:
        if kind != POLYGON:
            continue
        for n, r in enumerate(p):
            r = np.round(r / grid) * grid
            if len(r) and (r[0] != r[-1]).any():
                r = np.concatenate([r, r[:1]])
            if oriented and (signed_area(r) > 0) != (n == 0):
                r = r[::-1]
            out.append(np.concatenate([r[:-1], r[1:]], 1))
    return np.concatenate(out) if out else np.zeros((0, 4))


def line_segments(g: Geometry | None, grid: float) -> np.ndarray:
    out = []
    for kind, p in simple_parts(g) if g is not None else []:
        if kind == LINE and len(p) > 1:
            r = np.round(p / grid) * grid
            out.append(np.concatenate([r[:-1], r[1:]], 1))
    return np.concatenate(out) if out else np.zeros((0, 4))


def _pairs(s: np.ndarray, most: int = 1 << 19):
    """Pairs of segments whose boxes meet, by a sweep over x: index arrays, about ``most`` candidates at a time."""
    x0, x1 = np.minimum(s[:, 0], s[:, 2]), np.maximum(s[:, 0], s[:, 2])
    y0, y1 = np.minimum(s[:, 1], s[:, 3]), np.maximum(s[:, 1], s[:, 3])
    order = np.argsort(x0, kind="stable")
    many = np.searchsorted(x0[order], x1[order], side="right") - np.arange(1, len(s) + 1)
    total = np.cumsum(many)
    at = 0
    while at < len(s):
        upto = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, side="right")))
        m = many[at:upto]
        k = np.repeat(np.arange(at, upto), m)
        i, j = order[k], order[k + 1 + np.arange(len(k)) - np.repeat(np.cumsum(m) - m, m)]
        near = (y0[j] <= y1[i]) & (y1[j] >= y0[i])
        if near.any():
            yield i[near], j[near]
        at = upto


def _cross(a: np.ndarray, b: np.ndarray):
    """For each pair of segments the cross product of their directions and where they meet along either."""
    r, s, d = a[:, 2:] - a[:, :2], b[:, 2:] - b[:, :2], b[:, :2] - a[:, :2]
    cross = r[:, 0] * s[:, 1] - r[:, 1] * s[:, 0]
    with np.errstate(divide="ignore", invalid="ignore"):
        return cross, (d[:, 0] * s[:, 1] - d[:, 1] * s[:, 0]) / cross, (d[:, 0] * r[:, 1] - d[:, 1] * r[:, 0]) / cross


def node(segments: np.ndarray, owner: np.ndarray, points: np.ndarray, grid: float):
    """Split segments where they meet each other or a point; ``(pieces, owner)``, without zero-length pieces."""
    for _ in range(8):
        keep = (segments[:, :2] != segments[:, 2:]).any(1)
        segments, owner = segments[keep], owner[keep]
        where, what = [np.zeros(0, int)], [np.zeros((0, 2))]
        for i, j in _pairs(segments):
            a, b = segments[i], segments[j]
            # ends that lie on the other segment, within half the grid
            for ends, line, of in ((b[:, :2], a, i), (b[:, 2:], a, i), (a[:, :2], b, j), (a[:, 2:], b, j)):
                hit = _on(ends, line, grid)
                where.append(of[hit])
                what.append(ends[hit])
            cross, t, u = _cross(a, b)
            with np.errstate(invalid="ignore"):
                proper = (cross != 0) & (t > 0) & (t < 1) & (u > 0) & (u < 1)
            x = np.round((a[proper, :2] + t[proper, None] * (a[proper, 2:] - a[proper, :2])) / grid) * grid
            where += [i[proper], j[proper]]
            what += [x, x]
        for x in points:
            near = (np.minimum(segments[:, 0], segments[:, 2]) <= x[0]) & (x[0] <= np.maximum(segments[:, 0], segments[:, 2]))
            near &= (np.minimum(segments[:, 1], segments[:, 3]) <= x[1]) & (x[1] <= np.maximum(segments[:, 1], segments[:, 3]))
            at = np.flatnonzero(near)
            at = at[_on(x[None], segments[at], grid)]
            where.append(at)
            what.append(np.repeat(x[None], len(at), 0))
        at, cuts = np.concatenate(where), np.concatenate(what)
        inner = (cuts != segments[at, :2]).any(1) & (cuts != segments[at, 2:]).any(1)
        at, cuts = at[inner], cuts[inner]
        if not len(at):
            break
        along = ((cuts - segments[at, :2]) * (segments[at, 2:] - segments[at, :2])).sum(1)
        order = np.lexsort((along, at))
        at, cuts = at[order], cuts[order]
        first = np.concatenate([[True], at[1:] != at[:-1]])
        split = at[first]
        # each segment's chain of cuts, then its end
        place = np.arange(len(at)) + np.cumsum(first) - 1
        ends = np.empty((len(at) + len(split), 2))
        ends[place] = cuts
        last = np.concatenate([place[1:][first[1:]] - 1, [len(ends) - 1]])
        ends[last] = segments[split, 2:]
        begins = np.concatenate([ends[:1], ends[:-1]])
        begins[place[first]] = segments[split, :2]
        whole = np.ones(len(segments), bool)
        whole[split] = False
        segments = np.concatenate([segments[whole], np.concatenate([begins, ends], 1)])
        owner = np.concatenate([owner[whole], np.repeat(owner[split], np.diff(np.concatenate([[-1], last])))])
    keep = (segments[:, :2] != segments[:, 2:]).any(1)
    return segments[keep], owner[keep]


def _on(p: np.ndarray, s: np.ndarray, grid: float) -> np.ndarray:
    """Which points lie on which segments within half the grid; rows of either broadcast."""
    a, d = s[:, :2], s[:, 2:] - s[:, :2]
    n = (d * d).sum(1)
    e = p - a
    dot = (e * d).sum(1)
    return (dot >= 0) & (dot <= n) & (np.abs(e[:, 0] * d[:, 1] - e[:, 1] * d[:, 0]) <= 0.5 * grid * np.sqrt(n))


def _unique(pieces: np.ndarray, owner: np.ndarray, layers: int):
    """Pieces once each, pointing right (or up), with each layer's net direction and count."""
    flip = (pieces[:, 0] > pieces[:, 2]) | ((pieces[:, 0] == pieces[:, 2]) & (pieces[:, 1] > pieces[:, 3]))
    canon = np.where(flip[:, None], pieces[:, [2, 3, 0, 1]], pieces)
    u, back = np.unique(canon, axis=0, return_inverse=True)
    back = back.ravel()
    net, many = np.zeros((len(u), layers), int), np.zeros((len(u), layers), int)
    np.add.at(net, (back, owner), np.where(flip, -1, 1))
    np.add.at(many, (back, owner), 1)
    return u, net, many


def winding(points: np.ndarray, u: np.ndarray, net: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
    """Winding numbers just above each point, from upward rays; pieces point right.

    ``own`` numbers the piece that a point is the middle of, which its ray must not count.
    """
    out = np.zeros((len(points), net.shape[1]), int)
    flat = np.flatnonzero(u[:, 0] < u[:, 2])
    s, n = u[flat], net[flat]
    if not len(s):
        return out
    slope = (s[:, 3] - s[:, 1]) / (s[:, 2] - s[:, 0])
    place = np.full(len(u), -1)
    place[flat] = np.arange(len(flat))
    for at in range(0, len(points), 512):
        p = points[at : at + 512]
        x = p[:, 0][:, None]
        hit = (s[:, 0] <= x) & (x < s[:, 2])
        hit &= s[:, 1] + (x - s[:, 0]) * slope > p[:, 1][:, None]
        if own is not None:
            mine = place[own[at : at + 512]]
            rows = np.flatnonzero(mine >= 0)
            hit[rows, mine[rows]] = False
        out[at : at + 512] = -np.rint(hit.astype(np.float32) @ n.astype(np.float32)).astype(int)  # small whole numbers
    return out


def _winding_right(points: np.ndarray, u: np.ndarray, net: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Winding numbers just right of each point, from rays to the right."""
    turned = np.stack([-u[:, 1], u[:, 0], -u[:, 3], u[:, 2]], 1)  # a quarter turn takes right to up
    flip = turned[:, 0] > turned[:, 2]
    turned = np.where(flip[:, None], turned[:, [2, 3, 0, 1]], turned)
    return winding(np.stack([-points[:, 1], points[:, 0]], 1), turned, np.where(flip[:, None], -net, net), own)


def sides(u: np.ndarray, net: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Winding numbers (left, right) of every piece, for each layer; left is above, or west of upright pieces."""
    mid = (u[:, :2] + u[:, 2:]) / 2
    upright = u[:, 0] == u[:, 2]
    left, right = np.zeros_like(net), np.zeros_like(net)
    if (~upright).any():
        above = winding(mid[~upright], u, net, np.flatnonzero(~upright))
        left[~upright], right[~upright] = above, above - net[~upright]
    if upright.any():
        east = _winding_right(mid[upright], u, net, np.flatnonzero(upright))
        right[upright], left[upright] = east, east + net[upright]
    return left, right


def _rings(edges: np.ndarray) -> list[np.ndarray]:
    """Rings of directed edges with the interior on their left; at a junction the sharpest left turn is taken."""
    out: dict[tuple, list[int]] = {}
    for i, e in enumerate(edges):
        out.setdefault((e[0], e[1]), []).append(i)
    used, rings = np.zeros(len(edges), bool), []
    for first in range(len(edges)):
        if used[first]:
            continue
        path, i = [], first
        while True:
            used[i] = True
            path.append(edges[i, :2])
            end = (edges[i, 2], edges[i, 3])
            if end == (edges[first, 0], edges[first, 1]):
                break
            options = [j for j in out.get(end, []) if not used[j]]
            if not options:
                path = []
                break
            if len(options) > 1:
                back = math.atan2(edges[i, 1] - edges[i, 3], edges[i, 0] - edges[i, 2])
                turn = lambda j: (back - math.atan2(edges[j, 3] - edges[j, 1], edges[j, 2] - edges[j, 0])) % (2 * math.pi)  # noqa: E731,B023
                i = min(options, key=turn)
            else:
                i = options[0]
        if len(path) > 2:
            rings.append(np.array([*path, path[0]]))
    return [s for r in rings for s in _split(r)]


def _split(r: np.ndarray) -> list[np.ndarray]:
    """Simple rings of a ring that touches itself in points."""
    seen, stack, out = {}, [], []
    for p in map(tuple, r):
        if p in seen:
            at = seen[p]
            loop = stack[at:] + [p]
            for q in stack[at + 1 :]:
                del seen[q]
            del stack[at + 1 :]
            if len(loop) > 3:
                out.append(np.array(loop))
        else:
            seen[p] = len(stack)
            stack.append(p)
    return out


def _tidy(r: np.ndarray) -> np.ndarray:
    """Drop points on straight runs."""
    q = r[:-1]
    a, b = q - np.roll(q, 1, 0), np.roll(q, -1, 0) - q
    keep = (a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]) != 0
    q = q[keep] if keep.sum() >= 3 else q
    return np.concatenate([q, q[:1]])


def assemble(edges: np.ndarray) -> Geometry:
    """Polygons of directed border edges (interior on the left), holes put into the smallest shell around them."""
    rings = [_tidy(r) for r in _rings(edges)]
    shells = [[r] for r in rings if signed_area(r) > 0]
    shells.sort(key=lambda s: signed_area(s[0]))
    for h in rings:
        if signed_area(h) < 0:
            for s in shells:
                if locate_ring(_inner(h), s[0]) == IN or (s[0][:, None] == h[None]).all(2).any() and _inside_ring(h, s[0]):
                    s.append(h)
                    break
    return build([(POLYGON, s) for s in shells]) if shells else (POLYGON, [])


def _inner(r: np.ndarray) -> np.ndarray:
    """A point of a ring's border, the middle of its first piece."""
    return (r[0] + r[1]) / 2


def _inside_ring(h: np.ndarray, shell: np.ndarray) -> bool:
    found = [locate_ring((h[i] + h[i + 1]) / 2, shell) for i in range(len(h) - 1)]
    return IN in found and OUT not in found


def locate_ring(p, r: np.ndarray, slack: float = 0.0) -> int:
    a, b = r[:-1], r[1:]
    d, e = b - a, p - a
    cross = d[:, 0] * e[:, 1] - d[:, 1] * e[:, 0]
    dot = (e * d).sum(1)
    n = (d * d).sum(1)
    if ((np.abs(cross) <= slack * np.sqrt(n) + 1e-15 * n) & (dot >= 0) & (dot <= n)).any():
        return ON
    up = (a[:, 1] <= p[1]) & (b[:, 1] > p[1]) & (cross > 0)
    down = (a[:, 1] > p[1]) & (b[:, 1] <= p[1]) & (cross < 0)
    return IN if up.sum() - down.sum() else OUT


def locate(p, g: Geometry | None, slack: float = 0.0) -> int:
    """Place of a point in the polygons of ``g``."""
    best = OUT
    for kind, rings in simple_parts(g):
        if kind == POLYGON:
            at = locate_ring(p, rings[0], slack)
            if at == IN:
                inner = [locate_ring(p, h, slack) for h in rings[1:]]
                at = ON if ON in inner else OUT if IN in inner else IN
            best = min(best, at)
    return best


# --- overlay -------------------------------------------------------------------------------------------------


def is_box(g: Geometry | None) -> tuple | None:
    """(x0, y0, x1, y1) of an axis-parallel rectangle, else None."""
    parts = simple_parts(g)
    if len(parts) != 1 or parts[0][0] != POLYGON or len(parts[0][1]) != 1 or len(parts[0][1][0]) != 5:
        return None
    r = parts[0][1][0]
    step = np.diff(r, axis=0)
    if ((step != 0).sum(1) == 1).all() and (r[0] == r[-1]).all() and (step[0] + step[2] == 0).all():
        return (*r.min(0).tolist(), *r.max(0).tolist())
    return None


RULES = {
    "intersection": lambda a, b: a & b, "union": lambda a, b: a | b, "difference": lambda a, b: a & ~b, "symdifference": lambda a, b: a ^ b,
}


def _border(segments: Callable[[float], list[np.ndarray]], grid: float, inside: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Directed border edges of the places where ``inside`` holds of the layers' winding numbers.

    At every point as many edges must come in as go out.  Where slivers thinner than rounding upset this, the
    arrangement is made again on a coarser grid, on which they close.
    """
    for _ in range(4):
        layers = segments(grid)
        s = np.concatenate(layers)
        pieces, owner = node(s, np.repeat(np.arange(len(layers)), [len(x) for x in layers]), np.zeros((0, 2)), grid)
        if not len(pieces):
            return np.zeros((0, 4))
        u, net, _ = _unique(pieces, owner, len(layers))
        left, right = sides(u, net)
        l, r = inside(left > 0), inside(right > 0)
        edges = np.concatenate([u[l & ~r], u[r & ~l][:, [2, 3, 0, 1]]])
        ends, back = np.unique(edges.reshape(-1, 2), axis=0, return_inverse=True)
        if not np.bincount(back.ravel(), np.tile([1.0, -1.0], len(edges)), len(ends)).any():
            return edges
        grid *= 64
    return edges


def overlay(a: Geometry | None, b: Geometry | None, how: str, grid: float = 0.0) -> Geometry:
    """Polygonal result of a set operation on the polygons of ``a`` and ``b``; an empty Polygon if nothing is left."""
    if how == "intersection" and not grid and (p := is_box(a)) and (q := is_box(b)):
        x0, y0, x1, y1 = max(p[0], q[0]), max(p[1], q[1]), min(p[2], q[2]), min(p[3], q[3])
        from .model import box

        return box(x0, y0, x1, y1) if x0 < x1 and y0 < y1 else (POLYGON, [])
    grid = grid or grid_of(a, b)
    if (found := convex.overlay(a, b, how, grid)) is not None:
        return found
    rule = RULES[how]
    return assemble(_border(lambda step: [ring_segments(a, step), ring_segments(b, step)], grid, lambda w: rule(w[:, 0], w[:, 1])))


def union_all(gs: list[Geometry | None], grid: float = 0.0) -> Geometry:
    """Union of the polygons of many geometries in one arrangement; large lists in halves, by place."""
    gs = [g for g in gs if g is not None and simple_parts(g)]
    if not gs:
        return (POLYGON, [])
    grid = grid or grid_of(*gs)
    if len(gs) > 64:
        gs.sort(key=lambda g: envelope(g)[:2])
        return union_all([union_all(gs[i : i + 32], grid) for i in range(0, len(gs), 32)], grid)
    return assemble(_border(lambda step: [np.concatenate([ring_segments(g, step) for g in gs])], grid, lambda w: w[:, 0]))


def make_valid(g: Geometry | None, grid: float = 0.0) -> Geometry | None:
    """Polygons rebuilt by the even-odd rule from their linework; lines and points stay."""
    if g is None or not grid and convex.corners(g):
        return g
    parts = simple_parts(g)
    out = [p for p in parts if p[0] != POLYGON]
    for p in parts:
        if p[0] != POLYGON:
            continue
        step = grid or grid_of(p)
        s = ring_segments(p, step, oriented=False)
        pieces, owner = node(s, np.zeros(len(s), int), np.zeros((0, 2)), step)
        if not len(pieces):
            continue
        u, _, many = _unique(pieces, owner, 1)
        odd = many[:, 0] % 2 == 1
        u = u[odd]
        if not len(u):
            continue
        left, right = sides(u, np.ones((len(u), 1), int))
        # With every piece counted once in its own direction, parity is what matters.
        l, r = left[:, 0] % 2 == 1, right[:, 0] % 2 == 1
        out += simple_parts(assemble(np.concatenate([u[l & ~r], u[r & ~l][:, [2, 3, 0, 1]]])))
    multi = g[0] in (MULTIPOLYGON, COLLECTION)
    if multi and len([p for p in out if p[0] == POLYGON]) > 1 and all(p[0] == POLYGON for p in out):
        return union_all(out, grid)
    return build(out) if out else (g[0], None if g[0] == POINT else [])


def is_simple(g: Geometry | None) -> bool:
    """No self-crossing: lines meet themselves at the ends of a closed line only."""
    if g is None:
        return False
    for kind, p in simple_parts(g):
        if kind == LINE and len(p) > 2:
            grid = grid_of((LINE, p))
            s = line_segments((LINE, p), grid)
            pieces, _ = node(s, np.zeros(len(s), int), np.zeros((0, 2)), grid)
            live = s[(s[:, :2] != s[:, 2:]).any(1)]
            u, _, many = _unique(pieces, np.zeros(len(pieces), int), 1)
            if len(pieces) != len(live) or (many > 1).any():
                return False
            ends, counts = np.unique(u.reshape(-1, 2), axis=0, return_counts=True)
            if (counts > 2).any() or ((counts == 2).sum() < len(ends) - 2 and not (counts == 2).all()):
                return False
        elif kind == POLYGON and not is_valid((kind, p)):
            return False
    return True


def is_valid(g: Geometry | None) -> bool:
    """Closed rings of at least four points that don't cross, holes inside their shell, parts apart."""
    if g is None:
        return False
    if convex.corners(g):
        return True
    polygons = []
    for kind, p in simple_parts(g):
        if kind == LINE and len(np.unique(p, axis=0)) < 2 or not np.isfinite(coordinates((kind, p))).all():
            return False
        if kind != POLYGON:
            continue
        if any(len(r) < 4 or (r[0] != r[-1]).any() or signed_area(r) == 0 for r in p):
            return False
        grid = grid_of((kind, p))
        s = ring_segments((kind, p), grid)
        live = s[(s[:, :2] != s[:, 2:]).any(1)]
        pieces, owner = node(s, np.zeros(len(s), int), np.zeros((0, 2)), grid)
        u, net, many = _unique(pieces, owner, 1)
        if (many > 1).any() or len(_crossed(live, grid)):
            return False
        left, right = sides(u, net)
        values = np.concatenate([left, right])
        if values.min() < 0 or values.max() > 1:
            return False
        polygons.append((kind, p))
    if len(polygons) > 1:
        whole = area(union_all(polygons))
        if abs(whole - sum(map(area, polygons))) > 1e-9 * max(1.0, whole):
            return False
    return True


def _crossed(s: np.ndarray, grid: float) -> list:
    """Pairs of segments that cross properly."""
    out = []
    for i, j in _pairs(s):
        cross, a, b = _cross(s[i], s[j])
        with np.errstate(invalid="ignore"):
            proper = (cross != 0) & (a > 1e-12) & (a < 1 - 1e-12) & (b > 1e-12) & (b < 1 - 1e-12)
        out += list(zip(i[proper].tolist(), j[proper].tolist(), strict=True))
    return out


# --- relations -----------------------------------------------------------------------------------------------


def _relate_intervals(a0: float, a1: float, b0: float, b1: float) -> list[list[int]]:
    """As :func:`relate`, of two intervals on a line."""
    ends = lambda some: 0 if any(some) else -1
    whole = lambda yes: 1 if yes else -1
    return [
        [whole(max(a0, b0) < min(a1, b1)), ends(a0 < x < a1 for x in (b0, b1)), whole(a0 < b0 or a1 > b1)],
        [ends(b0 < x < b1 for x in (a0, a1)), ends(x == y for x in (a0, a1) for y in (b0, b1)), ends(not b0 <= x <= b1 for x in (a0, a1))],
        [whole(b0 < a0 or b1 > a1), ends(not a0 <= x <= a1 for x in (b0, b1)), 1],
    ]


def _relate_boxes(p: tuple, q: tuple) -> list[list[int]]:
    """A rectangle's interior, border and exterior are products of those of its sides, so dimensions add up."""
    x, y = _relate_intervals(p[0], p[2], q[0], q[2]), _relate_intervals(p[1], p[3], q[1], q[3])
    m = [[-1] * 3 for _ in range(3)]
    for i in range(3):
        for j in range(3):
            if x[i][j] < 0:
                continue
            for k in range(3):
                for n in range(3):
                    if y[k][n] >= 0:
                        at, to = max(i, k), max(j, n)
                        m[at][to] = max(m[at][to], x[i][j] + y[k][n])
    return m


def relate(a: Geometry, b: Geometry) -> list[list[int]]:
    """Dimensionally extended intersection matrix; rows and columns are interior, border, exterior; -1 is empty."""
    if (p := is_box(a)) and (q := is_box(b)):
        return _relate_boxes(p, q)
    grid = grid_of(a, b)
    snap = lambda p: np.round(p / grid) * grid
    sets = []
    for g in (a, b):
        parts = simple_parts(g)
        pts = np.array([snap(p[1]) for p in parts if p[0] == POINT]).reshape(-1, 2)
        ends: dict[tuple, int] = {}
        for k, p in parts:
            if k == LINE and len(p):
                for e in (snap(p[0]), snap(p[-1])):
                    ends[tuple(e)] = ends.get(tuple(e), 0) + 1
        sets.append((pts, {e for e, n in ends.items() if n % 2}, ring_segments(g, grid), line_segments(g, grid)))
    segs = [sets[0][2], sets[0][3], sets[1][2], sets[1][3]]
    points = np.concatenate([sets[0][0], sets[1][0]])
    pieces, owner = node(np.concatenate(segs), np.repeat([0, 1, 2, 3], [len(s) for s in segs]), points, grid)
    m = [[-1] * 3 for _ in range(3)]

    def mark(i, j, dim):
        m[i][j] = max(m[i][j], dim)

    m[2][2] = 2
    if len(pieces):
        u, net, many = _unique(pieces, owner, 4)
        left, right = sides(u, net)
        for side in (left, right):
            for x in np.unique(side[:, [0, 2]] > 0, axis=0):
                mark(0 if x[0] else 2, 0 if x[1] else 2, 2)
        place = np.full((len(u), 2), OUT)
        for n, (rg, ln) in enumerate(((0, 1), (2, 3))):
            inside_l, inside_r = left[:, rg] > 0, right[:, rg] > 0
            place[inside_l & inside_r, n] = IN
            place[inside_l != inside_r, n] = ON
            on_line = (many[:, ln] > 0) & (place[:, n] == OUT)
            place[on_line, n] = IN
        for x in np.unique(place, axis=0):
            mark(x[0], x[1], 1)
    else:
        u, many, place = np.zeros((0, 4)), np.zeros((0, 4), int), np.zeros((0, 2), int)
    nodes = {tuple(x) for x in points} | {tuple(x) for x in u.reshape(-1, 2)}
    touch: dict[tuple, list[int]] = {}
    for i, e in enumerate(u):
        touch.setdefault((e[0], e[1]), []).append(i)
        touch.setdefault((e[2], e[3]), []).append(i)
    for p in nodes:
        at = []
        for n, g in enumerate((a, b)):
            near = touch.get(p, [])
            rg, ln = 2 * n, 2 * n + 1
            if any(place[i, n] == ON and many[i, rg] for i in near):
                at.append(ON)
            elif locate(np.array(p), g) == IN or any(place[i, n] == IN and many[i, rg] for i in near):
                at.append(IN)
            elif any(many[i, ln] for i in near):
                at.append(ON if p in sets[n][1] else IN)
            elif len(sets[n][0]) and (sets[n][0] == p).all(1).any():
                at.append(IN)
            elif locate(np.array(p), g) == ON:
                at.append(ON)
            else:
                at.append(OUT)
        mark(at[0], at[1], 0)
    return m


def _apart(a, b) -> bool:
    p, q = envelope(a), envelope(b)
    return p is None or q is None or p[0] > q[2] or q[0] > p[2] or p[1] > q[3] or q[1] > p[3]


def intersects(a, b) -> bool:
    if _apart(a, b):
        return False
    m = relate(a, b)
    return max(m[0][0], m[0][1], m[1][0], m[1][1]) >= 0


def contains(a, b) -> bool:
    if _apart(a, b):
        return False
    m = relate(a, b)
    return m[0][0] >= 0 and m[2][0] < 0 and m[2][1] < 0


def within(a, b) -> bool:
    return contains(b, a)


def touches(a, b) -> bool:
    if _apart(a, b):
        return False
    m = relate(a, b)
    return m[0][0] < 0 and max(m[0][1], m[1][0], m[1][1]) >= 0


def crosses(a, b) -> bool:
    if _apart(a, b):
        return False
    m, p, q = relate(a, b), dimension(a), dimension(b)
    if p == q == 1:
        return m[0][0] == 0
    return m[0][0] >= 0 and (m[0][2] if p < q else m[2][0]) >= 0 and p != q


def overlaps(a, b) -> bool:
    if _apart(a, b) or dimension(a) != dimension(b):
        return False
    m = relate(a, b)
    return m[0][0] == dimension(a) and m[0][2] >= 0 and m[2][0] >= 0


def equals(a, b) -> bool:
    if _apart(a, b):
        return not simple_parts(a) and not simple_parts(b)
    m = relate(a, b)
    return m[0][0] >= 0 and max(m[0][2], m[1][2], m[2][0], m[2][1]) < 0


def distance(a: Geometry | None, b: Geometry | None) -> float:
    """Least distance; -1 if either is null or empty."""
    if a is None or b is None or not simple_parts(a) or not simple_parts(b):
        return -1.0
    if (p := is_box(a)) and (q := is_box(b)):
        return math.hypot(max(p[0] - q[2], q[0] - p[2], 0.0), max(p[1] - q[3], q[1] - p[3], 0.0))
    if not _apart(a, b) and intersects(a, b):
        return 0.0
    best = math.inf

    def segs(g):
        out = [np.concatenate([p[1], p[1]])[None] for p in simple_parts(g) if p[0] == POINT]
        lines = [p[1] for p in simple_parts(g) if p[0] == LINE] + [r for p in simple_parts(g) if p[0] == POLYGON for r in p[1]]
        out += [np.concatenate([r[:-1], r[1:]], 1) if len(r) > 1 else np.concatenate([r, r], 1) for r in lines]
        return np.concatenate(out)

    sa, sb = segs(a), segs(b)
    for one, two in ((sa, sb), (sb, sa)):
        for p in np.unique(one.reshape(-1, 2), axis=0):
            o, d = two[:, :2], two[:, 2:] - two[:, :2]
            n = (d * d).sum(1)
            t = np.clip(np.where(n > 0, ((p - o) * d).sum(1) / np.where(n > 0, n, 1), 0), 0, 1)
            best = min(best, float(np.hypot(*(o + t[:, None] * d - p).T).min()))
    return best


# --- shapes --------------------------------------------------------------------------------------------------


def convex_hull(g: Geometry) -> Geometry:
    """Monotone chain."""
    pts = sorted(map(tuple, np.unique(coordinates(g), axis=0)))
    if len(pts) == 0:
        return (COLLECTION, [])
    if len(pts) == 1:
        return (POINT, np.array(pts[0]))

    def half(ps):
        out = []
        for p in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    hull = half(pts) + half(pts[::-1])
    return (LINE, ring(hull)) if len(hull) == 2 else (POLYGON, [ring([*hull, hull[0]])])


def boundary(g: Geometry) -> Geometry:
    """Rings of polygons as lines; ends of open lines as points."""
    out, ends = [], {}
    for kind, p in simple_parts(g):
        if kind == POLYGON:
            out += [(LINE, r) for r in p]
        elif kind == LINE:
            for e in (tuple(p[0]), tuple(p[-1])):
                ends[e] = ends.get(e, 0) + 1
    out += [(POINT, np.array(e)) for e, n in ends.items() if n % 2]
    return build(out) if out else (COLLECTION, [])


def _peucker(r: np.ndarray, tolerance: float) -> np.ndarray:
    keep = np.zeros(len(r), bool)
    keep[[0, -1]] = True
    stack = [(0, len(r) - 1)]
    while stack:
        i, j = stack.pop()
        if j - i < 2:
            continue
        a, d = r[i], r[j] - r[i]
        e = r[i + 1 : j] - a
        n = d @ d
        t = np.clip(e @ d / n, 0, 1) if n else np.zeros(len(e))
        off = np.hypot(*(e - t[:, None] * d).T)
        k = int(off.argmax())
        if off[k] > tolerance:
            keep[i + 1 + k] = True
            stack += [(i, i + 1 + k), (i + 1 + k, j)]
    return r[keep]


def simplify(g: Geometry, tolerance: float, preserve: bool = False) -> Geometry:
    """Douglas-Peucker; with ``preserve`` rings keep four points and a result that isn't valid is tried with half the tolerance."""

    def once(t: float) -> Geometry:
        out = []
        for kind, p in simple_parts(g):
            if kind == LINE:
                out.append((LINE, _peucker(p, t)))
            elif kind == POLYGON:
                rings = []
                for n, r in enumerate(p):
                    far = int(np.hypot(*(r - r[0]).T).argmax())
                    s = np.concatenate([_peucker(r[: far + 1], t)[:-1], _peucker(r[far:], t)])
                    if len(s) < 4:
                        if not preserve:
                            if n == 0:
                                break
                            continue
                        s = r
                    rings.append(s)
                if rings:
                    out.append((POLYGON, rings))
            else:
                out.append((kind, p))
        multi = g[0] > POLYGON
        return build(out, g[0] if multi or not out else None)

    found = once(tolerance)
    while preserve and tolerance > 0 and not is_valid(found) and is_valid(g):
        tolerance /= 2
        if tolerance < grid_of(g):
            return g
        found = once(tolerance)
    return found


def _capsule(a, b, d: float, quad: int) -> np.ndarray:
    """Outline of all points within ``d`` of a segment, arcs of ``quad`` pieces to a quarter circle."""
    at = math.atan2(b[1] - a[1], b[0] - a[0]) if (a != b).any() else 0.0
    t = np.linspace(0, math.pi, 2 * quad + 1)
    one = np.stack([b[0] + d * np.cos(at - math.pi / 2 + t), b[1] + d * np.sin(at - math.pi / 2 + t)], 1)
    two = np.stack([a[0] + d * np.cos(at + math.pi / 2 + t), a[1] + d * np.sin(at + math.pi / 2 + t)], 1)
    r = np.concatenate([one, two])
    if (a == b).all():
        r = np.concatenate([one[:-1], two[:-1]])
    return np.concatenate([r, r[:1]])


def _buffer_box(b: tuple, d: float, quad: int) -> Geometry:
    """A rectangle grown by ``d``, arcs of ``quad`` pieces at its corners, or shrunk: the outline of all capsules at once."""
    x0, y0, x1, y1 = b
    if d < 0:
        from .model import box

        return box(x0 - d, y0 - d, x1 + d, y1 + d) if x0 - d < x1 + d and y0 - d < y1 + d else (POLYGON, [])
    t = np.linspace(0, math.pi / 2, quad + 1)
    arcs = [np.stack([x + d * np.cos(t + turn), y + d * np.sin(t + turn)], 1) for x, y, turn in (
        (x1, y0, -math.pi / 2), (x1, y1, 0.0), (x0, y1, math.pi / 2), (x0, y0, math.pi))]
    return (POLYGON, [np.concatenate([*arcs, arcs[0][:1]])])


def buffer(g: Geometry | None, d: float, quad_segs: int = 30) -> Geometry:
    """Round buffer; ``quad_segs`` of 0 or less is 30; a negative distance shrinks polygons and empties the rest."""
    if g is None:
        return (POLYGON, [])
    quad = quad_segs if quad_segs > 0 else 30
    if d == 0:
        return union_all([g])
    if b := is_box(g):
        return _buffer_box(b, d, quad)
    caps = []
    for kind, p in simple_parts(g):
        if kind == POLYGON:
            rings = p
        elif d > 0:
            rings = [p] if kind == LINE else [np.array([p, p])]
        else:
            continue
        for r in rings:
            for a, b in zip(r[:-1], r[1:], strict=True):
                if kind == POINT or (a != b).any():
                    caps.append((POLYGON, [_capsule(a, b, abs(d), quad)]))
    solid = build([p for p in simple_parts(g) if p[0] == POLYGON]) if dimension(g) == 2 else (POLYGON, [])
    if not caps:
        return (POLYGON, [])
    if d > 0:
        return union_all([*caps, *simple_parts(solid)])
    return overlay(union_all([solid]), union_all(caps), "difference")


def auto_distance(g: Geometry, ratio: float = 1.5) -> float:
    """Distance from the outer rings' area A and perimeter P: sqrt(A) * 0.01 * ratio * (1 + 0.5 * deviation from a circle)."""
    ratio = ratio if ratio > 0 else 1.5
    outer = [p[1][0] for p in simple_parts(g) if p[0] == POLYGON]
    a, p = sum(abs(signed_area(r)) for r in outer), sum(map(path_length, outer))
    if a <= 0 or p <= 0:
        return 0.0
    half = math.sqrt(a / math.pi) / 2
    return math.sqrt(a) * 0.01 * ratio * (1 + 0.5 * abs(a / p - half) / half)


def buffer_auto(g: Geometry, ratio: float = 1.5, quad_segs: int = 30) -> Geometry:
    """Each outer ring buffered by its own distance, its holes put back as they were."""
    out = []
    for kind, p in simple_parts(g):
        if kind == POLYGON:
            grown = buffer((POLYGON, [p[0]]), auto_distance((POLYGON, [p[0]]), ratio), quad_segs)
            holes = union_all([(POLYGON, [h]) for h in p[1:]])
            out += simple_parts(overlay(grown, holes, "difference") if simple_parts(holes) else grown)
    return build(out) if out else (POLYGON, [])


def snap_to_grid(g: Geometry | None, grid: float) -> Geometry | None:
    """Coordinates rounded to multiples of ``grid``, polygons repaired; unchanged for a grid of 0 or less."""
    if g is None or grid <= 0:
        return g
    from .model import map_coordinates

    snapped = map_coordinates(g, lambda c: np.round(c / grid) * grid)
    return make_valid(snapped) if dimension(g) == 2 else remove_repeated(snapped)


def close_rings(g: Geometry) -> Geometry:
    from .model import map_coordinates

    if g[0] == POLYGON:
        return (POLYGON, [r if len(r) and (r[0] == r[-1]).all() else np.concatenate([r, r[:1]]) for r in g[1]])
    if g[0] in (POINT, LINE):
        return map_coordinates(g, lambda c: c)
    return (g[0], [close_rings(p) for p in g[1]])


def segmentize(g: Geometry, longest: float) -> Geometry:
    """Points put in evenly so that no segment is longer than ``longest``."""
    from .model import map_coordinates

    def f(c):
        if len(c) < 2 or longest <= 0:
            return c
        n = np.maximum(1, np.ceil(np.hypot(*np.diff(c, axis=0).T) / longest).astype(int))
        out = [c[i] + (c[i + 1] - c[i]) * (np.arange(n[i]) / n[i])[:, None] for i in range(len(c) - 1)]
        return np.concatenate([*out, c[-1:]])

    return map_coordinates(g, f)


def remove_repeated(g: Geometry, tolerance: float = 0.0) -> Geometry:
    from .model import map_coordinates

    def f(c):
        keep = [0]
        for i in range(1, len(c)):
            if math.hypot(*(c[i] - c[keep[-1]])) > tolerance:
                keep.append(i)
        if len(c) > 1 and keep[-1] != len(c) - 1:
            if len(keep) > 1:
                keep[-1] = len(c) - 1
            else:
                keep.append(len(c) - 1)
        return c[keep]

    return map_coordinates(g, f)


def line_difference(line: Geometry, other: Geometry, slack: float = 0.0) -> Geometry:
    """Parts of lines that don't run along the rings or lines of ``other``."""
    grid = max(grid_of(line, other), slack)
    a = line_segments(line, grid)
    b = np.concatenate([ring_segments(other, grid), line_segments(other, grid)])
    pieces, owner = node(np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)]), np.zeros((0, 2)), grid)
    key = lambda s: (min((s[0], s[1]), (s[2], s[3])), max((s[0], s[1]), (s[2], s[3])))
    taken = {key(s) for s in pieces[owner == 1]}
    free = [s for s in pieces[owner == 0] if key(s) not in taken]
    return build(_chains(free)) if free else (LINE, ring([]))


def _chains(segments: list) -> list[Geometry]:
    """Segments joined end to end where exactly two meet."""
    at: dict[tuple, list[int]] = {}
    for i, s in enumerate(segments):
        for p in ((s[0], s[1]), (s[2], s[3])):
            at.setdefault(p, []).append(i)
    used, out = set(), []

    def grow(path: list, p: tuple):
        while True:
            nxt = [i for i in at[p] if i not in used]
            if len(at[p]) != 2 or len(nxt) != 1:
                return
            used.add(nxt[0])
            s = segments[nxt[0]]
            p = (s[2], s[3]) if (s[0], s[1]) == p else (s[0], s[1])
            path.append(p)

    for i, s in enumerate(segments):
        if i in used:
            continue
        used.add(i)
        path = [(s[0], s[1]), (s[2], s[3])]
        grow(path, path[-1])
        path.reverse()
        grow(path, path[-1])
        path.reverse()
        out.append((LINE, ring(path)))
    return out


def longest_part(g: Geometry) -> Geometry:
    """The first of the longest lines; anything without lines comes back unchanged."""
    lines = [p for p in simple_parts(g) if p[0] == LINE]
    return max(lines, key=lambda p: path_length(p[1])) if lines else g


def polygonal(g: Geometry | None) -> Geometry | None:
    """As a MultiPolygon; None where nothing polygonal is left."""
    found = [p for p in simple_parts(g) if p[0] == POLYGON]
    return (MULTIPOLYGON, found) if found else None
