"""Repeated geometries are computed once, and every feature gets its result."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.functions import geometry as G
from geoloom.kernel import calls, convex, model, planar
from geoloom.operators import dissolve, overlay

BOX = "id long, xmin double, ymin double, xmax double, ymax double"


def boxes(spark, rows):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in rows], BOX)


def boxed(df):
    return df.select("id", G.box(*[F.col(c) for c in overlay.BOX]).alias("geom"))


def arranged(a, b, how):
    grid = planar.grid_of(a, b)
    segments = lambda step: [planar.ring_segments(a, step), planar.ring_segments(b, step)]
    return planar.assemble(planar._border(segments, grid, lambda w: planar.RULES[how](w[:, 0], w[:, 1])))


def test_convex_equals_arrangement():
    rng = np.random.default_rng(3)
    settled = 0
    for _ in range(300):
        shapes = []
        for _ in range(2):
            p = rng.integers(0, 10, (5, 2)).astype(float) if rng.random() < 0.5 else rng.random((5, 2)) * 10
            hull = planar.convex_hull((model.POLYGON, [model.ring([*p, p[0]])]))
            if hull[0] == model.POLYGON:
                shapes.append((hull[0], [hull[1][0][:: rng.choice([-1, 1])].copy()]))
        if len(shapes) < 2:
            continue
        for how in ("intersection", "difference"):
            found = convex.overlay(*shapes, how, planar.grid_of(*shapes))
            if found is not None:
                settled += 1
                assert planar.area(found) == pytest.approx(planar.area(arranged(*shapes, how)), abs=1e-9)
    assert settled > 200


def test_convex_tells_stars_and_bows():
    star = [(np.cos(0.8 * np.pi * i), np.sin(0.8 * np.pi * i)) for i in range(5)]
    assert convex.corners((model.POLYGON, [model.ring([*star, star[0]])])) is None
    assert convex.corners(model.polygon([(0, 0), (1, 1), (1, 0), (0, 1), (0, 0)])) is None
    assert convex.corners(model.polygon([(0, 0), (0, 1), (1, 0), (0, 0)])) == [[1, 0], [0, 1], [0, 0]]


def test_boxes_are_buffered_without_an_arrangement(monkeypatch):
    want = {d: planar.area(planar.buffer(model.polygon([(0, 0), (5, 0), (5, 7), (2, 7), (0, 7), (0, 0)]), d)) for d in (2.0, -1.0, -3.0)}
    monkeypatch.setattr(planar, "node", None)
    for d, a in want.items():
        assert planar.area(planar.buffer(model.box(0, 0, 5, 7), d)) == pytest.approx(a, abs=1e-8)


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(calls, "BYTES", 5000)
    known = calls.memory(calls.name())
    for i in range(1000):
        known.keep(str(i).encode(), i)
    assert len(known) < 30
    for _ in range(50):
        calls.memory(calls.name())
    assert len(calls._memories) <= calls.FUNCTIONS


@pytest.mark.parametrize("twins", [1024, 7])
def test_shapes_meet_once(spark, monkeypatch, twins):
    monkeypatch.setattr(overlay, "TWINS", twins)
    a = boxes(spark, [(i, (i % 2 * 100, 0, i % 2 * 100 + 4, 4)) for i in range(60)])
    b = boxes(spark, [(1000 + i, (2, 2, 6, 6)) for i in range(40)])
    x, y = overlay.prepared(boxed(a)), overlay.prepared(boxed(b))
    assert (x.shapes.count(), x.count, x.most, y.most) == (2, 60, 30, 40)
    assert overlay.prepared_pairs(x, y).count() == 1
    want = {(i, 1000 + j) for i in range(0, 60, 2) for j in range(40)}
    pairs = overlay.intersect(boxed(a), boxed(b).withColumnRenamed("id", "zone"), measures={"area": G.area}).collect()
    assert len(pairs) == len(want) and {(r.id, r.zone) for r in pairs} == want and {r.area for r in pairs} == {4.0}
    plain = overlay.envelope_pairs(a, b).collect()
    assert len(plain) == len(want) and {(r.a_id, r.b_id) for r in plain} == want
    rest = {r.id: r.area for r in overlay.erase(boxed(a), boxed(b), "id", measures={"area": G.area}).collect()}
    assert rest == {i: 16.0 if i % 2 else 12.0 for i in range(60)}
    merged = {r.id: (r.zone, r.area) for r in overlay.merged_intersect(boxed(a), boxed(b).withColumnRenamed("id", "zone"), "id").withColumn("area", G.area(F.col("geom"))).collect()}
    assert merged == {i: (1000, 4.0) for i in range(0, 60, 2)}


def test_merged_intersect_is_the_merge(spark):
    rng = np.random.default_rng(8)
    side = lambda n, w: [(i // 2, (x, y, x + w, y + w)) for i, (x, y) in enumerate(rng.integers(0, 12, (n, 2)))]
    a, b = boxed(boxes(spark, side(30, 3))), boxed(boxes(spark, side(30, 4))).withColumnRenamed("id", "zone")
    rows = lambda d: sorted((r.id, r.zone, round(r.area, 6)) for r in d.withColumn("area", G.area(F.col("geom"))).collect())
    assert rows(overlay.merged_intersect(a, b, "id")) == rows(overlay.merge_by_input(overlay.intersect(a, b), "id"))


def test_covered_boxes_pool_rows_of_one_id(spark):
    a = boxes(spark, [(1, (0, 0, 4, 4)), (1, (0, 0, 4, 4)), (2, (0, 0, 4, 4)), (3, (0, 0, 4, 4)), (3, (10, 0, 14, 4)), (4, (50, 50, 51, 51))])
    b = boxes(spark, [(i, (2, 0, 12, 2)) for i in range(5)])
    assert {r.id: r.covered for r in overlay.covered_boxes(a, b, "id").collect()} == {1: 4.0, 2: 4.0, 3: 8.0}


@pytest.mark.parametrize("plain", [True, False])
def test_containment_counts_features_of_one_shape(spark, plain):
    around = [(i, (0, 0, 20, 20)) for i in range(5)] + [(5 + i, (1, 1, 10, 10)) for i in range(4)]
    df = boxes(spark, [*around, (50, (2, 2, 3, 3)), (51, (2, 2, 3, 3))])
    out = dissolve.containment(df if plain else boxed(df), "id", boxes=plain)
    got = {r["id"]: (r["parent"], r["level"]) for r in out.collect()}
    assert got == {**{i: (None, 0) for i in range(5)}, **{5 + i: (4, 5) for i in range(4)}, 50: (8, 9), 51: (8, 9)}


def test_nothing_is_left_of_twins(spark):
    df = boxed(boxes(spark, [(1, (0, 0, 4, 4)), (2, (0, 0, 4, 4)), (3, (2, 0, 8, 4)), (4, (20, 0, 21, 1))]))
    rest, common = ({(r.id, r.a) for r in x.select("id", G.area("geom").alias("a")).collect()} for x in dissolve.self_overlap_parts(df, "id"))
    assert rest == {(3, 16.0), (4, 1.0)}
    assert common == {(1, 16.0), (1, 8.0)}
