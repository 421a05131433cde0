"""Queries of the geometry kernel on slanted edges, holes, lines and invalid rings, whose measures have closed forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import dissolve, layers, overlay
from .base import COVER_SQL, MEET, ORACLE_SQL, P_SQL, PT_SQL, Z_SQL, dealt, parcels, points, query, zones
from .vector_queries import AREA, CELL, NEST, PIECES, _nested, area, boxed

W, H = "(x1 - x0)", "(y1 - y0)"


def ring(*corners: str) -> Column:
    """An open ring of ``"x y"`` expressions over the bounds ``x0, y0, x1, y1``."""
    names = {"x0": "xmin", "y0": "ymin", "x1": "xmax", "y1": "ymax"}

    def value(text: str) -> Column:
        for short, long in names.items():
            text = text.replace(short, long)
        return F.expr(text).cast("double")

    return F.array(*[F.array(*[value(v) for v in c.split(" ")]) for c in corners])


def shaped(layer: DataFrame, *rings: tuple[str, ...]) -> DataFrame:
    """A layer of polygons with these rings."""
    return dealt(layer).withColumn("geom", G.make_polygon(F.array(*[ring(*r) for r in rings])))


TRIANGLE = ("x0 y0", "x1 y0", "x0 y1")
FRAME = ("x0 y0", "x1 y0", "x1 y1", "x0 y1"), ("x0+(x1-x0)/4 y0+(y1-y0)/4", "x0+(x1-x0)/4 y0+3*(y1-y0)/4", "x0+3*(x1-x0)/4 y0+3*(y1-y0)/4", "x0+3*(x1-x0)/4 y0+(y1-y0)/4")
CORNERED = ("x0 y0", "x1 y0", "x1 y0+(y1-y0)/2", "x0+(x1-x0)/2 y0+(y1-y0)/2", "x0+(x1-x0)/2 y1", "x0 y1")
BOW = ("x0 y0", "x1 y1", "x1 y0", "x0 y1")


def measured(layer: DataFrame, geom: Column, digits: int = 6) -> DataFrame:
    return layer.select("id", F.round(G.area(geom), digits).alias("area"))


@query(f"with {P_SQL} select id, round({W} * {H} / 2, 6) area, round({W} + {H} + sqrt({W} * {W} + {H} * {H}), 6) perimeter, round((2 * x0 + x1) / 3, 6) cx, round((2 * y0 + y1) / 3, 6) cy, cast(4 as integer) points from p")
def triangle_measures(spark, sf_dir):
    t = shaped(parcels(spark, sf_dir), TRIANGLE)
    c = G.envelope(G.centroid(F.col("geom")))
    return t.select("id", F.round(G.area(F.col("geom")), 6).alias("area"), F.round(G.length(F.col("geom")), 6).alias("perimeter"), c.alias("c"), G.num_points(F.col("geom")).alias("points")).select(
        "id", "area", "perimeter", F.round("c.xmin", 6).alias("cx"), F.round("c.ymin", 6).alias("cy"), "points"
    )


def _halves(spark, sf_dir) -> DataFrame:
    """The left half of each parcel's bounds, moved apart, so that each meets its own triangle only."""
    p = _spread(spark, sf_dir)
    return p.withColumn("xmax", (F.col("xmin") + F.col("xmax")) / 2).withColumnRenamed("id", "half")


def _spread(spark, sf_dir) -> DataFrame:
    """Parcels set apart on a lattice of pitch 32."""
    p = parcels(spark, sf_dir)
    w, h = F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")
    x, y = F.expr("cast(32 * (id % 128) as double)"), F.expr("cast(32 * floor(id / 128) as double)")
    return p.select("id", "grp", x.alias("xmin"), y.alias("ymin"), (x + w).alias("xmax"), (y + h).alias("ymax"))


@query(f"with {P_SQL} select id, round({W} * {H} * 3 / 8, 6) area from p")
def overlay_clip_triangles(spark, sf_dir):
    """A right triangle loses a quarter of its area to the far half of its box."""
    a = shaped(_spread(spark, sf_dir), TRIANGLE).select("id", "geom")
    return overlay.clip(a, boxed(_halves(spark, sf_dir)).select("half", "geom"), "id", measures=area(6)).select("id", "area")


@query(f"with {P_SQL} select id, round({W} * {H} / 8, 6) area from p")
def overlay_erase_triangles(spark, sf_dir):
    a = shaped(_spread(spark, sf_dir), TRIANGLE).select("id", "geom")
    return overlay.erase(a, boxed(_halves(spark, sf_dir)).select("half", "geom"), "id", measures=area(6)).select("id", "area")


@query(f"with {P_SQL} select id, id half, round({W} * {H} * 3 / 8, 6) area from p")
def overlay_intersect_triangles(spark, sf_dir):
    a = shaped(_spread(spark, sf_dir), TRIANGLE).select("id", "geom")
    return overlay.intersect(a, boxed(_halves(spark, sf_dir)).select("half", "geom"), measures=area(6)).select("id", "half", "area")


@query(f"with {P_SQL} select 'a' side, id, round({W} * {H} / 8, 6) area from p union all select 'b', id, round({W} * {H} / 8, 6) from p")
def overlay_symdiff_triangles(spark, sf_dir):
    """The triangle's part beyond the half box, and the half box's part beyond the triangle."""
    a = shaped(_spread(spark, sf_dir), TRIANGLE).select("id", "geom")
    out = overlay.sym_difference(a, boxed(_halves(spark, sf_dir)).select("half", "geom"), "id", "half", measures=area(6))
    side = F.when(F.col("half").isNull(), "a").otherwise("b")
    return out.select(side.alias("side"), F.coalesce("id", "half").alias("id"), "area")


@query(ORACLE_SQL["overlay_symdiff_area"].replace("id, area from rest", "id, round(area, 5) area from rest").replace(
    f"select 'b', z.id, {AREA} - coalesce(c.covered, 0) from", f"select 'b', z.id, round({AREA} - coalesce(c.covered, 0), 5) from"))
def overlay_symdiff_kernel(spark, sf_dir):
    a, b = boxed(parcels(spark, sf_dir)).select("id", "geom"), boxed(zones(spark, sf_dir)).select(F.col("id").alias("zone"), "geom")
    out = overlay.sym_difference(a, b, "id", "zone", measures=area(5))
    return out.select(F.when(F.col("zone").isNull(), "a").otherwise("b").alias("side"), F.coalesce("id", "zone").alias("id"), "area")


@query(f"with {P_SQL}, {Z_SQL}, {PIECES}, {COVER_SQL} select id, round(covered, 5) area from covered")
def overlay_merge_by_input(spark, sf_dir):
    """All pieces of one parcel, merged: its covered part."""
    a, b = boxed(parcels(spark, sf_dir)).select("id", "geom"), boxed(zones(spark, sf_dir)).select(F.col("id").alias("zone"), "geom")
    return measured(overlay.merged_intersect(a, b, "id"), F.col("geom"), 5)


@query(f"with {P_SQL} select id, round({W} * {H} * 3 / 4, 6) area, round(3 * ({W} + {H}), 6) border, cast(10 as integer) points, round({W} * {H}, 6) outer_area from p")
def frame_measures(spark, sf_dir):
    """A box with a hole half as wide: its measures, and those of its outer ring alone."""
    g = shaped(parcels(spark, sf_dir), *FRAME)
    c = F.col("geom")
    return g.select("id", F.round(G.area(c), 6).alias("area"), F.round(G.length(G.boundary(c)), 6).alias("border"), G.num_points(c).alias("points"), F.round(G.area(G.exterior(c)), 6).alias("outer_area"))


@query(f"with {P_SQL} select id, round({W} * {H} * 7 / 8, 6) hull, round({W} * {H} * 3 / 4, 6) area from p")
def convex_hull_area(spark, sf_dir):
    """A box without its upper right quarter: the hull cuts that corner along its diagonal."""
    g = shaped(parcels(spark, sf_dir), CORNERED)
    return g.select("id", F.round(G.area(G.convex_hull(F.col("geom"))), 6).alias("hull"), F.round(G.area(F.col("geom")), 6).alias("area"))


@query(f"with {P_SQL} select id, round({W} * {H} / 2, 6) area, false valid, true repaired from p")
def make_valid_bows(spark, sf_dir):
    """A bow-tie becomes its two triangles."""
    g = shaped(parcels(spark, sf_dir), BOW)
    m = G.make_valid(F.col("geom"))
    return g.select("id", F.round(G.area(m), 6).alias("area"), G.is_valid(F.col("geom")).alias("valid"), G.is_valid(m).alias("repaired"))


@query(f"with {P_SQL} select cast(count_if(id % 3 <> 0) as bigint) \"valid\", cast(count_if(id % 3 = 0) as bigint) invalid from p")
def count_valid_mixed(spark, sf_dir):
    p = parcels(spark, sf_dir)
    return layers.count_valid(shaped(p.where("id % 3 = 0"), BOW).unionByName(boxed(p.where("id % 3 <> 0"))))


@query(f"with {P_SQL} select id, round({W} + {H} / 2, 6) flat, round({W} + {H}, 6) whole from (select id, x0, x1, y0, y1 from p)")
def simplify_lines(spark, sf_dir):
    """A bend of a tenth goes, a corner stays."""
    bent = ring("x0 y0", "x0+(x1-x0)/2 y0+0.1", "x1 y0", "x1 y0+(y1-y0)/2")
    corner = ring("x0 y0", "x1 y0", "x1 y1")
    g = parcels(spark, sf_dir).withColumns({"a": G.make_line(bent), "b": G.make_line(corner)})
    return g.select("id", F.round(G.length(G.simplify(F.col("a"), 0.5)), 6).alias("flat"), F.round(G.length(G.simplify(F.col("b"), 0.5)), 6).alias("whole"))


@query(f"with {PT_SQL} select event_id, round(sqrt((lon - 10) * (lon - 10) + (lat - 20) * (lat - 20)), 9) dist from pt")
def point_distance_kernel(spark, sf_dir):
    at = G.distance(G.point(F.col("lon"), F.col("lat")), G.point(F.lit(10.0), F.lit(20.0)))
    return points(spark, sf_dir).select("event_id", F.round(at, 9).alias("dist"))


@query(f"""with {P_SQL} select id, round(sqrt(power(greatest(400 - x1, x0 - 600, 0), 2) + power(greatest(300 - y1, y0 - 500, 0), 2)), 9) dist from p""")
def box_distance_kernel(spark, sf_dir):
    far = G.box(F.lit(400.0), F.lit(300.0), F.lit(600.0), F.lit(500.0))
    return boxed(parcels(spark, sf_dir)).select("id", F.round(G.distance(F.col("geom"), far), 9).alias("dist"))


INSIDE = "(p.x0 >= z.x0 and p.x1 <= z.x1 and p.y0 >= z.y0 and p.y1 <= z.y1)"


@query(f"""with {P_SQL}, {Z_SQL} select p.id a_id, z.id b_id, ({MEET} and not {INSIDE} and not (z.x0 >= p.x0 and z.x1 <= p.x1 and z.y0 >= p.y0 and z.y1 <= p.y1)) overlapping,
 {INSIDE} covered, (p.x0 = z.x0 and p.x1 = z.x1 and p.y0 = z.y0 and p.y1 = z.y1) same, true meeting, false apart
 from p join z on p.x0 <= z.x1 and z.x0 <= p.x1 and p.y0 <= z.y1 and z.y0 <= p.y1""")
def predicates_of_boxes(spark, sf_dir):
    tests = {"overlapping": G.overlaps, "covered": lambda a, b: G.contains(b, a), "same": G.equals, "meeting": G.intersects, "apart": G.disjoint}
    return overlay.met_pairs(boxed(parcels(spark, sf_dir)), boxed(zones(spark, sf_dir)), CELL, touching=True, tests=tests).select("a_id", "b_id", *tests)


@query(f"with {P_SQL} select id, true crossing, true touching, true apart, true inside, false crossing_inside from p")
def predicates_of_triangles(spark, sf_dir):
    """A line through a triangle, one along its long side, one beyond it, and one within."""
    line = lambda *c: G.make_line(ring(*c))
    t = shaped(parcels(spark, sf_dir), TRIANGLE)
    t = t.withColumns({
        "through": line("x0-1 y0+(y1-y0)/4", "x1+1 y0+(y1-y0)/4"), "along": line("x1 y0", "x0 y1"), "beyond": line("x1 y1", "x1+1 y1"),
        "within": line("x0+(x1-x0)/8 y0+(y1-y0)/8", "x0+(x1-x0)/4 y0+(y1-y0)/4"),
    })
    g = F.col("geom")
    return t.select(
        "id", G.crosses(F.col("through"), g).alias("crossing"), G.touches(F.col("along"), g).alias("touching"), G.disjoint(F.col("beyond"), g).alias("apart"),
        G.within(F.col("within"), g).alias("inside"), G.crosses(F.col("within"), g).alias("crossing_inside"),
    )


@query(f"""with {P_SQL} select id, round({W} * {H} * 5 / 8, 6) whole, round({W} * {H} * 3 / 8, 6) common, round({W} * {H} / 8, 6) rest, round({W} * {H} / 4, 6) either from p""")
def set_operations_on_triangles(spark, sf_dir):
    """Union, intersection, difference and symmetric difference of a triangle and half its box."""
    half = G.make_polygon(F.array(ring("x0 y0", "x0+(x1-x0)/2 y0", "x0+(x1-x0)/2 y1", "x0 y1")))
    t = shaped(parcels(spark, sf_dir), TRIANGLE).withColumn("half", half)
    a, b = F.col("geom"), F.col("half")
    return t.select("id", *[F.round(G.area(f(a, b)), 6).alias(n) for n, f in (("whole", G.union), ("common", G.intersection), ("rest", G.difference), ("either", G.sym_difference))])


@query(ORACLE_SQL["containment_parent"])
def containment_parent_kernel(spark, sf_dir):
    return dissolve.containment(boxed(_nested(spark, sf_dir)), "id", CELL).select("id", "parent")


@query(ORACLE_SQL["containment_level"])
def containment_level_kernel(spark, sf_dir):
    return dissolve.containment(boxed(_nested(spark, sf_dir)), "id", CELL).select("id", "level")


@query(f"""{NEST}, tree as (select u.id, u.a, (select arg_min(v.id, (v.a, -v.id)) from u v where v.a > u.a and v.x0 <= u.x0 and v.x1 >= u.x1 and v.y0 <= u.y0 and v.y1 >= u.y1) parent,
 (select count(*) from u v where v.a > u.a and v.x0 <= u.x0 and v.x1 >= u.x1 and v.y0 <= u.y0 and v.y1 >= u.y1) lvl from u),
 holes as (select parent, sum(a) a from tree where lvl % 2 = 1 group by parent)
 select t.id, round(t.a - case when t.lvl % 2 = 0 then coalesce(h.a, 0) else 0 end, 6) area, cast(t.lvl as integer) "level" from tree t left join holes h on h.parent = t.id""")
def donut_areas(spark, sf_dir):
    """Polygons at an even depth with those directly inside as holes; ring areas are subtracted, overlapping or not."""
    out = dissolve.donuts(boxed(_nested(spark, sf_dir)), "id", size=CELL)
    return out.select("id", F.round(G.area(F.col("geom")), 6).alias("area"), "level")


@query(f"with {P_SQL} select id, cast(row_number() over (order by {AREA} desc, id) as bigint) \"rank\" from p")
def area_rank(spark, sf_dir):
    return dissolve.rank_by_area(boxed(parcels(spark, sf_dir)).select("id", "geom"), "id").select("id", F.col("rank").cast("long").alias("rank"))


@query(f"with {P_SQL} select id, round(greatest({W}, {H} / 2), 6) longest from p")
def longest_parts(spark, sf_dir):
    """Of two lines, the longer one."""
    def wkt(c: str) -> Column:
        return F.expr(f"cast({c.replace('x0', 'xmin').replace('x1', 'xmax').replace('y0', 'ymin').replace('y1', 'ymax')} as string)")

    two = F.concat(F.lit("MULTILINESTRING (("), wkt("x0"), F.lit(" "), wkt("y0"), F.lit(","), wkt("x1"), F.lit(" "), wkt("y0"), F.lit("),("), wkt("x0"), F.lit(" "), wkt("y0"), F.lit(","), wkt("x0"), F.lit(" "), wkt("y0+(y1-y0)/2"), F.lit("))"))
    return parcels(spark, sf_dir).select("id", F.round(G.length(G.longest_line(G.geom_from_wkt(two))), 6).alias("longest"))


@query(f"with {P_SQL} select id, round((floor(x1 / 4 + 0.5) - floor(x0 / 4 + 0.5)) * 4 * (floor(y1 / 4 + 0.5) - floor(y0 / 4 + 0.5)) * 4, 6) area from (select id, x0 + 1 x0, x1 + 1 x1, y0 + 1 y0, y1 + 1 y1 from p) where x0 % 4 <> 2 and x1 % 4 <> 2 and y0 % 4 <> 2 and y1 % 4 <> 2")
def snapped_area(spark, sf_dir):
    """Corners rounded to multiples of four; those half way between, which round to even, aside."""
    p = parcels(spark, sf_dir).withColumns({c: F.col(c) + 1 for c in overlay.BOX}).where(" and ".join(f"{c} % 4 <> 2" for c in overlay.BOX))
    return measured(boxed(p), G.snap(F.col("geom"), F.lit(4.0)))


@query(f"with {P_SQL} select id, cast(1 + 2 * (ceil({W} / 3) + ceil({H} / 3)) as integer) points from p")
def segmentized_points(spark, sf_dir):
    return boxed(parcels(spark, sf_dir)).select("id", G.num_points(G.segmentize(F.col("geom"), F.lit(3.0))).alias("points"))


@query(f"with {P_SQL} select id, round({AREA} + 2 * ({W} + {H}) * (1 + id % 3) + (1 + id % 3) * (1 + id % 3) * 4 * 30 * 0.5 * sin(pi() / 60), 4) area from p")
def buffer_by_field(spark, sf_dir):
    """Rectangles grown by a column's value."""
    d = F.expr("cast(1 + id % 3 as double)")
    return measured(boxed(parcels(spark, sf_dir)), G.buffer(F.col("geom"), d), 4)


@query(f"with {P_SQL} select id, round(({W} - 2) * ({H} - 2), 5) area from p")
def buffer_inward(spark, sf_dir):
    return measured(boxed(parcels(spark, sf_dir)), G.buffer(F.col("geom"), -1.0), 5)


@query(f"with {P_SQL}, {Z_SQL}, e as (select min(x0) x0, min(y0) y0, max(x1) x1, max(y1) y1 from (select x0, y0, x1, y1 from p union all select x0, y0, x1, y1 from z)) select round({AREA}, 6) area from e")
def extent_polygon_area(spark, sf_dir):
    wkt = layers.extent_wkt(parcels(spark, sf_dir), zones(spark, sf_dir))
    return wkt.select(F.round(G.area(G.geom_from_wkt(F.col(wkt.columns[0]))), 6).alias("area"))


@query(f"with {P_SQL} select id, grp, cast(row_number() over (order by id) as bigint) object_id from p")
def object_ids(spark, sf_dir):
    out = layers.ensure_object_id(parcels(spark, sf_dir).select("id", "grp"), ["id"], "object_id")
    return out.select("id", "grp", F.col("object_id").cast("long").alias("object_id"))


@query(f"with {P_SQL}, {Z_SQL}, pieces as (select grp id, x0, y0, x1, y1 from p), {COVER_SQL} select id grp, round(covered, 4) area from covered")
def dissolve_by_field(spark, sf_dir):
    return dissolve.dissolve_field(boxed(parcels(spark, sf_dir)).select("grp", "geom"), "grp").select("grp", F.round(G.area(F.col("geom")), 4).alias("area"))
