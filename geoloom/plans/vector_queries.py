"""Queries of the vector operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import tiles
from ..operators import dissolve, layers, overlay
from ..sources import types
from .base import COMMON, COVER_SQL, MEET, ORACLE_SQL, P_SQL, PT_SQL, QUERIES, Z_SQL, ZA_SQL, ZD_SQL, apart_zones, dealt, parcels, points, query, spread_zones, table, zones

CELL = 64.0


def boxed(layer: DataFrame) -> DataFrame:
    """A layer of rectangles with its WKB column."""
    return dealt(layer).withColumn("geom", G.box(F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax")))


AREA = "(x1 - x0) * (y1 - y0)"


def area(digits: int | None = None) -> dict:
    """The area of a result as its ``area``, rounded if asked for."""
    return {"area": lambda g: G.area(g) if digits is None else F.round(G.area(g), digits)}


@query(f"with {P_SQL}, {Z_SQL} select p.id a_id, z.id b_id, (least(p.x1, z.x1) - greatest(p.x0, z.x0)) * (least(p.y1, z.y1) - greatest(p.y0, z.y0)) area from p join z on {MEET}")
def overlay_intersect_boxes(spark, sf_dir):
    pairs = overlay.intersect_boxes(parcels(spark, sf_dir), zones(spark, sf_dir), CELL)
    return pairs.select("a_id", "b_id", overlay.box_area().alias("area"))


@query(f"with {P_SQL}, {Z_SQL} select p.id a_id, z.id b_id, round((least(p.x1, z.x1) - greatest(p.x0, z.x0)) * (least(p.y1, z.y1) - greatest(p.y0, z.y0)), 6) area from p join z on {MEET}")
def overlay_intersect_kernel(spark, sf_dir):
    a = boxed(parcels(spark, sf_dir)).select(F.col("id").alias("a_id"), "geom")
    b = boxed(zones(spark, sf_dir)).select(F.col("id").alias("b_id"), "geom")
    return overlay.intersect(a, b, measures=area(6)).select("a_id", "b_id", "area")


PIECES = f"pieces as (select p.id, {COMMON} from p join z on {MEET})"


@query(f"with {P_SQL}, {Z_SQL}, {PIECES}, {COVER_SQL} select id, covered area from covered")
def overlay_clip_area(spark, sf_dir):
    return overlay.covered_boxes(parcels(spark, sf_dir), zones(spark, sf_dir), "id", CELL).select("id", F.col("covered").alias("area"))


@query(f"with {P_SQL}, {Z_SQL}, {PIECES}, {COVER_SQL} select id, round(covered, 5) area from covered")
def overlay_clip_kernel(spark, sf_dir):
    return overlay.clip(boxed(parcels(spark, sf_dir)), boxed(zones(spark, sf_dir)), "id", measures=area(5)).select("id", "area")


LEFT = f"rest as (select p.id, {AREA} - coalesce(covered, 0) area from p left join covered c on c.id = p.id)"


@query(f"with {P_SQL}, {Z_SQL}, {PIECES}, {COVER_SQL}, {LEFT} select id, area from rest where area > 0")
def overlay_erase_area(spark, sf_dir):
    p = parcels(spark, sf_dir)
    c = overlay.covered_boxes(p, zones(spark, sf_dir), "id", CELL)
    area = overlay.box_area() - F.coalesce("covered", F.lit(0.0))
    return p.join(c, "id", "left").select("id", area.alias("area")).where("area > 0")


@query(f"with {P_SQL}, {Z_SQL}, {PIECES}, {COVER_SQL}, {LEFT} select id, round(area, 5) area from rest where area > 0")
def overlay_erase_kernel(spark, sf_dir):
    return overlay.erase(boxed(parcels(spark, sf_dir)), boxed(zones(spark, sf_dir)), "id", measures=area(5)).select("id", "area")


@query(f"with {P_SQL}, {ZD_SQL}, {PIECES}, {COVER_SQL}, {LEFT} select id, sum(area) area, cast(count(*) as bigint) parts from (select id, {AREA} area from pieces union all select id, area from rest where area > 0) group by id")
def overlay_identity_area(spark, sf_dir, layer=apart_zones):
    p, z = parcels(spark, sf_dir), layer(spark, sf_dir)
    both = overlay.intersect_boxes(p, z, CELL).select(F.col("a_id").alias("id"), overlay.box_area().alias("area"))
    c = overlay.covered_boxes(p, z, "id", CELL)
    rest = p.join(c, "id", "left").select("id", (overlay.box_area() - F.coalesce("covered", F.lit(0.0))).alias("area")).where("area > 0")
    return both.unionByName(rest).groupBy("id").agg(F.sum("area").alias("area"), F.count("*").alias("parts"))


@query(f"with {P_SQL}, {ZD_SQL}, {PIECES}, {COVER_SQL}, {LEFT} select id, round(sum(area), 5) area, cast(count(*) as bigint) parts from (select id, {AREA} area from pieces union all select id, area from rest where area > 0) group by id")
def overlay_identity_kernel(spark, sf_dir, layer=apart_zones):
    a, b = boxed(parcels(spark, sf_dir)), boxed(layer(spark, sf_dir)).withColumnRenamed("id", "zone")
    out = overlay.identity(a, b, "id", "prefix", measures=area())
    return out.groupBy("id").agg(F.round(F.sum("area"), 5).alias("area"), F.count("*").alias("parts"))


BACK = "back as (select z.id, greatest(z.x0, p.x0) x0, greatest(z.y0, p.y0) y0, least(z.x1, p.x1) x1, least(z.y1, p.y1) y1 from z join p on " + MEET + ")"
COVER_BACK = COVER_SQL.replace("pieces", "back").replace("e as (", "e2 as (").replace("from e)", "from e2)").replace(", s as (", ", s2 as (").replace("from s join", "from s2 s join").replace("bars", "bars2").replace("covered as (", "covered2 as (")


@query(f"""with {P_SQL}, {Z_SQL}, {PIECES}, {COVER_SQL}, {LEFT}, {BACK}, {COVER_BACK}
 select 'a' side, id, area from rest where area > 0 union all select 'b', z.id, {AREA} - coalesce(c.covered, 0) from z left join covered2 c on c.id = z.id where {AREA} - coalesce(c.covered, 0) > 0""")
def overlay_symdiff_area(spark, sf_dir):
    p, z = parcels(spark, sf_dir).select("id", *overlay.BOX), zones(spark, sf_dir).select("id", *overlay.BOX)
    sides = []
    for name, a, b in (("a", p, z), ("b", z, p)):
        c = overlay.covered_boxes(a, b, "id", CELL)
        sides.append(a.join(c, "id", "left").select(F.lit(name).alias("side"), "id", (overlay.box_area() - F.coalesce("covered", F.lit(0.0))).alias("area")).where("area > 0"))
    return sides[0].unionByName(sides[1])


@query(f"with {P_SQL}, {ZD_SQL}, {PIECES}, {COVER_SQL}, {LEFT} select 'a' side, id, area from rest where area > 0 union all select 'b', id, {AREA} from z")
def overlay_update_area(spark, sf_dir, layer=apart_zones):
    a, b = boxed(parcels(spark, sf_dir)).select(F.lit("a").alias("side"), "id", "geom"), boxed(layer(spark, sf_dir)).select(F.lit("b").alias("side"), "id", "geom")
    return overlay.update(a, b, "id", measures=area()).select("side", "id", "area")


@query(f"""with {P_SQL}, {ZD_SQL}, {PIECES}, {COVER_SQL}, {LEFT}, {BACK}, {COVER_BACK}
 select 'both' part, round(sum({AREA}), 4) area, cast(count(*) as bigint) features from pieces union all select 'a', round(sum(area), 4), count(*) from rest where area > 0
 union all select 'b', round(sum(area), 4), count(*) from (select {AREA} - coalesce(c.covered, 0) area from z left join covered2 c on c.id = z.id) where area > 0""")
def overlay_union_area(spark, sf_dir, layer=apart_zones):
    a = boxed(parcels(spark, sf_dir)).select(F.col("id").alias("a_id"), "geom")
    b = boxed(layer(spark, sf_dir)).select(F.col("id").alias("b_id"), "geom")
    out = overlay.union(a, b, "a_id", "b_id", measures=area())
    part = F.when(F.col("b_id").isNull(), "a").when(F.col("a_id").isNull(), "b").otherwise("both")
    return out.groupBy(part.alias("part")).agg(F.round(F.sum("area"), 4).alias("area"), F.count("*").alias("features"))


def _over_all_zones(name: str) -> None:
    """The query again, with every supplier in the second layer."""

    @query(ORACLE_SQL[name].replace(ZD_SQL, ZA_SQL), f"{name}_all")
    def run(spark, sf_dir):
        return QUERIES[name](spark, sf_dir, spread_zones)


for _name in ("overlay_identity_area", "overlay_identity_kernel", "overlay_update_area", "overlay_union_area"):
    _over_all_zones(_name)


def _strategy(name: str, sql: str) -> None:
    @query(f"with {P_SQL}, {Z_SQL} select {sql} from p join z on {MEET}", f"field_strategy_{name}")
    def run(spark, sf_dir):
        p, z = parcels(spark, sf_dir), zones(spark, sf_dir)
        pairs = overlay.envelope_pairs(p, z, CELL)
        fields = layers.merge_fields(["id", "grp", "nat"], ["id", "nat"], name)
        return pairs.select(*[F.col(f"{s}_{c}").alias(n) for s, c, n in fields])


_strategy("table1", "p.id, p.grp, p.nat")
_strategy("table2", "z.id, z.nat")
_strategy("prefer1", "p.id, p.grp, p.nat")
_strategy("prefer2", "z.id, z.nat, p.grp")
_strategy("prefix", "p.id, p.grp, p.nat, z.id l2_id, z.nat l2_nat")


@query(f"with {Z_SQL} select p.id a_id, z.id b_id, (least(p.x1, z.x1) - greatest(p.x0, z.x0)) * (least(p.y1, z.y1) - greatest(p.y0, z.y0)) area from z p join z on p.id < z.id and {MEET}")
def self_overlap_pairs(spark, sf_dir):
    z = zones(spark, sf_dir)
    return overlay.intersect_boxes(z, z, CELL).where("a_id < b_id").select("a_id", "b_id", overlay.box_area().alias("area"))


@query(f"with {Z_SQL}, pieces as (select p.id, {COMMON} from z p join z on p.id <> z.id and {MEET}), {COVER_SQL} select z.id, round({AREA} - coalesce(covered, 0), 5) area from z left join covered c on c.id = z.id where {AREA} - coalesce(covered, 0) > 1e-6")
def self_overlap_rest(spark, sf_dir):
    rest, _ = dissolve.self_overlap_parts(boxed(zones(spark, sf_dir)).select("id", "geom"), "id")
    return rest.select("id", F.round(G.area(F.col("geom")), 5).alias("area"))


NEST = f"with {P_SQL}, {Z_SQL}, u as (select id, x0, y0, x1, y1, {AREA} a from p union all select 1000000 + id, x0, y0, x1, y1, {AREA} from z)"


def _nested(spark, sf_dir):
    p = parcels(spark, sf_dir).select("id", *overlay.BOX)
    return p.unionByName(zones(spark, sf_dir).select((F.col("id") + 1000000).alias("id"), *overlay.BOX))


@query(f"{NEST} select u.id, (select arg_min(v.id, (v.a, -v.id)) from u v where v.a > u.a and v.x0 <= u.x0 and v.x1 >= u.x1 and v.y0 <= u.y0 and v.y1 >= u.y1) parent from u")
def containment_parent(spark, sf_dir):
    return dissolve.containment(_nested(spark, sf_dir), "id", CELL, boxes=True).select("id", "parent")


@query(f"{NEST} select u.id, cast((select count(*) from u v where v.a > u.a and v.x0 <= u.x0 and v.x1 >= u.x1 and v.y0 <= u.y0 and v.y1 >= u.y1) as integer) \"level\" from u")
def containment_level(spark, sf_dir):
    return dissolve.containment(_nested(spark, sf_dir), "id", CELL, boxes=True).select("id", "level")


@query(f"with {Z_SQL}, pieces as (select nat id, x0, y0, x1, y1 from z), {COVER_SQL} select id nat, round(covered, 4) area, cast((select count(*) from z where z.nat = covered.id) as bigint) members from covered")
def dissolve_area_by_group(spark, sf_dir):
    z = boxed(zones(spark, sf_dir)).select("nat", "id", "geom")
    out = dissolve.dissolve(z, ["nat"], "id")
    n = z.groupBy("nat").agg(F.count("*").alias("members"))
    return out.join(n, "nat").select("nat", F.round(G.area(F.col("geom")), 4).alias("area"), "members")


@query(f"with {Z_SQL}, pieces as (select 1 id, x0, y0, x1, y1 from z), {COVER_SQL} select round(covered, 3) area from covered")
def union_all_area(spark, sf_dir):
    return dissolve.union_layer(boxed(zones(spark, sf_dir)).select("geom")).select(F.round(G.area(F.col("geom")), 3).alias("area"))


@query(f"with {P_SQL}, {Z_SQL} select min(x0) xmin, min(y0) ymin, max(x1) xmax, max(y1) ymax from (select x0, y0, x1, y1 from p union all select x0, y0, x1, y1 from z)")
def layer_extent(spark, sf_dir):
    return layers.extent(parcels(spark, sf_dir), zones(spark, sf_dir))


@query(f"with {P_SQL} select id, grp from p where x0 <= 400 and x1 >= 200 and y0 <= 500 and y1 >= 300")
def filter_extent(spark, sf_dir):
    return layers.filter_extent(parcels(spark, sf_dir), 200.0, 300.0, 400.0, 500.0).select("id", "grp")


@query(f"with {P_SQL} select id from p where x0 <= 400 and x1 >= 200 and y0 <= 500 and y1 >= 300")
def filter_geometry_box(spark, sf_dir):
    from ..kernel import model

    return layers.filter_geometry(boxed(parcels(spark, sf_dir)), model.to_wkb(model.box(200, 300, 400, 500))).select("id")


@query(f"with {P_SQL} select grp, cast(count(*) as bigint) features, sum(x1 - x0) width from p group by grp")
def feature_count(spark, sf_dir):
    return parcels(spark, sf_dir).groupBy("grp").agg(F.count("*").alias("features"), F.sum(F.col("xmax") - F.col("xmin")).alias("width"))


@query("select cast(count(*) as bigint) \"valid\", cast(0 as bigint) invalid from customer")
def count_valid(spark, sf_dir):
    return layers.count_valid(boxed(parcels(spark, sf_dir)))


@query(f"with {P_SQL} select id, {AREA} area, 2 * (x1 - x0 + y1 - y0) perimeter, (x0 + x1) / 2 cx, (y0 + y1) / 2 cy from p")
def ring_measures(spark, sf_dir):
    g = boxed(parcels(spark, sf_dir))
    c = G.envelope(G.centroid(F.col("geom")))
    return g.select("id", G.area(F.col("geom")).alias("area"), G.length(F.col("geom")).alias("perimeter"), c.alias("c")).select("id", "area", "perimeter", F.col("c.xmin").alias("cx"), F.col("c.ymin").alias("cy"))


@query(f"""with {P_SQL}, q as (select id, {AREA} a, 2 * (x1 - x0 + y1 - y0) p from p), r as (select id, a, p, sqrt(a / pi()) / 2 half from q)
 select id, round(sqrt(a) * 0.01 * 1.5 * (1 + 0.5 * abs(a / p - half) / half), 9) dist from r""")
def auto_buffer_distance(spark, sf_dir):
    return boxed(parcels(spark, sf_dir)).select("id", F.round(G.auto_distance(F.col("geom")), 9).alias("dist"))


@query(f"with {Z_SQL} select id, round({AREA} + 2 * (x1 - x0 + y1 - y0) * 3 + 9 * 4 * 30 * 0.5 * sin(pi() / 60), 4) area from z")
def buffer_area(spark, sf_dir):
    """A rectangle grown by 3: its area, its sides and four quarter circles of 30 pieces each."""
    return boxed(zones(spark, sf_dir)).select("id", F.round(G.area(G.buffer(F.col("geom"), 3.0)), 4).alias("area"))


@query(f"with {PT_SQL} select event_id, round(sqrt((lon - 10) * (lon - 10) + (lat - 20) * (lat - 20)), 9) dist from pt")
def point_distance(spark, sf_dir):
    p = points(spark, sf_dir)
    return p.select("event_id", F.round(F.hypot(F.col("lon") - 10.0, F.col("lat") - 20.0), 9).alias("dist"))


@query(f"""with {P_SQL}, {Z_SQL} select p.id a_id, z.id b_id, {MEET} overlapping, (p.x0 >= z.x0 and p.x1 <= z.x1 and p.y0 >= z.y0 and p.y1 <= z.y1) inside,
 not ({MEET}) touching from p join z on p.x0 <= z.x1 and z.x0 <= p.x1 and p.y0 <= z.y1 and z.y0 <= p.y1 where z.id < 40""")
def predicates(spark, sf_dir):
    return _predicates(parcels(spark, sf_dir), zones(spark, sf_dir).where("id < 40"))


@query(ORACLE_SQL["predicates"].removesuffix(" where z.id < 40"), "predicates_all")
def predicates_all(spark, sf_dir):
    """The same over all zones."""
    return _predicates(parcels(spark, sf_dir), zones(spark, sf_dir))


def _predicates(p: DataFrame, z: DataFrame) -> DataFrame:
    tests = {"overlapping": lambda a, b: G.area(G.common_area(a, b)) > 0, "inside": G.within, "touching": G.touches}
    return overlay.met_pairs(boxed(p), boxed(z), CELL, touching=True, tests=tests).select("a_id", "b_id", *tests)


@query(f"""with {PT_SQL} select event_id, cast(case when z between 25 and 45 then z end as integer) zone, cast(case when z between 25 and 45 then z + 4509 end as integer) epsg
 from (select event_id, cast(floor((lon + 1.5) / 3) as integer) z from pt)""")
def cgcs_zone(spark, sf_dir):
    p = points(spark, sf_dir)
    return p.select("event_id", tiles.cgcs2000_zone(F.col("lon")).alias("zone"), tiles.cgcs2000_epsg(F.col("lon")).alias("epsg"))


@query(f"""with {PT_SQL} select event_id, round(lon * 20037508.342789244 / 180, 4) x, round(ln(tan((90 + lat) * pi() / 360)) * 6378137.0, 4) y from pt""")
def reproject_points(spark, sf_dir):
    e = G.envelope(G.transform(G.point(F.col("lon"), F.col("lat")), 4326, 3857))
    return points(spark, sf_dir).select("event_id", e.alias("e")).select("event_id", F.round("e.xmin", 4).alias("x"), F.round("e.ymin", 4).alias("y"))


@query("""with s as (select o_custkey k, max(cast(o_totalprice as double)) v from orders group by o_custkey)
 select c_custkey, coalesce(v, c_acctbal) balance from customer left join s on k = c_custkey""")
def sync_field_join(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("balance"))
    o = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_totalprice").cast("double").alias("v")).withColumnRenamed("o_custkey", "c_custkey")
    return layers.sync_field(c, o, "c_custkey", {"v": "balance"})


@query(f"with {P_SQL} select id, grp from p where grp <> 'BUILDING'")
def delete_by_filter(spark, sf_dir):
    return layers.delete_where(parcels(spark, sf_dir), "grp = 'BUILDING'").layer.select("id", "grp")


@query(f"with {P_SQL}, {Z_SQL} select id, grp, nat from p union all select id, null, nat from z")
def append_by_name(spark, sf_dir):
    return layers.append(parcels(spark, sf_dir).select("id", "grp", "nat"), zones(spark, sf_dir).select("nat", "id"))


@query("select c_custkey, c_name from customer")
def fuzzy_drop(spark, sf_dir):
    return layers.drop_fields_like(layers.drop_fields_like(table(spark, sf_dir, "customer"), "NATION"), "seg").drop("c_acctbal")


@query("select p_partkey, case when regexp_matches(t, '^[0-9]') then substr('f_' || t, 1, 10) else substr(t, 1, 10) end field from (select p_partkey, replace(replace(replace(p_type, ' ', '_'), '-', '_'), '.', '_') t from part)")
def sanitize_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", layers.sanitize_column(F.col("p_type")).alias("field"))


@query("select * from (values ('integer','Integer',0),('bigint','Integer64',0),('numeric(10,2)','Real',10),('varchar(50)','String',50),('boolean','Integer',0),('timestamp','DateTime',0),('uuid','String',36),('bytea','Binary',0)) t(pg_type, field_type, width)")
def type_mapping(spark, sf_dir):
    names = ["integer", "bigint", "numeric(10,2)", "varchar(50)", "boolean", "timestamp", "uuid", "bytea"]
    rows = [(n, *types.from_postgres(n)[:2]) for n in names]
    return spark.createDataFrame(rows, "pg_type string, field_type string, width int")


@query(f"with {P_SQL} select id, cast(rank() over (order by grp, id) as bigint) object_id from p")
def add_row_id(spark, sf_dir):
    return layers.with_row_id(parcels(spark, sf_dir).select("id", "grp"), "object_id", ["grp", "id"]).select("id", "object_id")


@query(f"with {P_SQL} select id, cast(least(greatest(floor((y0 + y1) / 2 / (1100 / 8.0)), 0), 7) * 8 + least(greatest(floor((x0 + x1) / 2 / (1100 / 8.0)), 0), 7) as integer) cell from p")
def vector_tile_index(spark, sf_dir):
    p = parcels(spark, sf_dir)
    x, y = (F.col("xmin") + F.col("xmax")) / 2.0, (F.col("ymin") + F.col("ymax")) / 2.0
    return p.select("id", layers.tile_index(x, y, (0.0, 0.0, 1100.0, 1100.0), 8).alias("cell"))


@query(f"with {P_SQL} select cast(count(*) as bigint) updated, cast(0 as bigint) skipped, cast((select count(*) from customer) - count(*) as bigint) missing from (select distinct o_custkey from orders join customer on o_custkey = c_custkey)")
def sync_field_counts(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    return layers.sync_counts(c, o, "c_custkey", "o_totalprice")


@query(f"with {P_SQL} select id, 'Polygon' kind, 'polygon' family, cast(5 as integer) points, true valid from p")
def geometry_header(spark, sf_dir):
    g = boxed(parcels(spark, sf_dir))
    c = F.col("geom")
    return g.select("id", G.geometry_type(c).alias("kind"), G.wkb_family(c).alias("family"), G.num_points(c).alias("points"), G.is_valid_wkb(G.wkb_hex(c)).alias("valid"))


@query(f"with {P_SQL} select id, 'POLYGON ((' || cast(x0 as bigint) || ' ' || cast(y0 as bigint) || ',' || cast(x1 as bigint) || ' ' || cast(y0 as bigint) || ',' || cast(x1 as bigint) || ' ' || cast(y1 as bigint) || ',' || cast(x0 as bigint) || ' ' || cast(y1 as bigint) || ',' || cast(x0 as bigint) || ' ' || cast(y0 as bigint) || '))' wkt from p")
def wkt_round_trip(spark, sf_dir):
    return boxed(parcels(spark, sf_dir)).select("id", G.as_wkt(G.geom_from_geojson(G.as_geojson(G.geom_from_wkt(G.as_wkt(F.col("geom")))))).alias("wkt"))
