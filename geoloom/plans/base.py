"""Registration of queries and the layers and rasters they run on, derived from the bundled tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query under its function's name, with SQL that gives the same rows."""

    def wrap(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(layer: DataFrame) -> DataFrame:
    """Rows dealt evenly before work in Python, so that it spreads over all cores however few files they came in."""
    return layer.repartition(2 * layer.sparkSession.sparkContext.defaultParallelism)


def d(c: str | Column) -> Column:
    return F.expr(c).cast("double") if isinstance(c, str) else c.cast("double")


def parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles of customers."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("grp"), F.col("c_nationkey").alias("nat"),
        d("(c_custkey * 37) % 1000").alias("xmin"), d("(c_custkey * 91) % 1000").alias("ymin"),
        d("(c_custkey * 37) % 1000 + 5 + c_custkey % 20").alias("xmax"), d("(c_custkey * 91) % 1000 + 5 + (c_custkey * 7) % 20").alias("ymax"),
    )


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles of suppliers, which may overlap one another."""
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nat"),
        d("(s_suppkey * 113) % 1000").alias("xmin"), d("(s_suppkey * 71) % 1000").alias("ymin"),
        d("(s_suppkey * 113) % 1000 + 40 + (s_suppkey * 13) % 80").alias("xmax"), d("(s_suppkey * 71) % 1000 + 40 + (s_suppkey * 29) % 80").alias("ymax"),
    )


def apart_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred rectangles on a grid that don't meet."""
    s = table(spark, sf_dir, "supplier").where("s_suppkey < 100")
    cx, cy = "s_suppkey % 10", "cast(floor(s_suppkey / 10) as bigint)"
    return s.select(
        F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nat"), d(f"100 * ({cx}) + 10").alias("xmin"), d(f"100 * ({cy}) + 10").alias("ymin"),
        d(f"100 * ({cx}) + 90").alias("xmax"), d(f"100 * ({cy}) + 90").alias("ymax"),
    )


def spread_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles of all suppliers that don't meet, on a grid over the parcels whose pitch follows the largest key."""
    s, side = table(spark, sf_dir, "supplier"), 1
    most = s.agg(F.max("s_suppkey")).first()[0] or 0
    while side * side <= most:
        side *= 2
    pitch, cx, cy = 1024.0 / side, F.col("s_suppkey") % side, F.floor(F.col("s_suppkey") / side)
    return s.select(
        F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nat"), ((d(cx) + 0.125) * pitch).alias("xmin"), ((d(cy) + 0.125) * pitch).alias("ymin"),
        ((d(cx) + 0.875) * pitch).alias("xmax"), ((d(cy) + 0.875) * pitch).alias("ymax"),
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", "ts", (d("(event_id * 7919) % 360000") / 1000.0 - 180.0).alias("lon"), (d("(event_id * 104729) % 170000") / 1000.0 - 85.0).alias("lat")
    )


def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four bands of line items, and their keys."""
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", d("l_quantity").alias("b1"), (d("l_extendedprice") / 1000.0).alias("b2"),
        d("l_discount").alias("b3"), d("l_tax").alias("b4"),
    )


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors as a raster: a row each, 64 columns."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("int").alias("y"), F.posexplode("embedding").alias("x", "v")).withColumn("v", d("v"))


def rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a byte image 20 wide."""
    return table(spark, sf_dir, "part").select(
        F.expr("cast(floor(p_partkey / 20) as int)").alias("y"), F.expr("cast(p_partkey % 20 as int)").alias("x"),
        F.expr("cast((p_partkey * 31) % 256 as int)").alias("b1"), F.expr("cast((p_partkey * 57 + p_size * 3) % 256 as int)").alias("b2"),
        F.expr("cast(cast(floor(p_retailprice) as bigint) % 256 as int)").alias("b3"),
    )


def heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (d("o_totalprice") / 100.0 - 500.0).alias("h"))


#: The same fixtures for the other engine.
P_SQL = """p as (select c_custkey id, c_mktsegment grp, c_nationkey nat, cast((c_custkey*37)%1000 as double) x0, cast((c_custkey*91)%1000 as double) y0,
 cast((c_custkey*37)%1000+5+c_custkey%20 as double) x1, cast((c_custkey*91)%1000+5+(c_custkey*7)%20 as double) y1 from customer)"""
Z_SQL = """z as (select s_suppkey id, s_nationkey nat, cast((s_suppkey*113)%1000 as double) x0, cast((s_suppkey*71)%1000 as double) y0,
 cast((s_suppkey*113)%1000+40+(s_suppkey*13)%80 as double) x1, cast((s_suppkey*71)%1000+40+(s_suppkey*29)%80 as double) y1 from supplier)"""
ZD_SQL = """z as (select s_suppkey id, s_nationkey nat, cast(100*(s_suppkey%10)+10 as double) x0, cast(100*(s_suppkey//10)+10 as double) y0,
 cast(100*(s_suppkey%10)+90 as double) x1, cast(100*(s_suppkey//10)+90 as double) y1 from supplier where s_suppkey < 100)"""
ZA_SQL = """grid as (select cast(power(2, ceil(log2(max(s_suppkey) + 1) / 2)) as bigint) side from supplier),
 z as (select s_suppkey id, s_nationkey nat, (s_suppkey%side + cast(0.125 as double))*(cast(1024 as double)/side) x0, (s_suppkey//side + cast(0.125 as double))*(cast(1024 as double)/side) y0,
 (s_suppkey%side + cast(0.875 as double))*(cast(1024 as double)/side) x1, (s_suppkey//side + cast(0.875 as double))*(cast(1024 as double)/side) y1 from supplier, grid)"""
PT_SQL = """pt as (select event_id, ts, cast((event_id*7919)%360000 as double)/1000-180 lon, cast((event_id*104729)%170000 as double)/1000-85 lat from events)"""
B_SQL = """b as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(l_quantity as double) b1, cast(l_extendedprice as double)/1000 b2,
 cast(l_discount as double) b3, cast(l_tax as double) b4 from lineitem)"""
R_SQL = """r as (select cast(vec_id as integer) y, cast(i-1 as integer) x, cast(embedding[i] as double) v from embeddings, range(1, 65) t(i))"""
RGB_SQL = """g as (select cast(p_partkey//20 as integer) y, cast(p_partkey%20 as integer) x, cast((p_partkey*31)%256 as integer) b1,
 cast((p_partkey*57+p_size*3)%256 as integer) b2, cast(cast(floor(p_retailprice) as bigint)%256 as integer) b3 from part)"""
H_SQL = """h as (select o_orderkey id, cast(o_totalprice as double)/100-500 h from orders)"""
LONG_SQL = RGB_SQL + """, l as (select 1 band, y, x, cast(b1 as double) v from g union all select 2, y, x, b2 from g union all select 3, y, x, b3 from g)"""
#: Area of the union of pieces(id, x0, y0, x1, y1) by id, as covered(id, covered).
COVER_SQL = """e as (select distinct id, unnest([x0, x1]) x from pieces), s as (select id, x, lead(x) over (partition by id order by x) x2 from e),
 bars as (select s.id, s.x, s.x2, p.y0, p.y1, max(p.y1) over (partition by s.id, s.x order by p.y0, p.y1 rows between unbounded preceding and 1 preceding) m
 from s join pieces p on p.id = s.id and p.x0 <= s.x and p.x1 >= s.x2 where s.x2 is not null),
 covered as (select id, sum(greatest(y1 - greatest(y0, coalesce(m, y0)), 0) * (x2 - x)) covered from bars group by id)"""
MEET = "p.x0 < z.x1 and z.x0 < p.x1 and p.y0 < z.y1 and z.y0 < p.y1"
COMMON = "greatest(p.x0, z.x0) x0, greatest(p.y0, z.y0) y0, least(p.x1, z.x1) x1, least(p.y1, z.y1) y1"
