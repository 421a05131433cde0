"""Overlays of database tables, with a reader that gives layers instead of a server's rows; typed bands; storage."""

import pytest
from pyspark.sql import functions as F

from geoloom import storage
from geoloom.functions import bands as B
from geoloom.functions import geometry as G
from geoloom.operators import overlay, tables
from geoloom.operators import raster_geometry as RG
from geoloom.plans.base import parcels, zones
from geoloom.plans.vector_queries import boxed

A = tables.Table("jdbc:postgresql://host/db", "parcels", ["id", "grp"], where="grp <> 'x'", parts=4)
Z = tables.Table("jdbc:postgresql://host/db", "zones", ["zone"], key="zone")


@pytest.fixture(scope="module")
def layers(spark):
    sf = "/root/testdata/sf0.01"
    return {"parcels": boxed(parcels(spark, sf)).select("id", "grp", "geom"), "zones": boxed(zones(spark, sf)).select(F.col("id").alias("zone"), "geom")}


@pytest.mark.parametrize("how", ["clip", "erase", "intersect", "identity", "symdifference", "update", "union"])
def test_overlay_of_tables_is_overlay_of_layers(spark, layers, how):
    asked = []

    def read(session, url, name, columns, **kw):
        asked.append((name, columns, kw["partition"], kw["where"]))
        return layers[name]

    got = tables.overlay_tables(spark, how, A, Z, scan=lambda s, t: tables.scan(s, t, span=lambda *_: (0, 99), read=read))
    a, z = layers["parcels"], layers["zones"]
    want = {
        "clip": lambda: overlay.clip(a, z, "id"), "erase": lambda: overlay.erase(a, z, "id"), "intersect": lambda: overlay.intersect(a, z),
        "identity": lambda: overlay.identity(a, z, "id"), "symdifference": lambda: overlay.sym_difference(a, z, "id", "zone"),
        "update": lambda: overlay.update(a, z, "id"), "union": lambda: overlay.union(a, z, "id", "zone"),
    }[how]()
    rows = lambda d: sorted((*[str(r[c]) for c in d.columns if c != "geom"], round(r["_a"], 6)) for r in d.withColumn("_a", G.area(F.col("geom"))).collect())
    assert got.columns == want.columns and rows(got) == rows(want)
    assert asked == [("parcels", ["id", "grp"], ("id", 0, 100, 4), "grp <> 'x'"), ("zones", ["zone"], ("zone", 0, 100, 16), None)]


def test_overlay_of_tables_merges_by_key(spark, layers):
    got = tables.overlay_tables(spark, "intersect", A, Z, merge=True, scan=lambda s, t: layers[t.name])
    clip = overlay.clip(layers["parcels"], layers["zones"], "id")
    area = lambda d: {r["id"]: round(r["a"], 5) for r in d.select("id", G.area(F.col("geom")).alias("a")).collect()}
    assert area(got) == area(clip) and got.count() == clip.count()
    with pytest.raises(ValueError):
        tables.overlay_tables(spark, "nothing", A, Z, scan=lambda s, t: layers[t.name])


def test_statement_and_empty_table(spark, layers):
    assert tables.statement(A) == """(SELECT "id", "grp", ST_AsBinary("geom") AS geom FROM "public"."parcels" WHERE grp <> 'x') t"""
    seen = []
    tables.scan(spark, A, span=lambda *_: None, read=lambda *a, **kw: seen.append(kw["partition"]) or layers["parcels"])
    assert seen == [None]


def test_bands_hold_their_type(spark):
    rows = [(1, -3.0), (2, 2.5), (3, 300.0), (4, float("nan")), (5, None), (6, -2.5)]
    d = spark.createDataFrame(rows, "i int, v double")
    one = lambda kind, nodata=None: [r[0] for r in d.orderBy("i").select(B.to_band_type(F.col("v"), kind, nodata).alias("v")).collect()]
    assert one("Byte") == [0, 3, 255, 0, 0, 0] and one("Int16", -9999) == [-3, 3, 300, -9999, -9999, -3]
    assert one("Float64")[:3] == [-3.0, 2.5, 300.0]
    with pytest.raises(ValueError):
        B.calculate_and_write(d.withColumn("b1", F.col("v")), "b1", 2, {1: "Byte"})


def test_read_tile_outside_and_bands(spark):
    d = spark.createDataFrame([(b, y, x, float(b)) for b in (1, 2, 3, 4, 5) for y in range(4) for x in range(4)], "band int, y int, x int, v double")
    edge = 20037508.342789244
    gt = (-edge, edge / 2, 0.0, edge, 0.0, -edge / 2)
    got = RG.read_tile(d, gt, 4, 4, 0, 0, 0, 8).toPandas()
    assert sorted(got.band.unique()) == [1, 2, 3] and len(got) == 3 * 64 and ((got.v - got.band).abs() < 1e-9).all()
    assert RG.read_tile(d.where("band < 3"), gt, 4, 4, 0, 0, 0, 8).count() == 0
    far = (10 * edge, edge / 2, 0.0, edge, 0.0, -edge / 2)
    assert RG.read_tile(d, far, 4, 4, 0, 0, 0, 8).count() == 0


def test_storage_frees_what_it_discards(spark):
    t = storage.materialize(spark.range(100).groupBy((F.col("id") % 7).alias("k")).count(), "numbers")
    assert t.count() == 7
    folder = t.inputFiles()[0].rsplit("/", 1)[0]
    assert storage.exists(spark, folder) and folder.removeprefix("file:").lstrip("/").startswith(storage.run_dir(spark).removeprefix("file:").lstrip("/"))
    storage.discard(t)
    assert not storage.exists(spark, folder)
    assert spark.conf.get(storage.CLEAN_UP, None) in (None, "false")
