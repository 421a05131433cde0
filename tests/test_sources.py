"""File formats, connectors and catalogue: round trips."""

import datetime as dt
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.functions import geometry as G
from geoloom.kernel import model
from geoloom.operators import catalog
from geoloom.sources import codecs, readers, types, writers

HOLED = model.polygon([(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)], [(2, 2), (2, 4), (4, 4), (4, 2), (2, 2)])
TWO = model.build([model.box(0, 0, 1, 1), model.box(5, 5, 6, 6)])


def layer(spark, *geometries):
    rows = [(i, f"näme {i}", i * 1.5, dt.date(2024, 1, i + 1), model.to_wkb(g) if g else None) for i, g in enumerate(geometries)]
    return spark.createDataFrame(rows, "id int, `a long name` string, value double, day date, geom binary")


def texts(df, column="geom"):
    return [r[0] for r in df.select(G.as_wkt(F.col(column))).collect()]


def test_shapefile(spark, tmp_path):
    df = layer(spark, HOLED, TWO, None)
    names = writers.write_shapefile(df, f"{tmp_path}/a.shp", 4326)
    assert names == ["id", "a_long_nam", "value", "day"]
    back = readers.read_layer(spark, f"{tmp_path}/a.shp")
    rows = back.orderBy("fid").collect()
    assert [(r["id"], r["a_long_nam"], r["value"], r["day"]) for r in rows] == [(i, f"näme {i}", i * 1.5, dt.date(2024, 1, i + 1)) for i in range(3)]
    assert rows[2]["geom"] is None
    assert [G_area(r["geom"]) for r in rows[:2]] == [96, 2] and "GEOGCS" in (tmp_path / "a.prj").read_text()
    for g in (model.from_wkt("LINESTRING (0 0,1 1)"), model.from_wkt("POINT (1 2)"), model.from_wkt("MULTIPOINT ((1 2),(3 4))")):
        assert model.to_wkt(codecs.read_shp(codecs.write_shp([g])[0])[0]) == model.to_wkt(g)
    with pytest.raises(ValueError):
        codecs.write_shp([HOLED, model.from_wkt("POINT (1 2)")])


def G_area(wkb):
    from geoloom.kernel.planar import area

    return area(model.from_wkb(bytes(wkb)))


def test_shapefile_without_cpg_is_gbk(spark, tmp_path):
    shp, shx = codecs.write_shp([model.box(0, 0, 1, 1)])
    (tmp_path / "b.shp").write_bytes(shp)
    (tmp_path / "b.dbf").write_bytes(codecs.write_dbf([("NAME", "C", 20, 0)], [["中文"]], "gbk"))
    assert readers.read_shapefile(spark, f"{tmp_path}/b.shp").first()["NAME"] == "中文"


def test_geojson(spark, tmp_path):
    df = layer(spark, HOLED, TWO, None)
    writers.write_layer(df, f"{tmp_path}/a.geojson")
    back = readers.read_layer(spark, f"{tmp_path}/a.geojson").orderBy("id")
    assert texts(back) == [model.to_wkt(HOLED), model.to_wkt(TWO), None]
    assert dict(back.dtypes)["id"] == "bigint" and dict(back.dtypes)["value"] == "double" and back.first()["a long name"] == "näme 0"
    first = readers.read_geojson(spark, f"{tmp_path}/a.geojson", first_row_schema=True)
    assert dict(first.dtypes)["value"] == "bigint"


@pytest.mark.parametrize("ext", ["kml", "kmz"])
def test_kml(spark, tmp_path, ext):
    df = layer(spark, HOLED, TWO).withColumnRenamed("a long name", "name")
    writers.write_layer(df, f"{tmp_path}/a.{ext}")
    back = readers.read_layer(spark, f"{tmp_path}/a.{ext}").orderBy("id")
    assert texts(back) == [model.to_wkt(HOLED), model.to_wkt(TWO)] and [r["name"] for r in back.collect()] == ["näme 0", "näme 1"]


def test_dxf(spark, tmp_path):
    df = spark.createDataFrame([("roads", model.to_wkb(model.from_wkt("LINESTRING (0 0,1 1,2 0)"))), ("plots", model.to_wkb(model.box(0, 0, 1, 1))), ("p", model.to_wkb(model.from_wkt("POINT (3 4)")))], "Layer string, geom binary")
    writers.convert_from = None
    writers.write_layer(df, f"{tmp_path}/a.dxf")
    back = readers.read_layer(spark, f"{tmp_path}/a.dxf")
    assert sorted(zip((r["Layer"] for r in back.collect()), texts(back))) == [("p", "POINT (3 4)"), ("plots", "POLYGON ((0 0,1 0,1 1,0 1,0 0))"), ("roads", "LINESTRING (0 0,1 1,2 0)")]
    old = "0\nSECTION\n2\nENTITIES\n0\nPOLYLINE\n8\nx\n70\n1\n0\nVERTEX\n10\n0\n20\n0\n0\nVERTEX\n10\n1\n20\n0\n0\nVERTEX\n10\n1\n20\n1\n0\nSEQEND\n0\nENDSEC\n0\nEOF\n"
    assert model.to_wkt(codecs.read_dxf(old)[0][1]) == "POLYGON ((0 0,1 0,1 1,0 0))"


def test_convert_and_list(spark, tmp_path):
    writers.write_layer(layer(spark, HOLED), f"{tmp_path}/a.geojson")
    writers.convert(spark, f"{tmp_path}/a.geojson", f"{tmp_path}/b.shp")
    found = {(r["layer"], r["format"]) for r in readers.list_layers(spark, str(tmp_path)).collect()}
    assert found == {("a", "geojson"), ("b", "shp")}
    info = readers.layer_info(readers.read_layer(spark, f"{tmp_path}/b.shp"))
    assert info["count"] == 1 and info["geometry"] == ["Polygon"] and ("value", "Real") in info["fields"]
    for bad in ("x.gdb", "x.xyz"):
        with pytest.raises(ValueError):
            readers.read_layer(spark, bad)


def test_families_and_records(spark):
    df = layer(spark, HOLED, model.from_wkt("POINT (1 2)"), model.from_wkt("MULTIPOINT ((1 2),(3 4))")).withColumn("ogc_fid", F.lit(1))
    parts = writers.split_families(df)
    assert {k: v.count() for k, v in parts.items()} == {"point": 2, "polygon": 1} and "ogc_fid" not in parts["point"].columns
    back = readers.from_records(spark, [{"geom": model.to_wkb(HOLED).hex(), "n": 3, "ok": True, "t": "x"}, {"geom": None, "n": None, "ok": False, "t": None}])
    assert dict(back.dtypes)["n"] == "bigint" and back.first()["ok"] == 1 and texts(back)[0] == model.to_wkt(HOLED)


def test_png_and_tiff(spark, tmp_path):
    rng = np.random.default_rng(1)
    for shape in ((5, 7), (5, 7, 3), (5, 7, 4)):
        p = rng.integers(0, 256, shape).astype(np.uint8)
        assert (codecs.read_png(codecs.write_png(p)) == p).all()
    for kind in codecs.DTYPES.values():
        b = (rng.random((2, 6, 9)) * 100).astype(kind)
        for squeeze in (True, False):
            back, head = codecs.read_tiff(codecs.write_tiff(b, (10.0, 0.5, 0.0, 20.0, 0.0, -0.5), 4549, -9999.0, squeeze))
            assert (back == b).all() and head["geo"] == (10.0, 0.5, 0.0, 20.0, 0.0, -0.5) and head["epsg"] == 4549 and head["nodata"] == -9999
    px = spark.createDataFrame([(1, n, y, x, float(n * 100 + y * 10 + x)) for n in (1, 2) for y in range(3) for x in range(4)], "raster int, band int, y int, x int, v double")
    assert writers.write_files(writers.encode_rasters(px, "Int16", (0.0, 1.0, 0.0, 3.0, 0.0, -1.0), 3857), str(tmp_path), "tif") == 1
    back = readers.read_raster(spark, f"{tmp_path}/1.tif")
    assert {(r["band"], r["y"], r["x"], r["v"]) for r in back.collect()} == {(r["band"], r["y"], r["x"], r["v"]) for r in px.collect()}
    head = readers.raster_header(spark, f"{tmp_path}/1.tif").first()
    assert (head["width"], head["height"], head["bands"], head["epsg"], head["has_geo"], head["type"]) == (4, 3, 2, 3857, True, "Int16")


def test_tiles_and_mbtiles(spark, tmp_path):
    pts = spark.createDataFrame([(0.1, 0.1, 10, 20, 30), (-90.0, 45.0, 0, 0, 0)], "lon double, lat double, r int, g int, b int")
    tiles = writers.encode_tiles(writers.tile_pixels(pts, 2))
    rows = {(r["x"], r["y"]): codecs.read_png(bytes(r["tile"])) for r in tiles.collect()}
    assert set(rows) == {(2, 1), (1, 1)} and rows[(2, 1)][255, 0].tolist() == [10, 20, 30, 255] and not rows[(1, 1)].any()
    n = writers.write_mbtiles(tiles, f"{tmp_path}/a.mbtiles", writers.mbtiles_metadata("t", 2, 2, (-180, -85, 180, 85)))
    assert n == 2
    with sqlite3.connect(tmp_path / "a.mbtiles") as db:
        assert sorted(db.execute("select zoom_level, tile_column, tile_row from tiles").fetchall()) == [(2, 1, 1), (2, 2, 1)]
        assert dict(db.execute("select name, value from metadata").fetchall())["maxzoom"] == "2"
    h = spark.createDataFrame([(2, 0, 0, 5, 6, 123.4)], "z int, tx int, ty int, px int, py int, h double")
    png = codecs.read_png(bytes(writers.terrain_tiles(h).first()["tile"]))
    r, g, b = (int(v) for v in png[6, 5, :3])
    assert -10000 + (r * 65536 + g * 256 + b) * 0.1 == pytest.approx(123.4, abs=0.11)


def test_batches_with_fallback(spark, tmp_path):
    path = str(tmp_path / "t.db")
    sqlite3.connect(path).execute("create table t (id integer primary key)").connection.commit()

    def insert(rows):
        with sqlite3.connect(path, timeout=30) as db:
            db.executemany("insert into t values (?)", [(int(r[0]),) for r in rows])

    df = spark.createDataFrame([(i % 7,) for i in range(10)], "id int").coalesce(1)
    bad = writers.write_in_batches(df, insert, batch=4).collect()
    assert sorted(r["id"] for r in bad) == [0, 1, 2] and sqlite3.connect(path).execute("select count(*) from t").fetchone()[0] == 7


def test_sql_for_databases(spark):
    sql = readers.postgis_query("public", "roads", ["id", "name", "geom"], where="id > 3")
    assert sql == '(SELECT "id", "name", ST_AsBinary("geom") AS geom FROM "public"."roads" WHERE id > 3) t'
    drop, create, index = writers.postgis_table(layer(spark, HOLED), "public", "roads", "MultiPolygon", 4490)
    assert "CASCADE" in drop and "geometry(MultiPolygon, 4490)" in create and '"a long name" TEXT' in create and "GIST" in index
    assert len(readers.tile_predicates("geom", 4326, (0, 0, 10, 10), 3)) == 9


def test_types():
    assert types.from_postgres("numeric(12,3)") == ("Real", 12, 3, True) and types.from_postgres("jsonb")[3] is False
    assert types.from_postgres("bigint", "gdb")[0] == "Real" and types.lossy("numeric(10,2)") and types.lossy("bigint", "gdb") and not types.lossy("integer")
    assert types.geometry_compatible("Polygon", "MultiPolygon") and not types.geometry_compatible("MultiPolygon", "Polygon")


def test_catalogue(spark):
    catalog.create_dataset(spark, "ds", 4490)
    df = G.with_envelope(layer(spark, HOLED, TWO).withColumnRenamed("a long name", "name")).select("id", "name", "value", "geom")
    catalog.save_layer(df, "ds.plots")
    catalog.set_alias(spark, "ds.plots", "It's plots", {"name": "Name"})
    m = catalog.refresh_extent(spark, "ds.plots")
    assert m.extent == (0, 0, 10, 10) and m.alias == "It's plots" and catalog.read_metadata(spark, "ds.plots") == m
    m.srid, m.geometry = 4549, "MultiPolygon"
    back = catalog.from_xml(catalog.to_xml(m))
    assert (back.name, back.alias, back.srid, back.extent, back.geometry) == (m.name, m.alias, 4549, m.extent, "MultiPolygon") and [f["alias"] for f in back.fields] == ["id", "Name", "value"]
    assert catalog.from_xml("<Name>x</Name><broken").name == "x"
    assert catalog.list_layers(spark, "ds") == ["plots"] and "ds" in catalog.list_datasets(spark)
    catalog.relate(spark, "ds", "plots")
    catalog.relate(spark, "ds", "plots")
    assert catalog.relations(spark).count() == 1
    assert catalog.drop_layers(spark, ["ds.plots", "ds.none"], True) == {"ds.none": "there is no layer ds.none"}
    with pytest.raises(ValueError):
        catalog.drop_layer(spark, "ds.plots")
    catalog.drop_dataset(spark, "ds")
