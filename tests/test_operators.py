"""Operators beyond what SQL can check: general geometries, edits, streams, band language, raster kernels."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from geoloom.functions import bands as B
from geoloom.functions import colors
from geoloom.functions import geometry as G
from geoloom.kernel import model
from geoloom.kernel.planar import area
from geoloom.operators import dissolve, layers, overlay
from geoloom.operators import raster as R
from geoloom.streaming import overlay_stream, tile_counts


def shapes(spark, *rows):
    return spark.createDataFrame([(i, n, model.to_wkb(g) if g else None) for i, n, g in rows], "id int, name string, geom binary")


def stars(spark, seed, count, name):
    from test_kernel import star

    rng = np.random.default_rng(seed)
    return shapes(spark, *[(i, f"{name}{i % 3}", star(seed + i, 7, *rng.uniform(0, 6, 2))) for i in range(count)])


def areas(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r["a"] for r in df.groupBy(*keys).agg(F.sum(G.area("geom")).alias("a")).collect()}


def total(df):
    return df.agg(F.sum(G.area("geom"))).first()[0] or 0.0


def test_overlay_laws(spark):
    a, b = stars(spark, 100, 25, "a"), stars(spark, 500, 20, "b").withColumnRenamed("id", "bid").withColumnRenamed("name", "bname")
    whole = areas(a, "id")
    clip, rest = areas(overlay.clip(a, b, "id"), "id"), areas(overlay.erase(a, b, "id"), "id")
    for i, x in whole.items():
        assert clip.get(i, 0) + rest.get(i, 0) == pytest.approx(x, abs=1e-7)
    united = dissolve.union_layer(b)
    assert total(overlay.clip(a, b, "id")) == pytest.approx(total(overlay.intersect(a, united.withColumn("bid", F.lit(1)))), abs=1e-6)
    assert total(overlay.update(a, b, "id")) == pytest.approx(sum(rest.values()) + total(b), abs=1e-7)
    one, two = overlay.sym_difference(a, b, "id", "bid"), overlay.sym_difference(b, a, "bid", "id")
    assert total(one) == pytest.approx(total(two), abs=1e-7) and set(one.columns) == {"id", "name", "bid", "bname", "geom"}
    pairs = overlay.intersect(a, b)
    for size in (0.4, 3.0, 50.0):
        assert areas(overlay.intersect(a, b, size=size), "id", "bid") == pytest.approx(areas(pairs, "id", "bid"))
    assert total(overlay.union(a, b, "id", "bid")) == pytest.approx(total(pairs) + sum(rest.values()) + total(overlay.erase(b, a, "bid")), abs=1e-7)
    merged = overlay.merge_by_input(pairs, "id")
    assert merged.count() == pairs.select("id").distinct().count()
    snapped = overlay.intersect(a, b, grid=0.01)
    assert total(snapped) == pytest.approx(total(pairs), rel=0.1)


def test_overlay_edge_cases(spark):
    a = shapes(spark, (1, "x", model.box(0, 0, 2, 2)), (2, "y", None), (3, "z", (model.POLYGON, [])), (4, "w", model.box(5, 5, 6, 6)))
    b = shapes(spark, (1, "q", model.box(2, 0, 3, 2)), (2, "r", model.box(1, 1, 3, 3))).select(F.col("id").alias("bid"), "geom")
    assert [(r["id"], r["bid"]) for r in overlay.intersect(a, b).select("id", "bid").collect()] == [(1, 2)]
    assert areas(overlay.erase(a, b, "id"), "id") == {1: 3, 4: 1}
    assert overlay.clip(a, b.limit(0), "id").count() == 0 and overlay.erase(a.limit(0), b, "id").count() == 0
    with pytest.raises(ValueError):
        layers.merge_fields(["a"], ["b"], "other")
    assert layers.merge_fields(["ID", "x"], ["id", "y"], "prefer2") == [("b", "id", "id"), ("b", "y", "y"), ("a", "x", "x")]


def test_wide_features_meet_at_coarser_levels(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(300):
        x, y = rng.uniform(0, 1000, 2)
        w, h = rng.choice([1.0, 5.0, 60.0, 900.0]), rng.choice([1.0, 5.0, 60.0, 900.0])
        rows.append((i, float(x), float(y), float(x + w), float(y + h)))
    df = spark.createDataFrame(rows, "id int, xmin double, ymin double, xmax double, ymax double")
    want = {(a[0], b[0]) for a in rows for b in rows if a[1] < b[3] and b[1] < a[3] and a[2] < b[4] and b[2] < a[4]}
    for size in (2.0, 30.0, None):
        got = [(r["a_id"], r["b_id"]) for r in overlay.envelope_pairs(df, df, size).select("a_id", "b_id").collect()]
        assert len(got) == len(want) and set(got) == want


def test_dissolve(spark):
    df = stars(spark, 900, 30, "g")
    out = dissolve.dissolve(df, ["name"], "id")
    assert {r["name"]: r["id"] for r in out.collect()} == {"g0": 0, "g1": 1, "g2": 2}
    again = dissolve.dissolve(out, ["name"], "id")
    assert areas(again, "name") == pytest.approx(areas(out, "name")) and areas(dissolve.dissolve_field(df, "name"), "name") == pytest.approx(areas(out, "name"))
    with pytest.raises(ValueError):
        dissolve.dissolve(df, ["none"], "id")
    assert dissolve.union_layer(df.limit(0)).count() == 0
    bow = shapes(spark, (1, "b", model.polygon([(0, 0), (2, 2), (2, 0), (0, 2), (0, 0)])))
    assert total(dissolve.dissolve(bow, ["name"], "id")) == 2


def test_self_overlap(spark):
    df = shapes(spark, (1, "a", model.box(0, 0, 2, 2)), (2, "b", model.box(1, 0, 3, 2)), (3, "c", model.box(10, 0, 11, 1)))
    out = sorted((r["id"], r["a"]) for r in dissolve.self_overlap(df, "id").select("id", G.area("geom").alias("a")).collect())
    assert out == [(1, 2), (1, 2), (2, 2), (3, 1)]


def test_donuts(spark):
    df = shapes(spark, *[(i, "n", model.box(i, i, 100 - i, 100 - i)) for i in range(4)], (9, "out", model.box(200, 0, 210, 10)))
    tree = {r["id"]: (r["parent"], r["level"]) for r in dissolve.containment(df, "id").collect()}
    assert tree == {0: (None, 0), 1: (0, 1), 2: (1, 2), 3: (2, 3), 9: (None, 0)}
    got = {r["id"]: r["a"] for r in dissolve.donuts(df, "id").select("id", G.area("geom").alias("a")).collect()}
    assert got == {0: 10000 - 98**2, 1: 98**2, 2: 96**2 - 94**2, 3: 94**2, 9: 100}
    ranks = {r["id"]: r["rank"] for r in dissolve.rank_by_area(df, "id").collect()}
    assert ranks == {0: 1, 1: 2, 2: 3, 3: 4, 9: 5}


def test_nulls_follow_the_engine(spark):
    df = spark.createDataFrame([(None, model.to_wkb(model.box(0, 0, 1, 1)))], "a binary, b binary")
    r = df.select(
        G.intersects("a", "b").alias("i"), G.disjoint("a", "b").alias("d"), G.distance("a", "b").alias("x"), G.area("a").alias("s"), G.is_empty("a").alias("e"),
        G.is_valid("a").alias("v"), G.union("a", "b").alias("u"), G.wkb_type(F.col("a")).alias("t"), G.geometry_type(F.col("b")).alias("k"),
    ).first()
    assert tuple(r) == (False, True, -1.0, 0.0, True, False, None, 0, "Polygon")
    assert df.select(G.is_valid_wkb(F.lit("01")).alias("v"), G.is_valid_wkb(F.lit("zz")).alias("w")).first()[:] == (False, False)
    assert df.select(G.remove_duplicate_points(F.col("b")).alias("c")).first()["c"] == df.first()["b"]


def test_sql_functions(spark):
    names = G.register_functions(spark)
    assert "geo_union_agg" in names
    r = spark.sql("select geo_area(geo_intersection(geo_box(0D,0D,2D,2D), geo_box(1D,1D,3D,3D))) a, geo_as_wkt(geo_centroid(geo_from_wkt('POLYGON ((0 0,2 0,2 2,0 2,0 0))'))) c").first()
    assert r["a"] == 1 and r["c"] == "POINT (1 1)"


def test_buffers(spark):
    df = spark.createDataFrame([(1, 2.0), (2, -1.0), (3, None)], "id int, d double").withColumn("geom", G.box(F.lit(0.0), F.lit(0.0), F.lit(4.0), F.lit(4.0)))
    kept = df.where("d > 0").withColumn("geom", G.buffer(F.col("geom"), F.col("d"), 8))
    assert total(kept) == pytest.approx(16 + 32 + 4 * 16 * math.sin(math.pi / 16), rel=1e-6)
    auto = df.limit(1).withColumn("geom", G.buffer_auto(F.col("geom"))).select(G.area("geom").alias("a")).first()["a"]
    assert auto > 16
    moved = df.limit(1).select(G.transform(G.transform(F.col("geom"), 4326, 3857), 3857, 4326).alias("g")).first()["g"]
    assert area(model.from_wkb(bytes(moved))) == pytest.approx(16, rel=1e-9)
    with pytest.raises(ValueError):
        G.transform(F.col("geom"), 4326, 9999)


def test_edits(spark):
    t = spark.createDataFrame([(1, 1.0, "a"), (2, 2.0, "b"), (3, 3.0, "c")], "OBJECTID int, v double, n string")
    assert layers.delete_by_id(t, 2).count == 1 and layers.delete_where(t, "v > 1").layer.count() == 1
    with pytest.raises(ValueError):
        layers.delete_where(t, "v > 99")
    s = spark.createDataFrame([(1, 10.0, 1), (1, 20.0, 2), (2, None, 1), (9, 5.0, 1)], "OBJECTID int, w double, o int")
    got = {r["OBJECTID"]: r["v"] for r in layers.sync_field(t, s, "OBJECTID", {"w": "v"}, order_by="o").collect()}
    assert got == {1: 20.0, 2: 2.0, 3: 3.0}
    assert {r["OBJECTID"]: r["v"] for r in layers.sync_field(t, s, "OBJECTID", {"w": "v"}, order_by="o", update_nulls=True).collect()} == {1: 20.0, 2: None, 3: 3.0}
    assert layers.sync_counts(t, s, "OBJECTID", "w").first()[:] == (1, 1, 1)
    assert layers.add_field(t, "k", "int", 7, 5).schema["k"].metadata == {"width": 5} and layers.ensure_object_id(t, ["n"]).columns == t.columns
    with pytest.raises(ValueError):
        layers.add_field(t, "V", "int")
    ids = layers.with_row_id(spark.range(1000).withColumn("k", F.col("id") * 7 % 1000), "n", ["k"]).select("k", "n").collect()
    assert all(r["n"] == r["k"] + 1 for r in ids)
    assert layers.map_fields(t, include=["n"], rename={"n": "m"}).columns == ["m"] and layers.unique_field_names(["a very long name", "a very long nose", "1x"]) == ["a_very_lon", "a_very_l_1", "f_1x"]
    assert layers.drop_fields_like(t, "OBJ").columns == ["v", "n"] and layers.append(t, t.drop("n")).count() == 6


def test_import(spark):
    df = shapes(spark, (1, "ok", model.box(0, 0, 1, 1)), (2, "none", None), (3, "bow", model.polygon([(0, 0), (2, 2), (2, 0), (0, 2), (0, 0)])), (4, "line", model.polygon([(0, 0), (1, 1), (0, 0), (0, 0)])), (5, "far", model.box(0, 90, 1, 91)))
    rows, counts = layers.import_layer(df, target_srid=3857)
    assert counts.first()[:] == (5, 2, 1, 2) and sorted(r["id"] for r in rows.collect()) == [1, 3]
    assert layers.import_layer(df, allow_null=True)[1].first()["inserted"] == 4
    out = layers.insert(df, df.where("id = 1").withColumn("more", F.lit(1)))
    assert out.count() == 6 and out.columns == df.columns
    with pytest.raises(ValueError):
        layers.insert(df, df.withColumn("more", F.lit(1)), strict=True)
    assert layers.count_valid(df).first()[:] == (2, 2)


# --- band language -------------------------------------------------------------------------------------------


def evaluate(node, v):
    """The language's rules in Python."""
    nan = math.nan
    a = [evaluate(x, v) for x in node.args]
    truth = lambda x: math.isnan(x) or x != 0
    if node.op == "number":
        return node.value
    if node.op == "band":
        return v[node.value - 1]
    if node.op == "/":
        return nan if a[1] == 0 else a[0] / a[1]
    if node.op in ("&&", "||"):
        return float(truth(a[0]) and truth(a[1]) if node.op == "&&" else truth(a[0]) or truth(a[1]))
    if node.op in (">", ">=", "<", "<=", "==", "!="):
        return float({">": a[0] > a[1], ">=": a[0] >= a[1], "<": a[0] < a[1], "<=": a[0] <= a[1], "==": a[0] == a[1], "!=": a[0] != a[1]}[node.op])
    if node.op in ("min", "max"):
        return a[1] if math.isnan(a[0]) else a[0] if math.isnan(a[1]) else {"min": min, "max": max}[node.op](*a)
    if node.op == "neg":
        return -a[0]
    if node.op == "abs":
        return abs(a[0])
    return {"+": lambda: a[0] + a[1], "-": lambda: a[0] - a[1], "*": lambda: a[0] * a[1]}[node.op]()


def test_band_language(spark):
    rng = np.random.default_rng(2)
    texts = []

    def grow(depth):
        if depth == 0 or rng.random() < 0.2:
            return rng.choice(["b1", "B2", "band3", "0", "1.5", "2e1", ".5"])
        k = rng.integers(0, 5)
        if k == 0:
            return f"-{grow(depth - 1)}"
        if k == 1:
            return f"{rng.choice(['min', 'MAX'])}({grow(depth - 1)}, {grow(depth - 1)})"
        if k == 2:
            return f"abs({grow(depth - 1)})"
        return f"({grow(depth - 1)} {rng.choice(['+', '-', '*', '/', '>', '>=', '<', '<=', '==', '!=', '&&', '||'])} {grow(depth - 1)})"

    texts = [grow(4) for _ in range(60)]
    rows = [(0.0, 1.0, math.nan), (2.5, -3.0, 0.0), (math.nan, math.nan, 1.0), (0.5, 0.5, 7.0)]
    df = spark.createDataFrame(rows, "b1 double, b2 double, b3 double")
    cols = {n: F.col(f"b{n}") for n in (1, 2, 3)}
    out = df.select(*[B.compile_expression(t, cols).cast("double").alias(f"c{i}") for i, t in enumerate(texts)]).collect()
    for i, t in enumerate(texts):
        tree = B.Parser(t).parse()
        for r, v in zip(out, rows):
            want, got = evaluate(tree, v), r[f"c{i}"]
            assert got == pytest.approx(want, nan_ok=True), (t, v)


def test_band_grammar(spark):
    df = spark.createDataFrame([(2.0, 3.0)], "b1 double, b2 double")
    cols = {1: F.col("b1"), 2: F.col("b2")}
    for text, want in (("-b1^2", 4), ("2^3^2", 512), ("1 - 2 - 3", -4), ("8/2/2", 2), ("1 < 2 < 3", 1), ("3 > 2 > 1", 0), ("log(0)", -math.inf), ("ln(-1)", math.nan), ("round(-2.5)", -3),
                       ("round(0.5)", 1), ("ceil(1.2)+floor(-1.2)", 0), ("log10(1000)", 3), ("b1/0", math.nan), ("pow(b1,b2)", 8), ("sqrt(-1)", math.nan), ("sin(0)+cos(0)+tan(0)+exp(0)", 2)):
        assert df.select(B.compile_expression(text, cols).alias("v")).first()["v"] == pytest.approx(want, nan_ok=True), text
    for text in ("b1 +", "b1 % 2", "!b1", "b1 = 2", "sqrt(b1, b2)", "min(b1)", "foo(b1)", "b1 b2", "", "(b1", "b0", "b1 & b2"):
        assert not B.is_valid_expression(text), text
    with pytest.raises(ValueError):
        B.compile_expression("b7", cols)
    good, bad = B.calculate_batch(["b1+1", "b9", "b1+"], cols)
    assert list(good) == ["b1+1"] and set(bad) == {"b9", "b1+"}
    assert not B.is_valid_expression("+".join(f"b{i}" for i in range(1, 34))) and B.is_valid_expression("+".join(f"b{i}" for i in range(1, 33)))


def test_index_nans(spark):
    df = spark.createDataFrame([(1.0, -1.0), (math.nan, 1.0), (1.0, 0.0)], "a double, b double")
    a, b = F.col("a"), F.col("b")
    got = df.select(B.ndvi(a, b).alias("n"), B.lai(a, b).alias("l"), B.band_math(a, b, "min").alias("m"), B.band_scalar(a, 0.0, "div").alias("d"), B.band_scalar(a, 9, "max").alias("k"), B.reclassify(a, [B.Rule(0, 2, 5)], 0).alias("r")).collect()
    assert math.isnan(got[0]["n"]) and got[0]["l"] == 6 and got[2]["l"] == 6 and math.isnan(got[1]["m"]) and math.isnan(got[0]["d"]) and got[0]["k"] == 1 and math.isnan(got[1]["r"]) and got[0]["r"] == 5


# --- rasters -------------------------------------------------------------------------------------------------


def grid(spark, a, **more):
    rows = [(y, x, float(a[y, x])) for y in range(a.shape[0]) for x in range(a.shape[1])]
    df = spark.createDataFrame(rows, "y int, x int, v double")
    for k, v in more.items():
        df = df.withColumn(k, F.lit(v))
    return df


def array(df, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r["y"], r["x"]] = r["v"]
    return out


def test_focal_blocks_agree(spark):
    rng = np.random.default_rng(3)
    a = rng.random((40, 50))
    a[rng.random(a.shape) < 0.1] = np.nan
    df = grid(spark, a)
    for kind in R.FILTERS:
        one, two = array(R.apply_filter(df, kind, 5), a.shape), array(R.apply_filter(df, kind, 5, block=16), a.shape)
        assert np.allclose(one, two, equal_nan=True), kind
        assert np.array_equal(one[:2], a[:2], equal_nan=True)
    w = a[8:13, 20:25]
    assert array(R.apply_filter(df, "median", 5), a.shape)[10, 22] == pytest.approx(np.nanmedian(w)) and array(R.apply_filter(df, "max", 5), a.shape)[10, 22] == np.nanmax(w)
    for bad in (("mean", 4), ("sobel", 1), ("none", 3)):
        with pytest.raises(ValueError):
            R.apply_filter(df, *bad)


@pytest.mark.parametrize("method", ["bilinear", "cubic", "cubicspline", "lanczos"])
def test_resampling(spark, method):
    y, x = np.mgrid[0:16, 0:20]
    plane = 2.0 * x + 3.0 * y + 1
    up = array(R.resample(grid(spark, plane), 20, 16, 40, 32, method), (32, 40))
    want = 2 * ((np.arange(40) + 0.5) / 2 - 0.5) + 3 * ((np.arange(32) + 0.5) / 2 - 0.5)[:, None] + 1
    assert np.allclose(up[8:-8, 8:-8], want[8:-8, 8:-8], atol=0.2 if method == "lanczos" else 1e-9)
    flat = array(R.resample(grid(spark, np.full((16, 20), 7.0)), 20, 16, 7, 5, method), (5, 7))
    assert np.allclose(flat, 7)
    assert R.resampled_size(100, 50, factor=0.333) == (33, 16) and R.resampled_size(10, 10, size=(3, 4), factor=9) == (3, 4) and R.resampled_size(10, 10, resolution=(20, 20)) == (1, 1)
    with pytest.raises(ValueError):
        R.resampled_size(1, 1)


def test_statistics_and_overviews(spark):
    a = np.array([[1.0, np.nan, 3.0, 4.0], [5.0, 6.0, -1.0, 8.0]])
    s = R.statistics(grid(spark, a), nodata=-1.0).first()
    assert (s["min"], s["max"], s["n"]) == (1, 8, 6) and s["stddev"] == pytest.approx(np.std([1, 3, 4, 5, 6, 8]))
    assert array(R.overview(grid(spark, a), 2), (1, 2)).tolist() == [[4.0, 3.5]] and R.overview_levels(2048, 1024) == [2, 4] and R.overview_levels(100, 100) == [2]
    n = array(R.normalize(grid(spark, a), 0, 1), a.shape)
    assert n[0, 0] == pytest.approx(2 / 9) and math.isnan(n[0, 1]) and array(R.normalize(grid(spark, np.ones((2, 2))), 0, 9), (2, 2)).tolist() == [[1, 1], [1, 1]]
    assert [r["n"] for r in R.histogram(grid(spark, a), "v", 0, 8, 4).orderBy("bin").collect()] == [1, 1, 2, 2]


def test_mosaic_and_palette(spark):
    rows = [(0, 1, 0, 0, 5.0), (1, 1, 0, 0, -9999.0), (0, 1, 0, 1, 1.0), (1, 1, 0, 1, 2.0), (1, 1, 0, 2, math.nan)]
    df = spark.createDataFrame(rows, "raster int, band int, y int, x int, v double")
    assert {(r["x"]): r["v"] for r in R.mosaic(df, nodata=-9999.0).collect()} == {0: 5.0, 1: 2.0}
    assert {(r["x"]): r["v"] for r in R.mosaic_priority(df, {0: 2, 1: 1}, -9999.0).collect()} == {0: 5.0, 1: 1.0}
    heads = spark.createDataFrame([(0.0, 10.0, 10.0, 0.0, 1.0, 1.0, 3), (5.0, 12.0, 15.5, 2.0, 0.5, 0.5, 3)], "left double, top double, right double, bottom double, res_x double, res_y double, bands int")
    m = R.mosaic_info(heads).first()
    assert (m["width"], m["height"], m["same_bands"]) == (31, 24, True)
    px = spark.createDataFrame([(0, x, 10 * (x % 3), 0, 200) for x in range(9)] + [(1, 0, 255, 255, 255)], "y int, x int, r int, g int, b int")
    assert R.rgb_to_palette(px, 3).select("v").distinct().count() == 3
    ramp = R.ramp_palette(spark, [(0, 0, 0), (255, 255, 255)])
    back = R.palette_to_rgba(spark.createDataFrame([(0, 0, 128.0)], "y int, x int, v double"), ramp).first()
    assert back[:] == (0, 0, 128, 128, 128, 255)
    with pytest.raises(ValueError):
        R.top_colors(px, 0)


def test_balance_dispatch(spark):
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 256, (12, 12)).astype(float), rng.integers(60, 200, (12, 12)).astype(float)
    p, q = grid(spark, a, band=1), grid(spark, b, band=1)
    for m in R.METHODS:
        out = R.color_balance(p, q, m, overlap=(0, 0, 12, 12))
        v = array(out, a.shape)
        assert v.min() >= 0 and v.max() <= 255 and (v == np.floor(v)).all(), m
    assert array(R.moment_match(p, q), a.shape).mean() == pytest.approx(b.mean(), abs=3)
    assert R.smart_balance(p, q).count() == 144
    for bad in (("histogram", None), ("regression", q), ("none", q)):
        with pytest.raises(ValueError):
            R.color_balance(p, bad[1], bad[0])


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 255), st.integers(0, 255)), min_size=2, max_size=6, unique_by=lambda p: p[0]))
def test_curves_pass_their_points(points):
    table = colors.curve_table(points)
    assert len(table) == 256 and all(abs(table[x] - y) <= 1 for x, y in points) and all(0 <= v <= 255 for v in table)


def test_tables():
    assert colors.curve_table([(0, 0)]) == list(range(256)) and colors.levels_table() == list(range(256)) and colors.gamma_table(1.0) == list(range(256))
    s = colors.curve_table(colors.s_curve_points(1.0))
    assert s[0] == 0 and s[255] == 255 and s[64] == 32 and s[192] == 224


def test_tiler(spark):
    with pytest.raises(ValueError):
        R.tiler(spark, 10, 10, 5, 5, 5, 0)
    rows = R.tiler(spark, 130, 100, 50, 50, start=3).collect()
    assert [(r["index"], r["row"], r["col"], r["width"], r["height"]) for r in rows] == [(3, 0, 0, 50, 50), (4, 0, 1, 50, 50), (5, 0, 2, 30, 50), (6, 1, 0, 50, 50), (7, 1, 1, 50, 50), (8, 1, 2, 30, 50)]


# --- streams -------------------------------------------------------------------------------------------------


def test_streams(spark, sf, tmp_path):
    from geoloom.plans.base import points

    static = points(spark, sf)
    src = tmp_path / "in"
    static.repartition(3).write.parquet(str(src))
    stream = spark.readStream.schema(static.schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    q = tile_counts(stream, "1 hour", 3, watermark="60 days").writeStream.format("memory").queryName("tiles").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.sql("select * from tiles").collect()} == {tuple(r) for r in tile_counts(static, "1 hour", 3).collect()}
    zones = spark.createDataFrame([(1, -90.0, -40.0, 10.0, 40.0), (2, 0.0, 0.0, 90.0, 80.0)], "id int, xmin double, ymin double, xmax double, ymax double")
    moved = stream.select("event_id", F.col("lon").alias("x"), F.col("lat").alias("y"))
    q = overlay_stream(moved, zones, 30.0).select("event_id", "z_id").writeStream.format("memory").queryName("hits").start()
    q.processAllAvailable()
    q.stop()
    want = static.where("lon >= -90 and lon < 10 and lat >= -40 and lat < 40").count() + static.where("lon >= 0 and lon < 90 and lat >= 0 and lat < 80").count()
    assert spark.sql("select * from hits").count() == want > 0


# --- rasters and polygons, bands, canvases, table functions --------------------------------------------------


def test_raster_geometry(spark):
    from geoloom.operators import raster_geometry as RG
    from geoloom.sources import codecs

    px = grid(spark, np.arange(100.0).reshape(10, 10), band=1)
    layer = shapes(spark, (1, "tri", model.polygon([(0, 0), (10, 0), (0, 10), (0, 0)])), (2, "ring", model.polygon([(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)], [(2, 2), (8, 2), (8, 8), (2, 8), (2, 2)])))
    counts = {r["id"]: r["n"] for r in RG.clip_by_features(px, layer, "id").groupBy("id").agg(F.count("*").alias("n")).collect()}
    assert counts[2] == 64 and counts[1] in (45, 55)
    world = RG.clip_by_features(px, shapes(spark, (1, "w", model.box(100, 80, 104, 90))), "id", (100.0, 1.0, 0.0, 90.0, 0.0, -1.0))
    assert sorted((r["y"], r["x"]) for r in world.collect()) == [(y, x) for y in range(10) for x in range(4)]
    gt = (0.0, 0.01, 0.0, 0.1, 0.0, -0.01)
    k = 111319.49079327358
    back = RG.reproject(px, gt, 4326, 3857, (0.0, 0.01 * k, 0.0, 0.1 * k, 0.0, -0.01 * k), 10, 10)
    assert array(back, (10, 10)).tolist() == np.arange(100.0).reshape(10, 10).tolist()
    assert RG.transformed_geotransform((0, 1, 0, 0, 0, -1), 5, 6, 2, 90)[:1] == (5,)
    two = RG.add_band(px, 2, F.col("v") * 2)
    assert [r["v"] for r in RG.pick_bands(two, [2]).where("y = 0 and x = 3").collect()] == [6.0] and RG.remove_band(two, 1).agg(F.max("band")).first()[0] == 1
    with pytest.raises(ValueError):
        RG.pick_bands(px, [])
    head = spark.createDataFrame([(1,)], "width int")
    meta = RG.set_band_metadata(RG.set_band_metadata(head, 1, unit="m", scale="2"), 1, unit="km").first()["band_metadata"]
    assert meta == {"1.unit": "km", "1.scale": "2"}
    tile = codecs.write_png(np.full((4, 4, 3), 9, np.uint8))
    out = RG.paste(spark.createDataFrame([("c", tile, 2, 3), ("c", tile, -2, -2)], "raster string, tile binary, x int, y int"), 8, 8).first()["content"]
    img = codecs.read_png(bytes(out))
    assert img[3, 2].tolist() == [9, 9, 9, 255] and img[1, 1].tolist() == [9, 9, 9, 255] and img[7, 7].tolist() == [0, 0, 0, 0]
    done = RG.ColorPipeline(px).then(R.apply_filter, "mean", 4).then(R.overview, 2)
    with pytest.raises(ValueError):
        done.result()
    assert RG.ColorPipeline(px).then(R.overview, 2).result().count() == 25
    assert RG.balance_many({"a": px}, px, "regression") == {"a": None}


def test_session_helpers(spark):
    from geoloom import session
    from geoloom.functions.tables import register_table_functions

    register_table_functions(spark)
    assert spark.sql("select count(*) n from geo_cells(0D, 0D, 25D, 15D, 10D)").first()["n"] == 6
    G.register_functions(spark)
    assert spark.sql("select count(*) n from raster_tiles(100, 50, 32)").first()["n"] == 8
    df, o = session.counted(spark.range(7))
    df.collect()
    assert o.get["n"] == 7
    with session.cancellable(spark, "t"):
        assert "t" in spark.sparkContext.getJobTags()
    session.progress(spark, lambda done, total: None)


def test_constructors_and_map(spark):
    df = spark.createDataFrame([([[0.0, 0.0], [1.0, 1.0]], [[[0.0, 0.0], [2.0, 0.0], [2.0, 2.0]]])], "l array<array<double>>, p array<array<array<double>>>")
    r = df.select(G.as_wkt(G.make_line("l")).alias("l"), G.area(G.make_polygon("p")).alias("a")).first()
    assert r["l"] == "LINESTRING (0 0,1 1)" and r["a"] == 2
    out = layers.map_features(shapes(spark, (1, "a", None), (2, "b", None)), lambda f: {"k": f["id"] * 10} if f["id"] > 1 else None, "k int")
    assert [x["k"] for x in out.collect()] == [20]
