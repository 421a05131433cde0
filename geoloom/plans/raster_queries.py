"""Queries of the raster, band and tile operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bands as B
from ..functions import colors, tiles
from ..operators import raster as R
from .base import B_SQL, H_SQL, LONG_SQL, P_SQL, PT_SQL, R_SQL, RGB_SQL, bands, heights, parcels, points, query, raster, rgb

KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
K = ", ".join(KEYS)
DIV = "case when ({d}) = 0 then null else ({n}) / ({d}) end"


def clean(c, digits: int = 6):
    """Rounded, NaN as null."""
    return F.when(F.isnan(c) | c.isNull(), F.lit(None).cast("double")).otherwise(F.round(c, digits))


def _band(name: str, column, sql: str) -> None:
    @query(f"with {B_SQL} select {K}, round({sql}, 6) v from b", name)
    def run(spark, sf_dir):
        return bands(spark, sf_dir).select(*KEYS, clean(column()).alias("v"))


def _expr(name: str, text: str, sql: str, condition: str | None = None) -> None:
    _band(name, lambda: B.calculate(text, {n: F.col(f"b{n}") for n in range(1, 5)}, condition, -9999.0), sql)


_expr("band_expr_basic", "(B1 - band2) / (b1 + b2) * 2 ^ 2 - -1", f"({DIV.format(n='b1 - b2', d='b1 + b2')}) * 4 + 1")
_expr("band_expr_logic", "(b1 > 25 && b3 < 0.05) || b4 == 0", "cast(((b1 > 25 and b3 < 0.05) or b4 = 0) as integer)::double")
_expr("band_expr_functions", "sqrt(abs(b1 - 20)) + min(b1, b2) - max(b3, b4) * pow(b1, 2) + floor(b2) - ceil(b2) + round(b2)", "sqrt(abs(b1 - 20)) + least(b1, b2) - greatest(b3, b4) * b1 * b1 + floor(b2) - ceil(b2) + floor(b2 + 0.5)")
_expr("band_expr_condition", "b2 / b3", f"case when b1 > 10 then {DIV.format(n='b2', d='b3')} else -9999 end", "b1 > 10")
_expr("band_expr_chain", "0 < b3 < 2", "cast((cast(0 < b3 as integer) < 2) as integer)::double")
for _op, _sql in (("add", "b1 + b2"), ("sub", "b1 - b2"), ("mul", "b1 * b3"), ("div", DIV.format(n="b1", d="b3")), ("min", "least(b1, b2)"), ("max", "greatest(b1, b2)")):
    _b = "b3" if _op in ("mul", "div") else "b2"
    _band(f"band_math_{_op}", lambda o=_op, b=_b: B.band_math(F.col("b1"), F.col(b), o), _sql)
_band("band_scalar", lambda: B.band_scalar(B.band_scalar(F.col("b1"), 3.0, "mul"), 4.0, "div"), "b1 * 3 / 4")
RULES = [B.Rule(0, 10, 1), B.Rule(10, 25, 2), B.Rule(25, 40, 3)]
_band("reclassify", lambda: B.reclassify(F.col("b1"), RULES, 9.0), "case when b1 >= 0 and b1 < 10 then 1 when b1 >= 10 and b1 < 25 then 2 when b1 >= 25 and b1 < 40 then 3 else 9 end::double")
_band("conditional_replace", lambda: B.conditional_replace(F.col("b1"), [B.Rule(5, 10, -1, False, True), B.Rule(0, 20, -2)]), "case when b1 > 5 and b1 <= 10 then -1 when b1 >= 0 and b1 < 20 then -2 else b1 end")
_band("mask_threshold", lambda: B.mask(F.col("b2"), B.threshold_mask(F.col("b1"), 10, 30), -9999.0), "case when b1 between 10 and 30 then b2 else -9999 end")
_band("nodata_mask", lambda: F.when(B.nodata_mask(F.col("b3"), 0.0), 1.0).otherwise(0.0), "case when b3 <> 0 then 1.0 else 0.0 end::double")
ND = "case when ({a} + {b}) = 0 then null else ({a} - {b}) / ({a} + {b}) end"
for _name, _f, _a, _b in (("ndvi", B.ndvi, "b4", "b3"), ("ndwi", B.ndwi, "b2", "b4"), ("mndwi", B.mndwi, "b2", "b3"), ("ndbi", B.ndbi, "b3", "b4"), ("ndsi", B.ndsi, "b1", "b3")):
    _band(_name, lambda f=_f, a=_a, b=_b: f(F.col(a), F.col(b)), ND.format(a=_a, b=_b))
_band("evi", lambda: B.evi(F.col("b4"), F.col("b3"), F.col("b1")), "2.5 * (b4 - b3) / (b4 + 6 * b3 - 7.5 * b1 + 1)")
_band("savi", lambda: B.savi(F.col("b4"), F.col("b3"), 0.5), "(b4 - b3) / (b4 + b3 + 0.5) * 1.5")
_band("lai", lambda: B.lai(F.col("b2"), F.col("b1")), "(select case when v is null then 6.0 when v >= 0.69 then 6.0 when v <= 0.1 then 0.0 else -ln((0.69 - v) / 0.59) / 0.91 end from (select " + ND.format(a="b2", b="b1") + " v))")


@query(f"with {R_SQL}, s as (select min(v) lo, max(v) hi from r) select y, x, round((v - lo) / (hi - lo) * 255, 6) v from r, s")
def normalize(spark, sf_dir):
    return R.normalize(raster(spark, sf_dir), 0.0, 255.0).select("y", "x", clean(F.col("v")).alias("v"))


@query(f"with {R_SQL} select x, round(min(v), 9) \"min\", round(max(v), 9) \"max\", round(avg(v), 9) mean, round(stddev_pop(v), 9) stddev, count(*) n from r group by x")
def band_stats(spark, sf_dir):
    s = R.statistics(raster(spark, sf_dir), by=("x",))
    return s.select("x", *[F.round(c, 9).alias(c) for c in ("min", "max", "mean", "stddev")], "n")


@query(f"with {R_SQL}, h as (select least(floor((v + 0.5) / (1.0 / 32)), 31) bin, count(*) n from r where v between -0.5 and 0.5 group by 1) select cast(i as integer) bin, coalesce(n, 0) n from range(32) t(i) left join h on bin = i")
def histogram_dense(spark, sf_dir):
    return R.histogram(raster(spark, sf_dir), "v", -0.5, 0.5, 32)


HIST = "hist as (select band, cast(v as integer) bin, count(*) n from l group by 1, 2)"
CDF = HIST + ", c as (select band, bin, n, sum(n) over (partition by band order by bin) cdf, sum(n) over (partition by band) total from hist)"


@query(f"with {LONG_SQL}, {CDF} select band, bin, round(cdf / total, 9) share from c")
def cdf(spark, sf_dir):
    c = R.cumulative(R.byte_histogram(long_rgb(spark, sf_dir)))
    return c.select("band", "bin", F.round("share", 9).alias("share"))


def long_rgb(spark, sf_dir):
    return R.melt(rgb(spark, sf_dir), ["b1", "b2", "b3"])


@query(f"with {RGB_SQL} select " + ", ".join(f"round(avg(b{i}), 6) mean_{c}, round(stddev_pop(b{i}), 6) std_{c}, min(b{i})::double min_{c}, max(b{i})::double max_{c}" for i, c in ((1, "r"), (2, "g"), (3, "b"))) + " from g")
def color_stats(spark, sf_dir):
    s = R.color_statistics(rgb(spark, sf_dir))
    return s.select(*[F.round(c, 6).alias(c) if c[:3] in ("mea", "std") else c for c in s.columns])


def _focal(kind: str, sql: str, size: int = 3) -> None:
    half = size // 2

    @query(
        f"with {R_SQL}, m as (select max(y) h, max(x) w from r), k as (select a.y, a.x, a.v own, b.v, b.y - a.y dy, b.x - a.x dx from r a join r b on b.y between a.y - {half} and a.y + {half} and b.x between a.x - {half} and a.x + {half}) "
        f"select y, x, round(case when y >= {half} and x >= {half} and y <= h - {half} and x <= w - {half} then f else own end, 6) + 0.0 v from (select y, x, any_value(own) own, {sql} f from k group by y, x), m",
        f"focal_{kind}",
    )
    def run(spark, sf_dir):
        return R.apply_filter(raster(spark, sf_dir), kind, size).select("y", "x", (F.round("v", 6) + F.lit(0.0)).alias("v"))  # no negative zero


_focal("mean", "avg(v)")
_focal("median", "median(v)")
_focal("min", "min(v)")
_focal("max", "max(v)")
_focal("gaussian", "sum(v * exp(-(dx * dx + dy * dy) / 0.5)) / sum(exp(-(dx * dx + dy * dy) / 0.5))")
_focal("sobel", "sqrt(pow(sum(v * dx * (2 - abs(dy))), 2) + pow(sum(v * dy * (2 - abs(dx))), 2))")
_focal("laplace", "sum(case when abs(dx) + abs(dy) = 1 then v when dx = 0 and dy = 0 then -4 * v else 0 end)")


def _lut(name: str, spark_lut, sql: str) -> None:
    @query(f"with {LONG_SQL}, {CDF}, {sql} select l.band, l.y, l.x, cast(lut.o as double) v from l join lut on lut.band = l.band and lut.bin = cast(l.v as integer)", name)
    def run(spark, sf_dir):
        p = long_rgb(spark, sf_dir)
        return R.apply_lut(p, spark_lut(p)).select("band", "y", "x", "v")


ENDS = """ends as (select band, coalesce(min(bin) filter (cdf > floor(total * {p} / 100)), 0) lo, coalesce(max(bin) filter (total - cdf + n > floor(total * {p} / 100)), 255) hi from c group by band),
 e2 as (select band, lo, case when hi <= lo then lo + 1 else hi end hi from ends),
 lut as (select c.band, bin, case when bin <= lo then 0 when bin >= hi then 255 else floor((bin - lo) * (255.0::double / (hi - lo))) end o from c join e2 on e2.band = c.band)"""
_lut("auto_levels", lambda p: R.auto_levels_lut(p, 2.0), ENDS.format(p="2.0"))
_lut("auto_contrast", lambda p: R.auto_levels_lut(p, 0.5), ENDS.format(p="0.5"))
_lut("hist_equalize", R.equalize_lut, "q as (select *, min(cdf) over (partition by band) m from c), lut as (select band, bin, case when cdf <= m then 0 else floor(least(greatest((cdf - m) * (255.0::double / (total - m)), 0), 255)) end o from q)")
REF = """rl as (select band, 19 - x x, y, cast((v * 7 + 31) as integer) % 256 v from l), rh as (select band, v bin, count(*) n from rl group by 1, 2),
 rd as (select b.band, cast(i as integer) bin, coalesce(n, 0) n from (values (1), (2), (3)) b(band), range(256) t(i) left join rh on rh.band = b.band and rh.bin = i),
 rc as (select band, bin, sum(n) over (partition by band order by bin) / sum(n) over (partition by band) share from rd)"""


def _reference(p):
    return p.select("band", "y", (F.lit(19) - F.col("x")).alias("x"), ((F.col("v") * 7 + 31) % 256).alias("v"))


_lut("hist_match", lambda p: R.match_lut(p, _reference(p)), REF + ", lut as (select c.band, c.bin, (select arg_min(rc.bin, (abs(c.cdf / c.total - rc.share), rc.bin)) from rc where rc.band = c.band) o from c)")


def _rgb(name: str, f, sql: str) -> None:
    @query(f"with {RGB_SQL} {sql}", name)
    def run(spark, sf_dir):
        return f(rgb(spark, sf_dir))


def _triple(cols, names=("r", "g", "b"), digits: int | None = None):
    return [(F.round(c, digits) if digits else c).alias(n) for c, n in zip(cols, names, strict=True)]


C3 = ("b1", "b2", "b3")
HUE = """m as (select y, x, b1 / 255.0::double r, b2 / 255.0::double g, b3 / 255.0::double b, greatest(b1, b2, b3) / 255.0::double hi, least(b1, b2, b3) / 255.0::double lo from g),
 d as (select *, hi - lo dl from m), hh as (select *, case when dl = 0 then 0 when hi = r then 60 * ((((g - b) / dl) + 6) % 6) when hi = g then 60 * ((b - r) / dl + 2) else 60 * ((r - g) / dl + 4) end h from d)"""
_rgb("rgb_to_hsl", lambda p: p.select("y", "x", *_triple(colors.rgb_to_hsl(*map(F.col, C3)), ("h", "s", "l"), 6)), ", " + HUE + " select y, x, round(h, 6) h, round(case when dl = 0 then 0 when (hi + lo) / 2 > 0.5 then dl / (2 - hi - lo) else dl / (hi + lo) end, 6) s, round((hi + lo) / 2, 6) l from hh")
_rgb("rgb_to_hsv", lambda p: p.select("y", "x", *_triple(colors.rgb_to_hsv(*map(F.col, C3)), ("h", "s", "v"), 6)), ", " + HUE + " select y, x, round(h, 6) h, round(case when hi = 0 then 0 else dl / hi end, 6) s, round(hi, 6) v from hh")
_rgb("hsl_round_trip", lambda p: p.select("y", "x", *_triple([F.round(c, 4) for c in colors.hsl_to_rgb(*colors.rgb_to_hsl(*map(F.col, C3)))])), "select y, x, b1::double r, b2::double g, b3::double b from g")
BYTE = "cast(floor(least(greatest({v}, 0), 255)) as integer)"
_rgb("adjust_colors", lambda p: p.select("y", "x", *_triple(colors.adjust(*map(F.col, C3), colors.Adjust(brightness=0.1, contrast=0.25)))), "select y, x, " + ", ".join(BYTE.format(v=f"(b{i} + 0.1::double * 255 - 128) * 1.5::double + 128") + f" {c}" for i, c in ((1, "r"), (2, "g"), (3, "b"))) + " from g")
_rgb("adjust_gamma", lambda p: p.select("y", "x", *_triple(colors.adjust(*map(F.col, C3), colors.Adjust(gamma=2.0)))), "select y, x, " + ", ".join(BYTE.format(v=f"sqrt(b{i} / 255.0::double) * 255") + f" {c}" for i, c in ((1, "r"), (2, "g"), (3, "b"))) + " from g")
_rgb("preset_black_white", lambda p: p.select("y", "x", *_triple(colors.preset("black_white", *map(F.col, C3)))), ", k as (select y, x, " + ", ".join(f"least(greatest((b{i} - 128) * 1.2::double + 128, 0), 255) c{i}" for i in (1, 2, 3)) + " from g) select y, x, " + ", ".join(BYTE.format(v="(greatest(c1 / 255, c2 / 255, c3 / 255) + least(c1 / 255, c2 / 255, c3 / 255)) / 2.0::double * 255") + f" {c}" for c in "rgb") + " from k")
_rgb("levels_lut", lambda p: p.select("y", "x", colors.lookup(colors.levels_table(20, 220, 1.0, 10, 240), F.col("b1")).alias("v")), "select y, x, " + BYTE.format(v="10 + (case when b1 <= 20 then 0 when b1 >= 220 then 1 else (b1 - 20) / 200.0::double end) * 230.0::double") + " v from g")
_rgb("curve_two_points", lambda p: p.select("y", "x", colors.lookup(colors.curve_table([(0, 255), (255, 0)]), F.col("b1")).alias("v")), "select y, x, case when b1 = 0 then 255 when b1 = 255 then 0 else " + BYTE.format(v="255 + t * (-127.5 + t * (3 * -255 + 2 * 127.5 + 127.5 + t * (-127.5 - 127.5 + 2 * 255)))") + " end v from (select *, b1 / 255.0::double t from g)")
_rgb("white_balance", lambda p: R.white_balance(p), ", a as (select avg(b1) r, avg(b2) g, avg(b3) b from g) select y, x, " + ", ".join(BYTE.format(v=f"b{i} * ((a.r + a.g + a.b) / 3 / a.{c})") + f" b{i}" for i, c in ((1, "r"), (2, "g"), (3, "b"))) + " from g, a")
_rgb("palette_topn", lambda p: R.top_colors(p.select(F.col("b1").alias("r"), F.col("b2").alias("g"), F.col("b3").alias("b")), 16), ", k as (select (b1 >> 2) * 4096 + (b2 >> 2) * 64 + (b3 >> 2) code, count(*) n from g group by 1 order by n desc, code limit 16) select cast(row_number() over (order by n desc, code) - 1 as integer) idx, cast((code >> 12) * 4 as integer) r, cast(((code >> 6) & 63) * 4 as integer) g, cast((code & 63) * 4 as integer) b, n from k")


STATS = "s as (select band, avg(v) m, stddev_pop(v) sd from l group by band)"


@query(f"with {LONG_SQL}, {REF}, {STATS}, t as (select band, avg(v) m, stddev_pop(v) sd from rl group by band), k as (select s.band, 1 + (t.sd / s.sd - 1) * 0.6 a, s.m sm, t.m tm from s join t on t.band = s.band) select l.band, y, x, floor(least(greatest(v * a + (tm - sm * a) * 0.6, 0), 255)) v from l join k on k.band = l.band")
def mean_std_match(spark, sf_dir):
    p = long_rgb(spark, sf_dir)
    return R.mean_std_match(p, R.statistics(_reference(p), by=("band",)), 0.6).select("band", "y", "x", "v")


@query(f"with {LONG_SQL}, {REF}, j as (select l.band, l.v x, r.v y from l join rl r on r.band = l.band and r.y = l.y and r.x = l.x where l.x < 15 and l.y < 60 and l.v <> 0 and r.v <> 0), f as (select band, least(greatest(regr_slope(y, x), 0.5), 2) a, least(greatest(regr_intercept(y, x), -50), 50) b from j group by band) select l.band, y, x, floor(least(greatest(v * a + b, 0), 255)) v from l join f on f.band = l.band")
def linear_regression_balance(spark, sf_dir):
    p = long_rgb(spark, sf_dir)
    return R.regression_balance(p, _reference(p), 0, 0, 15, 60).select("band", "y", "x", "v")


FOUR = """w as (select l.*, x / {n}.0::double - 0.5 fx, y / {n}.0::double - 0.5 fy, (select floor(max(x) / {n}.0) from l) nx, (select floor(max(y) / {n}.0) from l) ny from l),
 q as (select *, least(greatest(floor(fx), 0), nx) x0, least(greatest(floor(fx) + 1, 0), nx) x1, least(greatest(floor(fy), 0), ny) y0, least(greatest(floor(fy) + 1, 0), ny) y1,
 case when fx < 0 then 0 else fx - floor(fx) end wx, case when fy < 0 then 0 else fy - floor(fy) end wy from w)"""


@query(f"with {LONG_SQL}, m as (select band, floor(y / 8.0) ty, floor(x / 8.0) tx, avg(v) m from l group by 1, 2, 3), a as (select band, avg(v) a from l group by 1), " + FOUR.format(n=8) + """
 select q.band, q.y, q.x, floor(least(greatest(q.v + (a.a - ((m0.m * (1 - wx) + m1.m * wx) * (1 - wy) + (m2.m * (1 - wx) + m3.m * wx) * wy)) * 0.5, 0), 255)) v from q join a on a.band = q.band
 join m m0 on m0.band = q.band and m0.ty = y0 and m0.tx = x0 join m m1 on m1.band = q.band and m1.ty = y0 and m1.tx = x1 join m m2 on m2.band = q.band and m2.ty = y1 and m2.tx = x0 join m m3 on m3.band = q.band and m3.ty = y1 and m3.tx = x1""")
def dodging(spark, sf_dir):
    return R.dodging(long_rgb(spark, sf_dir), 8, 0.5)


@query(f"with {LONG_SQL}, hs as (select band, floor(y / 10.0) ty, floor(x / 10.0) tx, cast(v as integer) bin, count(*) n from l group by 1, 2, 3, 4), ks as (select distinct band, ty, tx from hs), "
       "de as (select ks.*, cast(i as integer) bin, coalesce(n, 0) n from ks cross join range(256) t(i) left join hs on hs.band = ks.band and hs.ty = ks.ty and hs.tx = ks.tx and hs.bin = i), "
       "s1 as (select *, sum(n) over (partition by band, ty, tx) size from de), s2 as (select *, floor(size * 8.0 / 256) clip from s1), s3 as (select *, sum(greatest(n - clip, 0)) over (partition by band, ty, tx) ov from s2), "
       "s4 as (select band, ty, tx, bin, size, sum(least(n, clip) + floor(ov / 256)) over (partition by band, ty, tx order by bin) cdf from s3), "
       "s5 as (select *, coalesce(min(cdf) filter (cdf > 0) over (partition by band, ty, tx), 0) m from s4), m as (select band, ty, tx, bin, floor(least(greatest((cdf - m) * (255.0::double / (size - m + 1)), 0), 255)) m from s5), " + FOUR.format(n=10) + """
 select q.band, q.y, q.x, floor(least(greatest((m0.m * (1 - wx) + m1.m * wx) * (1 - wy) + (m2.m * (1 - wx) + m3.m * wx) * wy, 0), 255)) v from q
 join m m0 on m0.band = q.band and m0.ty = y0 and m0.tx = x0 and m0.bin = cast(q.v as integer) join m m1 on m1.band = q.band and m1.ty = y0 and m1.tx = x1 and m1.bin = cast(q.v as integer)
 join m m2 on m2.band = q.band and m2.ty = y1 and m2.tx = x0 and m2.bin = cast(q.v as integer) join m m3 on m3.band = q.band and m3.ty = y1 and m3.tx = x1 and m3.bin = cast(q.v as integer)""")
def clahe(spark, sf_dir):
    return R.clahe(long_rgb(spark, sf_dir), 10, 8.0)


@query(f"with {LONG_SQL}, k as (select a.band, a.y, a.x, any_value(a.v) f, avg(b.v) m, avg(b.v * b.v) - avg(b.v) * avg(b.v) var from l a join l b on b.band = a.band and b.y between a.y - 3 and a.y + 3 and b.x between a.x - 3 and a.x + 3 group by 1, 2, 3) select band, y, x, floor(least(greatest((f - m) * (0.8 * 50 / greatest(case when var > 0 then sqrt(var) else 1 end, 1)) + 0.9 * 127 + (1 - 0.9) * m, 0), 255)) v from k")
def wallis(spark, sf_dir):
    return R.wallis(long_rgb(spark, sf_dir), 127.0, 50.0, 0.8, 0.9, 7, ("band",)).select("band", "y", "x", "v")


@query(f"with {LONG_SQL}, r as (select band, y, x + 12 x, 255 - v v from l), j as (select coalesce(a.band, r.band) band, coalesce(a.y, r.y) y, coalesce(a.x, r.x) x, coalesce(a.v, 0) va, coalesce(r.v, 0) vb from l a full join r on r.band = a.band and r.y = a.y and r.x = a.x), t as (select *, (x - 12) / 6.0::double t from j) select band, y, x, floor(least(greatest(case when x < 12 then va when x >= 18 then vb else va * (1 - t * t * (3 - 2 * t)) + vb * (t * t * (3 - 2 * t)) end, 0), 255)) v from t")
def gradient_blend(spark, sf_dir):
    p = long_rgb(spark, sf_dir)
    return R.gradient_blend(p, p.withColumn("v", 255 - F.col("v")), 20, 12, 8, 6)


@query("""with t as (select cast(i // 12 as integer) "row", cast(i % 12 as integer) col from range(96) r(i)), u as (select *, col * 90 x, "row" * 90 y, least(100, 1000 - col * 90) w, least(100, 700 - "row" * 90) h from t)
 select 'tile_' || i || '_r' || "row" || '_c' || col name, i "index", "row", col, x, y, w width, h height from (select *, cast(row_number() over (order by "row", col) - 1 as integer) i from u where w >= 25 and h >= 25)""")
def tiler_grid(spark, sf_dir):
    return R.tiler(spark, 1000, 700, 100, 100, 10, 10)


MOS = f"with {R_SQL}, a as (select y + 0 y, x, v, 0 k from r where y < 400 union all select y - 50, x + 10, case when x % 7 = 0 then -9999 else v + 1 end, 1 from r where y >= 100) select y, x, round(arg_max(v, {{o}}), 9) v from a where abs(v + 9999) > 1e-10 group by y, x"


def _three(spark, sf_dir):
    r = raster(spark, sf_dir)
    a = r.where("y < 400").select(F.lit(0).alias("raster"), F.lit(1).alias("band"), "y", "x", "v")
    b = r.where("y >= 100").select(F.lit(1).alias("raster"), F.lit(1).alias("band"), (F.col("y") - 50).alias("y"), (F.col("x") + 10).alias("x"), F.when(F.col("x") % 7 == 0, -9999.0).otherwise(F.col("v") + 1).alias("v"))
    return a.unionByName(b)


@query(MOS.format(o="k"))
def mosaic_last_wins(spark, sf_dir):
    return R.mosaic(_three(spark, sf_dir), nodata=-9999.0).select("y", "x", F.round("v", 9).alias("v"))


@query(MOS.format(o="-k"))
def mosaic_priority(spark, sf_dir):
    return R.mosaic_priority(_three(spark, sf_dir), {0: 5, 1: 2}, -9999.0).select("y", "x", F.round("v", 9).alias("v"))


@query(f"with {R_SQL}, n as (select max(y) + 1 h from r) select cast(ty as integer) y, cast(tx as integer) x, round(v, 9) v from n, range(0, 40) b(tx), range(0, 120) a(ty) join r on r.y = cast(floor((ty + 0.5) * (select h from n) / 120.0) as integer) and r.x = cast(floor((tx + 0.5) * 1.6) as integer)")
def resample_nearest(spark, sf_dir):
    r = raster(spark, sf_dir)
    h = r.agg(F.max("y")).first()[0] + 1
    return R.resample(r, 64, h, 40, 120, "nearest").select("y", "x", F.round("v", 9).alias("v"))


@query(f"with {R_SQL} select cast(y // 4 as integer) y, cast(x // 4 as integer) x, round(avg(v), 9) v from r group by 1, 2")
def overview_avg(spark, sf_dir):
    return R.overview(raster(spark, sf_dir), 4).select("y", "x", F.round("v", 9).alias("v"))


@query(f"with {R_SQL} select y, x, round(v, 9) v from r where x >= 10 and x < 30 and y >= 100 and y < 150")
def read_window(spark, sf_dir):
    return R.region(raster(spark, sf_dir), 10, 100, 20, 50).select("y", "x", F.round("v", 9).alias("v"))


@query(f"with {R_SQL}, {P_SQL} select p.id, cast(count(*) as bigint) pixels, round(avg(v), 9) mean from p join r on r.x + 0.5 > p.x0 and r.x + 0.5 < p.x1 and r.y + 0.5 > p.y0 and r.y + 0.5 < p.y1 group by p.id")
def clip_raster_by_boxes(spark, sf_dir):
    """Pixels whose centre lies in a rectangle: each rectangle lists its blocks of 32 x 32 pixels and meets theirs."""
    p = parcels(spark, sf_dir)
    cell = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / 32), F.floor(F.col(hi) / 32)))
    p = p.withColumn("bx", cell("xmin", "xmax")).withColumn("by", cell("ymin", "ymax"))
    r = raster(spark, sf_dir).withColumns({"bx": F.floor(F.col("x") / 32), "by": F.floor(F.col("y") / 32), "cx": F.col("x") + 0.5, "cy": F.col("y") + 0.5})
    j = r.join(p, ["bx", "by"]).where("cx > xmin and cx < xmax and cy > ymin and cy < ymax")
    return j.groupBy("id").agg(F.count("*").alias("pixels"), F.round(F.avg("v"), 9).alias("mean"))


@query(f"with {PT_SQL} select event_id, cast(least(greatest(floor((lon + 180) / 360 * 1024), 0), 1023) as integer) x, cast(least(greatest(floor((1 - ln(tan(lat * pi() / 180) + 1 / cos(lat * pi() / 180)) / pi()) / 2 * 1024), 0), 1023) as integer) y from pt")
def lonlat_to_tile(spark, sf_dir):
    x, y = tiles.lonlat_to_tile(F.col("lon"), F.col("lat"), F.lit(10))
    return points(spark, sf_dir).select("event_id", x.alias("x"), y.alias("y"))


@query("with t as (select i % 64 x, i // 64 y, 2 * pi() * 6378137.0 / 64 s from range(4096) r(i)) select cast(x as integer) x, cast(y as integer) y, round(x * s - pi() * 6378137.0, 4) minx, round(pi() * 6378137.0 - (y + 1) * s, 4) miny, round((x + 1) * s - pi() * 6378137.0, 4) maxx, round(pi() * 6378137.0 - y * s, 4) maxy from t")
def tile_bounds(spark, sf_dir):
    t = spark.range(4096).select((F.col("id") % 64).cast("int").alias("x"), F.floor(F.col("id") / 64).cast("int").alias("y"))
    b = tiles.tile_bounds(F.col("x"), F.col("y"), F.lit(6))
    return t.select("x", "y", *[F.round(c, 4).alias(n) for c, n in zip(b, ("minx", "miny", "maxx", "maxy"), strict=True)])


@query("with z as (select i z, 2 * pi() * 6378137.0 / pow(2, i) s from range(0, 12) r(i)) select cast(z as integer) z, cast((least(floor((5000000 + pi() * 6378137.0) / s), pow(2, z) - 1) - floor((-3000000 + pi() * 6378137.0) / s) + 1) * (least(floor((pi() * 6378137.0 + 1000000) / s), pow(2, z) - 1) - floor((pi() * 6378137.0 - 6000000) / s) + 1) as bigint) n from z")
def tile_range_count(spark, sf_dir):
    return R.estimate_tiles(spark, -3000000.0, -1000000.0, 5000000.0, 6000000.0, 0, 11)


@query(f"with {PT_SQL} select event_id, round(lon, 8) lon, round(lat, 8) lat from pt")
def mercator_roundtrip(spark, sf_dir):
    p = points(spark, sf_dir)
    lon, lat = tiles.mercator_to_lonlat(*tiles.lonlat_to_mercator(F.col("lon"), F.col("lat")))
    return p.select("event_id", F.round(lon, 8).alias("lon"), F.round(lat, 8).alias("lat"))


CODE = "cast(least(greatest(floor((h + 10000) / 0.1::double), 0), 16777215) as bigint)"


@query(f"with {H_SQL} select id, cast(c >> 16 as integer) r, cast((c >> 8) & 255 as integer) g, cast(c & 255 as integer) b from (select id, {CODE} c from h)")
def terrain_mapbox(spark, sf_dir):
    return heights(spark, sf_dir).select("id", *_triple(tiles.terrain_rgb(F.col("h"))))


@query(f"with {H_SQL} select id, cast(c >> 16 as integer) r, cast((c >> 8) & 255 as integer) g, cast(c & 255 as integer) b from (select id, cast(floor(least(greatest(h + 32768, 0), 65535.99609375) * 256) as bigint) c from h)")
def terrain_terrarium(spark, sf_dir):
    return heights(spark, sf_dir).select("id", *_triple(tiles.terrain_rgb(F.col("h"), "terrarium")))


@query(f"with {H_SQL} select id, round(-10000 + {CODE} * 0.1, 4) h from h")
def terrain_decode(spark, sf_dir):
    return heights(spark, sf_dir).select("id", F.round(tiles.terrain_decode(*tiles.terrain_rgb(F.col("h"))), 4).alias("h"))


@query(f"with {PT_SQL}, t as (select event_id, date_trunc('hour', ts) w, cast(least(greatest(floor((lon + 180) / 360 * 8), 0), 7) as integer) x, cast(least(greatest(floor((1 - ln(tan(lat * pi() / 180) + 1 / cos(lat * pi() / 180)) / pi()) / 2 * 8), 0), 7) as integer) y from pt) select cast(epoch(w) as bigint) start, x, y, count(*) n from t group by 1, 2, 3")
def events_tile_counts(spark, sf_dir):
    from ..streaming import tile_counts

    return tile_counts(points(spark, sf_dir), "1 hour", 3)


@query(f"with {R_SQL}, {P_SQL} select p.id, cast(count(*) as bigint) pixels, round(sum(v), 6) total from p join r on r.x + 0.5 > p.x0 and r.x + 0.5 < p.x1 and r.y + 0.5 > p.y0 and r.y + 0.5 < p.y1 group by p.id")
def clip_raster_by_features(spark, sf_dir):
    """As the rectangles above, through the polygon kernel."""
    from ..functions import geometry as G
    from ..operators import raster_geometry as RG

    p = parcels(spark, sf_dir).select("id", G.box(F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax")).alias("geom"))
    out = RG.clip_by_features(raster(spark, sf_dir).withColumn("band", F.lit(1)), p, "id")
    return out.groupBy("id").agg(F.count("*").alias("pixels"), F.round(F.sum("v"), 6).alias("total"))


@query(f"with {LONG_SQL} select case band when 3 then 1 when 1 then 2 end band, y, x, v from l where band in (1, 3)")
def merge_bands(spark, sf_dir):
    from ..operators import raster_geometry as RG

    return RG.pick_bands(long_rgb(spark, sf_dir), [3, 1]).select("band", "y", "x", "v")


#: Weights of the source pixels around a target pixel at twice the size, nearest side first: at 0.25, 0.75, 1.25 ... away.
_SINC = "(sin(pi() * {t}) / (pi() * {t})) * (sin(pi() * {t} / 3) / (pi() * {t} / 3))"
TAPS = {
    "bilinear": ["0.75::double", "0.25::double"],
    "cubic": ["0.8671875::double", "0.2265625::double", "-0.0703125::double", "-0.0234375::double"],
    "cubicspline": ["(2::double/3 - 0.0625 + 0.0078125)", "(2::double/3 - 0.5625 + 0.2109375)", "(0.421875::double/6)", "(0.015625::double/6)"],
    "lanczos": [_SINC.format(t=t) for t in ("0.25::double", "0.75::double", "1.25::double", "1.75::double", "2.25::double", "2.75::double")],
}


def _doubled(method: str) -> None:
    """The raster at twice its size: along x, then along y; beyond a border the border pixel counts."""
    taps = TAPS[method]

    def side(even: bool, axis: str, by: str) -> str:
        terms = []
        for n, w in enumerate(taps):
            far = (n + 1) // 2  # steps away: own, beside, other side, ...
            ahead = (n % 2 == 1) != even
            f = "lead" if ahead else "lag"
            shifts = [f"{f}(v, {k}) over (partition by {by} order by {axis})" for k in range(far, 0, -1)]
            terms.append(f"({w}) * coalesce({', '.join([*shifts, 'v'])})" if far else f"({w}) * v")
        return f"({' + '.join(terms)}) / ({' + '.join(taps)})"

    sql = f"""with {R_SQL}, a as (select y, 2 * x x, {side(True, 'x', 'y')} v from r union all select y, 2 * x + 1, {side(False, 'x', 'y')} from r),
 b as (select 2 * y y, x, {side(True, 'y', 'x')} v from a union all select 2 * y + 1, x, {side(False, 'y', 'x')} from a)
 select cast(y as integer) y, cast(x as integer) x, round(v, 9) v from b"""

    @query(sql, f"resample_{method}")
    def run(spark, sf_dir):
        r = raster(spark, sf_dir)
        rows = r.agg(F.max("y")).first()[0] + 1
        return R.resample(r, 64, rows, 128, 2 * rows, method).select("y", "x", F.round("v", 9).alias("v"))


for _method in TAPS:
    _doubled(_method)

_band("band_math_pow", lambda: B.band_math(F.col("b1"), F.col("b3"), "pow"), "power(b1, b3)")


@query(f"with {R_SQL} select round(min(v), 9) \"min\", round(max(v), 9) \"max\", round(avg(v), 9) mean, round(stddev_pop(v), 9) stddev, count(*) n from r where x between 10 and 29 and y between 100 and 299")
def region_stats(spark, sf_dir):
    s = R.statistics(R.region(raster(spark, sf_dir), 10, 100, 20, 200))
    return s.select(*[F.round(c, 9).alias(c) for c in ("min", "max", "mean", "stddev")], "n")


def _curve_sql(points: list[tuple[float, float]], v: str) -> str:
    """Catmull-Rom through control points, as the usual matrix form, cut to whole bytes."""
    xs, ys = zip(*points)
    cases = [f"when {v} <= {xs[0]} then {ys[0]}::double", f"when {v} >= {xs[-1]} then {ys[-1]}::double"]
    for k in range(len(xs) - 1):
        p0, p1, p2, p3 = ys[max(k - 1, 0)], ys[k], ys[k + 1], ys[min(k + 2, len(ys) - 1)]
        t = f"(({v} - {xs[k]})::double / {xs[k + 1] - xs[k]})"
        cases.append(f"when {v} <= {xs[k + 1]} then 0.5::double * (2 * {p1} + ({p2 - p0}) * {t} + ({2 * p0 - 5 * p1 + 4 * p2 - p3}) * {t} * {t} + ({3 * p1 - p0 - 3 * p2 + p3}) * {t} * {t} * {t})")
    return f"cast(floor(least(greatest(case {' '.join(cases)} end, 0), 255) + 1e-9) as integer)"


def _curve(name: str, points: list[tuple[float, float]]) -> None:
    @query(f"with {RGB_SQL} select y, x, {', '.join(f'{_curve_sql(points, c)} {c}' for c in ('b1', 'b2', 'b3'))} from g", name)
    def run(spark, sf_dir):
        table = colors.curve_table(points)
        return rgb(spark, sf_dir).select("y", "x", *[colors.lookup(table, F.col(c)).alias(c) for c in ("b1", "b2", "b3")])


_curve("curve_three_points", [(0, 20), (100, 60), (255, 240)])
_curve("s_curve", [(0, 0), (64, 48), (128, 128), (192, 208), (255, 255)])


def _byte(text: str) -> str:
    return f"cast(floor(least(greatest({text}, 0), 255)) as integer)"


def _adjusted(name: str, how, text: str) -> None:
    @query(f"with {RGB_SQL} select y, x, {', '.join(f'{_byte(text.format(v=c))} {c}' for c in ('b1', 'b2', 'b3'))} from g", name)
    def run(spark, sf_dir):
        r, g, b = colors.adjust(F.col("b1"), F.col("b2"), F.col("b3"), how)
        return rgb(spark, sf_dir).select("y", "x", r.alias("b1"), g.alias("b2"), b.alias("b3"))


_adjusted("adjust_brightness", colors.Adjust(brightness=0.2), "{v} + 51::double")
_adjusted("adjust_contrast", colors.Adjust(contrast=0.25), "({v}::double - 128) * 1.5 + 128")
_adjusted("adjust_contrast_down", colors.Adjust(contrast=-0.5), "({v}::double - 128) * 0.5 + 128")


@query(f"with {B_SQL} select {K}, case when b1 > 10 then least(greatest(sign(b2 * 3 - 50) * floor(abs(b2 * 3 - 50) + 0.5), 0), 255) else 0 end b1, b2, b3, b4 from b")
def band_write_byte(spark, sf_dir):
    """An expression written to a band of bytes: rounded and held to 0..255; where the condition fails, nodata is."""
    kinds = {1: "Byte", 2: "Float64", 3: "Float64", 4: "Float64"}
    return B.calculate_and_write(bands(spark, sf_dir), "b2 * 3 - 50", 1, kinds, "b1 > 10", 0.0)


@query(f"with {B_SQL} select {K}, b1, cast(cast(b2 / 3 as float) as double) b2, b3, b4 from b")
def band_write_single(spark, sf_dir):
    kinds = {1: "Float64", 2: "Float32", 3: "Float64", 4: "Float64"}
    return B.calculate_and_write(bands(spark, sf_dir), "b2 / 3", 2, kinds)


@query(f"""with {R_SQL}, t as (select unnest(range(0, 16)) n), n as (select max(y) + 1 rows from r),
 c as (select n px, (n + 0.5::double) * 4 - 0.5 p from t), d as (select n py, (n + 0.5::double) * 4 - 0.5 p from t),
 cx as (select px, cast(floor(p) as integer) x0, p - floor(p) w from c), dy as (select py, cast(floor(p) as integer) y0, p - floor(p) w from d)
 select cast(k as integer) band, cast(py as integer) py, cast(px as integer) px,
 round((1 - cx.w) * (1 - dy.w) * a.v + cx.w * (1 - dy.w) * b.v + (1 - cx.w) * dy.w * e.v + cx.w * dy.w * f.v, 9) v
 from cx, dy, range(1, 4) q(k), r a, r b, r e, r f where a.x = x0 and a.y = y0 and b.x = x0 + 1 and b.y = y0 and e.x = x0 and e.y = y0 + 1 and f.x = x0 + 1 and f.y = y0 + 1""")
def tile_bilinear(spark, sf_dir):
    """The tile in the world's corner of a raster with four pixels to each of its sixteen."""
    from ..operators import raster_geometry as RG

    r = raster(spark, sf_dir).withColumn("band", F.lit(1))
    rows = r.agg(F.max("y")).first()[0] + 1
    edge, side = 20037508.342789244, 2 * 20037508.342789244 / 2**3 / 64
    return RG.read_tile(r, (-edge, side, 0.0, edge, 0.0, -side), 64, rows, 3, 0, 0, 16).select("band", "py", "px", F.round("v", 9).alias("v"))
