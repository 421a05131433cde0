"""Overlay of two polygon layers as grid-keyed joins.

Every feature is listed in the cells that its envelope covers; equal cells join, envelopes are compared, and the
pair counts only in the cell that holds the larger of the two lower-left corners, so none comes up twice and no
geometry is cut.  Results are one row for each pair or feature, without tile borders.

Features of equal geometry share a shape.  Shapes meet, are overlaid and measured once, whatever the number of
features; the features join the results last.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..storage import discard, materialize
from .layers import merge_fields

BOX = ("xmin", "ymin", "xmax", "ymax")
MEMBERS = 512  # of a group that one union call takes
PAIRS = 4096  # of features that one task overlays
TWINS = 1024  # features of one shape that meet its results in one task
ROWS = 65536  # that meet results in one task


def _spans(*layers: DataFrame) -> list[tuple]:
    """For each layer the sum and maximum of the wider sides of its envelopes, its bounds and its rows: one job."""
    side = F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin"))
    stats = [F.sum(side), F.max(side), F.min("xmin"), F.min("ymin"), F.max("xmax"), F.max("ymax"), F.count("*")]
    parts = [x.agg(*[c.alias(f"c{i}") for i, c in enumerate(stats)]).withColumn("_at", F.lit(n)) for n, x in enumerate(layers)]
    both = parts[0] if len(parts) == 1 else parts[0].unionAll(parts[1])
    return [tuple(r)[:7] for r in sorted(both.collect(), key=lambda r: r["_at"])]


def _size_of(spans: list[tuple]) -> float:
    """About twice the mean side, and no less than cells of which there is one for each feature."""
    some = [s for s in spans if s[6] and s[0] is not None]
    if not some:
        return 1.0
    n = sum(s[6] for s in some)
    w, h = max(s[4] for s in some) - min(s[2] for s in some), max(s[5] for s in some) - min(s[3] for s in some)
    return max(2 * sum(s[0] for s in some) / n, math.sqrt(max(w * h, 1e-300) / n)) or 1.0


def cell_size(a: DataFrame, b: DataFrame) -> float:
    """The cell that :func:`envelope_pairs` takes by itself, from one aggregate of both layers."""
    return _size_of(_spans(a, b))


def cells(layer: DataFrame, size: float, prefix: str) -> DataFrame:
    """Envelope columns renamed with a prefix, and one row for each cell ``(_cx, _cy)``."""
    out = layer.select(*[F.col(c).alias(f"{prefix}{c}") for c in layer.columns])
    span = lambda lo, hi: F.sequence(F.floor(F.col(prefix + lo) / size), F.floor(F.col(prefix + hi) / size))
    return out.withColumn("_cx", F.explode(span("xmin", "xmax"))).withColumn("_cy", F.explode(span("ymin", "ymax")))


def _level(prefix: str, size: float) -> Column:
    """Doublings of the cell after which an envelope covers few cells; 0 up to four cells wide."""
    span = F.greatest(F.col(f"{prefix}xmax") - F.col(f"{prefix}xmin"), F.col(f"{prefix}ymax") - F.col(f"{prefix}ymin"))
    return F.greatest(F.ceil(F.log2(F.greatest(span, F.lit(size)) / (4.0 * size))), F.lit(0)).cast("int")


def _leveled(layer: DataFrame, size: float, prefix: str, other_top: int) -> DataFrame:
    """:func:`cells` at a feature's own level and at the coarser ones that the other layer has."""
    out = layer.select(*[F.col(c).alias(f"{prefix}{c}") for c in layer.columns]).withColumn(f"_{prefix}level", _level(prefix, size))
    out = out.withColumn("_level", F.explode(F.sequence(F.col(f"_{prefix}level"), F.greatest(F.col(f"_{prefix}level"), F.lit(other_top)))))
    width = size * F.pow(F.lit(2.0), F.col("_level"))
    span = lambda lo, hi: F.sequence(F.floor(F.col(prefix + lo) / width), F.floor(F.col(prefix + hi) / width))
    return out.withColumn("_cx", F.explode(span("xmin", "xmax"))).withColumn("_cy", F.explode(span("ymin", "ymax")))


def _met(a: DataFrame, b: DataFrame, size: float | None = None, *, touching: bool = False) -> DataFrame:
    """Pairs of rows whose envelopes overlap (or touch): all columns of both, prefixed ``a_`` and ``b_``.

    Rows far wider than a cell are listed in cells of twice, four times ... the width, so none is listed more
    than some dozen times; a pair meets at the coarser of its two levels.
    """
    spans = _spans(a, b)
    size = size or _size_of(spans)
    top_a, top_b = (max(0, math.ceil(math.log2(max(x[1] or 0.0, size) / (4.0 * size)))) for x in spans)
    if top_a == top_b == 0:
        j = cells(a, size, "a_").join(cells(b, size, "b_"), ["_cx", "_cy"])
        width, level = F.lit(size), F.lit(True)
    else:
        j = _leveled(a, size, "a_", top_b).join(_leveled(b, size, "b_", top_a), ["_level", "_cx", "_cy"])
        width, level = size * F.pow(F.lit(2.0), F.col("_level")), F.col("_level") == F.greatest("_a_level", "_b_level")
    less = (lambda x, y: F.col(x) <= F.col(y)) if touching else (lambda x, y: F.col(x) < F.col(y))
    hit = less("a_xmin", "b_xmax") & less("b_xmin", "a_xmax") & less("a_ymin", "b_ymax") & less("b_ymin", "a_ymax")
    here = (F.floor(F.greatest("a_xmin", "b_xmin") / width) == F.col("_cx")) & (F.floor(F.greatest("a_ymin", "b_ymin") / width) == F.col("_cy"))
    return j.where(level & hit & here).drop("_cx", "_cy", "_level", "_a_level", "_b_level")


def with_rows(found: DataFrame, rows: DataFrame, keys: tuple[str, ...], prefix: str, count: int, most: int) -> DataFrame:
    """``found`` with each of the ``rows`` that have the same ``keys``, prefixed; ``count`` rows, at most ``most`` of one key.

    Both sides are dealt by key over as many tasks as the rows need.  Keys of more than ``TWINS`` rows are dealt
    further, and what was found for them is repeated for each of their parts.
    """
    rows, on = rows.select(*[F.col(c).alias(prefix + c) for c in rows.columns]), [prefix + k for k in keys]
    if most > TWINS:
        hot = rows.groupBy(*on).agg(F.ceil(F.count("*") / TWINS).alias("_k")).where("_k > 1")
        many = F.coalesce("_k", F.lit(1))
        rows = rows.join(hot, on, "left").withColumn("_s", F.pmod(F.xxhash64(*rows.columns), many)).drop("_k")
        found = found.join(hot, on, "left").withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), many - 1))).drop("_k")
        on = [*on, "_s"]
    parts = min(max(2 * rows.sparkSession.sparkContext.defaultParallelism, count // ROWS), 8192)
    return found.repartition(parts, *on).join(rows.repartition(parts, *on), on).drop("_s")


def envelope_pairs(a: DataFrame, b: DataFrame, size: float | None = None, *, touching: bool = False) -> DataFrame:
    """Pairs whose envelopes overlap (or touch): all columns of both, prefixed ``a_`` and ``b_``.

    Where envelopes are repeated, each meets the others once, and the rows join the pairs last.
    """
    shapes = [x.groupBy(*BOX).agg(F.count("*").alias("_n")) for x in (a, b)]
    (rows_a, most_a), (rows_b, most_b) = (x.agg(F.sum("_n"), F.max("_n")).first() for x in shapes)
    if max(most_a or 1, most_b or 1) == 1:
        return _met(a, b, size, touching=touching)
    pairs = _met(*[x.drop("_n") for x in shapes], size, touching=touching)
    pairs = with_rows(pairs, b, BOX, "b_", rows_b or 0, most_b or 1)
    return with_rows(pairs, a, BOX, "a_", rows_a or 0, most_a or 1)


def box_area(prefix: str = "") -> Column:
    return (F.col(f"{prefix}xmax") - F.col(f"{prefix}xmin")) * (F.col(f"{prefix}ymax") - F.col(f"{prefix}ymin"))


def _common_box() -> dict[str, Column]:
    return {"xmin": F.greatest("a_xmin", "b_xmin"), "ymin": F.greatest("a_ymin", "b_ymin"), "xmax": F.least("a_xmax", "b_xmax"), "ymax": F.least("a_ymax", "b_ymax")}


def intersect_boxes(a: DataFrame, b: DataFrame, size: float | None = None) -> DataFrame:
    """Pairs of overlapping rectangles with their common one as ``xmin, ymin, xmax, ymax``; expressions only."""
    return envelope_pairs(a, b, size).withColumns(_common_box())


def covered_boxes(a: DataFrame, b: DataFrame, a_id: str, size: float | None = None) -> DataFrame:
    """``(a_id, covered)``: how much of each rectangle of ``a`` the union of ``b`` covers.

    The distinct edges of the pieces in a rectangle cut it into strips along x; in each strip the pieces are merged
    along y by a running maximum, so overlapping pieces count once.  Equal rectangles of either layer are looked at once.
    """
    from pyspark.sql.window import Window

    sets = a.where(" and ".join(f"{c} is not null" for c in BOX)).groupBy(F.col(a_id).alias("_id")).agg(F.sort_array(F.collect_set(F.struct(*BOX))).alias("_set"))
    shapes = sets.select("_set").distinct().select("_set", F.explode("_set").alias("_b")).select("_set", "_b.*")
    pieces = _met(shapes, b.select(*BOX).distinct(), size).withColumns(_common_box()).select(F.col("a__set").alias("_set"), *BOX)
    edges = pieces.select("_set", F.explode(F.array("xmin", "xmax")).alias("_x")).distinct()
    w = Window.partitionBy("_set").orderBy("_x")
    strips = edges.withColumn("_x2", F.lead("_x").over(w)).where("_x2 is not null")
    bars = strips.join(pieces, "_set").where("xmin <= _x and xmax >= _x2").select("_set", "_x", "_x2", "ymin", "ymax")
    order = Window.partitionBy("_set", "_x").orderBy("ymin", "ymax")
    upto = F.max("ymax").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.col("ymax") - F.greatest("ymin", F.coalesce(upto, F.col("ymin"))), F.lit(0.0))
    covered = bars.withColumn("_new", new).groupBy("_set").agg(F.sum(F.col("_new") * (F.col("_x2") - F.col("_x"))).alias("covered"))
    return sets.join(covered, "_set").select(F.col("_id").alias(a_id), "covered")


# --- general geometries --------------------------------------------------------------------------------------


def members_by(rows: DataFrame, keys: list[str], geom: str = "geom") -> DataFrame:
    """``keys, _members``: each group's geometries, ``MEMBERS`` at most, larger groups as unions of salted parts."""
    rows = rows.select(*keys, F.col(geom).alias("_g")).where("_g is not null")
    while True:
        counts = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
        most = counts.agg(F.max("_n")).first()[0] or 0
        if most <= MEMBERS:
            return rows.groupBy(*keys).agg(F.sort_array(F.collect_list("_g")).alias("_members"))
        parts = counts.withColumn("_k", F.ceil(F.col("_n") / MEMBERS)).drop("_n")
        named = parts.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_k")
        same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
        salted = (rows.join(named, same) if keys else rows.crossJoin(F.broadcast(named))).withColumn("_s", F.pmod(F.xxhash64("_g"), "_k"))
        # equal geometries share a salt, so they are taken once each; what is left of a part is evenly dealt
        lists = salted.select(*keys, "_s", "_g").distinct().groupBy(*keys, "_s").agg(F.sort_array(F.collect_list("_g")).alias("_m"))
        rows = materialize(lists.select(*keys, G.union_list("_m").alias("_g")), "unions")


def union_by(rows: DataFrame, keys: list[str], geom: str = "geom", out: str = "geom") -> DataFrame:
    """Union of each group's geometries, in salted steps so that a large group never meets in one call whole.

    Groups without any geometry have a null one.  An empty table without keys gives no row.
    """
    found = members_by(rows, keys, geom).select(*keys, G.union_list("_members").alias(out))
    if not keys:
        return found.where(F.col(out).isNotNull())
    every = rows.select(*[F.col(k).alias(f"_k_{k}") for k in keys]).where(F.col(geom).isNull()).distinct() if geom in rows.columns else None
    if every is None:
        return found
    bare = every.join(found, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], "left_anti").select(*[F.col(f"_k_{k}").alias(k) for k in keys])
    return found.unionByName(bare.withColumn(out, F.lit(None).cast("binary")))


@dataclass(frozen=True)
class Layer:
    """A prepared layer: ``shapes`` are its distinct geometries with bounds and a number ``_row``, ``rows`` its features with that number."""

    rows: DataFrame
    shapes: DataFrame
    fields: list[str]
    count: int
    most: int

    def meets(self, found: DataFrame, prefix: str = "", fields: list[str] | None = None) -> DataFrame:
        """What was found of shapes, for every feature: its fields, prefixed, are added."""
        rows = self.rows.select("_row", *(self.fields if fields is None else fields))
        return with_rows(found, rows, ("_row",), prefix, self.count, self.most)


def prepared(layer: DataFrame, valid: bool = False, grid: float = 0.0) -> Layer:
    """The layer written once, its distinct geometries parsed (repaired, snapped) in one pass; null and empty ones go."""
    fields = [c for c in layer.columns if c not in (*BOX, "geom", "_row")]
    raw = materialize(layer.where("geom is not null").select(*fields, F.col("geom").alias("_raw")), "raw")
    parts = 2 * layer.sparkSession.sparkContext.defaultParallelism
    known = raw.groupBy("_raw").agg(F.count("*").alias("_n"))
    known = known.repartition(max(parts, known.count() // ROWS), "_raw")
    made = known.select("_raw", "_n", G.prepared(valid, grid)(F.col("_raw")).alias("_p")).select("_raw", "_n", "_p.*").where("geom is not null and xmin is not null")
    shapes = materialize(made.withColumn("_row", F.monotonically_increasing_id()), "shapes")
    count, most = shapes.agg(F.sum("_n"), F.max("_n")).first()
    rows = materialize(raw.join(shapes.select("_raw", "_row"), "_raw").select("_row", *fields), "rows")
    discard(raw)
    return Layer(rows, shapes.drop("_raw", "_n"), fields, count or 0, most or 1)


def prepared_pairs(a: Layer, b: Layer, size: float | None = None, *, where: Column | None = None, touching: bool = False) -> DataFrame:
    """``(a__row, b__row)`` of the shapes of two layers, dealt evenly: numbers and bounds alone meet in the cells."""
    narrow = [x.shapes.select("_row", *BOX) for x in (a, b)]
    pairs = _met(*narrow, size, touching=touching)
    pairs = materialize((pairs if where is None else pairs.where(where)).select("a__row", "b__row"), "pairs")
    parts = max(2 * pairs.sparkSession.sparkContext.defaultParallelism, pairs.count() // PAIRS)
    return pairs.repartition(parts, F.xxhash64("a__row", "b__row"))


def with_geometry(pairs: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs with all columns of the shapes of both layers but their bounds, prefixed."""
    for prefix, x in (("a_", a), ("b_", b)):
        pairs = pairs.join(x.select(*[F.col(c).alias(prefix + c) for c in x.columns if c not in BOX]), f"{prefix}_row")
    return pairs


def met_pairs(
    a: DataFrame, b: DataFrame, size: float | None = None, *, touching: bool = False, tests: dict[str, Callable[[Column, Column], Column]] | None = None
) -> DataFrame:
    """Pairs of features whose bounds overlap (or touch), with the columns and geometries of both.

    With ``tests``, functions of the two geometries by name, their results take the place of the geometries; each is
    made once for a pair of shapes, whatever the number of features that have them.
    """
    a, b = prepared(a), prepared(b)
    met = with_geometry(prepared_pairs(a, b, size, touching=touching), a.shapes, b.shapes)
    values = ["a_geom", "b_geom"] if tests is None else [f(F.col("a_geom"), F.col("b_geom")).alias(n) for n, f in tests.items()]
    return a.meets(b.meets(met.select("a__row", "b__row", *values), "b_"), "a_").drop("a__row", "b__row")


def _finish(rows: DataFrame, measures: dict[str, Callable[[Column], Column]] | None) -> DataFrame:
    """Polygonal results and their measures; rows of which nothing polygonal is left go."""
    return rows.where("geom is not null").withColumns({n: f(F.col("geom")) for n, f in (measures or {}).items()})


def _both(a: DataFrame, b: DataFrame, valid: bool, grid: float, size: float | None) -> tuple[Layer, Layer, DataFrame]:
    """Both layers prepared, and the pairs of shapes whose bounds overlap."""
    a, b = prepared(a, valid, grid), prepared(b, valid, grid)
    return a, b, prepared_pairs(a, b, size)


def _common(a: Layer, b: Layer, pairs: DataFrame, strategy: str, prefix: str, measures: dict | None = None) -> DataFrame:
    names = merge_fields(a.fields, b.fields, strategy, prefix)
    met = with_geometry(pairs, a.shapes, b.shapes).select("a__row", "b__row", G.common_area("a_geom", "b_geom").alias("geom"))
    found = _finish(met, measures)
    values = [c for c in found.columns if c not in ("a__row", "b__row")]
    own, other = ([c for s, c, _ in names if s == side] for side in "ab")
    out = a.meets(b.meets(found, "b_", other), "a_", own)
    return out.select(*[F.col(f"{s}_{c}").alias(n) for s, c, n in names], *values)


def _rest(a: Layer, b: Layer, pairs: DataFrame, how: str, f, measures: dict | None = None, own: str = "a_", other: str = "b_") -> DataFrame:
    """``f`` of each shape of ``a`` and the shapes of ``b`` that it meets, as ``_row, geom`` and measures.

    The shapes are dealt by number, so that calls spread over all cores however few files the layer came in.
    """
    met = pairs.join(b.shapes.select(F.col("_row").alias(f"{other}_row"), "geom"), f"{other}_row")
    lists = members_by(met.select(F.col(f"{own}_row").alias("_row"), "geom"), ["_row"])
    parts = max(2 * a.shapes.sparkSession.sparkContext.defaultParallelism, a.shapes.count() // PAIRS)
    return _finish(a.shapes.repartition(parts, "_row").join(lists, "_row", how).select("_row", f("geom", "_members").alias("geom")), measures)


def _against(a: Layer, b: Layer, pairs: DataFrame, how: str, f, measures: dict | None = None, own: str = "a_", other: str = "b_") -> DataFrame:
    """:func:`_rest` for each feature of ``a``, with its fields."""
    return _each(a, _rest(a, b, pairs, how, f, measures, own, other))


def _each(a: Layer, found: DataFrame) -> DataFrame:
    return a.meets(found).select(*a.fields, *[c for c in found.columns if c != "_row"])


def intersect(
    a: DataFrame, b: DataFrame, strategy: str = "prefer1", *, grid: float = 0.0, size: float | None = None, prefix: str = "l2_", measures: dict | None = None
) -> DataFrame:
    """One row for each pair with a common area, fields by ``strategy``.

    ``measures`` here and below are functions of the resulting geometry by the name of their column.  They are taken
    once for each pair of shapes, so a caller that wants an area alone has no geometry repeated for each feature.
    """
    return _common(*_both(a, b, False, grid, size), strategy, prefix, measures)


def clip(a: DataFrame, b: DataFrame, a_id: str, *, grid: float = 0.0, size: float | None = None, valid: bool = True, measures: dict | None = None) -> DataFrame:
    """What of each feature of ``a`` lies in the union of ``b``; fields of ``a``."""
    return _against(*_both(a, b, valid, grid, size), "inner", G.common_with_all, measures)


def erase(a: DataFrame, b: DataFrame, a_id: str, *, grid: float = 0.0, size: float | None = None, valid: bool = True, measures: dict | None = None) -> DataFrame:
    """What of each feature of ``a`` lies outside of the union of ``b``; features that meet none stay whole."""
    return _against(*_both(a, b, valid, grid, size), "left", G.rest_of_all, measures)


def identity(
    a: DataFrame, b: DataFrame, a_id: str, strategy: str = "prefer1", *, grid: float = 0.0, size: float | None = None, prefix: str = "l2_", measures: dict | None = None
) -> DataFrame:
    """Intersections with fields of both, and the rest of ``a`` with the fields of ``b`` null."""
    met = _both(a, b, False, grid, size)
    return _common(*met, strategy, prefix, measures).unionByName(_against(*met, "left", G.rest_of_all, measures), allowMissingColumns=True)


def sym_difference(a: DataFrame, b: DataFrame, a_id: str, b_id: str, *, grid: float = 0.0, size: float | None = None, measures: dict | None = None) -> DataFrame:
    """What lies in one layer only; fields of equal name share a column."""
    a, b, pairs = _both(a, b, False, grid, size)
    back = _against(b, a, pairs, "left", G.rest_of_all, measures, "b_", "a_")
    return _against(a, b, pairs, "left", G.rest_of_all, measures).unionByName(back, allowMissingColumns=True)


def update(a: DataFrame, b: DataFrame, a_id: str, *, grid: float = 0.0, size: float | None = None, measures: dict | None = None) -> DataFrame:
    """``a`` without ``b``, and ``b``."""
    a, b, pairs = _both(a, b, False, grid, size)
    whole = _finish(b.shapes.select("_row", G.to_multi_polygon(F.col("geom")).alias("geom")), measures)
    return _against(a, b, pairs, "left", G.rest_of_all, measures).unionByName(_each(b, whole), allowMissingColumns=True)


def union(
    a: DataFrame, b: DataFrame, a_id: str, b_id: str, strategy: str = "prefer1", *, grid: float = 0.0, size: float | None = None, prefix: str = "l2_",
    measures: dict | None = None,
) -> DataFrame:
    """Intersections, the rest of ``a`` and the rest of ``b``."""
    a, b, pairs = _both(a, b, False, grid, size)
    out = _common(a, b, pairs, strategy, prefix, measures).unionByName(_against(a, b, pairs, "left", G.rest_of_all, measures), allowMissingColumns=True)
    return out.unionByName(_against(b, a, pairs, "left", G.rest_of_all, measures, "b_", "a_"), allowMissingColumns=True)


def merge_by_input(rows: DataFrame, input_id: str) -> DataFrame:
    """The compatible merge: all pieces of one input feature become one, with the fields of the first piece."""
    others = [c for c in rows.columns if c not in ("geom", input_id)]
    firsts = rows.groupBy(input_id).agg(F.min(F.struct(*others)).alias("_f")) if others else rows.select(input_id).distinct()
    merged = union_by(rows, [input_id])
    key = F.col(input_id).eqNullSafe(F.col("_key"))
    out = firsts.join(merged.withColumnRenamed(input_id, "_key"), key)
    return out.select(input_id, *[F.col(f"_f.{c}").alias(c) for c in others], "geom")


def merged_intersect(a: DataFrame, b: DataFrame, a_id: str, *, grid: float = 0.0, size: float | None = None, prefix: str = "l2_") -> DataFrame:
    """:func:`merge_by_input` of an :func:`intersect` that prefers fields of ``a``, without a row for each pair.

    The pieces of a shape are merged once and its features take them over; of the fields of ``b`` the least row counts.
    """
    a, b, pairs = _both(a, b, False, grid, size)
    names = merge_fields(a.fields, b.fields, "prefer1", prefix)
    extra = [(c, n) for s, c, n in names if s == "b"]
    met = with_geometry(pairs, a.shapes, b.shapes).select(F.col("a__row").alias("_row"), F.col("b__row").alias("_other"), G.common_area("a_geom", "b_geom").alias("geom"))
    pieces = materialize(_finish(met, None), "pieces")
    found = union_by(pieces, ["_row"])
    if extra:
        least = b.rows.groupBy(F.col("_row").alias("_other")).agg(F.min(F.struct(*[F.col(c).alias(n) for c, n in extra])).alias("_b"))
        first = pieces.select("_row", "_other").join(least, "_other").groupBy("_row").agg(F.min("_b").alias("_b"))
        found = found.join(first, "_row").select("_row", "geom", "_b.*")
    return merge_by_input(_each(a, found), a_id).select(a_id, *[n for _, _, n in names if n != a_id], "geom")


def intersection_rows(a: DataFrame, b: DataFrame, size: float | None = None) -> DataFrame:
    """Pairwise intersections with the fields of ``a`` alone, repeated features and all."""
    return intersect(a, b, "table1", size=size)


def difference_rows(a: DataFrame, b: DataFrame, a_id: str, size: float | None = None) -> DataFrame:
    """Each feature of ``a`` less all features of ``b`` that meet it, one after the other: the same set as an erase."""
    return erase(a, b, a_id, size=size, valid=False)
