"""Operator 10: near-duplicate vectors by spherical k-means cells and blocked cosines."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import connected_components
from .storage import materialize

BLOCK = 1024
WIDE = 512  # cells that one k-means fits


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Unit centroids of unit rows ``x``; an empty cell takes a row far from its centroid."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        best, near = np.empty(len(x), np.int64), np.empty(len(x))
        for at in range(0, len(x), 4096):
            s = x[at : at + 4096] @ c.T
            best[at : at + 4096] = s.argmax(1)
            near[at : at + 4096] = s.max(1)
        total = np.zeros_like(c)
        np.add.at(total, best, x)
        size = np.linalg.norm(total, axis=1)
        lost = np.flatnonzero(size < 1e-9)
        total[lost] = x[np.argsort(near)[: len(lost)]]
        c = total / np.linalg.norm(total, axis=1, keepdims=True)
    return c


def grown_cells(x: np.ndarray, k: int, seed: int = 5) -> np.ndarray:
    """``k`` unit centroids at most: in one go while few, else the cells of coarse cells, in proportion to their rows."""
    if k <= WIDE:
        return spherical_kmeans(x, min(k, len(x)), seed=seed)
    coarse = spherical_kmeans(x, math.isqrt(k), seed=seed)
    home = np.concatenate([(x[at : at + 4096] @ coarse.T).argmax(1) for at in range(0, len(x), 4096)])
    out = []
    for i in range(len(coarse)):
        own = x[home == i]
        share = min(len(own), round(k * len(own) / len(x)))
        out.append(spherical_kmeans(own, share, seed=seed + i) if share > 1 else coarse[i : i + 1])
    return np.concatenate(out)


def cells_of(x: np.ndarray, c: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """The nearest cell of each unit row, and for each row and cell whether a vector within the angle of ``cosine``
    may call that cell its nearest (a bound that loses none; the slack covers rounding)."""
    s = x @ c.T
    home = s.argmax(1)
    if cosine <= 0:
        return home, np.ones(s.shape, bool)
    apart = 2 - 2 * (c[home] @ c.T)  # squared distance of each centroid from the home centroid
    gap = s[np.arange(len(x)), home][:, None] - s
    reach = np.sqrt(np.maximum(apart - gap * gap, 0)) * np.sqrt(max(1 - cosine**2, 0)) / cosine
    return home, gap <= reach + 1e-6


def _assign(shared, cosine: float):
    def run(batches):
        models = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = [np.asarray(v, np.float64) for v in batch.column("_v").to_pylist()]
            areas = []
            for at in range(0, len(vectors), 256):
                part = vectors[at : at + 256]
                found: list = [None] * len(part)
                for dim in {len(v) for v in part}:
                    pick = [i for i, v in enumerate(part) if len(v) == dim]
                    if dim not in models:
                        for i in pick:
                            found[i] = np.array([dim << 32])
                        continue
                    c, area = models[dim]
                    x = np.stack([part[i] for i in pick])
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                    home, ok = cells_of(x, c, cosine)
                    meets = np.zeros((len(pick), area.max() + 1), bool)
                    row, cell = np.nonzero(ok)
                    meets[row, area[cell]] = True
                    for i, own, row in zip(pick, area[home], meets, strict=True):
                        # a pair of two areas is compared in the later one
                        found[i] = np.concatenate([[own], own + 1 + np.flatnonzero(row[own + 1 :])]) + (dim << 32)
                areas += found
            yield pa.RecordBatch.from_arrays(
                [batch.column("_node"), batch.column("_copies"), batch.column("_v"), pa.array([x.tolist() for x in areas], pa.list_(pa.int64()))],
                ["_node", "_copies", "_v", "_areas"],
            )

    return run


def _compare(cosine: float):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        home, lists = frame[frame["_home"]], frame[~frame["_home"]]
        if not len(home) or not len(lists):
            return pd.DataFrame(columns=["u", "v", "n"]).astype("int64")
        unit = []
        for part in (home, lists):
            x = np.stack(part["_v"].to_numpy()).astype(np.float64)
            unit.append(x / np.linalg.norm(x, axis=1, keepdims=True))
        h, m = home["_node"].to_numpy(), lists["_node"].to_numpy()
        many_h, many_m = home["_copies"].to_numpy(), lists["_copies"].to_numpy()
        counts_h, counts_m = np.zeros(len(h), np.int64), np.zeros(len(m), np.int64)
        ids, back = np.unique(np.concatenate([h, m]), return_inverse=True)
        at_h, at_m = back[: len(h)], back[len(h) :]
        label, edges = np.arange(len(ids)), []
        for at in range(0, len(h), 256):
            near = (unit[0][at : at + 256] @ unit[1].T >= cosine) & (h[at : at + 256, None] != m)
            for r in np.flatnonzero(near.any(1)):
                j = np.flatnonzero(near[r])
                counts_h[at + r] = many_m[j].sum()
                counts_m[j] += many_h[at + r]
                own, others = at_h[at + r], at_m[j]
                others = others[label[others] != label[own]]
                if len(others):  # one edge to each tree that the row joins
                    joined, first = np.unique(label[others], return_index=True)
                    edges += [(ids[own], ids[o], 0) for o in others[first]]
                    label[np.isin(label, joined)] = label[own]
        # a pair within the area comes up from both sides
        counts_m[lists["_p"].to_numpy() == 0] = 0
        tally = [(n, n, c) for n, c in zip(np.concatenate([h, m]), np.concatenate([counts_h, counts_m]), strict=True) if c]
        return pd.DataFrame(edges + tally, columns=["u", "v", "n"]).astype("int64")

    return run


def near_duplicates(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9, cell_rows: int = 256,
    sample_rows: int = 100_000, most_cells: int = 16_384,
) -> DataFrame:
    """``vectors`` -> ``(id, n_links, component_id, kept)`` over pairs whose cosine is at least ``cosine``.

    Centroids are fitted on at most ``sample_rows`` vectors (64 MB of them), the ones with the smallest hash: a cell for
    ``cell_rows`` rows, coarse cells first and then cells within them where there are many.  ``most_cells`` bounds what
    every task holds (8 MB at 64 components), not what is compared.  Neighbouring cells form areas of some thousand
    rows.  Every vector has a home area and is also listed in each later area with a cell that a vector within the angle
    may call home; home rows meet listed rows in blocks, by double-precision products.  That bound has no cap, so
    every pair is found and counted exactly; where the vectors have no clusters it excludes little, and the blocks
    grow with the square of the rows.  Equal vectors are one node with a count, so copies never pair; larger areas
    only mean more block pairs, so nothing is capped.  Each block pair returns link counts and a spanning forest.
    Vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of
    different lengths don't link; null ids keep their rows with null results; repeated ids are one vertex; an
    empty table gives an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    v = F.col(vector_col)
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    fair = v.isNotNull() & ~F.exists(v, odd) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("_id"), v.cast("array<double>").alias("_v"), F.coalesce(fair, F.lit(False)).alias("_fair"))
    rows = rows.withColumns({"_a": F.xxhash64("_v"), "_b": F.xxhash64("_v", F.lit(1))})
    nodes = materialize(
        rows.where("_fair and _id is not null").groupBy("_a", "_b", "_v").agg(F.min("_id").alias("_node"), F.count("*").alias("_copies")), "vectors"
    )
    models = {}
    lengths = nodes.groupBy(F.size("_v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n")).limit(64).collect()
    # eight blocks or more where there are rows enough, of at most 8192 rows and about 2M components
    step = min(8 * BLOCK, max(256, lengths[0]["n"] // 8), max(256, 2_000_000 // max(r["d"] for r in lengths))) if lengths else BLOCK
    for r in lengths:
        k = min(most_cells, -(-r["n"] // cell_rows))
        if k > 1:
            take = min(max(k, sample_rows), max(k, 64_000_000 // (8 * r["d"])))
            got = nodes.where(F.size("_v") == r["d"]).orderBy(F.xxhash64("_a"), "_node").limit(take).select("_v").toArrow()
            x = np.asarray(got.column("_v").combine_chunks().flatten()).reshape(-1, r["d"])
            c = grown_cells(x / np.linalg.norm(x, axis=1, keepdims=True), min(k, len(x)))
            areas = min(len(c), -(-r["n"] // min(8 * BLOCK, max(cell_rows, r["n"] // 8))))
            models[r["d"]] = c, np.unique((c @ grown_cells(c, areas).T).argmax(1), return_inverse=True)[1]
    listed = materialize(
        nodes.select("_node", "_copies", "_v").mapInArrow(
            _assign(spark.sparkContext.broadcast(models), cosine), "_node long, _copies long, _v array<double>, _areas array<long>"
        ), "cells",
    )
    at = listed.select("_node", "_copies", "_v", F.posexplode("_areas").alias("_p", "_area"))
    sizes = at.groupBy("_area").agg(
        F.ceil(F.count_if(F.col("_p") == 0) / step).alias("_hb"), F.ceil(F.count("*") / (2 * step)).alias("_lb")
    ).where("_hb > 0")
    sizes = materialize(sizes, "cell-sizes")  # so that the join deals both sides itself and can split a hot area
    dealt = at.join(sizes, "_area").withColumn("_h", F.xxhash64("_node", F.lit(9)))
    sides = [
        dealt.where("_p = 0").select(
            "_area", "_node", "_copies", "_v", "_p", F.lit(True).alias("_home"), F.pmod("_h", "_hb").alias("_x"),
            F.explode(F.sequence(F.lit(0).cast("long"), F.col("_lb") - 1)).alias("_y"),
        ),
        dealt.select(
            "_area", "_node", "_copies", "_v", "_p", F.lit(False).alias("_home"),
            F.explode(F.sequence(F.lit(0).cast("long"), F.col("_hb") - 1)).alias("_x"), F.pmod("_h", "_lb").alias("_y"),
        ),
    ]
    found = materialize(
        sides[0].union(sides[1]).groupBy("_area", "_x", "_y").applyInPandas(_compare(cosine), "u long, v long, n long"), "links"
    )
    counts = found.where("n > 0").groupBy(F.col("u").alias("_node")).agg(F.sum("n").alias("_n"))
    roots = connected_components(found.where("u <> v").select("u", "v"), "groups").select(F.col("id").alias("_node"), "root")
    full = nodes.select("_a", "_b", "_node", "_copies").join(counts, "_node", "left").join(roots, "_node", "left")
    named = full.select(
        "_a", "_b", (F.coalesce("_n", F.lit(0)) + F.col("_copies") - 1).alias("_links"), F.coalesce("root", "_node").alias("_root")
    )
    key = lambda c: F.when(F.col("_fair") & F.col("_id").isNotNull(), F.col(c))
    out = rows.select("_id", key("_a").alias("_a"), key("_b").alias("_b")).join(named, ["_a", "_b"], "left")
    return out.select(
        F.col("_id").alias(id_col), F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("_root", "_id").alias("component_id"),
    ).withColumn("kept", F.col(id_col) == F.col("component_id"))
