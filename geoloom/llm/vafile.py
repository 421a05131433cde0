"""Operator 8: exact top-k inner products by vector-approximation files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import materialize

CELLS = "dim int, rows binary, ids binary, cells binary, low binary, step long"
ASKS = "dim int, rows binary, ids binary, exact binary"
FOUND = "_q long, query_id long, _c long, _low double, _high double"
BLOCK_BYTES = 16 << 20  # of whole components that one block is made of
CHUNK_BYTES = 32 << 20  # of queries that every task holds at a time


def scaled(vector, scale: int):
    """Whole components ``floor(scale * x)``; null where the vector takes no part.

    The last condition keeps every inner product of two such vectors below 2**62, so scores are whole numbers.
    """
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    fair = vector.isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, odd)
    top = F.array_max(F.transform(vector, lambda x: F.abs(F.lit(float(scale)) * x.cast("double")))) + 1
    small = F.size(vector) * top * top < 2.0**62
    return F.when(fair & small, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))))


def _blocks(frames: Iterator[pd.DataFrame], block: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """``(dim, rows, ids, whole components)`` of about ``block`` vectors of one length, from one partition."""
    held: dict[int, list] = {}
    for frame in frames:
        for dim, part in frame.groupby("_dim"):
            rest = held.setdefault(int(dim), [])
            rest.append((part["_row"].to_numpy(np.int64), part["_id"].to_numpy(np.int64), np.stack(part["_v"].to_numpy()).astype(np.int64)))
            most = max(1, min(block, BLOCK_BYTES // (8 * int(dim))))
            while sum(len(r) for r, _, _ in rest) >= most:
                rows, ids, x = (np.concatenate(c) for c in zip(*rest, strict=True))
                yield int(dim), rows[:most], ids[:most], x[:most]
                rest[:] = [(rows[most:], ids[most:], x[most:])] if len(rows) > most else []
    for dim, rest in held.items():
        if rest:
            yield dim, *(np.concatenate(c) for c in zip(*rest, strict=True))


def _enough(x: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Rows of a block that may be among some query's ``k`` best: of equal vectors those with the ``k + 1`` smallest ids
    (one may be the query's own), ``k`` rows of each, as all others have as many before them."""
    same = np.unique(x.view(np.dtype((np.void, x.itemsize * x.shape[1]))).ravel(), return_inverse=True)[1]
    order = np.lexsort((ids, same))
    s, i = same[order], ids[order]
    fresh = np.concatenate([[True], s[1:] != s[:-1]])
    other = fresh | np.concatenate([[True], i[1:] != i[:-1]])
    number = np.cumsum(other)
    at = np.arange(len(x))
    before = number - np.maximum.accumulate(np.where(fresh, number, 0))
    again = at - np.maximum.accumulate(np.where(other, at, 0))
    return np.sort(order[(before <= k) & (again < k)])


def _pack(bits: int, block: int, k: int):
    """Blocks as the file holds them: row numbers, ids, cells (one byte a component), each cell's lowest value."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for dim, rows, ids, x in _blocks(frames, block):
            kept = _enough(np.ascontiguousarray(x), ids, k)
            rows, ids, x = rows[kept], ids[kept], x[kept]
            low = x.min(0)
            step = max(1, -(-int((x.max(0) - low).max() + 1) // (1 << bits)))
            cells = ((x - low) // step).astype(np.uint8)
            yield pd.DataFrame([(dim, rows.tobytes(), ids.tobytes(), cells.tobytes(), low.tobytes(), step)], columns=["dim", "rows", "ids", "cells", "low", "step"])

    return run


def _pack_asks(block: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for dim, rows, ids, x in _blocks(frames, block):
            yield pd.DataFrame([(dim, rows.tobytes(), ids.tobytes(), x.tobytes())], columns=["dim", "rows", "ids", "exact"])

    return run


def scan_block(q: np.ndarray, own: np.ndarray, ids: np.ndarray, cells: np.ndarray, low: np.ndarray, step: int, k: int):
    """What of one block may be among each query's ``k`` best: ``(query, candidate, lowest score, highest score)`` arrays.

    A cell bounds each component from both sides, so its inner products lie between two values.  A candidate stays if
    its highest possible score reaches the kth highest of the lowest ones; exact vectors aren't needed for that.
    """
    qf = q.astype(np.float64)
    corner = cells.astype(np.float64) * step + low
    up = np.maximum(qf, 0).sum(1) * (step - 1)
    down = np.minimum(qf, 0).sum(1) * (step - 1)
    out: list = [[], [], [], []]
    for first in range(0, len(q), 256):
        base = qf[first : first + 256] @ corner.T
        for i, line in enumerate(base, first):
            margin = 1 + 1e-9 * float(np.abs(line).max(initial=0) + up[i] - down[i])
            line[ids == own[i]] = -np.inf
            n = min(k, int(np.isfinite(line).sum()))
            if not n:
                continue
            bar = np.partition(line, len(line) - n)[len(line) - n] + down[i] - margin
            live = np.flatnonzero(line + up[i] + margin >= bar)
            for part, values in zip(out, (np.full(len(live), i), live, line[live] + down[i] - margin, line[live] + up[i] + margin), strict=True):
                part.append(values)
    cat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    return cat(out[0], int), cat(out[1], int), cat(out[2], float), cat(out[3], float)


def _scan(shared, k: int):
    """Every block of the file against the queries of this pass."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asks = [(d, np.frombuffer(r, np.int64), np.frombuffer(i, np.int64), np.frombuffer(x, np.int64)) for d, r, i, x in shared.value]
        for frame in frames:
            for r in frame.itertuples(index=False):
                rows, ids = np.frombuffer(r.rows, np.int64), np.frombuffer(r.ids, np.int64)
                cells, low = np.frombuffer(r.cells, np.uint8).reshape(len(ids), -1), np.frombuffer(r.low, np.int64)
                for dim, q_rows, q_ids, q in asks:
                    if dim == r.dim:
                        a, b, least, most = scan_block(q.reshape(len(q_ids), -1), q_ids, ids, cells, low, int(r.step), k)
                        yield pd.DataFrame({"_q": q_rows[a], "query_id": q_ids[a], "_c": rows[b], "_low": least, "_high": most})

    return run


def survivors(file: DataFrame, asks: DataFrame, k: int) -> DataFrame:
    """``(_q, query_id, _c, _low, _high)``: candidates that may be among the ``k`` best of each query, from cells alone.

    The queries come in passes of ``CHUNK_BYTES``, which every task holds; the file isn't shuffled in any of them.
    """
    spark = file.sparkSession
    sizes = asks.select("_at", F.octet_length("exact").alias("n")).orderBy("_at")
    passes: list[list[int]] = [[]]
    room = CHUNK_BYTES
    for r in sizes.toLocalIterator():  # a row for each block of queries
        if passes[-1] and r["n"] > room:
            passes.append([])
            room = CHUNK_BYTES
        passes[-1].append(r["_at"])
        room -= r["n"]
    out = None
    for wanted in passes:
        held = asks.where(F.col("_at").isin(wanted)).collect() if wanted else []  # CHUNK_BYTES or one block
        shared = spark.sparkContext.broadcast([(r["dim"], bytes(r["rows"]), bytes(r["ids"]), bytes(r["exact"])) for r in held])
        found = materialize(file.mapInPandas(_scan(shared, k), FOUND), "va-survivors")
        shared.unpersist()
        out = found if out is None else out.unionAll(found)
    bar = Window.partitionBy("_q").orderBy(F.desc("_low"), "_c")
    kth = out.select("_q", "_low", "_c").withColumn("_n", F.row_number().over(bar)).where(F.col("_n") <= k)
    kth = kth.groupBy("_q").agg(F.when(F.count("*") == k, F.min("_low")).otherwise(float("-inf")).alias("_bar"))
    return out.join(kth, "_q").where("_high >= _bar").drop("_bar")


def _read_exact(candidates: DataFrame, asked: DataFrame, exact: DataFrame) -> DataFrame:
    """Candidates with their scores, from the exact vectors of the rows they name."""
    q = asked.select(F.col("_row").alias("_q"), F.col("_v").alias("_qv"))
    c = exact.select(F.col("_row").alias("_c"), F.col("_id").alias("vec_id"), F.col("_v").alias("_cv"))
    product = F.aggregate(F.zip_with("_qv", "_cv", lambda x, y: x * y), F.lit(0).cast("long"), lambda s, x: s + x)
    return candidates.join(q, "_q").join(c, "_c").select("_q", "query_id", "_c", "_high", "vec_id", product.alias("score"))


def top_k(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 100, k: int = 5, scale: int = 256,
    bits: int = 7, block: int = 8192, query_block: int = 2048,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row whose id is divisible by ``every``, the ``k`` highest
    integer inner products over all other rows, ties to the smaller id.

    1. Rows are packed, partition by partition, into blocks of about ``block`` vectors of one byte a component (the
       vector-approximation file), of equal vectors as many as can matter; the exact vectors stay in a table of their own.
    2. Each block is scanned once against each block of queries for lower and upper bounds.  What may still be among
       a query's ``k`` best goes on: first by the bounds within a block, then by the kth highest lower bound of all.
    3. The ``k`` candidates with the highest upper bounds are read exactly; their kth score is the bar that any other one's
       upper bound must reach to be read as well, after which the result is certain.

    The stated query set grows with the table, so the work does too: rows x queries cell scans, spread over blocks.  The
    query set reaches the tasks in passes of a fixed size.  Vectors that are null, empty or hold null or
    non-finite components take no part, nor do rows with null ids, nor vectors whose scaled components are so large that
    products might leave 64 bits (``size * max ** 2 >= 2**62``).  Vectors of different lengths don't meet; repeated
    vectors are ranked by id; a row never finds a row of its own id; rows that share an id are one query, which counts
    each candidate once for each of them; an empty table gives an empty result.
    """
    if k < 1 or not 1 <= bits <= 8:
        raise ValueError("k must be 1 or more and bits 1 to 8")
    v = vectors.select(F.col(id_col).cast("long").alias("_id"), scaled(F.col(vector_col), scale).alias("_v")).where("_v is not null and _id is not null")
    exact = materialize(v.withColumns({"_dim": F.size("_v"), "_row": F.monotonically_increasing_id()}), "vectors")
    file = materialize(exact.mapInPandas(_pack(bits, block, k), CELLS), "va-file")
    asked = exact.where(F.col("_id") % every == 0)
    parts = max(1, asked.count() // query_block)
    asks = materialize(asked.repartition(parts, "_row").mapInPandas(_pack_asks(query_block), ASKS).withColumn("_at", F.monotonically_increasing_id()), "va-queries")
    live = materialize(survivors(file, asks, k), "va-candidates")
    order = Window.partitionBy("_q").orderBy(F.desc("_high"), "_c")
    ranked = live.withColumn("_n", F.row_number().over(order))
    first = materialize(_read_exact(ranked.where(F.col("_n") <= k), asked, exact), "va-first")
    bars = first.groupBy("_q").agg(F.when(F.count("*") == k, F.min("score")).alias("_bar"))
    more = ranked.where(F.col("_n") > k).join(bars, "_q").where("_bar is null or _high >= _bar")
    found = first.drop("_high").unionByName(_read_exact(more, asked, exact).drop("_high"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id", "_c")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
