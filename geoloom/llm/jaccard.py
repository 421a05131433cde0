"""Operator 7: n-gram Jaccard self-join by vertical partitioning."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import connected_components
from .held import drop, slices
from .shingles import U, mix, shingle_hashes
from .sieve import sift
from .storage import discard, materialize

RATIO = 1.4  # of the sizes that share one way of cutting
BLOCK_SETS, BLOCK_SHINGLES = 256, 400_000
COMMON_SHARE, MOST_COMMON, TALLY_DOCS = 0.001, 200_000, 2000  # what counts as common, and how many are told apart
RARE_ORDERS = 3
COLUMNS = 4096  # of the global order, counted together
PARTS = 8  # fragments of the global order in which overlaps of a pair are counted apart; a power of two
PROBES = 2  # likely links of a set that are looked at first
SKETCH_BITS, MOST_BITS = 2, 1 << 24  # of a sketch: for each shingle, at least; and in all


def size_class(n: int) -> int:
    return int(math.log(max(n, 1)) / math.log(RATIO) + 1e-9)


def differing(n: int, percent: int) -> int:
    """Largest symmetric difference of two linked sets of which the smaller has ``n`` shingles.

    With overlap o, 100 o >= percent (a + b - o), a = n and b <= 100 n / percent.
    """
    b = 100 * n // percent
    return max(x + y - 2 * -(-percent * (x + y) // (100 + percent)) for x, y in ((n, b), (n, max(n, b - 1))))


def fragments(klass: int, percent: int) -> tuple[int, int]:
    """Into how many fragments of the global order sets of a class are cut, and how many of those may be empty."""
    top = int(RATIO ** (klass + 1) + 1)
    most = max(differing(n, percent) for n in range(max(1, top - 20), top + 1))
    spare = 1 + most // 12
    return most + 1 + spare, spare


class Cutter:
    """Signatures of a set: one hash for each non-empty fragment.

    The global order is the order of the shingles' hashes, and a fragment is a range of it.  Two linked sets
    differ in at most ``most`` shingles, hence in at most ``most`` fragments; of ``most + 1 + spare`` fragments at
    least ``1 + spare`` are equal, and one of these isn't empty if either set has at most ``spare`` empty ones.
    This holds for the sets without the shingles that are common in the corpus as well, and common lines and
    passages alone then never make two texts candidates.  A set whose rarer part has too many empty fragments is
    also cut along further orders, and if ``RARE_ORDERS`` of them don't do, whole, along as many as it takes; as its
    partners either did with fewer or do the same, no link is lost.
    """

    def __init__(self, percent: int, common: np.ndarray):
        self.percent, self.common, self.known = percent, common, {}

    def plan(self, klass: int) -> tuple[int, int]:
        if klass not in self.known:
            self.known[klass] = fragments(klass, self.percent)
        return self.known[klass]

    def cut(self, h: np.ndarray, klass: int, orders: int, salt: int) -> tuple[list[np.ndarray], bool]:
        """Signatures along one order after the other, until one leaves few fragments empty."""
        count, spare = self.plan(klass)
        out = []
        for order in range(orders if len(h) else 0):
            s = h if order == 0 else np.sort(mix(h + U(order * 0x9E3779B97F4A7C15 % 2**64)))
            of = ((s >> U(32)) * U(count)) >> U(32)
            first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            total = np.add.reduceat(mix(s ^ U(0xA5A5A5A5A5A5A5A5)), first)
            out.append(mix(total + mix(of[first] + U((klass << 40) + (order << 32) + (salt << 24)))))
            if count - len(first) <= spare:
                return out, True
        return out, False

    def signatures(self, h: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Those of the rarer part, and those of the whole set where they are needed."""
        n = len(h)
        least = -(-self.percent * n // 100)  # the smallest partner cuts by its own class
        if n == 0 or differing(n, self.percent) == 0 and differing(max(1, least), self.percent) == 0:
            return [], []  # only equal sets link, and these are one node already
        at = np.searchsorted(self.common, h)
        rare = h[self.common[np.minimum(at, len(self.common) - 1)] != h] if len(self.common) else h
        some, whole = [], []
        for klass in range(size_class(max(1, least)), size_class(n) + 1):
            found, enough = self.cut(rare, klass, RARE_ORDERS, 0)
            some += found
            if not enough:
                found, enough = self.cut(h, klass, 4096, 1)
                if not enough:
                    raise RuntimeError(f"no order of 4096 cuts a set of {n} shingles evenly enough")
                whole += found
        return some, whole


def node_of(h: np.ndarray) -> int | None:
    """Digest of a set, which names it; None for the empty set."""
    return int(mix(mix(h).sum(keepdims=True) + U(len(h))).view(np.int64)[0]) if len(h) else None


def sketch_of(h: np.ndarray) -> bytes:
    """For each of a power of two of fragments, by the low bits of the hashes, whether it holds an odd number of shingles.

    A shingle that only one of two sets holds turns one bit, so the bits in which two sketches differ are at most as many
    as the shingles in which the sets differ.  The two halves of a sketch, one XOR the other, are the sketch of half as many bits.
    """
    bits = min(MOST_BITS, 1 << max(6, (SKETCH_BITS * len(h) - 1).bit_length()))
    return np.packbits((np.bincount((h & U(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def folded(sketch: bytes, size: int) -> np.ndarray:
    """A sketch as one of ``size`` bytes, which must be no more than it has."""
    x = np.frombuffer(sketch, np.uint8)
    while len(x) > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def _tally(width: int):
    """Counts of the shingles that at least three of some thousand texts hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(held: list[np.ndarray]) -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, int))
            often = n > 2
            return pa.RecordBatch.from_arrays([pa.array(h[often].view(np.int64)), pa.array(n[often].astype(np.int64))], ["_h", "_n"])

        held: list[np.ndarray] = []
        size = 0
        with np.errstate(over="ignore"):
            for batch in batches:
                for text in (t for part in slices(batch) for t in part.column(0).to_pylist()):
                    held.append(shingle_hashes(text, width))
                    size += len(held[-1])
                    if len(held) >= TALLY_DOCS and size >= 500_000 or size >= 4_000_000:
                        yield counted(held)
                        held, size = [], 0
            yield counted(held)

    return run


def common_shingles(rows: DataFrame, width: int) -> np.ndarray:
    """Sorted hashes of the shingles that about ``COMMON_SHARE`` of all texts hold, ``MOST_COMMON`` at most.

    The list only decides where candidates are looked for; results are the same with any list.
    """
    total = rows.count()
    dealt = rows.select("_text").coalesce(max(1, total // TALLY_DOCS))
    found = dealt.mapInArrow(_tally(width), "_h long, _n long").groupBy("_h").agg(F.sum("_n").alias("_n"))
    found = found.where(F.col("_n") >= max(10, int(total * COMMON_SHARE))).orderBy(F.desc("_n"), "_h").limit(MOST_COMMON)
    return np.sort(np.asarray(found.select("_h").toArrow().column(0), np.int64).view(np.uint64))


def _sets(width: int, percent: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop()
        cutter = Cutter(percent, shared.value)
        none = np.zeros(0, np.uint64)

        def lists(parts: list[np.ndarray]) -> pa.ListArray:
            ends = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([none, *parts]).view(np.int64)))

        with np.errstate(over="ignore"):
            for batch in batches:
                for part in slices(batch):
                    nodes, sizes, some, whole = [], [], [], []
                    for text in part.column(1).to_pylist():
                        h = shingle_hashes(text, width)
                        sizes.append(len(h))
                        nodes.append(node_of(h))
                        a, b = cutter.signatures(h)
                        some.append(np.concatenate([none, *a]))
                        whole.append(np.concatenate([none, *b]))
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), lists(some), lists(whole)],
                        ["_id", "_node", "_n", "_sigs", "_whole"],
                    )

    return run


def _sketches(width: int):
    """Each text's node and sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for part in slices(batch):
                    found = [shingle_hashes(t, width) for t in part.column(0).to_pylist()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([node_of(h) for h in found], pa.int64()), pa.array([sketch_of(h) for h in found], pa.binary())], ["_node", "_sketch"]
                    )

    return run


def _arrays(width: int):
    """Each text's set cut along the global order into ``PARTS`` fragments."""
    edges = (np.arange(1, PARTS, dtype=np.uint64) << U(64 - PARTS.bit_length() + 1)).astype(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for part in slices(batch):
                    found = [shingle_hashes(t, width) for t in part.column(0).to_pylist()]
                    nodes = pa.array([node_of(h) for h in found], pa.int64())
                    sizes = [np.diff(np.concatenate([[0], np.searchsorted(h, edges), [len(h)]])) for h in found]
                    inner = np.concatenate([[0], np.cumsum(np.concatenate(sizes))] if found else [[0]]).astype(np.int32)
                    flat = np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)
                    lists = pa.ListArray.from_arrays(pa.array(inner), pa.array(flat))
                    outer = pa.array(np.arange(len(found) + 1, dtype=np.int32) * PARTS)
                    yield pa.RecordBatch.from_arrays([nodes, pa.ListArray.from_arrays(outer, lists)], ["_node", "_parts"])

    return run


def overlaps(a: list[np.ndarray], b: list[np.ndarray] | None) -> np.ndarray:
    """Overlap counts of every set of ``a`` with every one of ``b`` (None: of ``a``).

    The shingles that two sets at least hold are cut, in global order, into fragments of ``COLUMNS``; each
    fragment's partial overlaps are one matrix product, and the parts are summed per pair.
    """
    sets = a + (b or [])
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    tokens, where, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = seen > 1
    rank = np.cumsum(shared) - 1
    live = shared[where]
    owner, column = owner[live], rank[where][live]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((len(a), len(b) if b is not None else len(a)), np.int64)
    count = int(shared.sum())
    for at in range(0, count, COLUMNS):
        low, high = np.searchsorted(column, [at, at + COLUMNS])
        m = np.zeros((len(sets), min(COLUMNS, count - at)), np.float32)
        m[owner[low:high], column[low:high] - at] = 1
        total += (m[: len(a)] @ (m[len(a) :] if b is not None else m).T).astype(np.int64)
    return total


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges (node, root) that join the components of a square boolean matrix; each row is looked at once."""
    todo, out = np.ones(len(linked), bool), []
    for root in range(len(linked)):
        if not todo[root]:
            continue
        todo[root] = False
        front = np.array([root])
        while len(front):
            new = linked[front].any(0) & todo
            todo &= ~new
            front = np.flatnonzero(new)
            out += [(int(i), root) for i in front]
    return out


def _may_link(percent: int):
    """Those of pairs with the sketches ``_su`` and ``_sv`` whose sets may link.

    Sets of s shingles together that differ in d link if (100 + percent) d <= (100 - percent) s, and d is at least the
    number of bits in which their sketches differ.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b, n in zip(batch.column("_su").to_pylist(), batch.column("_sv").to_pylist(), np.add(batch.column("nu"), batch.column("nv")), strict=True):
                size = min(len(a), len(b))
                apart = int(np.bitwise_count(folded(a, size) ^ folded(b, size)).sum())
                keep.append((100 + percent) * apart <= (100 - percent) * n)
            yield batch.filter(pa.array(keep, pa.bool_())).select(["u", "v", "nu", "nv"])

    return run


def _near(percent: int):
    """The sets of two blocks that may link with one of the other block (or of the same, if it meets itself) and of another component."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates("_node").reset_index(drop=True)
        columns = ["_p", "_x", "_y", "_block", "_sub", "_node"]
        size = min(map(len, frame["_sketch"]))
        signs = np.unpackbits(np.stack([folded(x, size) for x in frame["_sketch"]]), axis=1).astype(np.float32) * 2 - 1
        n, sub, first = frame["_n"].to_numpy(), frame["_sub"].to_numpy(), (frame["_block"] == frame["_x"]).to_numpy()
        hit = np.zeros(len(frame), bool)
        same = frame["_x"].iloc[0] == frame["_y"].iloc[0]
        left, right = (np.arange(len(frame)),) * 2 if same else (np.flatnonzero(first), np.flatnonzero(~first))
        if len(left) and len(right):
            apart = (signs.shape[1] - signs[left] @ signs[right].T) / 2
            near = ((100 + percent) * apart <= (100 - percent) * (n[left][:, None] + n[right])) & (sub[left][:, None] != sub[right])
            hit[left[near.any(1)]] = True
            hit[right[near.any(0)]] = True
        return frame.loc[hit, columns]

    return run


def _links(percent: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates("_node")
        same = frame["_x"].iloc[0] == frame["_y"].iloc[0]
        left = frame["_block"] == frame["_x"].iloc[0]
        parts = [frame] if same else [frame[left], frame[~left]]
        out: list[tuple[int, int]] = []
        if all(len(p) for p in parts):
            a = [np.concatenate(h).astype(np.int64) for h in parts[0]["_parts"]]
            b = None if same else [np.concatenate(h).astype(np.int64) for h in parts[1]["_parts"]]
            o = overlaps(a, b)
            na, nb = np.array([len(x) for x in a]), np.array([len(x) for x in (a if same else b)])
            ok = 100 * o >= percent * (na[:, None] + nb[None, :] - o)
            if not same:
                n = len(a)
                full = np.zeros((n + len(b), n + len(b)), bool)
                full[:n, n:], full[n:, :n] = ok, ok.T
                ok = full
            of = np.concatenate([p["_sub"].to_numpy() for p in parts])
            out = [(of[i], of[j]) for i, j in forest(ok) if of[i] != of[j]]
        return pd.DataFrame(out, columns=["u", "v"]).astype("int64")

    return run


def _ties(sets: DataFrame) -> DataFrame:
    """``(u, v, n)``: candidates that share ``n`` signatures, v < u; each set is tied to its neighbours only.

    Few sets share a fragment of rare shingles: neighbours in it are tied, in one shuffle.  A third of all sets may share
    a whole fragment: these are tied to its smallest node, from pre-aggregated minima.
    """
    order = Window.partitionBy("_sig").orderBy("_node")
    signed = sets.select("_node", F.explode("_sigs").alias("_sig"))
    near = signed.withColumn("_before", F.lag("_node").over(order)).where("_before < _node").select(F.col("_node").alias("u"), F.col("_before").alias("v"))
    whole = sets.where(F.size("_whole") > 0).select("_node", F.explode("_whole").alias("_sig")).distinct()
    low = whole.groupBy("_sig").agg(F.min("_node").alias("_low"), F.max("_node").alias("_high")).where("_low < _high").select("_sig", "_low")
    hot = whole.join(low, "_sig").select(F.col("_node").alias("u"), F.col("_low").alias("v")).where("u <> v")
    return near.union(hot).groupBy("u", "v").agg(F.count("*").alias("n"))


def linked_pairs(pairs: DataFrame, arrays: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs(u, v, nu, nv)`` that link: overlaps are counted for each fragment apart and summed per pair."""
    part = arrays.select("_node", F.posexplode("_parts").alias("_f", "_h")).where(F.size("_h") > 0)
    one = pairs.join(part.select(F.col("_node").alias("u"), "_f", F.col("_h").alias("_hu")), "u")
    both = one.join(part.select(F.col("_node").alias("v"), "_f", F.col("_h").alias("_hv")), ["v", "_f"])
    counts = both.select("u", "v", "nu", "nv", F.size(F.array_intersect("_hu", "_hv")).cast("long").alias("_o"))
    total = counts.groupBy("u", "v", "nu", "nv").agg(F.sum("_o").alias("_o"))
    return total.where(100 * F.col("_o") >= percent * (F.col("nu") + F.col("nv") - F.col("_o"))).select("u", "v")


def _open_pairs(dealt: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """``(_p, _x, _y, _block)``: pairs of blocks whose sets may still link, with a row for either block; and the groups
    that are cut into blocks.

    ``dealt(_node, _n, _root, _class, _sub, _big)`` are sets whose candidate group ``_root`` isn't all of one component.
    Sets of one big component form blocks of their own, which never meet each other.
    """
    key = ["_root", "_class", "_big", "_own"]
    groups = dealt.groupBy(*key).agg(
        F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("_n") / BLOCK_SHINGLES)).cast("long").alias("_k")
    ).withColumn("_g", F.xxhash64(*key))
    reach = 1 + max(0, math.ceil(math.log(100 / percent) / math.log(RATIO)) - 1)
    x = groups.select("_root", "_class", F.col("_g").alias("_gx"), F.col("_k").alias("_kx"))
    y = groups.select(
        "_root", F.explode(F.sequence(F.col("_class") - reach, F.col("_class") + reach)).alias("_class"), F.col("_g").alias("_gy"), F.col("_k").alias("_ky"), F.col("_big").alias("_by")
    )
    met = x.join(y, ["_root", "_class"]).where((F.col("_gx") < F.col("_gy")) | ((F.col("_gx") == F.col("_gy")) & ~F.col("_by")))
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    met = met.withColumn("_ax", upto("_kx")).withColumn("_ay", upto("_ky")).where((F.col("_gx") != F.col("_gy")) | (F.col("_ax") <= F.col("_ay")))
    met = met.select(F.xxhash64("_gx", "_ax").alias("_x"), F.xxhash64("_gy", "_ay").alias("_y")).withColumn("_p", F.xxhash64("_x", "_y"))
    return met.withColumn("_block", F.explode(F.array_distinct(F.array("_x", "_y")))), groups.select(*key, "_g", "_k")


def _rest_links(ties: DataFrame, nodes: DataFrame, sketches: DataFrame, fragments_of: Callable[[DataFrame], DataFrame], first: DataFrame, percent: int) -> DataFrame | None:
    """``(id, root)`` over the components ``first(id, root)``: which of them further links join; None where none are open.

    Ties between different components leave candidate groups open.  In each of these, sets are dealt to blocks by size
    class, and any two blocks whose sizes may link and that aren't of one component meet, by sketches first.  Of sets that
    may link by these, partial overlaps are counted fragment by fragment and summed per pair; a block pair returns a
    spanning forest.
    """
    named = lambda c, to: first.select(F.col("id").alias(c), F.col("root").alias(to))
    mapped = ties.select("u", "v").join(named("u", "_ru"), "u", "left").join(named("v", "_rv"), "v", "left")
    cross = mapped.select(F.coalesce("_ru", "u").alias("u"), F.coalesce("_rv", "v").alias("v")).where("u <> v").distinct()
    cross = materialize(cross, "open-ties")
    if cross.isEmpty():
        return None
    groups = connected_components(cross, "candidates").select(F.col("id").alias("_sub"), F.col("root").alias("_root"))
    log = F.floor(F.log(F.greatest(F.col("_n"), F.lit(1)).cast("double")) / math.log(RATIO) + 1e-9).cast("int")
    owned = nodes.select("_node", "_n", log.alias("_class")).join(named("_node", "_sub"), "_node", "left").withColumn("_sub", F.coalesce("_sub", "_node"))
    opened = materialize(owned.join(groups, "_sub"), "open-sets")
    sizes = opened.groupBy("_sub").agg((F.count("*") >= BLOCK_SETS // 4).alias("_big"))
    dealt = opened.join(sizes, "_sub").withColumn("_own", F.when(F.col("_big"), F.col("_sub")).otherwise(0))
    pairs, made = _open_pairs(dealt, percent)
    placed = dealt.join(made, ["_root", "_class", "_big", "_own"]).select(
        "_node", "_sub", "_n", F.xxhash64("_g", F.pmod(F.xxhash64("_node", F.lit(3)), F.col("_k"))).alias("_block")
    )
    met = placed.join(pairs, "_block").join(sketches, "_node").groupBy("_p")
    near = materialize(met.applyInPandas(_near(percent), "_p long, _x long, _y long, _block long, _sub long, _node long"), "near-sets")
    joined = None
    if not near.isEmpty():
        arrays = fragments_of(near.select("_node").distinct())
        joined = connected_components(near.join(arrays, "_node").groupBy("_p").applyInPandas(_links(percent), "u long, v long"), "links")
        discard(arrays)
    discard(cross, opened, near)
    return joined


def _component_roots(sets: DataFrame, ties: DataFrame, rows: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """``(_node, root)``, without nodes that have no links or with themselves as roots, and the table of all nodes."""
    nodes = materialize(sets.where("_node is not null").groupBy("_node", "_n").agg(F.min("_id").alias("_id")), "set-nodes")
    tied = ties.select(F.explode(F.array("u", "v")).alias("_node")).distinct()
    # one row of each candidate node brings its text
    wanted = materialize(nodes.join(tied, "_node").where("_id is not null").select("_node", "_id"), "wanted")
    # only where ids repeat can a node's text come twice
    repeated = bool(sets.where("_node is not null").groupBy("_id").agg(F.count("*").alias("_k")).where("_k > 1").take(1))

    def of_texts(texts: DataFrame, made, schema: str, name: str) -> DataFrame:
        out = texts.select("_text").mapInArrow(made, schema)
        return materialize(out.dropDuplicates(["_node"]) if repeated else out, name)

    def fragments_of(some: DataFrame) -> DataFrame:
        ids = materialize(wanted.join(some, "_node").select("_id").distinct(), "wanted-fragments")
        texts = sift(rows, F.col("_id"), ids, F.col("_id"))[0].join(ids, "_id", "left_semi")
        out = of_texts(texts, _arrays(width), "_node long, _parts array<array<long>>", "fragments")
        discard(ids)
        return out

    # sketches are small: those of further texts that the bitmap lets through cost less than a shuffle of the texts
    sketches = of_texts(sift(rows, F.col("_id"), wanted, F.col("_id"))[0], _sketches(width), "_node long, _sketch binary", "sketches")
    size = lambda c, to: nodes.select(F.col("_node").alias(c), F.col("_n").alias(to))
    drawn = lambda c, to: sketches.select(F.col("_node").alias(c), F.col("_sketch").alias(to))
    most = Window.partitionBy("u").orderBy(F.desc("n"), "v")
    likely = ties.withColumn("_i", F.row_number().over(most)).where(F.col("_i") <= PROBES).select("u", "v")
    likely = likely.join(size("u", "nu"), "u").join(size("v", "nv"), "v").where(100 * F.least("nu", "nv") >= percent * F.greatest("nu", "nv"))
    likely = likely.join(drawn("u", "_su"), "u").join(drawn("v", "_sv"), "v").mapInArrow(_may_link(percent), "u long, v long, nu long, nv long")
    likely = materialize(likely, "likely-links")  # so that its size is known: narrow pairs go to the fragments while they are few
    arrays = fragments_of(likely.select(F.explode(F.array("u", "v")).alias("_node")).distinct())
    first = connected_components(linked_pairs(likely, arrays, percent), "first-links")
    discard(arrays)
    rest = _rest_links(ties, nodes, sketches, fragments_of, first, percent)
    discard(sketches)
    if rest is None:
        return first.select(F.col("id").alias("_node"), "root"), nodes
    rest = rest.select(F.col("id").alias("_first"), F.col("root").alias("_root"))
    every = nodes.select("_node").join(first.withColumnRenamed("id", "_node"), "_node", "left").withColumn("_first", F.coalesce("root", "_node"))
    return every.join(rest, "_first", "left").select("_node", F.coalesce("_root", "_first").alias("root")), nodes


def jaccard_components(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80
) -> DataFrame:
    """``docs`` -> ``(id, n_shingles, component_id)``: exact components of the pairs whose Jaccard similarity is
    at least ``percent`` / 100.

    1. Each text becomes a set of shingle hashes (64 bits) and equal sets become one node, so copies never pair.
    2. Every set is cut along the global order into fragments, common shingles left out (:class:`Cutter`); sets that
       share a fragment are candidates.  Each is tied to one other of them, so ties grow with the rows.
    3. Of each set, the ``PROBES`` ties with the most shared fragments are verified: partial overlaps are counted per
       fragment and summed per pair (:func:`linked_pairs`).  That alone joins most near copies, in linear work.
    4. Where ties are left between different components, all sets of such a candidate group that aren't yet of one
       component are compared in blocks (:func:`_rest_links`), so no link between different sets is lost.

    Before fragments are read, in 3. and in 4., sketches of two to four bits a shingle exclude what surely doesn't link
    (:func:`sketch_of`), so the 64 bits of each shingle are written and shuffled only for sets that may have a link.

    Null, empty and blank texts have no shingles and are components of their own.  Null ids keep their rows, but
    a set that only they hold links with none; repeated ids share a component; an empty table gives an empty result;
    other columns are ignored.  Node names are 64-bit digests: two different sets share one with odds of 2**-64.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    spark = docs.sparkSession
    common = spark.sparkContext.broadcast(common_shingles(rows, width))  # MOST_COMMON hashes at most
    schema = "_id long, _node long, _n long, _sigs array<long>, _whole array<long>"
    wide = materialize(rows.mapInArrow(_sets(width, percent, common), schema), "sets")
    ties, sets = materialize(_ties(wide), "ties"), materialize(wide.select("_id", "_node", "_n"), "nodes")
    discard(wide)  # the signatures, far larger than the rest
    joined, nodes = _component_roots(sets, ties, rows, width, percent)
    discard(ties)
    named = nodes.groupBy("_node").agg(F.min("_id").alias("_id")).join(joined, "_node", "left")
    named = named.withColumn("_top", F.coalesce("root", "_node"))
    least = named.groupBy("_top").agg(F.min("_id").alias("component_id"))
    by_node = named.join(least, "_top").select("_node", "component_id")
    full = sets.where("_node is not null").select("_id", "_node", "_n").join(by_node, "_node").select("_id", "_n", "component_id")
    bare = sets.where("_node is null").select("_id", "_n", F.col("_id").alias("component_id"))
    return full.union(bare).select(F.col("_id").alias(id_col), F.col("_n").alias("n_shingles"), "component_id")
