"""Operator 2: consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations only."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .storage import materialize

SEGMENT = T.StructType([T.StructField(n, T.LongType()) for n in ("_arc", "_low", "_high", "_shard", "_base")])


def ring_arcs(shards: int, virtual_nodes: int, bits: int = 14) -> list[int]:
    """Owner of each of 2**bits equal slices of the ring: the first virtual node at or clockwise of the slice."""
    size = 1 << bits
    points = sorted(
        (int.from_bytes(hashlib.sha256(f"{s}/{v}".encode()).digest()[:8], "big") % size, s)
        for s in range(shards) for v in range(virtual_nodes)
    )
    out, at = [], 0
    for i in range(size):
        while at < len(points) and points[at][0] < i:
            at += 1
        out.append(points[at % len(points)][1])
    return out


def plan_bounded(counts: list[int], owners: list[int], capacities: list[int]) -> list[tuple[int, int, int, int]]:
    """``(arc, low, high, shard)``: ranks low..high-1 of an arc go to a shard.

    Arcs are visited round by round: in round r what is left of arc a asks the r-th distinct shard clockwise of
    it; a shard takes ranks in arc order until it is full, and the rest moves on.  Only counts enter the plan.
    """
    n, shards = len(counts), len(capacities)
    room, done, left, out = list(capacities), [0] * n, list(counts), []
    walk = []
    for a in range(n):
        seen, order = set(), []
        for step in range(n):
            s = owners[(a + step) % n]
            if s not in seen:
                seen.add(s)
                order.append(s)
                if len(order) == shards:
                    break
        walk.append(order)
    for r in range(shards):
        for a in range(n):
            if left[a] and r < len(walk[a]) and (take := min(left[a], room[s := walk[a][r]])):
                out.append((a, done[a], done[a] + take, s))
                done[a] += take
                left[a] -= take
                room[s] -= take
        if not any(left):
            break
    return out


def shard_bounded(
    rows: DataFrame, *, key: str = "doc_id", text_col: str = "text", shards: int = 16, virtual_nodes: int = 64, bucket_rows: int = 8192
) -> DataFrame:
    """``rows`` -> ``(key, size, text_crc32, shard, slot)`` under the law ``rows``: shard counts differ by one at most.

    A key's place on the ring is a hash of the key; the ring's fixed slices merge into at most ``shards *
    virtual_nodes`` arcs.  Loads are bounded by floor or ceiling of rows / shards, and an arc's ranks beyond a
    full shard continue clockwise to the next shard with room.  The driver sees one count per arc and nothing
    else.  Ranks within an arc are clockwise; they come from fine slices of about ``bucket_rows`` rows, whose number grows
    with the input.  A slice that one key fills is dealt on by a hash of the row, and equal rows are counted before they
    are dealt and unfolded afterwards, so one key or copy that makes up a third of the rows lands in no single task.  ``slot`` numbers a shard's rows from 0 without gaps.
    Size is the UTF-8 bytes of the text plus 1, null text being empty (size 1, CRC 0).  Null keys share one
    place; repeated rows get slots of their own; an empty table gives an empty result; other columns are ignored.
    """
    spark = rows.sparkSession
    bits = 14
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    narrow = rows.select(
        F.col(key).alias("_key"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    place = F.xxhash64(F.coalesce(F.col("_key").cast("string"), F.lit("\0")), F.lit("ring"))
    folded = materialize(
        narrow.groupBy("_key", "size", "text_crc32").agg(F.count("*").alias("_copies")).withColumn("_place", place), "ring"
    )
    owners = ring_arcs(shards, virtual_nodes, bits)
    #: Slices with the same owner in a row are one arc.
    arc_of, arcs = [], []
    for o in owners:
        if not arcs or arcs[-1] != o:
            arcs.append(o)
        arc_of.append(len(arcs) - 1)
    slice_of = F.shiftrightunsigned("_place", 64 - bits).cast("int")
    slices = F.broadcast(spark.createDataFrame(list(enumerate(arc_of)), "_slice int, _arc int"))  # 2**bits rows
    folded = folded.withColumn("_slice", slice_of).join(slices, "_slice").drop("_slice")
    counts = [0] * len(arcs)
    for r in folded.groupBy("_arc").agg(F.sum("_copies").alias("n")).collect():  # one row per arc, a fixed number
        counts[r["_arc"]] = r["n"]
    total = sum(counts)
    capacities = [total // shards + (s < total % shards) for s in range(shards)]
    plan, filled = [], [0] * shards
    for a, low, high, s in plan_bounded(counts, arcs, capacities):
        plan.append((a, low, high, s, filled[s]))
        filled[s] += high - low
    segments = F.broadcast(spark.createDataFrame(plan, SEGMENT))  # a fixed bound: arcs times shards
    # finer slices of the ring, in clockwise order; how fine they are changes no rank
    more = max(0, min(30, (-(-total // (bucket_rows << bits)) - 1).bit_length()))
    folded = folded.withColumn("_slice", F.shiftrightunsigned("_place", 64 - bits - more))
    # one key may fill a slice with rows of many texts: such a slice is dealt on by a hash of the whole row
    folded = folded.withColumn("_mark", F.xxhash64("_place", "size", "text_crc32"))
    full = folded.groupBy("_arc", "_slice").agg(F.count("*").alias("_rows")).where(F.col("_rows") > 4 * bucket_rows)
    full = full.select("_arc", "_slice", F.ceil(F.log2(F.col("_rows") / bucket_rows)).cast("int").alias("_deep"))
    folded = folded.join(full, ["_arc", "_slice"], "left").withColumn(
        "_part", F.when(F.col("_deep").isNull(), F.lit(0).cast("long")).otherwise(F.expr("shiftrightunsigned(_mark, 64 - _deep)"))
    )
    bucket = ["_arc", "_slice", "_part"]
    tally = folded.groupBy(*bucket).agg(F.sum("_copies").alias("_n"))
    before = Window.partitionBy("_arc").orderBy("_slice", "_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = tally.select(*bucket, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*bucket).orderBy("_place", "_key", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        folded.withColumn("_before", F.coalesce(F.sum("_copies").over(inside), F.lit(0)))
        .join(offsets, bucket)
        .withColumn("_from", F.col("_offset") + F.col("_before"))
    )
    #: Copies unfold in chunks, so that no array is long.
    step = 4096
    unfolded = ranked.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_copies") - 1) / step)))).withColumn(
        "_rank",
        F.explode(
            F.sequence(
                F.col("_from") + F.col("_chunk") * step,
                F.col("_from") + F.least((F.col("_chunk") + 1) * step, F.col("_copies")) - 1,
            )
        ),
    )
    placed = unfolded.join(segments, "_arc").where("_rank >= _low and _rank < _high")
    return placed.select(
        F.col("_key").alias(key), "size", "text_crc32", F.col("_shard").cast("int").alias("shard"),
        (F.col("_base") + F.col("_rank") - F.col("_low")).alias("slot"),
    )

