"""Connected components by alternating stars, distributed throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, materialize

SHARES = 64  # parts into which the edges of a vertex are dealt where one vertex has many


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*").alias("n"),
        F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s"),
    ).first()
    return row["n"], row["s"]


def _least(edges: DataFrame, own: bool) -> DataFrame:
    """``(u, m)``: the smallest neighbour of each vertex, or itself if that is smaller and ``own``."""
    low = F.min("v")
    return edges.groupBy("u").agg((F.least(low, F.col("u")) if own else low).alias("m"))


def _beside_least(edges: DataFrame, own: bool, hot: bool) -> DataFrame:
    """``edges`` with ``m``.  Where a vertex is hot, each vertex's edges are dealt to shares by their other end and its
    minimum goes to the shares it has, so its edges spread over as many tasks; others have a share or two."""
    if not hot:
        return edges.join(_least(edges, own), "u")
    dealt = edges.withColumn("_s", F.pmod(F.xxhash64("v"), F.lit(SHARES)))
    held = dealt.groupBy("u", "_s").agg(F.min("v").alias("v"))
    low = F.min("v")
    shares = held.groupBy("u").agg((F.least(low, F.col("u")) if own else low).alias("m"), F.collect_list("_s").alias("_all"))
    return dealt.join(shares.select("u", "m", F.explode("_all").alias("_s")), ["u", "_s"]).drop("_s")


def connected_components(edges: DataFrame, name: str = "components", max_rounds: int = 60) -> DataFrame:
    """``edges(u, v)`` -> ``(id, root)`` for every id on an edge; root is the smallest id of its component.

    Alternating large and small stars (Kiveris et al., 2014): every round rewrites each edge towards the
    smallest neighbour, so paths shorten geometrically.  Minima are pre-aggregated before each shuffle.  A star
    whose centre touches more than one in ``SHARES`` edges is dealt to shares, so it doesn't land in one task.
    Each round's table replaces the one before.  Loops and nulls are ignored; an empty edge table gives an empty result.
    """
    current = materialize(
        edges.where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        name,
    )
    before = _state(current)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        degree = current.groupBy("v").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
        hot = degree * SHARES > max(before[0], 10_000)
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _beside_least(both, True, hot).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = (
            _beside_least(large, False, False).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
            .union(_least(large, False).select("u", F.col("m").alias("v")))
            .distinct()
        )
        old, current = current, materialize(small, name)
        discard(old)
        after = _state(current)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    leaf = current.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return leaf.union(current.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
