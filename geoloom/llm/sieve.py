"""A bitmap of hashed keys that every task holds, so that rows that surely have no partner don't take part in a join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 26  # 8 MB, whatever the number of keys; a fuller bitmap only lets more rows through


def sift(rows: DataFrame, key: Column, keys: DataFrame, by: Column) -> tuple[DataFrame, DataFrame]:
    """``rows`` in two: those whose ``key`` may equal a value ``by`` of ``keys``, and those whose doesn't.

    No key is lost: equal values have equal bits.  The bitmap has ``BITS`` bits in parts of 4 KB, so what is broadcast
    doesn't grow with the keys; with many more keys than bits all rows may go to the first table.  Neither table shuffles
    ``rows``; their columns are kept.  Null keys are in the second.
    """
    bit = lambda c: F.pmod(F.xxhash64(c, F.lit(17)), F.lit(BITS))
    held = keys.where(by.isNotNull()).select(bit(by).alias("_bit"))
    maps = held.groupBy(F.bitmap_bucket_number("_bit").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_bit")).alias("_map"))
    at = F.bitmap_bit_position("_bit")
    byte = F.conv(F.hex(F.substring("_map", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = F.coalesce(byte.bitwiseAND(F.pow(F.lit(2), at % 8).cast("int")) != 0, F.lit(False))
    packed = rows.select(F.struct(*[rows[c] for c in rows.columns]).alias("_row"), F.when(key.isNotNull(), bit(key)).alias("_bit"))
    marked = packed.withColumn("_bucket", F.bitmap_bucket_number("_bit")).join(F.broadcast(maps), "_bucket", "left").withColumn("_found", found)
    return marked.where("_found").select("_row.*"), marked.where("not _found").select("_row.*")
