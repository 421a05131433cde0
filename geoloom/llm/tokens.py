"""Operator 1: token counts through a digest cache."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .held import slices
from .storage import exists, new_path
from .wordbpe import drops_white_space, encoder, tokenizer_version

SPACES = "[ \\t\\n\\x0B\\f\\r]+"


def content_digest(text, spaced: bool = False):
    """128 bits of SHA-256 over the content.  Unless ``spaced``, that is normalised: runs of ASCII white space are one
    space, none at the ends, which is right for tokenizers that drop white space."""
    whole = F.coalesce(text, F.lit(""))
    return F.unhex(F.substring(F.sha2(whole if spaced else F.trim(F.regexp_replace(whole, SPACES, " ")), 256), 1, 32))


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode_all
        for batch in batches:
            for part in slices(batch):
                counts = [len(ids) // 4 for ids in encode(part.column("_text").to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column("_digest"), pa.array(counts, pa.int64())], ["_digest", "_n"])

    return run


def count_tokens(
    docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", cache_path: str | None = None
) -> DataFrame:
    """``docs`` -> ``(id, n_bytes, n_tokens)``; counts of unseen contents are appended to the cache.

    The cache holds ``(_digest, _n)`` in one folder for each tokenizer version; digests are of the exact content where
    the tokenizer heeds white space.  Distinct digests are found by a
    pre-aggregated group-by, joined against the cache, and only the misses' texts are encoded: one stored row
    stands for all copies, so a text that makes up a third of the rows is encoded once.  The last join is a
    plain equi-join, whose hot digests adaptive execution splits.  Null text counts as empty (0 bytes, 0
    tokens); repeated and null ids keep their rows; an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    home = f"{cache_path or new_path(spark, 'token-cache')}/{tokenizer_version(tokenizer_path)}"
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    spaced = not drops_white_space(tokenizer_path)
    home += "-spaced" * spaced
    keyed = rows.withColumn("_digest", content_digest(F.col("_text"), spaced))
    kept_ids = F.coalesce(F.xxhash64("_id"), F.lit(0))
    wanted = keyed.groupBy("_digest").agg(F.min(kept_ids).alias("_at"))
    stored = _cache(spark, home)
    if stored is not None:
        wanted = wanted.join(stored.select("_digest"), "_digest", "left_anti")
    misses = (
        keyed.withColumn("_at", kept_ids)
        .join(wanted, ["_digest", "_at"], "left_semi")
        .select("_digest", "_text")
    )
    misses.mapInArrow(_encode(tokenizer_path), "_digest binary, _n long").write.mode("append").parquet(home)
    # rows that are repeated whole are stored twice; the join needs the same dealing by digest
    counts = _cache(spark, home).groupBy("_digest").agg(F.max("_n").alias("_n"))
    sized = keyed.select("_id", F.octet_length(F.coalesce("_text", F.lit(""))).cast("long").alias("n_bytes"), "_digest")
    return sized.join(counts, "_digest").select(F.col("_id").alias(id_col), "n_bytes", F.col("_n").alias("n_tokens"))


def _cache(spark: SparkSession, home: str) -> DataFrame | None:
    return spark.read.schema("_digest binary, _n long").parquet(home) if exists(spark, home) else None
