"""The ten registered queries; each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jaccard, licenses, lines, neardup, packing, ring, segment, tokens, toxicity, vafile
from .storage import shared_dir

WORDS = "word_bpe_49k.json"
SENTENCES = "piece_bpe_32k.model"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    home = f"{shared_dir(spark)}/token-cache/{hashlib.sha256(sf_dir.encode()).hexdigest()[:16]}"
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = tokens.count_tokens(docs, tokenizer_path(WORDS), cache_path=home)
    return counted.withColumn("over_limit", F.col("n_tokens") > 2048)


def op2_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = ring.shard_bounded(_table(spark, sf_dir, "documents").select("doc_id", "text"), shards=16)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op3_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "text_digest", "license", F.array_join("line_licenses", ",").alias("line_licenses"))


def op4_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select(
        "doc_id", F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False)).alias("held_out"),
        F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.3).cast("int").alias("predicted"),
        (F.col("toxicity") >= toxicity.threshold_column(model, F.col("lang"))).alias("rejected"),
    )


def op5_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.sample_segmentations(_table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path(SENTENCES), k=2)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_best_fit(_table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path(WORDS))


def op7_jaccard_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents").select("doc_id", "text"), width=3, percent=90)


def op8_va_file_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vafile.top_k(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), every=50, k=5)


def op9_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = lines.dedup_lines(docs.withColumn("n_lines", F.size(F.split(F.coalesce("text", F.lit("")), "\n"))))
    return found.select(
        "doc_id", "n_lines", F.array_join("removed_lines", ",").alias("removed_lines"),
        F.md5(F.coalesce("text", F.lit(""))).alias("kept_md5"),
    )


def op10_vector_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), cosine=0.9)


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_bounded_ring, op3_license_digests, op4_toxicity_cnn, op5_sampled_pieces, op6_best_fit_packing,
        op7_jaccard_fragments, op8_va_file_top_k, op9_line_runs, op10_vector_cells,
    )
}
