"""The queries of this subpackage, one per operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, extraction, histogram_packing, mpeg, near_dedup, ngram_lm, packing, periodic_runs, quality, secrets, topk, vector_codes, warc
from .common import read
from .oracles import ORACLE_SQL as ORACLE_SQL

Query = Callable[[SparkSession, str], DataFrame]


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(read(spark, sf_dir, "pages"))


def op2_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages"))


def op3_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = ngram_lm.scores(read(spark, sf_dir, "documents"))
    return scored.withColumn("log10_score", F.round("log10_score", 4))


def op4_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = bpe.decode(bpe.encode(read(spark, sf_dir, "documents")))
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents"))


def op8_mpeg_audio_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = mpeg.from_media(mpeg.to_media(read(spark, sf_dir, "documents")))
    tail = F.expr("substring(payload, length(payload) - 15, 16)")
    return back.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(tail).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        "feature",
    )


def op9_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_linked_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(read(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.report(periodic_runs.planted(read(spark, sf_dir, "documents")))


def op12_histogram_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram_packing.pack(read(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    "op1_main_text": op1_main_text,
    "op2_warc_round_trip": op2_warc_round_trip,
    "op3_stupid_backoff": op3_stupid_backoff,
    "op4_bpe_encode_decode": op4_bpe_encode_decode,
    "op5_exact_top_k": op5_exact_top_k,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_minhash_near_dedup": op7_minhash_near_dedup,
    "op8_mpeg_audio_columns": op8_mpeg_audio_columns,
    "op9_subword_quality": op9_subword_quality,
    "op10_linked_secrets": op10_linked_secrets,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_histogram_packing": op12_histogram_packing,
    "op13_vector_codes": op13_vector_codes,
}
