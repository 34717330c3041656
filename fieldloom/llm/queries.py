"""Registered queries of the training-data operators and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jaccard, licenses, lines, media, merkle, mixing, negatives, packing, quality, secrets, sentencepiece_codec, simhash, toxicity
from .common import read_table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return toxicity.score(docs, toxicity.fit(docs, labels))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.edited_report(read_table(spark, sf_dir, "documents"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return secrets.digests(secrets.scan(docs, secrets.train(secrets.default_samples(docs))))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents"), licenses.known_digests(spark))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.digests(read_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return quality.score(docs, quality.fit(docs, labels))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: how many ranges of it went, and size and digest of what remains."""
    kept = lines.dedup(read_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_removed", F.length("text").cast("long").alias("n_chars_kept"), F.sha2("text", 256).alias("text_sha256"))


def op9_media_avi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.round_trip(read_table(spark, sf_dir, "documents"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked(read_table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest_report(read_table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, negatives.shifted_label())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_simhash": op2_simhash,
        "op3_secrets": op3_secrets,
        "op4_licenses": op4_licenses,
        "op5_sentencepiece": op5_sentencepiece,
        "op6_quality": op6_quality,
        "op7_packing": op7_packing,
        "op8_line_dedup": op8_line_dedup,
        "op9_media_avi": op9_media_avi,
        "op10_jaccard_join": op10_jaccard_join,
        "op11_mixing": op11_mixing,
        "op12_merkle_manifest": op12_merkle_manifest,
        "op13_hard_negatives": op13_hard_negatives,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_licenses": licenses.oracle_sql(), "op11_mixing": mixing.oracle_sql(), "op12_merkle_manifest": merkle.oracle_sql(), "op13_hard_negatives": negatives.oracle_sql()}
