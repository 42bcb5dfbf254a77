"""Queries op1 to op13 over the tables of a folder, each thin: its operator does the work."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, context_mixing, decontaminate, hard_negatives, license_scan, minhash_dedup, mixing, quality_rules, secret_scan, substring_dedup, suffix_dedup, toxicity, warc_zip
from .common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    field = toxicity.learn(toxicity.training_rows(docs, table(spark, sf_dir, "labels")))
    scored = toxicity.score_texts(docs, field)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", F.to_json("spans").alias("spans"))


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), size=4).select("doc_id", "n_shingles", "component_id", "kept")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_passages(table(spark, sf_dir, "documents"), texts=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = quality_rules.learn(quality_rules.labelled_statistics(docs, table(spark, sf_dir, "labels")))
    return quality_rules.judge(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op8_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    packages = warc_zip.write_packages(table(spark, sf_dir, "pages"), warc_zip.package_folder(spark))
    return warc_zip.read_packages(packages, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_bytes(table(spark, sf_dir, "documents"), texts=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_mixing.score_texts(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine_negatives(table(spark, sf_dir, "embeddings"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(table(spark, sf_dir, "embeddings")).drop("centroid")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_minhash_dedup": op2_minhash_dedup,
        "op3_decontaminate": op3_decontaminate,
        "op4_substring_dedup": op4_substring_dedup,
        "op5_quality_rules": op5_quality_rules,
        "op6_mix_sources": op6_mix_sources,
        "op7_license_scan": op7_license_scan,
        "op8_warc_zip": op8_warc_zip,
        "op9_secret_scan": op9_secret_scan,
        "op10_suffix_dedup": op10_suffix_dedup,
        "op11_lm_scoring": op11_lm_scoring,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_centroids": op13_centroids,
    }
