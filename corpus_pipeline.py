"""The training-data pipeline over `documents`: quality rules, near-dedup, decontamination, secret
redaction, and mixing, each stage on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import decontaminate, minhash_dedup, mixing, quality_rules, secret_scan
from tracewell.llm.common import keyed, stash, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned rules keep."""
    rules = quality_rules.learn(quality_rules.labelled_statistics(docs, table(spark, sf_dir, "labels")))
    judged = quality_rules.judge(docs.select(*COLUMNS, F.col("text").alias("body")), rules, "body", "lang", "source", "n_chars")
    # Written before it is filtered: a filter moved below the statistics would compute them for each use.
    judged = stash(judged, "judged")
    return judged.where("kept").withColumnRenamed("body", "text").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the first by doc_id; of rows that are equal in doc_id
    and text one stays, the least by its other columns, while rows that share a doc_id but not the
    text are documents of their own.  Rows without a doc_id stay."""
    lead = minhash_dedup.near_duplicates(docs).where("leader and doc_id is not null").select("doc_id", "version").distinct()
    named = keyed(docs, "lang", "source", "n_chars")
    kept = named.where("doc_id is not null").join(lead, ["doc_id", "version"], "left_semi")
    again = kept.where("version <> 0").groupBy("doc_id", "version").agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("row")).select("doc_id", "row.*")
    return kept.where("version = 0").select(*COLUMNS).unionByName(again.select(*COLUMNS)).unionByName(named.where("doc_id is null").select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within the edit budget."""
    return decontaminate.flag_items(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark")).where("not contaminated").drop("contaminated")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by their kinds; n_chars counts the new text."""
    return secret_scan.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with the words taken of each."""
    mixed = mixing.mix_sources(docs.select(*COLUMNS), keep=("text", "lang", "n_chars"))
    return mixed.where("taken > 0").select(*COLUMNS, "size", "source_size", F.round("target", 6).alias("target"), "taken")


STAGES = [
    ("quality rules", quality),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("secret scans", secrets),
    ("mixing sources to target weights", mixture),
]
#: Rules are learned and secrets linked by code that SQL does not express; the tests hold the pipeline
#: against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
