"""The corpus pipeline: documents to packed training sequences, in five stages.

Each stage is a function ``(spark, docs, sf_dir) -> DataFrame``; its result is written as
Parquet and read again as the next one's ``docs``. All stages but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.language_id import NOISE_FROM, UNKNOWN, fit_floors, fit_profiles, length_class, predict_languages
from millrace.llm.near_dup import drop_near_duplicates
from millrace.llm.packing import pack_documents
from millrace.llm.quality_rules import quality_verdicts
from millrace.llm.secret_scan import redact_secrets
from millrace.plans.scratch import Scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language: those whose cosine with its prototype reaches the floor
    that the labelled rows of like length give (``fit_floors``). Prototypes and floors are
    learned from all labelled rows that are not held out.

    The predicted language replaces a missing label, and any other label that it
    contradicts on 64 characters or more; fewer decide nothing against a label."""
    profiles = fit_profiles(docs, rows_per_language=None)
    found = predict_languages(docs.select(*COLUMNS), profiles).where(F.col("lang_pred") != UNKNOWN)
    if not profiles:
        return found.select(*COLUMNS)
    floors = F.create_map(*[x for lang, own in fit_floors(docs, profiles).items() for x in (F.lit(lang), F.array(*map(F.lit, own)))])
    size = length_class(F.col("text"))
    found = found.where(F.col("score") >= F.get(F.element_at(floors, F.col("lang_pred")), size))
    lang = F.when(size >= NOISE_FROM, F.col("lang_pred")).otherwise(F.coalesce("lang", "lang_pred"))
    return found.withColumn("lang", lang).select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source."""
    return quality_verdicts(docs, keep=tuple(COLUMNS)).where("kept").select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 80 % of its five-word shingles: the least id."""
    return drop_near_duplicates(docs.select(*COLUMNS), k=5)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark."""
    return redact_secrets(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document's pieces go in the training sequences."""
    return pack_documents(docs, capacity=8192)


STAGES = [
    ("language_id", language_stage),
    ("quality_rules", quality_stage),
    ("minhash_near_dup", near_duplicate_stage),
    ("secret_scan", secret_stage),
    ("best_fit_packing", packing_stage),
]

ORACLE_SQL = None  # learned profiles, robust estimates and packing are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.save(docs, name)
            if k:
                scratch.drop(STAGES[k - 1][0])
    return docs
