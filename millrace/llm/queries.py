"""The registered query of each operator, with production parameters, and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import conversations, exact_search, near_dup, secret_scan, spelling, warc_zst
from millrace.llm.fingerprints import fingerprint_report
from millrace.llm.language_id import language_report
from millrace.llm.near_dup import near_duplicates
from millrace.llm.packing import pack_documents
from millrace.llm.quality_rules import quality_verdicts
from millrace.llm.secret_scan import secret_report
from millrace.llm.sentence_pieces import piece_report
from millrace.llm.sharding import shard_documents
from millrace.llm.token_counts import count_tokens
from millrace.plans.tables import read_table

TOKEN_LIMIT = 512


def _tokenizer_file(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read_table(spark, sf_dir, "documents"), shards=40)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"), capacity=8192)


def op3_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_search.search_report(read_table(spark, sf_dir, "embeddings"), every=20, k=20)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = count_tokens(read_table(spark, sf_dir, "documents"), _tokenizer_file("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", counted["n_tokens"] > TOKEN_LIMIT)


def op5_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), k=4, inner=80, union=100)


def op6_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_report(read_table(spark, sf_dir, "documents"), _tokenizer_file("piece_bpe_32k.model"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(read_table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(read_table(spark, sf_dir, "documents"))


def op9_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_zst.archive_report(read_table(spark, sf_dir, "pages"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_report(read_table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(read_table(spark, sf_dir, "documents"))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_report(read_table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_report(read_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_kd_sharding, op2_best_fit_packing, op3_exact_search, op4_token_counts, op5_minhash_near_dup,
        op6_sentence_pieces, op7_quality_rules, op8_secret_scan, op9_warc_zstd, op10_language_id,
        op11_spelling_variants, op12_fingerprints, op13_conversation_repair,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op3_exact_search": exact_search.ORACLE_SQL,
    "op5_minhash_near_dup": near_dup.ORACLE_SQL,
    "op8_secret_scan": secret_scan.ORACLE_SQL,
    "op9_warc_zstd": warc_zst.ORACLE_SQL,
    "op11_spelling_variants": spelling.ORACLE_SQL,
    "op13_conversation_repair": conversations.ORACLE_SQL,
}
