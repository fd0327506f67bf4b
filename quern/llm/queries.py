"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, license_scan, mixing, ngram_join, pieces, pii, quality_classifier, quality_rules, secret_scan, sql, url_filter


def _read(spark: SparkSession, sf_dir: str, table: str, *cols: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*cols)


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(_read(spark, sf_dir, "documents", "doc_id", "text"), words=3, percent=90)


#: The public model; its path is a parameter of op2_pieces, and of the environment.
PIECE_MODEL = os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


def op2_pieces(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    return pieces.encode(_read(spark, sf_dir, "documents", "doc_id", "text"), pieces.read_model(model or PIECE_MODEL))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_read(spark, sf_dir, "pages", "page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.apply_policy(quality_rules.ledger(_read(spark, sf_dir, "documents", "doc_id", "text")), quality_rules.STANDARD)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_read(spark, sf_dir, "documents", "doc_id", "text"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents", "doc_id", "text", "source"))


def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digest(license_scan.scan(_read(spark, sf_dir, "documents", "doc_id", "text")))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(_read(spark, sf_dir, "documents", "doc_id", "text")))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(_read(spark, sf_dir, "documents", "doc_id", "text"), _read(spark, sf_dir, "labels", "doc_id", "quality"))


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents come in two steps to a ledger of this run; the second scans only blobs that the first hasn't met."""
    return secret_scan.digest(secret_scan.scan(_read(spark, sf_dir, "documents", "doc_id", "text"), increments=2))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_ngram_join": op1_ngram_join, "op2_pieces": op2_pieces, "op3_url_filters": op3_url_filters, "op4_quality_rules": op4_quality_rules, "op5_license_scans": op5_license_scans, "op6_pii": op6_pii, "op7_exact_dedup": op7_exact_dedup, "op8_quality_classifier": op8_quality_classifier, "op9_secret_scans": op9_secret_scans, "op10_mixing": op10_mixing}


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_join": sql.NGRAM_JOIN, "op3_url_filters": sql.url_filters(), "op4_quality_rules": sql.QUALITY_RULES, "op7_exact_dedup": sql.EXACT_DEDUP}
