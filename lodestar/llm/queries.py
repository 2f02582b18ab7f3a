"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestar.llm import decontamination, fingerprints, language_id, line_dedup, near_dedup, packing, secrets, substring_dedup, url_filter, warc
from lodestar.llm.common import table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.near_texts(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(table(spark, sf_dir, "documents"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_document_fingerprints,
        op3_line_dedup,
        op4_url_filter,
        op5_substring_dedup,
        op6_warc,
        op7_benchmark_decontamination,
        op8_secret_scan,
        op9_minhash_near_dedup,
        op10_language_id,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op2_document_fingerprints": fingerprints.ORACLE_SQL,
    "op3_line_dedup": line_dedup.ORACLE_SQL,
    "op4_url_filter": url_filter.ORACLE_SQL,
    "op5_substring_dedup": substring_dedup.ORACLE_SQL,
    "op6_warc": warc.ORACLE_SQL,
    "op7_benchmark_decontamination": decontamination.ORACLE_SQL,
    "op8_secret_scan": secrets.ORACLE_SQL,
}
