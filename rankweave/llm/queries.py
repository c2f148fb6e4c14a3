"""Queries of the training-data operators for the driver: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rankweave.llm import decontaminate, fingerprint, html_extract, license_scan, line_dedup, near_dup, packing, phrases, quality, secrets, spelling, suffix_dedup, warc
from rankweave.llm.common import table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"))


def op6_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removed(table(spark, sf_dir, "documents"))


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve_revisits(warc.captures(table(spark, sf_dir, "pages")))
    return found.withColumn("headers", warc.header_text("headers"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_quality": op1_quality, "op2_license": op2_license, "op3_lines": op3_lines, "op4_suffix": op4_suffix, "op5_pack": op5_pack, "op6_near": op6_near, "op7_fingerprint": op7_fingerprint, "op8_html": op8_html, "op9_warc": op9_warc, "op10_decontaminate": op10_decontaminate, "op11_phrases": op11_phrases, "op12_secrets": op12_secrets, "op13_spelling": op13_spelling}


def oracle_sql() -> dict[str, str]:
    return {"op4_suffix": suffix_dedup.ORACLE_SQL, "op9_warc": warc.ORACLE_SQL, "op10_decontaminate": decontaminate.ORACLE_SQL, "op11_phrases": phrases.ORACLE_SQL, "op12_secrets": secrets.ORACLE_SQL, "op13_spelling": spelling.ORACLE_SQL}
