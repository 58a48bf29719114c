"""The opN queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinmesh.llm import html_crf, licenses, mixing, near_dup, packing, quality, rans, secrets, tiff, warc
from kinmesh.llm.shared import table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(table(spark, sf_dir, "documents"))


def op2_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_derivatives(table(spark, sf_dir, "pages"))


def op3_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.media_report(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_simhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicate_groups(table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op7_html_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_crf.extract_text(table(spark, sf_dir, "pages"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_documents(table(spark, sf_dir, "documents"))


def op9_weighted_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op10_rans_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans.token_file_report(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for n, f in sorted(globals().items()) if n.startswith("op") and n[2].isdigit()}
ORACLES: dict[str, str] = {"op9_weighted_fair_mix": mixing.SQL}
