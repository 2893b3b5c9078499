"""The registered queries of this subpackage: each applies one operator to a whole table and derives its digest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import contamination, extraction, jaccard, language, licenses, minhash, mixing, quality, recompression, resampling, secrets, spelling, warc
from lexmill.llm.tables import read


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = recompression.dedup_substrings(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard(read(spark, sf_dir, "documents"), shingle=3, percent=90)


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(read(spark, sf_dir, "pages"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(read(spark, sf_dir, "documents"))


def op5_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return warc.audit(pages, warc.damaged(pages))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("items")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(read(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licenses(read(spark, sf_dir, "documents"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).drop("source")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), shingle=4, percent=80)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read(spark, sf_dir, "documents"), damage=spelling.DAMAGE)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_substring_dedup, op2_jaccard_join, op3_html_extraction, op4_secret_scan, op5_warc_fixity, op6_decontamination, op7_quality_rules, op8_language_id, op9_license_scan, op10_source_mixing, op11_importance_resampling, op12_minhash_dedup, op13_spelling_variants)}

ORACLE_SQL: dict[str, str] = {"op5_warc_fixity": warc.ORACLE, "op7_quality_rules": quality.ORACLE, "op9_license_scan": licenses.oracle(), "op11_importance_resampling": resampling.ORACLE, "op13_spelling_variants": spelling.ORACLE}
