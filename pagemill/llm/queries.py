"""The registered queries of this package, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import langid, licenses, mixing, packing, quality, quality_rules, simhash, suffix_dedup, toxicity, winnowing
from pagemill.llm.shared import crc_mod, documents


def fold(of: int, held: int) -> Column:
    """Whether a doc_id's row is held out of learning."""
    return F.coalesce(crc_mod("doc_id", of) == held, F.lit(False))


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = langid.predict(docs, langid.fit(docs.where(crc_mod("doc_id", 3) != 1)))
    return found.select("doc_id", fold(3, 1).alias("held_out"), "lang_pred", "score", "distance", "rejected")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = documents(spark, sf_dir, "labels").where(crc_mod("doc_id", 4) != 2).select("doc_id", F.col("quality").alias("y"))
    return quality.score(documents(spark, sf_dir), labels).select("doc_id", fold(4, 2).alias("held_out"), "score", "predicted")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(documents(spark, sf_dir))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = documents(spark, sf_dir, "labels").where(crc_mod("doc_id", 3) != 1).select("doc_id", F.col("toxic").alias("y"))
    return toxicity.predict(docs, toxicity.fit(docs, labels)).select("doc_id", fold(3, 1).alias("held_out"), "score", "predicted")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(documents(spark, sf_dir)).select("doc_id", *quality_rules.COUNTS[:5], "base_failed", "kept", F.array_join("failed_rules", ",").alias("failed_rules"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir)).select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.fingerprint(documents(spark, sf_dir))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language": op1_language,
    "op2_quality": op2_quality,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_toxicity": op4_toxicity,
    "op6_quality_rules": op6_quality_rules,
    "op5_mixing": op5_mixing,
    "op10_packing": op10_packing,
    "op7_licenses": op7_licenses,
    "op8_fingerprints": op8_fingerprints,
    "op9_simhash": op9_simhash,
}

ORACLE_SQL: dict[str, str] = {"op6_quality_rules": quality_rules.sql(), "op8_fingerprints": winnowing.sql()}
