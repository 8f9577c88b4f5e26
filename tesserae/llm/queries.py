"""The registered queries of the operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, license_scan, pii_crf, quality_rules, secret_scan, simhash, source_mix, substring_dedup, suffix_tree_lm, token_output
from .common import table

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    """The installed file of a public tokenizer, found where the driver runs and, at the same place, on the executors."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quality_rules.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return got.withColumn("rejected_by", F.array_join("rejected_by", ","))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix_report(table(spark, sf_dir, "documents"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_report(table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_passages(table(spark, sf_dir, "documents")).drop("kept")


def op5_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree_lm.score(table(spark, sf_dir, "documents"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"), ["doc_id"])


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_report(table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_report(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_crf.find_pii(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_license_scan, op2_quality_rules, op3_secret_scan, op4_simhash_near_dedup, op5_suffix_tree_lm, op6_decontaminate,
    op7_token_output, op8_source_mix, op9_substring_dedup, op10_pii_crf)}
