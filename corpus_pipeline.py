"""The corpus pipeline: five stages, each on all that the one before kept.

Every stage's result is written to the folder that spark.checkpoint.dir names
and read back, so a lost executor never reaches past one stage.

Nulls and odd cases, by stage: a null or empty text has no words, so the quality
rules reject it; for the other stages it is an ordinary document (one of all empty
ones stays, none is contaminated, its size is 0, its tokens are the end id alone).
A null id, source or language is carried as a value of its own. Of repeated rows
one stays. An empty table stays empty. All stages but the last keep the columns of
their documents, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesserae.llm.common import materialize, table
from tesserae.llm.decontaminate import clean_documents
from tesserae.llm.near_dedup import drop_near_duplicates
from tesserae.llm.quality_rules import keep_good
from tesserae.llm.queries import tokenizer_path
from tesserae.llm.source_mix import mix_documents
from tesserae.llm.token_output import token_report


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base and the risk-controlled rules accept."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the source mix takes them."""
    return mix_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in binary shards, read back: place, size and checksum of every document."""
    return token_report(docs, tokenizer_path())


STAGES = [("quality_rules", quality), ("near_dedup", near_duplicates), ("decontaminate", decontaminate), ("source_mix", mix), ("token_output", tokens)]

#: Hash families, certified cutoffs and a tokenizer are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
