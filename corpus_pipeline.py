"""The corpus pipeline: language ID, quality rules, n-gram Jaccard join, mixing to target weights, byte-level BPE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyforge.llm import bpe, jaccard, langid, mixing, quality
from tallyforge.llm.common import persist, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is identified; texts without letters and those that fit no language better than another go."""
    return langid.identify(docs, langid.learn(docs), keep_from=langid.MIN_SCORE)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the counting rules and the classifier."""
    return quality.judge(docs, quality.fit(docs, table(spark, sf_dir, "labels")), keep_columns=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of documents linked by similarity, that with the smallest id."""
    return jaccard.distinct_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them."""
    return mixing.mix(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of each row."""
    return bpe.encode_decode(docs)


STAGES = [("language_id", language_id), ("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("mix_sources", mix_sources), ("byte_bpe", byte_bpe)]
#: Trained models and a tokenizer have no SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = persist(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
