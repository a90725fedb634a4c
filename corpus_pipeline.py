"""A corpus from documents: clear language, one of each group of near copies, no benchmark texts, no personal data,
encoded. Each stage is written as Parquet in the shared folder and read again, so a lost executor costs one stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textgauge.llm import bpe, decontaminate, language, neardup, pii
from textgauge.llm.common import shared_path, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear, by what the labelled ones among them teach."""
    return language.keep_identified(docs, language.learn(language.training_rows(docs)))


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that n-gram Jaccard similarity of 0.8 or more connects."""
    return neardup.keep_one(docs)


def remove_benchmark_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with spans of personal data replaced by their kind."""
    return pii.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids per document, with their number and the digests of the ids and of the decoded bytes."""
    return bpe.encode_rows(docs)


STAGES = [
    ("language", identify_language),
    ("near copies", remove_near_copies),
    ("decontamination", remove_benchmark_texts),
    ("personal data", mask_personal_data),
    ("byte-level BPE", encode),
]

#: SQL cannot express the language and personal data models; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; the result is that of the last one."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = shared_path(spark, f"stage-{i + 1}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
