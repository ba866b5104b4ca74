"""A training corpus from raw documents: filter, deduplicate, decontaminate, pack.

Every stage reads all that the one before it kept, written as Parquet in the shared
folder, so a lost executor costs at most its part of one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from colophon.llm import language, toxicity
from colophon.llm.common import read, stored
from colophon.llm.decontaminate import decontaminated
from colophon.llm.near import one_of_similar
from colophon.llm.packing import pack_documents
from colophon.llm.queries import tokenizer_file

#: Least score of a document's language: below, letters of no one language prevail.
LEAST_LANGUAGE_SCORE = 0.25


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or without a prevailing language, go."""
    return language.in_known_language(docs, language.train(docs), LEAST_LANGUAGE_SCORE)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents judged toxic by their nearest labelled examples go."""
    return toxicity.without_toxic(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked by a similarity of 0.8 the document of the smallest doc_id stays."""
    return one_of_similar(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontaminated(docs, read(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, each with its sequence and offset."""
    return pack_documents(docs, tokenizer_file())


STAGES = [
    ("language_id", language_id),
    ("toxicity", toxicity_filter),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: SQL cannot state the models; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
