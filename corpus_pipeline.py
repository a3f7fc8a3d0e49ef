"""A training corpus from raw documents: five stages, each by one operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ballast.llm import bpe, decontam, langid, ngram_join, quality
from ballast.llm.common import staged, table
from ballast.llm.queries import vocabulary


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; those without letters or without a clear language go."""
    return langid.accepted(docs, langid.train(docs))


def worth(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are likely of the top grade; toxic ones and those of low quality go."""
    model = quality.train(docs, quality.ratings_of(table(spark, sf_dir, "labels")), 3)
    return quality.accepted(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest doc_id."""
    return ngram_join.representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number of tokens, and digests of the token ids and of the decoded bytes."""
    return bpe.round_trip(docs, *vocabulary())


STAGES = [
    ("language", language),
    ("quality", worth),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

#: The classifiers and the encoding can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
