"""The corpus pipeline: stages over documents, each on all that its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written and read again before the next. All stages but the last return the
columns of the documents; the last tells where each piece of each document
stands in the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillframe.llm import decontam, langid, packing, passages, simhash
from quillframe.llm.common import Workspace, table
from quillframe.llm.queries import tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language models of all documents that name a language; documents that they reject go."""
    return langid.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash class stays: the one with the least id, and one row of it."""
    return simhash.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that several documents share stay in the first; documents that were nothing else go."""
    return passages.without_passages(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of ten words of a benchmark item go."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document that is left, in sequences."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontaminated", decontaminated),
    ("packed", packed),
]

#: SQL cannot express language models, SimHash and packing; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, over the table of documents."""
    docs = table(spark, sf_dir, "documents")
    ws = Workspace(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = ws.save(docs, name)
    return docs
