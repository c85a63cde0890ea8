"""The corpus pipeline: from raw documents to packed training sequences.

Each stage gets what its predecessor kept, written as Parquet and read again, and decides over all of it. All but the
last return the columns of `documents` unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gatesift.llm import decontam, exact_dedup, jaccard, packing, toxicity
from gatesift.llm.common import saved
from gatesift.llm.registry import table, vocabulary


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents which the lexicon model, learned from the labels, does not reject."""
    return toxicity.drop_toxic(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal up to white space the one with the smallest id."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 on five-word shingles the one with the smallest id."""
    return jaccard.drop_linked(docs, words=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of the benchmark."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 1024 tokens, with their ids."""
    return packing.pack(docs, vocabulary())


STAGES = [
    ("toxicity", reject_toxic),
    ("exact dedup", drop_copies),
    ("n-gram jaccard", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack),
]
# Learned weights and token ids are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = saved(docs)
    return docs
