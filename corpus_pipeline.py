"""The corpus pipeline: five stages over ``documents``, each one operator of
``churnlytics.llm``. Every function takes (spark, docs, sf_dir); all but the
last return the columns of ``docs``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from churnlytics.llm.common import read, store
from churnlytics.llm.decontaminate import decontaminate
from churnlytics.llm.minhash import drop_near_duplicates
from churnlytics.llm.packing import pack_documents
from churnlytics.llm.substrings import dedup_substrings
from churnlytics.llm.toxicity import drop_toxic, train_chain


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, fitted on ``labels``, rejects go."""
    return drop_toxic(docs, train_chain(docs, read(spark, sf_dir, "labels")))


def minhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the smallest id."""
    return drop_near_duplicates(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand in an earlier document are cut out of the texts."""
    return dedup_substrings(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a 10-word window of ``benchmark`` go."""
    return decontaminate(docs, read(spark, sf_dir, "benchmark"), n=10, mode="document")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces of sequences of at most 2048 tokens."""
    return pack_documents(docs, capacity=2048)


STAGES = [("toxicity", toxicity), ("minhash", minhash), ("substrings", substrings),
          ("decontamination", decontamination), ("packing", packing)]

# Trained models, signatures and tokenizers are beyond SQL; tests/llm holds the
# stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's result written and reread."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
