"""A corpus from raw documents to packed sequences.

Every stage takes ``(spark, docs, sf_dir)`` and gives a DataFrame; ``run``
writes each result to the shared folder and reads it back for the next, so a
lost executor costs no earlier stage. All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from forgeboard.llm import jaccard, packing, quality, toxicity
from forgeboard.llm.frames import prepare, table
from forgeboard.session import shared_dir, stage_in

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text and site speak for them."""
    prepare(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no word is tagged as toxic."""
    prepare(spark)
    return toxicity.without_toxic(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 0.8 of its five-word shingles."""
    prepare(spark)
    return jaccard.one_of_each(docs, width=5, percent=80)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences of 2048."""
    prepare(spark)
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_good),
    ("toxicity", drop_toxic),
    ("near copies", drop_near_copies),
    ("packing", pack),
]

#: Learnt models and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    stage = stage_in(shared_dir(spark, "pipeline"))
    for name, step in STAGES[:-1]:
        docs = stage(name.replace(" ", "-"), step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
