"""A training corpus from raw documents, in five stages: each is one operator, written and reread before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkloom.llm import common
from inkloom.llm.decontaminate import without_overlaps
from inkloom.llm.neardup import without_near_copies
from inkloom.llm.packing import pack
from inkloom.llm.pii import redacted
from inkloom.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores under 0.5; it learns from labels of documents that aren't held out."""
    return without_toxic(docs, common.table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: the one of least doc_id."""
    return without_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an overlap with a benchmark item."""
    return without_overlaps(docs, common.table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their personal data replaced by its kind in brackets; n_chars is the new length."""
    return redacted(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens, neighbours on the space-filling curve together: one row for each piece."""
    return pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: The classifier, the sketches and the tokenizer can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table documents; every stage's rows are written to the shared folder and read again.

    A stage's table is deleted when the next one's is written.
    """
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, common.written(stage(spark, docs, sf_dir), f"stage-{name}")
        common.release(before)
    return docs
