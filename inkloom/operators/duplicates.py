"""Repeats inside a document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkloom.functions import text as T


def duplicate_paragraphs(docs: DataFrame, least_words: int = 30) -> DataFrame:
    """doc_id, n_duplicates: paragraphs (lines) of 30 words or more that repeat an earlier one, by their lower-case words."""
    p = docs.select("doc_id", F.explode_outer(T.lines("text")).alias("p")).where(F.col("p").isNotNull())
    p = p.select("doc_id", T.lower_words("p").alias("w")).where(F.size("w") >= least_words).select("doc_id", F.array_join("w", " ").alias("key"))
    return p.groupBy("doc_id", "key").agg(F.count("*").alias("c")).where("c > 1").groupBy("doc_id").agg(F.sum(F.col("c") - 1).alias("n_duplicates"))


def spacing_variants(docs: DataFrame, least: int = 60) -> DataFrame:
    """doc_id, n_groups: paragraphs that are equal without white space and case (60 characters or more)."""
    p = docs.select("doc_id", F.explode_outer(T.lines("text")).alias("p")).where(F.col("p").isNotNull())
    p = p.select("doc_id", F.regexp_replace(F.lower("p"), r"\s+", "").alias("key")).where(F.length("key") >= least)
    return p.groupBy("doc_id", "key").agg(F.count("*").alias("c")).where("c > 1").groupBy("doc_id").agg(F.count("*").alias("n_groups"))


def duplicate_sentences(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences: distinct sentences over 20 characters that a document has twice or more."""
    s = docs.select("doc_id", F.explode_outer(T.sentences("text")).alias("s")).select("doc_id", F.regexp_replace("s", r"^\s+|\s+$", "").alias("s")).where(F.length("s") > 20)
    s = s.select("doc_id", F.regexp_replace(F.lower("s"), r"\.+$", "").alias("key"))
    return s.groupBy("doc_id", "key").agg(F.count("*").alias("c")).where("c > 1").groupBy("doc_id").agg(F.count("*").alias("n_sentences"))


def repeated_phrases(docs: DataFrame, words: int = 5) -> DataFrame:
    """doc_id, phrase, n: runs of `words` space-separated words, over 25 characters, three times or more."""
    w = docs.select("doc_id", F.filter(F.split(F.lower(T.text_of("text")), r"\s+"), lambda x: x != "").alias("w"))
    g = w.select("doc_id", F.explode_outer(T.grams(F.col("w"), words)).alias("phrase")).where(F.length("phrase") > 25)
    return g.groupBy("doc_id", "phrase").agg(F.count("*").alias("n")).where("n >= 3")
