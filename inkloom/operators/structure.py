"""Sections, section overlap, venue limits, numbers with units and addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkloom.functions import text as T

# Limits of each venue (words, pages, words of the abstract, least references); None: no limit.
VENUES = (
    ("ieee_conference", None, 8, 250, 8), ("ieee_journal", None, 14, 250, 10), ("ieee_access", 10000, None, 250, 20), ("acm", None, 10, 250, 10),
    ("elsevier", 8000, None, 300, 15), ("springer", 10000, None, 250, 15), ("nature", 5000, None, 150, 30), ("mdpi", None, None, 200, 20),
    ("wiley", 10000, None, 250, 15), ("tandfonline", 8000, None, 250, 15), ("plos", 10000, None, 300, 30), ("frontiers", 12000, None, 300, 30),
    ("lncs_springer", None, 16, 250, 15), ("science_journal", 11500, None, 125, 40), ("medical_journal", 5000, None, 300, 30), ("cell_journal", 12000, None, 150, 50),
    ("arxiv_preprint", None, None, 400, 1), ("ugc_care", None, None, 250, 15), ("aicte_conference", None, 6, 200, 8), ("naac_journal", 6000, None, 250, 20),
    ("scopus_indian", 8000, None, 250, 25), ("indian_single_column", 6000, None, 200, 10), ("ugc_phd_thesis", 80000, None, 300, 50), ("generic", None, None, 250, 8),
)
VENUE_SCHEMA = "venue string, word_limit int, page_limit int, abstract_limit int, min_references int"


def venues(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(VENUES), VENUE_SCHEMA)


def sections(docs: DataFrame) -> DataFrame:
    """doc_id, section (1, 2, ...), heading, words: text after each line that starts with # signs, up to the next."""
    p = docs.select("doc_id", F.posexplode_outer(F.split(T.text_of("text"), "\n")).alias("p", "x"))
    p = p.withColumn("head", F.col("x").rlike(r"^#{1,6}\s+\S"))
    p = p.withColumn("section", F.sum(F.col("head").cast("int")).over(Window.partitionBy("doc_id").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)))
    heading = F.max(F.when(F.col("head"), F.trim(F.lower(F.regexp_replace(F.regexp_replace("x", r"^#+\s+", ""), r"^\d+(\.\d+)*\.?\s+|:$", "")))))
    words = F.sum(F.when(~F.col("head"), F.size(T.words("x"))).otherwise(0))
    return p.where("section > 0").groupBy("doc_id", "section").agg(heading.alias("heading"), words.alias("words"))


def section_overlap(docs: DataFrame, least: float = 0.2) -> DataFrame:
    """doc_id, a, b, jaccard: neighbouring sections whose sets of words of 4 letters or more overlap."""
    p = docs.select("doc_id", F.posexplode_outer(F.split(T.text_of("text"), r"\n(?=#{1,6}\s)")).alias("k", "x"))
    p = p.select("doc_id", "k", F.array_distinct(F.filter(T.lower_words("x"), lambda w: F.length(w) >= 4)).alias("w"))
    after = F.lead("w").over(Window.partitionBy("doc_id").orderBy("k"))
    p = p.withColumn("v", after).where(F.col("v").isNotNull())
    share = F.size(F.array_intersect("w", "v")) / F.greatest(F.size(F.array_union("w", "v")), F.lit(1))
    return p.select("doc_id", F.col("k").alias("a"), (F.col("k") + 1).alias("b"), F.round(share, 6).alias("jaccard")).where(F.col("jaccard") >= least)


def compliance(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """doc_id, venue, words, over_words, over_pages: manuscripts (doc_id, venue, text) against the venue's limits."""
    w = docs.select("doc_id", "venue", F.size(T.words("text")).alias("words"))
    j = w.join(F.broadcast(chosen), "venue")  # 24 rows
    pages = F.greatest(F.lit(1.0), F.col("words") / 500)
    return j.select("doc_id", "venue", "words", F.coalesce(F.col("words") > F.col("word_limit"), F.lit(False)).alias("over_words"), F.coalesce(pages > F.col("page_limit"), F.lit(False)).alias("over_pages"))


def units(docs: DataFrame) -> DataFrame:
    """doc_id, unit, n_values: units that a document gives with two different numbers or more."""
    found = F.regexp_extract_all(F.lower(T.text_of("text")), F.lit(r"(\d+(?:\.\d+)?)\s*(?:participant|subject|sample|patient|node|instance|epoch|layer|feature|model)s?"), F.lit(0))
    r = docs.select("doc_id", F.explode_outer(found).alias("s")).where(F.col("s").isNotNull())
    r = r.select("doc_id", F.regexp_extract("s", r"^(\d+(?:\.\d+)?)", 1).alias("v"), F.regexp_extract("s", r"([a-z]+?)s?$", 1).alias("unit"))
    return r.groupBy("doc_id", "unit").agg(F.countDistinct("v").alias("n_values")).where("n_values > 1")


def shared_addresses(docs: DataFrame) -> DataFrame:
    """address, n_docs, n_domain: e-mail addresses with the number of documents that have them and their domain."""
    a = docs.select("doc_id", F.explode_outer(F.regexp_extract_all(F.lower(T.text_of("text")), F.lit(r"[a-z0-9._%+-]{1,64}@[a-z0-9-]+(?:\.[a-z0-9-]+)+"), F.lit(0))).alias("address")).where(F.col("address").isNotNull()).distinct()
    a = a.withColumn("domain", F.substring_index("address", "@", -1))
    by_domain = a.groupBy("domain").agg(F.countDistinct("doc_id").alias("n_domain"))
    return a.groupBy("address", "domain").agg(F.count("*").alias("n_docs")).join(by_domain, "domain").select("address", "n_docs", "n_domain")
