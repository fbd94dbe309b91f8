"""Identifiers in texts against snapshots of what online services know: present, absent, or unknown where nobody asked.

A service that can't be reached says nothing, so a missing row never counts as absent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkloom.functions import text as T

# How identifiers are written. The first group is the key.
IDENTIFIERS = {
    "doi": r"(10\.\d{4,9}/[^\s,;]+)",
    "orcid": r"(\d{4}-\d{4}-\d{4}-\d{3}[\dX])",
    "ror": r"(?:https?://)?ror\.org/(0[a-z0-9]{6}\d{2})",
    "arxiv": r"arXiv:\s*(\d{4}\.\d{4,5})",
    "trial": r"\b(NCT\d{8}|ISRCTN\d{8,13}|ChiCTR-\w+-\d+|ACTRN\d{14}|EudraCT\s*\d{4}-\d{6}-\d{2}|DRKS\d+|UMIN\d+|IRCT\d+|PACTR\d+)",
    "rrid": r"(RRID\s*:\s*(?:AB|SCR|CVCL|IMG|CBRB|MGI|IMSR|JAX|RBRC|CRL|ECACC)\s*_?\s*\d+)",
    "issn": r"\bISSN\s*:?\s*(\d{4}-\d{3}[\dX])",
}
SNAPSHOT = "kind string, key string, status string, payload map<string,string>"


def identifiers(docs: DataFrame) -> DataFrame:
    """doc_id, kind, key: every identifier of a text once; keys without white space, in lower case, and no full stop behind."""
    t = T.text_of("text")
    each = [F.transform(F.regexp_extract_all(t, F.lit(p), F.lit(1)), _named(kind)) for kind, p in IDENTIFIERS.items()]
    return docs.select("doc_id", F.explode_outer(F.array_distinct(F.concat(*each))).alias("x")).where(F.col("x").isNotNull()).select("doc_id", "x.*")


def _named(kind: str):
    return lambda s: F.struct(F.lit(kind).alias("kind"), F.regexp_replace(F.regexp_replace(F.lower(s), r"\s+", ""), r"[.)]+$", "").alias("key"))


def looked_up(found: DataFrame, snapshot: DataFrame) -> DataFrame:
    """found with status and payload: a left join, so whatever the snapshot doesn't hold is unknown.

    Keys that most texts name (a hot DOI) are many rows of one key: Spark's skew join splits them, and small snapshots are
    broadcast.
    """
    known = snapshot.select("kind", F.lower("key").alias("key"), "status", "payload").dropDuplicates(["kind", "key"])
    out = found.join(known, ["kind", "key"], "left")
    status = F.when(F.col("status").isin("present", "absent"), F.col("status")).otherwise("unknown")
    return out.select("doc_id", "kind", "key", status.alias("status"), "payload")


def lookup_summary(docs: DataFrame, snapshot: DataFrame) -> DataFrame:
    """doc_id, kind, n, present, absent, unknown, retracted (by payload)."""
    r = looked_up(identifiers(docs), snapshot)
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    return r.groupBy("doc_id", "kind").agg(F.count("*").alias("n"), count("present"), count("absent"), count("unknown"), F.count_if(F.col("payload")["retracted"] == "true").alias("retracted"))
