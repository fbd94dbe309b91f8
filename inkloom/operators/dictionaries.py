"""Texts against tables of phrases and names: each phrase length is one join by the words' run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkloom.functions import text as T

# Phrases that stand for others, and cell lines that are known to be mistaken for others.
PHRASES = (
    ("counterfeit consciousness", "artificial intelligence"), ("man-made reasoning", "artificial intelligence"), ("profound learning", "deep learning"), ("deep acquiring", "deep learning"),
    ("deep mastery", "deep learning"), ("profound neural networks", "deep neural networks"), ("profound neural organisation", "deep neural networks"), ("irregular timberland", "random forest"),
    ("irregular woods", "random forest"), ("colossal information", "big data"), ("neural organization", "neural network"), ("neural organisation", "neural network"),
    ("counterfeit neural networks", "artificial neural networks"), ("bosom malignancy", "breast cancer"), ("bosom disease", "breast cancer"), ("malignancy therapy", "cancer therapy"),
    ("lung malignancy", "lung cancer"), ("prostate malignancy", "prostate cancer"), ("gastric malignancy", "gastric cancer"), ("constant infection", "chronic disease"),
    ("constant kidney disease", "chronic kidney disease"), ("artery sickness", "artery disease"), ("coronary illness", "coronary disease"), ("malady mending", "disease curing"),
    ("poisonous substance", "toxic substance"), ("logical fallout", "logical fallacy"), ("research missing", "research gap"),
)
DECLARED = r"translated from|machine-translated|non-native english|author.{0,20}translation"
CELL_LINES = (
    ("mda-mb-435", ("mda mb 435", "mcf-7/adr"), "melanoma"), ("kb", ("kb cells", "hela derivative"), "HeLa contaminant"), ("intestine 407", ("int-407", "intestine-407", "int 407"), "HeLa contaminant"),
    ("wish", ("wish cells",), "HeLa contaminant"), ("hela s3", ("hela-s3", "hela s-3"), "HeLa subclone"), ("erie", ("erie cells",), "HeLa contaminant"), ("hap1", ("hap-1", "hap 1"), "HAP1"),
    ("cx-1", ("cx1",), "HeLa derivative"), ("flare", ("fl-amr",), "HEp-2 contaminant"), ("ptk2", ("ptk-2",), "may be cross-contaminated"), ("chromaffin", ("pc12",), "species mismatch possible"),
    ("vero", ("vero cells", "african green monkey kidney"), "often misidentified"), ("u2os", ("u-2 os", "u2 os"), "bone osteosarcoma"), ("hep-2", ("hep2", "hep-2 cells"), "HeLa contaminant"),
    ("etroit", ("etroit cells",), "HeLa contaminant"), ("amp6", ("amp-6",), "HeLa derivative"), ("eches", ("e-cadherin positive",), "may be misidentified"), ("a375", ("a-375",), "melanoma"), ("ht-29", ("ht29",), "colon"),
    ("hct116", ("hct-116", "hct 116"), "colon"), ("mcf7", ("mcf-7", "mcf 7"), "breast"), ("t47d", ("t-47d", "t47-d"), "breast"), ("sk-br-3", ("skbr3", "sk br 3"), "breast"), ("a549", ("a-549",), "lung"),
    ("calu-3", ("calu3",), "lung"), ("jurkat", ("jurkat cells",), "T-cell leukemia"), ("rala", ("raji",), "Burkitt lymphoma"), ("k562", ("k-562",), "CML"), ("hl-60", ("hl60",), "promyelocytic leukemia"),
    ("thp-1", ("thp1",), "monocytic"), ("huh-7", ("huh7",), "hepatoma"), ("hepg2", ("hep-g2", "hep g2"), "hepatoma"), ("b16", ("b-16", "b16f10"), "mouse melanoma"), ("cho", ("cho cells", "chinese hamster ovary"), "hamster"),
    ("cos-7", ("cos7",), "monkey kidney"), ("nih3t3", ("nih 3t3", "nih/3t3"), "mouse fibroblast"), ("l929", ("l-929",), "mouse fibroblast"), ("murine", ("murine cells",), "species confirmation needed"),
)
BIOMEDICAL = r"(?i)cell\s*(?:line|culture|suspension|lysate|extract)|culture(?:d)?\s*(?:in|on|with|cells)|in\s*vitro|STR\s*(?:profiling|authentication|analysis)|mycoplasma|passage(?:s)?\s*\d+|seeding\s*density|dmem|rpmi|fbs|fetal\s*bovine|transfect(?:ed|ion)|siRNA|shRNA|CRISPR|knockdown"
AUTHENTICATED = r"(?i)STR\s*(?:profil|authenticat|verif|analyz)|short\s*tandem\s*repeat|cell\s*(?:line\s*)?authenticat|DNA\s*fingerprint|mycoplasma\s*(?:test|check|free)"


def phrases(spark: SparkSession) -> DataFrame:
    """phrase, intended: the given table; any other of the same columns will do."""
    return spark.createDataFrame(list(PHRASES), "phrase string, intended string")


def tortured_phrases(docs: DataFrame, table: DataFrame, least_words: int = 150) -> DataFrame:
    """doc_id, n_phrases, n_hits, severity, confidence: phrases of a table that a text of `least_words` words or more holds.

    Three different phrases are high, two medium, one low; a declared translation lowers the confidence. A phrase is a run
    of words (letters only), so each phrase length in the table is one equi-join of runs.
    """
    low = docs.select("doc_id", F.lower(T.text_of("text")).alias("low"))
    w = low.select("doc_id", F.regexp_extract_all("low", F.lit("[a-z]+"), F.lit(0)).alias("w"), F.col("low").rlike(DECLARED).alias("declared")).where(F.size("w") >= least_words)
    known = table.select(F.lower("phrase").alias("gram"), F.size(F.split("phrase", " ")).alias("k")).distinct()
    lengths = sorted(r["k"] for r in known.select("k").distinct().collect())  # a handful of lengths
    if not lengths:
        return docs.select("doc_id", F.lit(0).alias("n_phrases"), F.lit(0).alias("n_hits"), F.lit("").alias("severity"), F.lit(0.0).alias("confidence")).limit(0)
    runs = w.select("doc_id", "declared", F.explode_outer(F.concat(*[T.grams(F.col("w"), k) for k in lengths])).alias("gram"))
    hits = runs.join(known.select("gram"), "gram").groupBy("doc_id", "declared").agg(F.countDistinct("gram").alias("n_phrases"), F.count("*").alias("n_hits"))
    many = F.col("n_phrases") >= 3
    severity = F.when(many, "High").when(F.col("n_phrases") == 2, "Medium").otherwise("Low")
    confidence = F.when(many, F.when(F.col("declared"), 0.55).otherwise(0.80)).otherwise(F.when(F.col("declared"), 0.35).otherwise(0.60))
    return hits.select("doc_id", "n_phrases", "n_hits", severity.alias("severity"), confidence.alias("confidence"))


def name_pattern(names: tuple[str, ...]) -> str:
    """Any of the names, with any or no space, hyphen or underscore where one has a hyphen, slash or underscore."""
    each = []
    for name in names:
        parts = [re.escape(p).replace(r"\ ", " ") for p in re.split(r"[-_/]", name) if p]
        each.append(r"[\s\-_]*".join(parts))
    return "|".join(each)


def cell_lines(docs: DataFrame, lines: tuple = CELL_LINES) -> DataFrame:
    """doc_id, line, authenticated: lines of the table that biomedical texts name, and whether authentication is stated."""
    t = docs.select("doc_id", T.text_of("text").alias("text")).where(F.col("text").rlike(BIOMEDICAL))
    t = t.select("doc_id", F.lower("text").alias("low"), F.col("text").rlike(AUTHENTICATED).alias("authenticated"))
    named = F.array_compact(F.array(*[F.when(F.col("low").rlike(name_pattern((line, *aliases))), F.lit(line)) for line, aliases, _ in lines]))
    return t.select("doc_id", F.explode_outer(named).alias("line"), "authenticated").where(F.col("line").isNotNull()).select("doc_id", "line", "authenticated")
