"""Statistics reported in a text: extracted with regular expressions, recomputed by functions.distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkloom.functions import text as T
from inkloom.functions.distributions import grim, p_value

NUMBER = r"(-?\d+(?:\.\d+)?)"
P = r"\s*,?\s*p\s*([=<>≤≥])\s*(\.?\d+(?:\.\d+)?)"
#: kind, pattern, groups of (df1, df2, value); 0: none.
FORMS = (
    ("t", rf"\bt\s*\(\s*{NUMBER}\s*\)\s*=\s*{NUMBER}{P}", (1, 0, 2)),
    ("F", rf"\bF\s*\(\s*{NUMBER}\s*,\s*{NUMBER}\s*\)\s*=\s*{NUMBER}{P}", (1, 2, 3)),
    ("chi2", rf"(?:χ²|chi2|chi²|χ2)\s*\(\s*{NUMBER}\s*\)\s*=\s*{NUMBER}{P}", (1, 0, 2)),
    ("r", rf"\br\s*\(\s*{NUMBER}\s*\)\s*=\s*(-?(?:0?\.\d+)){P}", (1, 0, 2)),
    ("z", rf"\bz\s*=\s*{NUMBER}{P}", (0, 0, 1)),
)
#: A sample size or a mean.
STATED = r"\b(?:[Nn]\s*=\s*\d{1,4}\b|(?:[Mm]|[Mm][Ee][Aa][Nn])\s*=\s*\d+\.\d+)"


def reported_tests(docs: DataFrame) -> DataFrame:
    """doc_id, kind, df1, df2, value, sign, reported, p, decision_error for every test in APA form.

    decision_error: the reported and the recomputed p lie on different sides of .05, however the statistic was rounded.
    """
    t = T.text_of("text")
    each = []
    for kind, pattern, (a, b, v) in FORMS:
        last = max(a, b, v)
        group = lambda s, k: F.regexp_extract(s, pattern, k)
        number = lambda s, k: group(s, k).try_cast("double") if k else F.lit(None).cast("double")
        each.append(F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), lambda s: F.struct(
            F.lit(kind).alias("kind"), number(s, a).alias("df1"), number(s, b).alias("df2"), number(s, v).alias("value"), group(s, last + 1).alias("sign"),
            number(s, last + 2).alias("reported"), F.length(F.regexp_extract(group(s, v), r"\.(\d+)", 1)).alias("digits"))))
    rows = docs.select("doc_id", F.explode_outer(F.concat(*each)).alias("x")).where(F.col("x").isNotNull()).select("doc_id", "x.*")
    half = F.lit(0.5) * F.pow(F.lit(10.0), -F.col("digits"))
    size = F.abs("value")
    rows = rows.select("*", p_value("kind", size, "df1", "df2").alias("p"), p_value("kind", F.greatest(size - half, F.lit(0.0)), "df1", "df2").alias("p_most"), p_value("kind", size + half, "df1", "df2").alias("p_least"))
    said = F.when(F.col("sign").isin("<", "≤"), F.col("reported") <= 0.05).when(F.col("sign").isin(">", "≥"), ~(F.col("reported") >= 0.05)).otherwise(F.col("reported") <= 0.05)
    error = (said & (F.col("p_least") > 0.05)) | (~said & (F.col("p_most") < 0.05))
    return rows.select("doc_id", "kind", "df1", "df2", "value", "sign", "reported", F.round("p", 6).alias("p"), F.coalesce(error, F.lit(False)).alias("decision_error"))


def impossible_means(docs: DataFrame) -> DataFrame:
    """doc_id, mean, n, possible: every mean of two decimals or more with the nearest sample size before it.

    A sample size counts if it begins less than 400 characters before the mean; many means may share one.
    """
    t = T.text_of("text")
    # the text before each statement, then the statement
    said = F.zip_with(F.split(t, STATED, -1), F.regexp_extract_all(t, F.lit(STATED), F.lit(0)), lambda gap, s: F.struct(F.length(gap).alias("gap"), s.alias("s")))
    none = F.array().cast("array<struct<mean:string,n:int>>")
    start = F.struct(F.lit(0).alias("at"), F.lit(None).cast("int").alias("n_at"), F.lit(None).cast("int").alias("n"), none.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        here, size = acc["at"] + x["gap"], x["s"].rlike("^[Nn]")
        mean = F.struct(F.regexp_extract(x["s"], r"(\d+\.\d+)$", 1).alias("mean"), acc["n"].alias("n"))
        near = ~size & (here - acc["n_at"] < 400) & x["s"].rlike(r"\.\d{2,}$")
        return F.struct(
            (here + F.length(x["s"])).alias("at"), F.when(size, here).otherwise(acc["n_at"]).alias("n_at"),
            F.when(size, F.regexp_extract(x["s"], r"(\d+)$", 1).try_cast("int")).otherwise(acc["n"]).alias("n"),
            F.when(near, F.concat(acc["out"], F.array(mean))).otherwise(acc["out"]).alias("out"),
        )

    # the last gap has no statement of its own
    found = F.aggregate(F.filter(said, lambda x: x["s"].isNotNull()), start, step, lambda acc: acc["out"])
    rows = docs.select("doc_id", F.explode_outer(found).alias("x")).where(F.col("x").isNotNull()).select("doc_id", "x.*")
    return rows.where(F.col("n").between(5, 1000)).select("doc_id", "mean", "n", grim("mean", "n").alias("possible"))
