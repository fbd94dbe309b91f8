"""Whether reported descriptive statistics can be true: rounding, bounded integers, variances, p-curves, baselines."""

from __future__ import annotations

import math
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from inkloom.functions import text as T

# How statistics are written, and the bounds that results are defined by.
STATED = r"\b(?:[Nn]\s*=\s*\d{1,4}\b|(?:[Mm]|[Mm][Ee][Aa][Nn])\s*=\s*\d+\.\d+|[Ss][Dd]\s*=\s*\d+\.\d+|\d+\s*(?:-|[Tt][Oo])\s*\d+\s*(?:[Pp][Oo][Ii][Nn][Tt]| [Ll][Ii][Kk][Ee][Rr][Tt]|)[- ][Ss][Cc][Aa][Ll][Ee])"
KINDS = {"n": r"^[Nn]", "mean": r"^[Mm]", "sd": r"^[Ss]", "scale": r"^\d"}
TRIPLES = (
    r"(?i)(\d+\.?\d*)\s*[±\-/]\s*(\d+\.?\d*)\s*[,( ]+\s*n\s*=\s*(\d+)",
    r"(?i)M\s*=\s*(\d+\.?\d*)\s*,\s*(?:SD|sd)\s*=\s*(\d+\.?\d*)\s*,\s*n\s*=\s*(\d+)",
    r"(?i)(?:mean|average)\s*=\s*(\d+\.?\d*)\s*\(\s*(?:SD|sd)\s*=\s*(\d+\.?\d*)\s*\)\s*[,( ]*\s*n\s*=\s*(\d+)",
)
P_VALUE = r"(?i)p\s*[=<]\s*\.?(\d+\.?\d*)"
RANDOMIZED = r"(?i)randomi[sz]ed|randomly\s+assigned|random\s+allocation|placebo[\s-]controlled|double[\s-]blind|controlled\s+trial"
PAIR = (
    r"(?i)(\d{1,4}(?:\.\d+)?)\s*[(\[{]?\s*(?:±|plus/?minus|\+/-)?\s*(\d{1,4}(?:\.\d+)?)\s*[)\]}]?\s*(?:vs\.?|versus|;|and)\s*"
    r"(\d{1,4}(?:\.\d+)?)\s*[(\[{]?\s*(?:±|plus/?minus|\+/-)?\s*(\d{1,4}(?:\.\d+)?)\s*[)\]}]?"
)
#: z of a two-tailed p of .6, .10 and .05.
Z_60, Z_10, Z_05 = 0.5244005127080407, 1.6448536269514722, 1.959963984540054


def decimals(s: str) -> int:
    return len(s.partition(".")[2])


@lru_cache(maxsize=4096)
def _sums_of_squares(n: int, top: int, total: int) -> int:
    """Bits s that are set: n whole numbers from 0 to `top` with this total and sum of squares s exist."""
    rows = {0: 1}
    for placed in range(n):
        after: dict[int, int] = {}
        for t, bits in rows.items():
            for v in range(top + 1):
                if t + v <= total <= t + v + (n - placed - 1) * top:
                    after[t + v] = after.get(t + v, 0) | bits << v * v
        rows = after
    return rows.get(total, 0)


@lru_cache(maxsize=65536)
def reachable(mean: str, sd: str, n: int, low: int, high: int) -> bool:
    """Whether n whole numbers from low to high can have this printed mean and sample deviation.

    A mean that none can have is left to GRIM and counts as reachable. Up to 100 numbers all sums of squares are found;
    beyond, they are all those of the total's parity between the least and the greatest, which differ from the found ones
    only next to the greatest.
    """
    if n < 2 or high <= low:
        return True
    d, e = decimals(mean), decimals(sd)
    middle = round(float(mean) * n)
    totals = [k - n * low for k in (middle - 1, middle, middle + 1) if n * low <= k <= n * high and f"{k / n:.{d}f}" == f"{float(mean):.{d}f}"]
    if not totals:
        return True
    top = high - low
    for t in totals:
        # sums of squares about the shifted zero whose deviation may print as sd
        half = 0.5 * 10.0**-e
        least = max(0, math.floor((n - 1) * max(0.0, float(sd) - half) ** 2 + t * t / n) - 1)
        most = math.ceil((n - 1) * (float(sd) + half) ** 2 + t * t / n) + 1
        q, r = divmod(t, n)
        smallest = (n - r) * q * q + r * (q + 1) ** 2
        full, rest = divmod(t, top)
        largest = full * top * top + rest * rest
        bits = _sums_of_squares(n, top, t) if n <= 100 else None
        for s in range(max(least, smallest), min(most, largest) + 1):
            if (s - t) % 2 == 0 and (bits is None or bits >> s & 1) and f"{math.sqrt(max(0.0, s - t * t / n) / (n - 1)):.{e}f}" == f"{float(sd):.{e}f}":
                return True
    return False


@lru_cache(maxsize=65536)
def consistent_deviation(mean: str, sd: str, n: int) -> bool | None:
    """Whether whole numbers without bounds can have this printed mean and deviation; None where no total fits the mean."""
    d = 2
    middle = round(float(mean) * n)
    totals = [k for k in range(max(0, middle - 2), middle + 3) if round(k / n, d) == round(float(mean), d)]
    if not totals or n < 2:
        return None
    for k in totals:
        ideal = (n - 1) * float(sd) ** 2 + k * k / n
        for t in (int(ideal), int(ideal) + 1):
            if t >= k * k / n and round(math.sqrt((t - k * k / n) / (n - 1)), d) == round(float(sd), d):
                return True
    return False


@F.pandas_udf(BooleanType())
def sprite(mean: pd.Series, sd: pd.Series, n: pd.Series, low: pd.Series, high: pd.Series) -> pd.Series:
    return pd.Series([reachable(*x) for x in zip(mean, sd, n.astype(int), low.astype(int), high.astype(int))], dtype=bool)


@F.pandas_udf(BooleanType())
def grimmer(mean: pd.Series, sd: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([consistent_deviation(m, s, int(k)) for m, s, k in zip(mean, sd, n)], dtype=object)


def _like(pattern: str):
    return lambda x: x["s"].rlike(pattern)


def _groups(pattern: str, names: tuple[str, ...]):
    """The groups of a match as a struct of numbers."""
    return lambda s: F.struct(*[F.regexp_extract(s, pattern, k + 1).try_cast("double").alias(n) for k, n in enumerate(names)])


def statements(docs: DataFrame) -> DataFrame:
    """doc_id and one array for each of n, mean, sd and scale: struct<at, end, s> of its statements in order."""
    t = T.text_of("text")
    said = F.zip_with(F.split(t, STATED, -1), F.regexp_extract_all(t, F.lit(STATED), F.lit(0)), lambda gap, s: F.struct(F.length(gap).alias("gap"), s.alias("s")))
    none = F.array().cast("array<struct<at:int,end:int,s:string>>")

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"] + x["gap"]
        return F.struct((at + F.length(x["s"])).alias("at"), F.concat(acc["out"], F.array(F.struct(at.alias("at"), (at + F.length(x["s"])).alias("end"), x["s"].alias("s")))).alias("out"))

    placed = F.aggregate(F.filter(said, lambda x: x["s"].isNotNull()), F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])
    rows = docs.select("doc_id", placed.alias("x"))
    return rows.select("doc_id", *[F.filter("x", _like(p)).alias(k) for k, p in KINDS.items()])


def _number(s: Column) -> Column:
    return F.regexp_extract(s, r"(\d+(?:\.\d+)?)$", 1)


def reported_means(docs: DataFrame) -> DataFrame:
    """doc_id, mean, sd, n, low, high: every mean with the deviation, sample size and scale that belong to it.

    The deviation is the first within 220 characters after the mean; the size is the one nearest to the deviation between
    the mean and 60 characters behind it, else the nearest before the mean within 220; the scale is the last within 400
    characters before, else 1 to 7.
    """
    r = statements(docs).select("doc_id", F.explode_outer("mean").alias("m"), "sd", "n", "scale").where(F.col("m").isNotNull())
    m, none = F.col("m"), F.lit(None)
    r = r.withColumn("d", F.get(F.filter("sd", lambda x: (x["at"] >= m["end"]) & (x["end"] <= m["end"] + 220)), 0)).where(F.col("d").isNotNull())
    d = F.col("d")
    inside = F.filter("n", lambda x: (x["at"] >= m["at"]) & (x["at"] <= d["end"] + 60))
    near = F.array_min(F.transform(inside, lambda x: F.struct(F.abs(x["at"] - d["end"]).alias("far"), _number(x["s"]).cast("int").alias("n"))))
    before = F.array_min(F.transform(F.filter("n", lambda x: (x["at"] <= m["at"]) & (m["at"] - x["at"] < 220)), lambda x: F.struct((m["at"] - x["at"]).alias("far"), _number(x["s"]).cast("int").alias("n"))))
    scale = F.element_at(F.filter("scale", lambda x: (x["at"] <= m["at"]) & (m["at"] - x["at"] < 400)), -1)
    scale = F.when(F.size(F.filter("scale", lambda x: (x["at"] <= m["at"]) & (m["at"] - x["at"] < 400))) > 0, scale["s"]).otherwise(none)
    out = r.select(
        "doc_id", _number(m["s"]).alias("mean"), _number(d["s"]).alias("sd"), F.coalesce(near["n"], before["n"]).alias("n"),
        F.coalesce(F.regexp_extract(scale, r"^(\d+)", 1).try_cast("int"), F.lit(1)).alias("low"),
        F.coalesce(F.regexp_extract(scale, r"^\d+\s*(?:-|[Tt][Oo])\s*(\d+)", 1).try_cast("int"), F.lit(7)).alias("high"),
    )
    return out.where(F.col("n").isNotNull())


def impossible_deviations(docs: DataFrame) -> DataFrame:
    """doc_id, mean, sd, n, low, high, reachable, consistent: reported_means() against bounded (SPRITE) and any whole numbers (GRIMMER)."""
    r = reported_means(docs).where(F.col("n").between(5, 5000) & (F.col("high") > F.col("low")))
    return r.select("*", sprite("mean", "sd", "n", "low", "high").alias("reachable"), grimmer("mean", "sd", "n").alias("consistent"))


def long_enough(docs: DataFrame, least_tokens: int) -> DataFrame:
    t = docs.select("doc_id", T.text_of("text").alias("text"))
    return t.where(F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")) >= least_tokens) if least_tokens else t


def p_curve(docs: DataFrame, least_tokens: int = 200) -> DataFrame:
    """doc_id, low, high, z, verdict of texts with five significant p-values or more: low ones (under .025) against high ones."""
    t = long_enough(docs, least_tokens)
    p = F.transform(F.regexp_extract_all("text", F.lit(P_VALUE), F.lit(1)), lambda x: x.try_cast("double"))
    p = t.select("doc_id", F.filter(p, lambda x: (x > 0) & (x < 0.05)).alias("p"))
    p = p.select("doc_id", F.size(F.filter("p", lambda x: x < 0.025)).alias("low"), F.size(F.filter("p", lambda x: x >= 0.025)).alias("high")).where(F.col("low") + F.col("high") >= 5)
    n = F.col("low") + F.col("high")
    z = (F.col("low") - n / 2) / F.sqrt(n / 4)
    verdict = F.when(z < -Z_10, "suspicious").when(z > Z_05, "healthy").otherwise("none")
    return p.select("doc_id", "low", "high", F.round(z, 6).alias("z"), verdict.alias("verdict"))


def reported_triples(docs: DataFrame) -> Column:
    """array<struct<mean, sd, n>> of the text column: all three ways of writing them."""
    each = []
    for p in TRIPLES:
        each.append(F.transform(F.regexp_extract_all("text", F.lit(p), F.lit(0)), _groups(p, ("mean", "sd", "n"))))
    return F.filter(F.concat(*each), lambda x: (x["sd"] > 0) & (x["n"] > 2))


def variance_checks(docs: DataFrame, least_tokens: int = 200) -> DataFrame:
    """doc_id, n_triples, sd_ratio, unequal (over 4), n_impossible: deviations beyond the mean, or three times the mean."""
    t = long_enough(docs, least_tokens)
    t = t.select("doc_id", reported_triples(t).alias("x")).select("doc_id", F.size("x").alias("n_triples"), "x").where("n_triples > 0")
    sd = F.transform("x", lambda x: x["sd"])
    over = lambda k: F.size(F.filter("x", lambda x: (x["mean"] > 0) & (x["sd"] > x["mean"] * k)))
    ratio = F.when(F.col("n_triples") > 1, F.array_max(sd) / F.array_min(sd)).otherwise(F.lit(1.0))
    return t.select("doc_id", "n_triples", F.round(ratio, 6).alias("sd_ratio"), (ratio > 4).alias("unequal"), (over(1.0) + over(3.0)).alias("n_impossible"))


def baseline_balance(docs: DataFrame, least_tokens: int = 200) -> DataFrame:
    """doc_id, n_pairs, max_z, n_alike, implausible, too_even: baseline comparisons of randomised trials (four or more).

    z: the difference in pooled deviations; implausible: one over 4. too_even: of eight or more comparisons, five and
    three fifths at least have a p over .6.
    """
    t = long_enough(docs, least_tokens).where(F.col("text").rlike(RANDOMIZED))
    pairs = F.transform(F.regexp_extract_all("text", F.lit(PAIR), F.lit(0)), _groups(PAIR, ("a", "sa", "b", "sb")))
    pairs = F.filter(pairs, lambda x: (x["sa"] >= 0.05) & (x["sb"] >= 0.05))
    z = t.select("doc_id", F.transform(pairs, lambda x: F.abs(x["a"] - x["b"]) / F.sqrt((x["sa"] * x["sa"] + x["sb"] * x["sb"]) / 2)).alias("z")).where(F.size("z") >= 4)
    alike, n = F.size(F.filter("z", lambda x: x < Z_60)), F.size("z")
    return z.select(
        "doc_id", n.alias("n_pairs"), F.round(F.array_max("z"), 6).alias("max_z"), alike.alias("n_alike"), (F.array_max("z") > 4).alias("implausible"),
        ((n >= 8) & (alike >= F.greatest(F.lit(5), F.floor(n * 0.6)))).alias("too_even"),
    )
