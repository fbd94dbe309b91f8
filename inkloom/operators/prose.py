"""Findings about style: the text metrics against fixed thresholds, and stylometric signals. One row for each document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkloom.functions import text as T

#: Emission order starts here, behind the rules.
FIRST_SEQ = 10_000
FINDING = "array<struct<seq:int,category:string,severity:string,title:string,confidence:double,action:string>>"


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the numbers that style findings are made of; density (of repeated phrases) is joined in where given."""
    d = docs.select("doc_id", T.text_of("text").alias("text"))
    d = d.select("doc_id", "text", F.lower("text").alias("low"), T.words("text").alias("w"), T.sentences("text").alias("s"))
    prose = F.filter("s", lambda x: ~F.trim(x).rlike(r"^\d+(?:\.\d+)*(?:[.)]?)$"))
    d = d.select("doc_id", "text", "low", "w", F.size("s").alias("n_s"), F.transform(prose, lambda x: F.size(T.words(x)).cast("double")).alias("n"), F.transform("s", lambda x: F.size(T.words(x)).cast("double")).alias("all_n"))
    n = F.size("w")
    syllables = F.greatest(F.aggregate("w", F.lit(0), lambda a, x: a + T.syllables(x)), F.lit(1))
    per_sentence, per_word = n / F.greatest(F.col("n_s"), F.lit(1)), syllables / F.greatest(n, F.lit(1))
    d = d.select("*", n.alias("words"), per_sentence.alias("ps"), per_word.alias("pw"), F.filter("all_n", lambda x: x > 0).alias("real"))
    be = F.regexp_count("text", F.lit(r"(?iU)\b(am|is|are|was|were|been|being|be)\s+(?:\w+\s+){0,3}(\w+ed|\w+en)\b"))
    verbs = F.regexp_count("text", F.lit(r"(?iU)\b\w+(?:ed|ing|es|s)\b"))
    m = T.mean(F.col("real"))
    # numbers only, no arrays: the rows are shuffled where a density is joined
    prose_n, runs, short = F.size("n").alias("prose_n"), F.size(F.filter("n", lambda x: x > 45)).alias("runs"), F.size(F.filter("n", lambda x: (x >= 1) & (x <= 3))).alias("short")
    return d.select(
        "doc_id", "words", prose_n, runs, short, (206.835 - 1.015 * F.col("ps") - 84.6 * F.col("pw")).alias("ease"), (0.39 * F.col("ps") + 11.8 * F.col("pw") - 15.59).alias("grade"),
        F.when(be > 0, be / F.greatest(verbs, F.lit(1))).otherwise(0.0).alias("passive"),
        T.occurrences(F.col("text"), "!").alias("exclamation"), T.occurrences(F.col("text"), ";").alias("semicolon"),
        F.regexp_count("text", F.lit("[.!?][A-Za-z]")).alias("glued"), F.regexp_count("text", F.lit("[^ ]  +[^ ]")).alias("double_space"),
        F.regexp_count("low", F.lit(r"(?U)\b(\w+)[ \t]+\1\b")).alias("repeated_words"),
        F.size(F.filter(F.array(*[F.lit(t) for t in T.INFORMAL]), lambda t: F.contains("low", t))).alias("informal"),
        T.term_count("text", T.HEDGES).alias("hedges"), T.term_count("text", T.TEMPLATES).alias("templates"),
        F.when(F.size("real") >= 8, F.round(T.stdev(F.col("real"), m) / m, 6)).otherwise(0.0).alias("burst"),
        F.when(F.size("w") >= 50, F.round(F.size(F.array_distinct("w")) / F.size("w"), 6)).otherwise(0.0).alias("ttr"),
        F.round(T.mean(F.col("all_n")), 6).alias("mean_words"), F.size("all_n").alias("n_sentences"),
    )


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def with_density(numbers: DataFrame, density: DataFrame | None) -> DataFrame:
    if density is None:
        return numbers.withColumn("density", F.lit(0.0))
    return numbers.join(density.select("doc_id", "density"), "doc_id", "left").withColumn("density", F.coalesce("density", F.lit(0.0)))


def style_findings(docs: DataFrame, density: DataFrame | None = None) -> DataFrame:
    """doc_id, f: findings of texts of 30 words or more; density: metrics.repetition_density() of the same documents."""
    d = with_density(measured(docs), density)
    # Thresholds, severities and confidences.
    rules = (
        ("Medium", "Prose is very hard to read", 0.60, (F.col("grade") > 14) | (F.col("ease") < 25)), ("Low", "Heavy passive voice", 0.50, F.col("passive") > 0.35),
        ("Medium", "Excessive run-on sentences", 0.70, (F.col("prose_n") > 0) & (F.col("runs") / F.greatest(F.col("prose_n"), F.lit(1)) > 0.12)), ("Low", "Sentence fragments detected", 0.50, F.col("short") > 3),
        ("Low", "Exclamation marks in academic text", 0.90, F.col("exclamation") > 0), ("Medium", "Missing space after punctuation", 0.90, F.col("glued") > 0),
        ("Low", "Double spaces detected", 0.90, F.col("double_space") > 0), ("Medium", "Repeated words (typos)", 0.90, F.col("repeated_words") > 0),
        ("Medium", "Informal / conversational language", 0.85, F.col("informal") > 0), ("Info", "Frequent hedging language", 0.60, F.col("hedges") > 0),
        ("Low", "Generic template phrasing", 0.55, F.col("templates") >= 5), ("Medium", "Repeated phrases / redundant prose", 0.65, F.col("density") > 0.05),
    )
    return d.select("doc_id", F.when(F.col("words") >= 30, _array("Language", rules, FIRST_SEQ)).otherwise(F.array().cast(FINDING)).alias("f"))


def _array(category: str, rules, first: int) -> Column:
    each = [F.when(hit, F.struct(F.lit(first + k).alias("seq"), F.lit(category).alias("category"), F.lit(s).alias("severity"), F.lit(t).alias("title"), F.lit(c).alias("confidence"), F.lit("").alias("action"))) for k, (s, t, c, hit) in enumerate(rules)]
    return F.array_compact(F.array(*each)).cast(FINDING)


# The signals' scales.
SIGNALS = {
    "uniform sentence rhythm (low burstiness)": lambda c: F.when(c("burst") > 0, clamp((0.45 - c("burst")) / 0.35)).otherwise(0.0),
    "low lexical diversity": lambda c: F.when(c("ttr") > 0, clamp((0.5 - c("ttr")) / 0.25)).otherwise(0.0),
    "very long average sentence": lambda c: F.when(c("mean_words") > 24, clamp((c("mean_words") - 24) / 16)).otherwise(0.0),
    "dense template transitions": lambda c: clamp((c("templates") - 2) / 8),
    "high phrase repetition": lambda c: clamp((c("density") - 0.04) / 0.10),
    "heavy semicolon use": lambda c: clamp((c("semicolon") / F.greatest(c("n_sentences"), F.lit(1)) - 0.5) / 1.5),
}


def style_signals(docs: DataFrame, density: DataFrame | None = None) -> DataFrame:
    """doc_id, score, active, elevated, flags: signals of writing by a machine in texts of 100 words or more.

    score: their Euclidean norm over 1.8, at most 1; active: signals of .35 or more; elevated: two active ones and a score
    of .55; flags: the names of signals of .6 or more. Signals are hints, never proof.
    """
    d = with_density(measured(docs), density).where("words >= 100")
    x = F.array(*[F.struct(F.lit(name).alias("name"), of(F.col).alias("v")) for name, of in SIGNALS.items()])
    d = d.select("doc_id", x.alias("x"))
    score = clamp(F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, s: a + s["v"] * s["v"])) / 1.8)
    active = F.size(F.filter("x", lambda s: s["v"] >= 0.35))
    flags = F.array_join(F.transform(F.filter("x", lambda s: s["v"] >= 0.6), lambda s: s["name"]), "; ")
    return d.select("doc_id", F.round(score, 6).alias("score"), active.alias("active"), ((active >= 2) & (score >= 0.55)).alias("elevated"), flags.alias("flags"))
