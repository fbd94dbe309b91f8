"""One row of text metrics for each document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkloom.functions import text as T


def word_counts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.size(T.words("text")).alias("word_count"), F.size(T.sentences("text")).alias("sentence_count"))


def sentence_lengths(docs: DataFrame) -> DataFrame:
    n = docs.select("doc_id", F.transform(T.sentences("text"), lambda s: F.size(T.words(s)).cast("double")).alias("n"))
    return n.select("doc_id", F.size("n").alias("sentences"), F.round(T.mean(F.col("n")), 6).alias("mean_words"), F.round(T.stdev(F.col("n"), T.mean(F.col("n"))), 6).alias("sd_words"), F.coalesce(F.array_max("n"), F.lit(0.0)).cast("int").alias("max_words"))


def readability(docs: DataFrame) -> DataFrame:
    """Reading ease and grade; null for a text without words, where both are undefined."""
    d = docs.select("doc_id", T.words("text").alias("w"), F.greatest(F.size(T.sentences("text")), F.lit(1)).alias("s"))
    d = d.select("doc_id", "s", F.size("w").alias("n"), F.greatest(F.aggregate("w", F.lit(0), lambda a, x: a + T.syllables(x)), F.lit(1)).alias("syllables"))
    ok = F.col("n") > 0
    per_sentence, per_word = F.col("n") / F.col("s"), F.col("syllables") / F.col("n")
    return d.select(
        "doc_id", "syllables",
        F.when(ok, F.round(206.835 - 1.015 * per_sentence - 84.6 * per_word, 6)).alias("reading_ease"),
        F.when(ok, F.round(0.39 * per_sentence + 11.8 * per_word - 15.59, 6)).alias("grade"),
    )


def type_token_ratio(docs: DataFrame) -> DataFrame:
    d = docs.select("doc_id", T.words("text").alias("w"))
    n = F.size("w")
    return d.select("doc_id", F.when(n >= 50, F.round(F.size(F.array_distinct("w")) / n, 6)).otherwise(0.0).alias("ttr"))


def burstiness(docs: DataFrame) -> DataFrame:
    """Coefficient of variation of the lengths of sentences with words; 0 under eight of them."""
    n = docs.select("doc_id", F.filter(F.transform(T.sentences("text"), lambda s: F.size(T.words(s)).cast("double")), lambda x: x > 0).alias("n"))
    m = T.mean(F.col("n"))
    return n.select("doc_id", F.when(F.size("n") >= 8, F.round(T.stdev(F.col("n"), m) / m, 6)).otherwise(0.0).alias("burstiness"))


def punctuation(docs: DataFrame) -> DataFrame:
    """Counts of signs. The em dash counts twice: results are defined that way."""
    t = T.text_of("text")
    one = lambda s: T.occurrences(t, s)
    return docs.select(
        "doc_id", (2 * one("—")).alias("em_dash"), one(";").alias("semicolon"), one(":").alias("colon"), one("!").alias("exclamation"),
        (one('"') + one("“") + one("”")).alias("quotes"), F.regexp_count(t, F.lit(r"\([^)]*\)")).alias("parentheses"), one(",").alias("comma"),
    )


def lexicon_counts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", *[T.term_count("text", terms).alias(n) for n, terms in (("hedges", T.HEDGES), ("informal", T.INFORMAL), ("templates", T.TEMPLATES), ("contribution", T.CONTRIBUTION))])


def passive_ratio(docs: DataFrame) -> DataFrame:
    t = T.text_of("text")
    be = F.regexp_count(t, F.lit(r"(?iU)\b(am|is|are|was|were|been|being|be)\s+(?:\w+\s+){0,3}(\w+ed|\w+en)\b"))
    verbs = F.regexp_count(t, F.lit(r"(?iU)\b\w+(?:ed|ing|es|s)\b"))
    return docs.select("doc_id", F.when(be > 0, F.round(be / F.greatest(verbs, F.lit(1)), 6)).otherwise(0.0).alias("passive_ratio"))


def ids_where(docs: DataFrame, condition: Column) -> Column:
    """Whether the rows of the row's doc_id fulfil a condition on their aggregates; seldom true of others too, as ids are
    marked in a bitmap by their hash.
    """
    bits = 8 * 4096
    ids = docs.groupBy("doc_id").agg(condition.alias("so")).where("so").select(F.bitmap_construct_agg(F.pmod(F.xxhash64("doc_id"), F.lit(bits))).alias("bitmap"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(bits)).cast("int")
    byte = F.conv(F.hex(F.substring(ids.scalar(), (F.shiftright(place, 3) + 1), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(byte.bitwiseAND(F.expr("shiftleft(1, cast(pmod(xxhash64(doc_id), 8) as int))")) != 0, F.lit(True))


def ids_of_several(docs: DataFrame) -> Column:
    """Whether several rows have the row's doc_id; seldom true of others too."""
    return ids_where(docs, F.count("*") > 1)


def _grams_by_way(docs: DataFrame, least: int, most: int, count: int, in_row: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of each document by one of three ways its runs: (doc_id, gram) one by one for documents over `in_row` signs; in the
    row, as an array r of (gram, n) with n of `count` or more, for those of one row, and for those of several rows, whose
    texts are first brought together.
    """
    # stop words become bars, so a text falls into runs without any, and only these are cut into grams
    barred = F.array_join(F.transform(T.lower_words("text"), lambda w: F.when(w.isin(list(T.GRAM_STOP)), "|").otherwise(w)), " ")
    words = lambda run: F.filter(F.split(run, " "), lambda w: w != "")
    each = lambda w: F.concat(*[T.grams(w, n) for n in range(least, most + 1)])
    small = ~ids_where(docs, F.sum(F.length(T.text_of("text"))) > in_row) if count > 1 else F.lit(False)
    several = ids_of_several(docs)

    runs = docs.where(~small).select("doc_id", F.explode_outer(F.split(barred, r"\|")).alias("run"))
    runs = runs.select("doc_id", words(F.col("run")).alias("w")).where(F.size("w") >= least)
    every = runs.select("doc_id", F.explode_outer(each(F.col("w"))).alias("gram")).where(F.col("gram").isNotNull())

    def counted(rows: DataFrame) -> DataFrame:
        w = rows.select("doc_id", F.filter(F.transform(F.split("runs", r"\|"), words), lambda w: F.size(w) >= least).alias("w")).where(F.size("w") > 0)
        g = w.select("doc_id", F.sort_array(F.flatten(F.transform("w", each))).alias("g"))
        first = F.array_compact(F.transform("g", lambda x, i: F.when((i == 0) | (x != F.get("g", i - 1)), i)))
        n = lambda i, k: (F.coalesce(F.get("first", k + 1), F.size("g")) - i).cast("long").alias("n")
        r = g.select("doc_id", "g", first.alias("first")).select("doc_id", F.transform("first", lambda i, k: F.struct(F.get("g", i).alias("gram"), n(i, k))).alias("r"))
        return r.select("doc_id", F.filter("r", lambda x: x["n"] >= count).alias("r"))

    long_runs = F.array_join(F.filter(F.split(barred, r"\|"), lambda run: F.size(words(run)) >= least), "|")
    together = docs.where(small & several).select("doc_id", long_runs.alias("runs")).where("runs != ''").groupBy("doc_id").agg(F.array_join(F.collect_list("runs"), "|").alias("runs"))
    return every, counted(docs.where(small & ~several).select("doc_id", barred.alias("runs"))), counted(together)


def repeated_grams(docs: DataFrame, least: int = 4, most: int = 6, count: int = 2, in_row: int = 1_000_000) -> DataFrame:
    """doc_id, gram, n: runs of `least` to `most` words without a stop word that a document has `count` times or more.

    A document of up to `in_row` signs is sorted out inside one row: only what it repeats is shuffled, or its texts once if
    several rows have its doc_id. Of longer documents every run is shuffled and counted.
    """
    every, alone, together = _grams_by_way(docs, least, most, count, in_row)
    rows = lambda d: d.select("doc_id", F.explode_outer("r").alias("r")).where(F.col("r").isNotNull()).select("doc_id", "r.gram", "r.n")
    summed = every.withColumn("n", F.lit(1).cast("long")).unionByName(rows(alone)).groupBy("doc_id", "gram").agg(F.sum("n").alias("n")).where(F.col("n") >= count)
    return summed.unionByName(rows(together))


def repetition_density(docs: DataFrame) -> DataFrame:
    """Share of surplus occurrences among repeated runs, for documents that have any."""
    return repeated_grams(docs).groupBy("doc_id").agg(F.round((F.sum("n") - F.count("*")) / F.sum("n"), 6).alias("density"))


def acronyms(docs: DataFrame) -> DataFrame:
    """Runs of 2 to 6 capitals that a document has three times or more."""
    a = docs.select("doc_id", F.explode_outer(F.regexp_extract_all(T.text_of("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))).alias("acronym"))
    return a.where(F.col("acronym").rlike("^[A-Z]{2,6}$")).groupBy("doc_id", "acronym").agg(F.count("*").alias("n")).where("n >= 3")
