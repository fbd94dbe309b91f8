"""Documents against a protected corpus. Both sides are exploded to keys, pre-aggregated, and joined by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkloom.functions import text as T


def distinct_grams(rows: DataFrame, key: str, n: int = 8) -> DataFrame:
    """key, gram (its 128-bit digest), n_grams of that key: distinct runs of n lower-case words."""
    # tokens are a column of their own: as an expression they would be made again for every run
    g = rows.select(key, T.lower_words("text").alias("w")).select(key, F.array_distinct(T.grams(F.col("w"), n)).alias("g"))
    return g.select(key, F.size("g").alias("n_grams"), F.explode_outer("g").alias("gram")).where(F.col("gram").isNotNull()).withColumn("gram", F.md5("gram"))


def corpus_overlap(docs: DataFrame, corpus: DataFrame, n: int = 8) -> DataFrame:
    """doc_id, item_id, fraction of the document's distinct runs that the item has, and its band."""
    d, c = distinct_grams(docs, "doc_id", n), distinct_grams(corpus, "item_id", n).select("item_id", "gram")
    f = d.join(c, "gram").groupBy("doc_id", "item_id").agg((F.count("*") / F.max("n_grams")).alias("f"))
    band = F.when(F.col("f") >= 0.45, "critical").when(F.col("f") >= 0.25, "medium").when(F.col("f") >= 0.15, "low").otherwise("none")
    return f.select("doc_id", "item_id", F.round("f", 6).alias("fraction"), band.alias("band"))


def union_overlap(docs: DataFrame, corpus: DataFrame, n: int = 8) -> DataFrame:
    """doc_id, n_grams, n_shared: distinct runs that the whole corpus has."""
    d = distinct_grams(docs, "doc_id", n)
    shared = d.join(distinct_grams(corpus, "item_id", n).select("gram").distinct(), "gram", "left_semi")
    return shared.groupBy("doc_id").agg(F.max("n_grams").alias("n_grams"), F.count("*").alias("n_shared"))


def positions(rows: DataFrame, key: str, n: int, pos: str) -> DataFrame:
    g = rows.select(key, T.lower_words("text").alias("w")).select(key, T.grams(F.col("w"), n).alias("g"))
    return g.select(key, F.posexplode_outer("g").alias(pos, "gram")).where(F.col("gram").isNotNull()).withColumn("gram", F.md5("gram"))


def longest_shared_run(docs: DataFrame, corpus: DataFrame, n: int = 8) -> DataFrame:
    """doc_id, item_id, run: most words in a row that both have, n at least; runs are islands on a diagonal."""
    j = positions(docs, "doc_id", n, "i").join(positions(corpus, "item_id", n, "j"), "gram").select("doc_id", "item_id", (F.col("i") - F.col("j")).alias("d"), "i").distinct()
    w = Window.partitionBy("doc_id", "item_id", "d").orderBy("i")
    islands = j.withColumn("isle", F.col("i") - F.row_number().over(w)).groupBy("doc_id", "item_id", "d", "isle").agg(F.count("*").alias("c"))
    return islands.groupBy("doc_id", "item_id").agg((F.max("c") + n - 1).alias("run"))


def matched_runs(docs: DataFrame, corpus: DataFrame, least: int = 14) -> DataFrame:
    """doc_id, n_runs, longest: runs of `least` tokens or more that all occur somewhere in the corpus (as a bag of tokens)."""
    t = docs.select("doc_id", F.posexplode_outer(T.lower_words("text")).alias("pos", "w")).where(F.col("w").isNotNull())
    known = corpus.select(F.explode_outer(T.lower_words("text")).alias("w")).where(F.col("w").isNotNull()).distinct()
    hit = t.join(known, "w", "left_semi")
    w = Window.partitionBy("doc_id").orderBy("pos")
    runs = hit.withColumn("isle", F.col("pos") - F.row_number().over(w)).groupBy("doc_id", "isle").agg(F.count("*").alias("c")).where(F.col("c") >= least)
    return runs.groupBy("doc_id").agg(F.count("*").alias("n_runs"), F.max("c").alias("longest"))


def sentence_rows(rows: DataFrame, key: str, least: int) -> DataFrame:
    """key, s (place of the sentence), n (distinct tokens), tok: sentences of `least` distinct tokens of 4 letters or more."""
    s = rows.select(key, F.posexplode_outer(T.sentences("text")).alias("s", "x")).where(F.col("x").isNotNull())
    s = s.select(key, "s", F.array_distinct(F.filter(T.lower_words("x"), lambda w: F.length(w) >= 4)).alias("w")).where(F.size("w") >= least)
    return s.select(key, "s", F.size("w").alias("n"), F.explode("w").alias("tok"))


def sentence_jaccard(docs: DataFrame, corpus: DataFrame, similarity: float = 0.55, least: int = 6) -> DataFrame:
    """doc_id, n_matched: sentences whose token set has Jaccard similarity of 0.55 or more with a corpus sentence.

    A prefix filter keeps the join small: of its n tokens, rarest in the corpus first, a sentence needs to share only one
    of the first n - ceil(0.55 n) + 1 with any match; the pairs found are then counted over all tokens.
    """
    d, c = sentence_rows(docs, "doc_id", least), sentence_rows(corpus, "item_id", least)
    freq = c.groupBy("tok").agg(F.count("*").alias("f"))

    def prefix(rows: DataFrame, key: str) -> DataFrame:
        ranked = rows.join(freq, "tok", "left").withColumn("r", F.row_number().over(Window.partitionBy(key, "s").orderBy(F.coalesce("f", F.lit(0)), "tok")))
        return ranked.where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * similarity) + 1).select(key, F.col("s").alias(f"s_{key}"), "tok")

    pairs = prefix(d, "doc_id").join(prefix(c, "item_id"), "tok").select("doc_id", "s_doc_id", "item_id", "s_item_id").distinct()
    a = d.select("doc_id", F.col("s").alias("s_doc_id"), F.col("n").alias("n_a"), "tok")
    b = c.select("item_id", F.col("s").alias("s_item_id"), F.col("n").alias("n_b"), "tok")
    both = pairs.join(a, ["doc_id", "s_doc_id"]).join(b, ["item_id", "s_item_id", "tok"]).groupBy("doc_id", "s_doc_id", "item_id", "s_item_id").agg(F.count("*").alias("k"), F.max("n_a").alias("n_a"), F.max("n_b").alias("n_b"))
    close = both.where(F.col("k") >= similarity * (F.col("n_a") + F.col("n_b") - F.col("k")) - 1e-9)
    return close.select("doc_id", "s_doc_id").distinct().groupBy("doc_id").agg(F.count("*").alias("n_matched"))


def tfidf_cosine(docs: DataFrame, corpus: DataFrame, least: float = 0.55) -> DataFrame:
    """doc_id, item_id, cosine of L2-normalised term counts times ln(N / df) + 1, over tokens of 4 letters or more.

    A prefix filter keeps the join small: an item's tokens, rarest first, are kept until the rest of its vector is shorter
    than `least`. A text without any of these tokens can't reach it, so common words make no pairs; the pairs found are
    then summed over all tokens.
    """
    def counts(rows: DataFrame, key: str) -> DataFrame:
        t = rows.select(key, F.explode_outer(T.lower_words("text")).alias("tok")).where(F.length("tok") >= 4)
        return t.groupBy(key, "tok").agg(F.count("*").alias("tf"))

    d, c = counts(docs, "doc_id"), counts(corpus, "item_id")
    df = d.select("tok").unionAll(c.select("tok")).groupBy("tok").agg(F.count("*").alias("df"))
    size = docs.agg(F.count("*").alias("a")).join(corpus.agg(F.count("*").alias("b"))).select((F.col("a") + F.col("b")).alias("big_n"))
    idf = df.join(F.broadcast(size)).select("tok", (F.ln(F.col("big_n") / F.col("df")) + 1).alias("idf"))  # one row

    def units(rows: DataFrame, key: str) -> DataFrame:
        x = rows.join(idf, "tok").select(key, "tok", "idf", (F.col("tf") * F.col("idf")).alias("x"))
        return x.withColumn("x", F.col("x") / F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy(key))))

    d, c = units(d, "doc_id"), units(c, "item_id")
    rest = F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("item_id").orderBy("idf", "tok").rowsBetween(Window.unboundedPreceding, 0))
    first = c.withColumn("rest", rest).where(F.col("rest") >= least * least - 1e-9).select("item_id", "tok")
    pairs = d.select("doc_id", "tok").join(first, "tok").select("doc_id", "item_id").distinct()
    dot = pairs.join(d.select("doc_id", "tok", F.col("x").alias("y")), "doc_id").join(c.select("item_id", "tok", "x"), ["item_id", "tok"])
    out = dot.groupBy("doc_id", "item_id").agg(F.sum(F.col("x") * F.col("y")).alias("cosine"))
    return out.where(F.col("cosine") >= least).select("doc_id", "item_id", F.round("cosine", 6).alias("cosine"))
