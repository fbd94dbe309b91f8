"""Citations and reference lists: numbers cited, gaps, co-citation, and screening against a table of titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkloom.functions import text as T


def cited_numbers(docs: DataFrame, body_only: bool = False) -> DataFrame:
    """doc_id, p (place of the paragraph), ref: every number in a [n] or [n, m] citation, once for a paragraph.

    body_only: not the lines of a reference list.
    """
    p = docs.select("doc_id", F.posexplode_outer(T.lines("text")).alias("p", "x")).where(F.col("x").isNotNull())
    p = p.where(~F.col("x").rlike(r"^\[\d+\]\s+\S")) if body_only else p
    c = p.select("doc_id", "p", F.explode_outer(F.regexp_extract_all("x", F.lit(r"\[(\d{1,3}(?:\s*,\s*\d{1,3})*)\]"), F.lit(1))).alias("c")).where(F.col("c").isNotNull())
    return c.select("doc_id", "p", F.explode(F.split("c", r"\s*,\s*")).alias("ref")).select("doc_id", "p", F.col("ref").try_cast("int").alias("ref")).distinct()


def citation_gaps(docs: DataFrame) -> DataFrame:
    """doc_id, missing: numbers between 1 and the largest cited one that are never cited."""
    c = cited_numbers(docs).groupBy("doc_id").agg(F.collect_set("ref").alias("refs"))
    gaps = F.array_except(F.sequence(F.lit(1), F.array_max("refs")), "refs")
    return c.where(F.array_max("refs") >= 1).select("doc_id", F.explode_outer(gaps).alias("missing")).where(F.col("missing").isNotNull())


def cocitations(docs: DataFrame) -> DataFrame:
    """doc_id, a, b (a < b): references cited in one paragraph."""
    c = cited_numbers(docs)
    one, two = c.select("doc_id", "p", F.col("ref").alias("a")), c.select("doc_id", "p", F.col("ref").alias("b"))
    return one.join(two, ["doc_id", "p"]).where("a < b").select("doc_id", "a", "b").distinct()


def triangles(docs: DataFrame) -> DataFrame:
    """doc_id, n_triangles of the co-citation graph."""
    e = cocitations(docs)
    ab, bc, ac = e, e.select("doc_id", F.col("a").alias("b"), F.col("b").alias("c")), e.select("doc_id", "a", F.col("b").alias("c"))
    return ab.join(bc, ["doc_id", "b"]).join(ac, ["doc_id", "a", "c"], "left_semi").groupBy("doc_id").agg(F.count("*").alias("n_triangles"))


def reference_rows(docs: DataFrame) -> DataFrame:
    """doc_id, ref_no, raw: lines that begin with [n] and go on for over 15 characters."""
    r = docs.select("doc_id", F.explode_outer(T.lines("text")).alias("x")).where(F.col("x").rlike(r"^\[\d+\]\s+\S"))
    r = r.select("doc_id", F.regexp_extract("x", r"^\[(\d+)\]", 1).try_cast("int").alias("ref_no"), F.regexp_extract("x", r"^\[\d+\]\s+(.*)$", 1).alias("raw"))
    return r.where(F.length("raw") > 15)


def citation_check(docs: DataFrame) -> DataFrame:
    """doc_id, ref, state: numbers that are cited but not listed (where a list exists), and entries that are never cited."""
    cited = cited_numbers(docs, body_only=True).select("doc_id", "ref").distinct()
    listed = reference_rows(docs).select("doc_id", F.col("ref_no").alias("ref")).distinct()
    both = cited.withColumn("c", F.lit(True)).join(listed.withColumn("l", F.lit(True)), ["doc_id", "ref"], "full")
    has = F.max("l").over(Window.partitionBy("doc_id"))
    state = F.when(F.col("c").isNull(), "never cited").when(F.col("l").isNull() & F.col("has"), "not listed")
    return both.withColumn("has", has).select("doc_id", "ref", state.alias("state")).where(F.col("state").isNotNull())


def citation_clusters(docs: DataFrame, least: int = 3) -> DataFrame:
    """doc_id, n_clusters, largest: connected components of `least` references or more of a text's co-citation graph.

    A text's graph has at most 999 nodes, so its components are found inside its row: every node takes the least label
    among its neighbours', as many times as halving paths needs.
    """
    e = cocitations(docs)
    both = e.unionAll(e.select("doc_id", F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.groupBy("doc_id", "a").agg(F.collect_set("b").alias("near"))
    graph = near.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("a", "near"))).alias("g"))

    def spread(labels: Column, _: Column) -> Column:
        # the least label of a node and its neighbours, then the label that this one has itself
        one = F.transform_values(labels, lambda k, v: F.least(v, F.array_min(F.transform(F.col("g")[k], lambda x: labels[x]))))
        return F.transform_values(one, lambda k, v: F.least(v, one[v]))

    first = F.transform_values("g", lambda k, v: k)
    rounds = F.sequence(F.lit(1), F.greatest(F.size(F.map_keys("g")), F.lit(1)))
    labels = F.map_values(F.aggregate(rounds, first, spread))
    rows = graph.select("doc_id", F.explode(labels).alias("cluster")).groupBy("doc_id", "cluster").agg(F.count("*").alias("size"))
    return rows.where(F.col("size") >= least).groupBy("doc_id").agg(F.count("*").alias("n_clusters"), F.max("size").alias("largest"))


def reference_flags(docs: DataFrame, as_of_year: int = 2026) -> DataFrame:
    """doc_id, ref_no and flags of a reference: a year in the future, pages that run backwards, no year, a repeated DOI."""
    r = reference_rows(docs).withColumn("doi", F.lower(F.regexp_extract("raw", r"(10\.\d{4,9}/[^\s,;]+)", 1)))
    bare = F.regexp_replace("raw", r"10\.\d{4,9}/[^\s,;]+", "")
    years = F.transform(F.regexp_extract_all(bare, F.lit(r"(?:^|[^0-9])((?:19|20)\d{2})(?:$|[^0-9-])"), F.lit(1)), lambda y: y.try_cast("int"))
    first, last = F.regexp_extract(bare, r"pp?\.\s*(\d{1,6})\s*[-–]\s*(\d{1,6})", 1).try_cast("int"), F.regexp_extract(bare, r"pp?\.\s*(\d{1,6})\s*[-–]\s*(\d{1,6})", 2).try_cast("int")
    r = r.withColumn("n_doi", F.count(F.when(F.col("doi") != "", F.col("doi"))).over(Window.partitionBy("doc_id", "doi")))
    return r.select("doc_id", "ref_no", F.coalesce(F.array_max(years) > as_of_year, F.lit(False)).alias("future_year"), F.coalesce(first > last, F.lit(False)).alias("backwards_pages"), (F.size(years) == 0).alias("no_year"), (F.col("n_doi") > 1).alias("repeated_doi"))


def screened(references: DataFrame, titles: DataFrame, shared: int = 4) -> DataFrame:
    """doc_id, ref_no, title_id: the first title with `shared` distinctive words in common, or three that are half of it.

    Words that stand in over 0.5 % of the titles (and in more than two) are not distinctive: this also keeps hot words out
    of the join.
    """
    words = lambda c: F.array_distinct(F.filter(T.lower_words(c), lambda w: F.length(w) >= 4))
    t = titles.select("title_id", F.explode(words("title")).alias("w"))
    n = titles.agg(F.count("*").alias("n_titles"))
    common = t.groupBy("w").agg(F.count("*").alias("c")).join(F.broadcast(n)).where((F.col("c") > F.col("n_titles") * 0.005) & (F.col("c") > 2)).select("w")
    t = t.join(common, "w", "left_anti")
    size = t.groupBy("title_id").agg(F.count("*").alias("size"))
    r = references.select("doc_id", "ref_no", F.explode(words("raw")).alias("w"))
    both = r.join(t, "w").groupBy("doc_id", "ref_no", "title_id").agg(F.count("*").alias("k")).join(size, "title_id")
    hit = both.where((F.col("k") >= shared) | ((F.col("k") >= 3) & (F.col("k") * 2 >= F.col("size"))))
    return hit.groupBy("doc_id", "ref_no").agg(F.min("title_id").alias("title_id"))
