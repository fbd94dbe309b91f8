"""Operator 1: benchmark decontamination by spaced seeds, in DataFrame functions only.

A mask keeps some positions of a window of tokens and ignores the others, so a substituted word spoils only the windows
that keep it. Windows of test items and of documents are hashed under every mask and joined by hash. A shared window
gives a diagonal (document, item, shift). Along each diagonal the whole item is compared with the document token by
token; the best segment scores matches minus mismatches. An overlap counts when this score reaches 0.6 of the item's
tokens, at least 8 and at most 12 (an item of fewer than 8 tokens: all of it).

Items that are too short for a mask (five tokens or fewer) are found where all their tokens stand in a row.

A text that repeats a passage shares one window many times. Each side's places of a window are one array, so a document
and an item meet once for each window that they share, and their diagonals are made distinct inside one row. Where the
pairs of places are more than the diagonals between the first and the last, all of these are taken instead: never more
than the sum of both lengths, whatever is repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkloom.llm import common

#: Kept positions; both masks weigh 5.
MASKS = ((0, 1, 2, 4, 5), (0, 1, 3, 6, 8))
LEAST = min(m[-1] for m in MASKS) + 1  # tokens of the shortest item that has a window
WORD = r"[\p{L}\p{N}]+"
BROADCAST_SEEDS = 1_000_000  # rows of 32 bytes
BROADCAST_DOCS = 2_000_000  # rows of 16 bytes


def token_hashes(text: Column) -> Column:
    """64-bit hashes of the words (letters and digits) in lower case; null text: none."""
    return F.transform(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))


def windows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, pos, h of every window under every mask; rows has keys and t, the token hashes."""
    t = F.col("t")

    def hashes(mask: tuple[int, ...], number: int) -> Column:
        last = F.size(t) - (mask[-1] + 1)
        at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.xxhash64(F.lit(number), *[F.get(t, i + o) for o in mask]))

    each = F.concat(*[hashes(m, k) for k, m in enumerate(MASKS)])
    # the outer form, as for the inner one the optimizer repeats the whole array, tokens and all, in a filter of its size
    out = rows.select(*keys, F.size("t").alias("n"), each.alias("w")).select(*keys, "n", F.posexplode_outer("w").alias("at", "h"))
    start, pos = F.col("at"), F.lit(None).cast("int")
    for m in MASKS:
        n = F.greatest(F.col("n") - m[-1], F.lit(0))
        pos = F.coalesce(pos, F.when(start < n, start))
        start = start - n
    return out.select(*keys, "at", "n", pos.alias("pos"), "h")


def item_tokens(items: DataFrame) -> DataFrame:
    t = items.select("item_id", token_hashes(F.col("text")).alias("t"))
    return t.withColumn("item_key", F.xxhash64("t")).distinct()


def shared_windows(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, item_key, p, q: for each window that a document and an item share, its places in both."""
    seeds = windows(item_tokens(items), ["item_id", "item_key"]).groupBy("h", "item_id", "item_key").agg(F.collect_set("pos").alias("q"))
    known = common.written(seeds, "seeds")
    # broadcast only while the test windows are few; beyond that Spark shuffles both sides by h
    few = known.count() <= BROADCAST_SEEDS
    mine = windows(docs.select("doc_id", token_hashes(F.col("text")).alias("t")), ["doc_id"]).select("doc_id", "h", "pos")
    wanted = known.select("h").distinct()
    mine = mine.join(F.broadcast(wanted) if few else wanted, "h", "left_semi").groupBy("doc_id", "h").agg(F.collect_set("pos").alias("p"))
    return mine.join(F.broadcast(known) if few else known, "h").select("doc_id", "item_id", "item_key", "p", "q")


def scored(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, n_hits, n_item, shift, score of every document and item with a shared window.

    shift: of the diagonals with a shared window (or between such), the one of the best score (the least of equal ones). n_hits: pairs of
    places of shared windows. Only documents with a shared window are tokenised again.
    """
    lines = common.written(shared_windows(docs, items), "windows")

    def between(w: Column) -> Column:
        first, last = F.array_min(w["p"]) - F.array_max(w["q"]), F.array_max(w["p"]) - F.array_min(w["q"])
        each = F.flatten(F.transform(w["p"], lambda x: F.transform(w["q"], lambda y: x - y)))
        return F.when(F.size(w["p"]).cast("long") * F.size(w["q"]) > last - first + 1, F.sequence(first, last)).otherwise(each)

    places = F.flatten(F.transform(F.collect_list(F.struct("p", "q")), between))
    pairs = lines.groupBy("doc_id", "item_id", "item_key").agg(F.array_sort(F.array_distinct(places)).alias("shifts"), F.sum(F.size("p").cast("long") * F.size("q")).alias("n_hits"))
    pairs = common.written(pairs, "shifts")
    common.release(lines)
    some = common.written(pairs.select(F.col("doc_id").alias("_d")).distinct(), "found")
    # 16 bytes a row; without the broadcast all texts would be shuffled
    some = F.broadcast(some) if some.count() <= BROADCAST_DOCS else some
    texts = docs.select("doc_id", "text").join(some, F.col("doc_id").eqNullSafe(F.col("_d")), "left_semi")
    texts = texts.select(F.col("doc_id").alias("_d"), token_hashes(F.col("text")).alias("t"))
    words = item_tokens(items).select("item_key", F.col("t").alias("it"), F.size("t").alias("n_item")).dropDuplicates(["item_key"])
    both = texts.join(pairs.join(words, "item_key"), F.col("_d").eqNullSafe(F.col("doc_id")))

    def segment(shift: Column) -> Column:
        """The document's tokens beside the item, by hash; equal segments have equal scores."""
        before = F.least(shift, F.lit(0))
        beside = F.slice("t", F.greatest(shift, F.lit(0)) + 1, F.greatest(F.col("n_item") + before, F.lit(0)))
        return F.struct(F.xxhash64(before, beside).alias("h"), shift.alias("shift"))

    # a repeated text has few different segments: each is compared once, at its least shift
    each = F.array_sort(F.transform("shifts", segment))
    # beside its predecessor; the list isn't named inside a lambda, where it would be made again for every element
    beside = F.zip_with(each, F.concat(F.array(F.lit(None).cast("struct<h:bigint,shift:int>")), each), lambda x, before: F.struct(x.alias("x"), before.alias("before")))
    different = F.filter(beside, lambda y: y["x"].isNotNull() & (y["before"].isNull() | (y["before"]["h"] != y["x"]["h"])))
    both = both.withColumn("shifts", F.transform(different, lambda y: y["x"]["shift"]))
    zero = F.struct(F.lit(0).alias("here"), F.lit(0).alias("best"))

    def of(shift: Column) -> Column:
        same = F.transform("it", lambda x, k: F.when((k + shift >= 0) & (F.get(F.col("t"), k + shift) == x), 1).otherwise(-1))

        def step(acc: Column, x: Column) -> Column:
            here = F.greatest(acc["here"] + x, F.lit(0))
            return F.struct(here.alias("here"), F.greatest(acc["best"], here).alias("best"))

        return F.struct(F.aggregate(same, zero, step, lambda acc: acc["best"]).alias("score"), (-shift).alias("back"))

    best = F.array_max(F.transform("shifts", of))
    out = both.select("doc_id", "item_id", "n_hits", "n_item", best.alias("b"))
    return out.select("doc_id", "item_id", "n_hits", "n_item", (-F.col("b.back")).alias("shift"), F.col("b.score").alias("score"))


def short_overlaps(docs: DataFrame, items: DataFrame) -> DataFrame | None:
    """doc_id, item_id, score, n_item, first_token, n_hits for items of 1 to LEAST - 1 tokens; None if there are none.

    A document has such an item where all its tokens stand in a row: every run of so many tokens is hashed.
    """
    short = item_tokens(items).where(F.size("t").between(1, LEAST - 1)).select("item_id", F.size("t").alias("n"), F.xxhash64(F.size("t"), "t").alias("h"))
    lengths = sorted(r["n"] for r in short.select("n").distinct().collect())  # at most LEAST - 1
    if not lengths:
        return None
    known = common.written(short, "short")
    few = known.count() <= BROADCAST_SEEDS
    t = docs.select("doc_id", token_hashes(F.col("text")).alias("t"))

    def runs(n: int) -> Column:
        last = F.size("t") - n
        at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.xxhash64(F.lit(n), F.array(*[F.get("t", i + k) for k in range(n)])))

    each = F.transform(F.concat(*[F.transform(runs(n), lambda h, i: F.struct(h.alias("h"), i.alias("pos"))) for n in lengths]), lambda x: x)
    found = t.select("doc_id", each.alias("r")).select("doc_id", F.explode_outer("r").alias("r")).select("doc_id", F.col("r.h").alias("h"), F.col("r.pos").alias("pos"))
    hits = found.join(F.broadcast(known.select("h").distinct()) if few else known.select("h").distinct(), "h", "left_semi")
    hits = hits.groupBy("doc_id", "h").agg(F.min("pos").cast("long").alias("first_token"), F.count("*").alias("n_hits"))
    out = hits.join(F.broadcast(known) if few else known, "h")
    return out.select("doc_id", "item_id", F.col("n").cast("long").alias("score"), F.col("n").cast("long").alias("n_item"), "first_token", "n_hits")


def least_score(n_item: Column) -> Column:
    return F.least(n_item, F.greatest(F.lit(8), F.least(F.lit(12), F.ceil(n_item * F.lit(0.6)).cast("int"))))


def overlaps(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row for each document and test item that overlap: doc_id, item_id, score, n_item, first_token, n_hits.

    score: matches minus mismatches of the best segment of the best diagonal; first_token: the place of this diagonal's
    item start among the document's tokens (0 if it lies before); n_hits: pairs of places of shared windows. Null texts
    and items without a word have no windows and so no rows. Rows of one doc_id (null too) count as one document; copies
    of an item each give their rows. Empty tables give no rows; other columns are ignored.
    """
    real = scored(docs, items).where(F.col("score") >= least_score(F.col("n_item")))
    out = real.groupBy("doc_id", "item_id").agg(
        F.max("score").cast("long").alias("score"), F.max("n_item").cast("long").alias("n_item"),
        F.greatest(F.min_by("shift", -F.col("score")), F.lit(0)).cast("long").alias("first_token"), F.max("n_hits").alias("n_hits"),
    )
    short = short_overlaps(docs, items)
    return out if short is None else out.unionByName(short)


def without_overlaps(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs that overlap no test item, with all their columns. Null doc_ids are matched as a value."""
    name = common.fresh(docs, "_bad")
    bad = overlaps(docs, items).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col(name)), "left_anti")


def op1_decontaminate_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
