"""Operator 7: near-duplicates by ProbMinHash, banding and verification.

Links are defined by the similarity of the sets of shingles, so every distinct shingle has the same weight: weights by
count would push texts apart that repeat a passage. Signature: each distinct five-word shingle of weight w is a Poisson process of rate w over the registers: its arrivals
have exponential gaps and go to registers drawn by hash. A register keeps the shingle that arrives first. A shingle
stops as soon as its next arrival is later than every register's current first (early termination). Two texts agree in a
register with the probability Jaccard similarity of their weighted shingle sets. Texts that agree in a band of registers
are candidates; they are verified by the exact Jaccard similarity of their sets of five-word shingles.

Large buckets: exact copies are one node each. Every member of a bucket is first compared with the bucket's least node
only; the links found are joined to components, and just the candidates left in different components are compared one
to one, if their parity sketches allow the similarity. A sketch has one bit for each of 1024 hash values: whether an odd
number of shingles has it. Each shingle that only one of two texts has flips one bit, so texts that are similar enough can
never differ in more bits than in shingles. So a bucket of many near copies costs about as many comparisons as it has
members, and no link between different components is lost.

So a bucket costs each member as many comparisons as members stand apart from its main component. Where these are more
than CROWD (texts that share a long passage, and little else), it isn't compared one to one. Its members are joined by prefixes instead, which is exact: of the shingles of two similar texts, ordered by
their number of texts, rarest first, the first n - ceil(similarity * n) + 1 have one in common. The passage's shingles
are the frequent ones, so they stand last and make no pairs.

Candidates are verified on their nodes' stored sets of shingle hashes. The least node of a large bucket meets its members
in several tasks, at most HUB_PAIRS pairs each.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkloom.llm import common, textvec

WORDS, SIMILARITY = 5, 0.8
ROWS, BANDS = 7, 36
SKETCH = 16  # longs of the parity sketch
#: Sets this small can't reach the similarity unless they are equal.
TINY = 3
KEPT_COPIES = 20_000
CROWD, HUB_PAIRS = 1000, 2000
GOLD, SILVER, MASK = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, (1 << 64) - 1


def shingles(block: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, hash, count) of the distinct shingles, by document; a text of fewer words is one shingle of them all."""
    t = textvec.Tokens(block, words_only=True)
    doc, h = t.grams(t.hash, words)
    n = np.bincount(t.doc, minlength=len(block))
    for n_words in range(1, words):
        d, g = t.grams(t.hash, n_words)
        few = n[d] == n_words
        doc, h = np.concatenate((doc, d[few])), np.concatenate((h, g[few]))
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    first = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])))) if doc.size else np.empty(0, np.int64)
    count = np.diff(np.concatenate((first, [doc.size])))
    return doc[first], h[first], count


def signatures(n_docs: int, doc: np.ndarray, h: np.ndarray, weight: np.ndarray, registers: int) -> np.ndarray:
    """ProbMinHash of every document: for each register the hash of the shingle that arrives first (n_docs x registers)."""
    first = np.full(n_docs * registers, np.inf)
    who = np.zeros(n_docs * registers, np.uint64)
    latest = np.full(n_docs, np.inf)
    time, step = np.zeros(doc.size), 0
    base = doc.astype(np.int64) * registers
    while doc.size:
        step += 1
        gap = textvec.mix(h + np.uint64(step * GOLD & MASK))
        time = time - np.log(((gap >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53) / weight
        live = time < latest[doc]
        doc, h, weight, time, base = doc[live], h[live], weight[live], time[live], base[live]
        register = ((textvec.mix(h ^ np.uint64(step * SILVER & MASK)) >> np.uint64(32)) * np.uint64(registers)) >> np.uint64(32)
        at = base + register.astype(np.int64)
        np.minimum.at(first, at, time)
        won = first[at] == time
        who[at[won]] = h[won]
        here = doc[np.concatenate(([True], doc[1:] != doc[:-1]))] if doc.size else doc
        latest[here] = first.reshape(n_docs, registers)[here].max(1)
    return who.reshape(n_docs, registers)


def band_hashes(texts: Sequence[str], words: int = WORDS, rows: int = ROWS, bands: int = BANDS) -> tuple[np.ndarray, np.ndarray]:
    """(number of distinct shingles, a hash for each band and then the sketch) of each text. All weights are 1, as in jaccard()."""
    sizes, out = np.zeros(len(texts), np.int64), np.zeros((len(texts), bands + SKETCH), np.int64)
    for start, block in textvec.blocks(texts):
        doc, h, _ = shingles(block, words)
        n = np.bincount(doc, minlength=len(block))
        who = np.zeros((len(block), rows * bands), np.uint64)
        large = n[doc] > TINY
        who[:] = signatures(len(block), doc[large], h[large], np.ones(np.count_nonzero(large)), rows * bands)
        if not large.all():
            whole = np.zeros(len(block), np.uint64)
            np.add.at(whole, doc[~large], textvec.mix(h[~large] + np.uint64(GOLD)))
            tiny = n <= TINY
            who[tiny] = whole[tiny, None]
        mixed = np.zeros((len(block), bands), np.uint64)
        for r in range(rows):
            mixed = textvec.mix(mixed * np.uint64(GOLD) + who[:, r::rows] + np.uint64(r))
        sizes[start : start + len(block)] = n
        out[start : start + len(block), :bands] = mixed.view(np.int64)
        bit = textvec.mix(h + np.uint64(SILVER)) % np.uint64(64 * SKETCH)
        sketch = np.zeros((len(block), SKETCH), np.uint64)
        np.bitwise_xor.at(sketch, (doc, (bit >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (bit & np.uint64(63)))
        out[start : start + len(block), bands:] = sketch.view(np.int64)
    return sizes, out


def signed(docs: DataFrame, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """doc_id, key (digest of the text), n (distinct shingles), bands (hashes, then the sketch): a row for each row of docs."""
    width = bands + SKETCH

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, tuple[int, bytes]] = {}  # copies are signed once
        for b in common.in_slices(batches):
            keys, texts = b.column(1).to_pylist(), b.column(2).to_pylist()
            if len(kept) > KEPT_COPIES:
                kept.clear()
            new = {k: i for i, k in enumerate(keys) if k not in kept}
            sizes, hashes = band_hashes([texts[i] for i in new.values()], rows=rows, bands=bands)
            kept.update((k, (int(n), x.tobytes())) for k, n, x in zip(new, sizes, hashes))
            flat = np.frombuffer(b"".join(kept[k][1] for k in keys), np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, width, dtype=np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([kept[k][0] for k in keys], pa.int64()), lists], names=["doc_id", "key", "n", "bands"])

    text = F.coalesce("text", F.lit(""))
    rows_ = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(text.cast("binary")).alias("key"), text.alias("text"))
    return common.written(rows_.mapInArrow(sign, "doc_id long, key string, n long, bands array<long>"), "signed")


def shingle_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, s (array<long>, the hashes of its distinct shingles) of the nodes(node); docs(_id, text)."""

    @F.pandas_udf("array<long>")
    def sets(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out: list[np.ndarray] = []
            for _, block in textvec.blocks(texts.tolist()):
                doc, h, _ = shingles(block)
                out.extend(np.split(h.view(np.int64), np.searchsorted(doc, np.arange(1, len(block)))))
            yield pd.Series(out, dtype=object)

    held = docs.join(nodes.select("node").distinct(), F.col("_id") == F.col("node"), "left_semi")
    # rows of one doc_id count as one document: the least text, as in classes()
    return held.groupBy(F.col("_id").alias("node")).agg(F.min_by("text", F.md5(F.col("text").cast("binary"))).alias("text")).select("node", sets("text").alias("s"))


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose sets(node, s) reach the similarity. Nodes with many partners are salted."""
    counts = pairs.groupBy("a").agg(F.ceil(F.count("*") / HUB_PAIRS).cast("int").alias("parts"))
    left = sets.select(F.col("node").alias("a"), F.col("s").alias("s_a")).join(counts, "a").select("a", "s_a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"))
    right = sets.select(F.col("node").alias("b"), F.col("s").alias("s_b"))
    dealt = pairs.join(counts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("salt"))
    both = F.size(F.array_intersect("s_a", "s_b"))
    fits = both >= (F.size("s_a") + F.size("s_b") - both) * F.lit(similarity) - 1e-9
    return dealt.join(right, "b").join(left, ["a", "salt"]).where(fits).select("a", "b")


def jaccard(pairs: list[str]) -> np.ndarray:
    """Similarity of texts 0 and 1, 2 and 3, and so on."""
    doc, h, _ = shingles([x.encode("utf-8", "surrogatepass") for x in pairs])
    n = np.bincount(doc, minlength=len(pairs))
    pair = doc >> 1
    order = np.lexsort((h, pair))
    pair, h = pair[order], h[order]
    both = np.bincount(pair[1:][(pair[1:] == pair[:-1]) & (h[1:] == h[:-1])], minlength=len(pairs) // 2)
    return both / np.maximum(n[0::2] + n[1::2] - both, 1)


def components(links: DataFrame) -> DataFrame:
    """(node, least): the least node of each linked node's component, by alternating large and small stars."""
    cur = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    seen = before = None
    while True:
        cur = common.written(cur, "stars")
        if before is not None:
            common.release(before)
        before = cur
        now = tuple(cur.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.hash("a", "b").cast("long"))).first())
        if now == seen:
            return cur.select(F.col("a").alias("node"), F.col("b").alias("least"))
        seen = now
        both = cur.unionAll(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(least, F.col("a") == F.col("u")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least.withColumnRenamed("a", "u"), F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        cur = small.unionAll(least.select("a", F.col("m").alias("b"))).distinct()


def size_fits(x: Column, y: Column, similarity: float) -> Column:
    """Sets whose sizes differ more can't reach the similarity."""
    return F.least(x, y) >= similarity * F.greatest(x, y) - 1e-9


def sketches_fit(x: Column, y: Column, sizes: Column, similarity: float) -> Column:
    """Whether sketches x and y differ in no more bits than sets of these sizes (their sum) may differ in shingles."""
    differ = F.aggregate(F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda acc, d: acc + d)
    return differ <= F.floor(sizes * ((1 - similarity) / (1 + similarity)) + 1e-9)


def prefix_pairs(crowd: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """a, b: nodes of crowd(node, n, label, sketch) of different labels that share a shingle of their prefixes."""
    mine = crowd.select("node", "n", "label", "sketch").join(sets, "node")
    each = mine.select("node", "n", F.explode("s").alias("h"))
    rank = each.join(each.groupBy("h").agg(F.count("*").alias("f")), "h").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("f", "h"))).alias("r"))
    kept = F.slice("r", F.lit(1), (F.col("n") - F.ceil(F.col("n") * similarity - 1e-9) + 1).cast("int"))
    first = common.written(rank.select("node", F.explode(kept).alias("x")).select("node", F.col("x.h").alias("h")).join(crowd, "node"), "prefixes")
    one = first.select("h", *[F.col(c).alias(f"{c}_a") for c in ("node", "n", "label", "sketch")])
    two = first.select("h", *[F.col(c).alias(f"{c}_b") for c in ("node", "n", "label", "sketch")])
    fits = (F.col("node_a") < F.col("node_b")) & (F.col("label_a") != F.col("label_b")) & size_fits(F.col("n_a"), F.col("n_b"), similarity)
    met = one.join(two, (one["h"] == two["h"]) & fits & sketches_fit(F.col("sketch_a"), F.col("sketch_b"), F.col("n_a") + F.col("n_b"), similarity))
    out = common.written(met.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct(), "met")
    common.release(first)
    return out


def classes(docs: DataFrame, similarity: float = SIMILARITY, rows: int = ROWS, bands: int = BANDS, crowd: int = CROWD) -> DataFrame:
    """doc_id, class_id for every row of docs; class_id: the least doc_id among texts linked directly or through others.

    Null text is empty. Texts without a word are only alike if equal; a text of fewer than five words is one shingle.
    Rows that share a doc_id count as one document. Null doc_ids: kept; a class of null doc_ids alone has a negative or
    positive hash of its text as class_id. An empty table gives no rows; other columns are ignored. `crowd`: members apart
    from a bucket's main component from which on it is compared by prefixes; it changes the work, not the links.
    """
    every = signed(docs, rows, bands)
    # exact copies are one node: the least doc_id
    nodes = common.written(every.groupBy("key").agg(F.min("doc_id").alias("m"), F.max("n").alias("n"), F.min_by("bands", F.coalesce("doc_id", F.lit(0))).alias("bands")).select("key", F.coalesce("m", F.xxhash64("key")).alias("node"), "n", "bands"), "nodes")
    members = nodes.where("n > 0").select("node", "n", F.posexplode(F.slice("bands", 1, bands)).alias("band", "h"))
    members = members.select("node", "n", F.xxhash64("band", "h").alias("bucket"))
    hubs = members.groupBy("bucket").agg(F.min(F.struct("node", "n")).alias("hub"), F.count("*").alias("size")).where("size > 1").select("bucket", F.col("hub.node").alias("a"), F.col("hub.n").alias("n_a"))
    full = common.written(members.join(hubs, "bucket"), "buckets")
    pairs = full.where((F.col("a") != F.col("node")) & size_fits(F.col("n_a"), F.col("n"), similarity)).select("a", F.col("node").alias("b")).distinct()
    pairs = common.written(pairs, "pairs")
    ids = docs.select(F.col("doc_id").cast("long").alias("_id"), F.coalesce("text", F.lit("")).alias("text"))
    ids = ids.select(F.coalesce("_id", F.xxhash64(F.md5(F.col("text").cast("binary")))).alias("_id"), "text")
    # the shingles of nodes that share a bucket with another
    sets = common.written(shingle_sets(ids, full), "sets")
    links = common.written(verified(pairs, sets, similarity), "links")
    label = components(links)
    labelled = full.select("bucket", "node", "n").join(label, "node", "left").withColumn("label", F.coalesce("least", "node")).drop("least")
    mixed = labelled.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("bucket")
    rest = common.written(labelled.join(mixed, "bucket"), "mixed")
    # a bucket's main component needs no pairs inside; all others meet every member of another component
    parts = rest.groupBy("bucket", "label").agg(F.count("*").alias("c"))
    main = parts.groupBy("bucket").agg(F.max(F.struct("c", "label")).alias("x"), F.sum("c").alias("size")).select("bucket", F.col("x.label").alias("main"), (F.col("size") - F.col("x.c")).alias("apart"))
    sketch = nodes.select("node", F.slice("bands", bands + 1, SKETCH).alias("sketch"))
    rest = rest.join(main, "bucket").join(sketch, "node")
    small = rest.where(F.col("apart") <= crowd)
    one = small.where("label <> main").select("bucket", F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("label").alias("label_a"), F.col("sketch").alias("sketch_a"))
    two = small.select("bucket", F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("label").alias("label_b"), F.col("sketch").alias("sketch_b"), (F.col("label") == F.col("main")).alias("in_main"))
    fits = (F.col("label_a") != F.col("label_b")) & (F.col("in_main") | (F.col("a") < F.col("b"))) & size_fits(F.col("n_a"), F.col("n_b"), similarity)
    other = one.join(two, (one["bucket"] == two["bucket"]) & fits & sketches_fit(F.col("sketch_a"), F.col("sketch_b"), F.col("n_a") + F.col("n_b"), similarity))
    other = other.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    large = rest.where(F.col("apart") > crowd).select("node", "n", "label", "sketch").dropDuplicates(["node"])
    met = prefix_pairs(large, sets, similarity) if large.limit(1).count() else None
    other = (other if met is None else other.unionAll(met)).distinct().join(pairs, ["a", "b"], "left_anti")
    more = common.written(verified(common.written(other, "others"), sets, similarity), "more")
    final = components(links.unionAll(more)) if more.limit(1).count() else label
    common.release(full, pairs, sets, *([] if met is None else [met]))
    by_key = nodes.select("key", "node").join(final, "node", "left").select("key", F.coalesce("least", "node").alias("class_id"))
    return every.select("doc_id", "key").join(by_key, "key").select("doc_id", "class_id")


def without_near_copies(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs whose doc_id is their class's least, with all their columns: one document of each class stays.

    Rows without a doc_id can't be told apart and go.
    """
    name = common.fresh(docs, "_keep")
    keep = classes(docs, similarity).where(F.col("doc_id") == F.col("class_id")).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(keep, F.col("doc_id") == F.col(name), "left_semi")


def op7_neardup_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(common.table(spark, sf_dir, "documents"))
