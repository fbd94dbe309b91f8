"""Operator 2: packing along a space-filling curve.

A document's distinct words are hashed and projected by random signs to DIMS dimensions; each coordinate's place among
those of all documents (it is normally distributed, whatever the length) gives a point, whose Hilbert index is its key.
Documents are range-partitioned and sorted by that key, tokenised, and their ids cut into sequences in this order, so
neighbours on the curve share sequences. Only the last sequence of a partition isn't full; these remainders are packed
together best-fit, by one row for each partition on the driver.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkloom.llm import common, textvec, tokens

DIMS, BITS = 4, 15
PIECE_SCHEMA = "part int, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, local_sequence long, offset long"


def project(texts: Sequence[str | None], dims: int = DIMS) -> np.ndarray:
    """Points in [0, 1)^dims: each distinct word adds a sign for each dimension, taken from its hash.

    The sum over n words, divided by the square root of n, has mean 0 and deviation 1 for short and long texts alike; its
    share of the normal distribution is the coordinate, so points fill the cube evenly.
    """
    out = np.zeros((len(texts), dims))
    for start, block in textvec.blocks(texts):
        t = textvec.Tokens(block, words_only=True)
        keys = (t.doc.astype(np.uint64) << np.uint64(40)) | (t.hash >> np.uint64(24))
        keys.sort()  # much faster than np.unique, which hashes
        keys = keys[np.append(True, keys[1:] != keys[:-1])[: len(keys)]]
        doc, h = (keys >> np.uint64(40)).astype(np.int64), textvec.mix(keys & np.uint64((1 << 40) - 1))
        scale = np.sqrt(np.maximum(np.bincount(doc, minlength=len(block)), 1))
        for d in range(dims):
            sign = 1.0 - 2.0 * ((h >> np.uint64(d)) & np.uint64(1)).astype(np.float64)
            out[start : start + len(block), d] = np.bincount(doc, sign, len(block)) / scale
    # the logistic approximation of the normal distribution function; its error is under 0.01
    return np.clip(1 / (1 + np.exp(-1.702 * out)), 0, np.nextafter(1, 0))


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index of points in [0, 1)^d, by Skilling's transform, for all rows at once."""
    x = (points * (1 << bits)).astype(np.int64).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(d):
            up = (x[i] & q) != 0
            t = np.where(up, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(up, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] ^= t
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[d - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(texts: Sequence[str | None]) -> np.ndarray:
    return hilbert(project(texts))


PART_BYTES, MOST_PARTS = 8 << 20, 20_000


def bounds(keyed: DataFrame, part_bytes: int = PART_BYTES) -> list[tuple[int, int]]:
    """Bounds (key, tie) of range partitions of about `part_bytes` of text each (more beyond MOST_PARTS partitions).

    They come from a sample of 20 rows a partition (20,000 at least), weighed by the lengths of the texts. They only
    balance the partitions: no row is left out.
    """
    size = keyed.agg(F.count("*").alias("rows"), F.sum(F.length("text") + 4).alias("bytes")).first()
    parts = min(MOST_PARTS, -(-(size["bytes"] or 0) // part_bytes))
    if parts < 2:
        return []

    @F.pandas_udf("long")
    def key(s: pd.Series) -> pd.Series:
        return pd.Series(curve_keys(s.tolist()))

    some = keyed.sample(min(1.0, max(20_000, 20 * parts) / size["rows"]), seed=7)
    held = sorted((r["key"], r["tie"], r["n"]) for r in some.select(key("text").alias("key"), "tie", (F.length("text") + 4).alias("n")).collect())
    ends = np.cumsum([n for _, _, n in held])
    at = np.searchsorted(ends, ends[-1] * np.arange(1, parts) / parts) if held else []
    return sorted({held[min(i, len(held) - 1)][:2] for i in at})


def pack(docs: DataFrame, size: int = 1024, tokenizer: str | None = None, end_id: int = 0, part_bytes: int = PART_BYTES) -> DataFrame:
    """Every id of every document in exactly one piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null or empty text: the end id alone. Repeated rows are packed each for itself; null doc_ids stay; an empty table
    gives no rows; other columns are ignored. Partitions are cut by bytes of text; rows of equal keys (copies) are dealt to
    partitions by a hash that differs from row to row.
    """
    file = tokenizer or tokens.default_path()
    # the row's number sets repeated rows apart
    tie = F.xxhash64("doc_id", F.length("text"), F.monotonically_increasing_id())
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", tie)
    cuts = bounds(keyed, part_bytes)
    parts = len(cuts) + 1
    cut_keys, cut_ties = np.array([k for k, _ in cuts], np.int64), np.array([t for _, t in cuts], np.int64)

    @F.pandas_udf("key long, part int")
    def place(text: pd.Series, tie: pd.Series) -> pd.DataFrame:
        keys, ties = curve_keys(text.tolist()), tie.to_numpy()
        part = np.searchsorted(cut_keys, keys, "left")
        last = np.searchsorted(cut_keys, keys, "right")
        for i in np.flatnonzero(last > part):  # keys equal to one or more bounds: by the tie
            part[i] += np.searchsorted(cut_ties[part[i] : last[i]], ties[i], "left")
        return pd.DataFrame({"key": keys, "part": part.astype(np.int32)})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, enc, at = TaskContext.get().partitionId(), tokens.encoder(file), 0
        tail = end_id.to_bytes(4, "little")
        for b in common.in_slices(batches):
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                raw = enc.encode(text) + tail
                total, start = len(raw) // 4, 0
                while start < total:
                    sequence, offset = divmod(at, size)
                    n = min(size - offset, total - start)
                    rows.append((part, doc_id, start, n, zlib.crc32(raw[4 * start : 4 * (start + n)]), total, sequence, offset))
                    start += n
                    at += n
            if rows:
                kinds = [pa.int32()] + [pa.int64()] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in PIECE_SCHEMA.split(", ")])

    placed = keyed.withColumn("at", place("text", "tie")).select("doc_id", "text", "tie", "at.key", "at.part")
    ordered = placed.repartitionById(parts, F.col("part")).sortWithinPartitions("key", "tie").select("doc_id", "text")
    pieces = common.written(ordered.mapInArrow(cut, PIECE_SCHEMA), "pack")
    return _numbered(pieces, size)


def _numbered(pieces: DataFrame, size: int) -> DataFrame:
    """Numbers for all sequences; the parts' remainders share sequences, best fit, largest first."""
    spark = pieces.sparkSession
    sums = sorted((r["part"], r["n"]) for r in pieces.groupBy("part").agg(F.sum("length").alias("n")).collect())
    base, rows = 0, {}
    for part, n in sums:
        rows[part] = [part, base, n // size, -1, 0]
        base += n // size
    free: list[tuple[int, int]] = []  # (room, sequence), by room
    for n, part in sorted(((n % size, part) for part, n in sums if n % size), reverse=True):
        at = bisect_left(free, (n, -1))
        room, sequence = free.pop(at) if at < len(free) else (size, base)
        base += sequence == base
        rows[part][3:] = [sequence, size - room]
        if room > n:
            insort(free, (room - n, sequence))
    # one row for each partition
    places = F.broadcast(spark.createDataFrame([tuple(x) for x in rows.values()], "part int, base long, n_full long, tail_sequence long, shift long"))
    full = F.col("local_sequence") < F.col("n_full")
    return pieces.join(places, "part").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        F.when(full, F.col("base") + F.col("local_sequence")).otherwise(F.col("tail_sequence")).alias("sequence_id"),
        F.when(full, F.col("offset")).otherwise(F.col("offset") + F.col("shift")).alias("offset"),
    )


def op2_pack_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"))
