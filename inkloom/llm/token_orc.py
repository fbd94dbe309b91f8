"""Operator 5: token ids in ORC files.

Documents are range-partitioned and sorted by doc_id, tokenised, and written as ORC: integer run-length encoding (version
2) of the ids, a row index every `index_rows` rows, stripes of `stripe_mb`, and a Bloom filter on doc_id. A reader
splits the files by stripes, and prunes stripes and row groups by their statistics and Bloom filters.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkloom.llm import common, tokens

END = 2
FILE_SCHEMA = "part int, doc_id long, local_start long, n_tokens long, ids array<int>"


def write_token_ids(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END, index_rows: int = 1000, stripe_mb: int = 16, bloom_fpp: float = 0.01) -> None:
    """Encode docs(doc_id, text) and write them under `path` in ascending doc_id order (null ids first, ties by text).

    Each row: `part` (the file's place in the order), doc_id, local_start (ids before it in its part), n_tokens, ids
    with the end id. Null or empty text: the end id alone. Repeated rows are all written; an empty table gives files
    without rows. Other columns are ignored.
    """
    file = tokenizer or tokens.default_path()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start, enc = TaskContext.get().partitionId(), 0, tokens.encoder(file)
        tail = end_id.to_bytes(4, "little")
        for b in common.in_slices(batches):
            raw = [enc.encode(t) + tail for t in b.column(1).to_pylist()]
            n = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
            ends = np.cumsum(n)
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(np.frombuffer(b"".join(raw), np.int32)))
            columns = [pa.array(np.full(n.size, part, np.int32)), b.column(0), pa.array(start + ends - n), pa.array(n), ids]
            start += int(ends[-1]) if n.size else 0
            yield pa.RecordBatch.from_arrays(columns, names=["part", "doc_id", "local_start", "n_tokens", "ids"])

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # a doc_id that many rows share is dealt out by its texts' hashes
    ranged = keyed.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    out = ranged.mapInArrow(encode, FILE_SCHEMA)
    (
        out.write.option("compression", "zstd")
        .option("orc.row.index.stride", index_rows)
        .option("orc.stripe.size", stripe_mb << 20)
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", bloom_fpp)
        .orc(path)
    )


def read_token_ids(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The files' rows; doc_ids: only these, by stripe statistics, row indexes and Bloom filters."""
    df = spark.read.schema(FILE_SCHEMA).orc(path)
    return df if doc_ids is None else df.where(F.col("doc_id").isin(doc_ids))


def starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, base): ids in all parts before. One row for each part passes the driver; only n_tokens is read."""
    sums = sorted((r["part"], r["n"]) for r in read_token_ids(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    ends = np.cumsum([n for _, n in sums]) if sums else []
    return spark.createDataFrame([(p, int(e) - n) for (p, n), e in zip(sums, ends)], "part int, base long")


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, from the files alone."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("ids")
            at, raw = ids.offsets.to_numpy().astype(np.int64) * 4, memoryview(np.ascontiguousarray(ids.values.to_numpy(), "<i4")).cast("B")
            crc = pa.array([zlib.crc32(raw[s:e]) for s, e in zip(at[:-1], at[1:])], pa.int64())
            n = pa.array((at[1:] - at[:-1]) // 4)
            yield pa.RecordBatch.from_arrays([b.column("part"), b.column("doc_id"), b.column("local_start"), n, crc], names=["part", "doc_id", "local_start", "n_tokens", "ids_crc32"])

    rows = read_token_ids(spark, path).mapInArrow(digest, "part int, doc_id long, local_start long, n_tokens long, ids_crc32 long")
    # one row for each file
    return rows.join(F.broadcast(starts(spark, path)), "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def op5_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.scratch(spark, "op5-orc")
    write_token_ids(common.table(spark, sf_dir, "documents"), path)
    return token_digest(spark, path)
