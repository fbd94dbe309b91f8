"""Operator 10: language identification by string kernels.

Kernel: the blended spectrum of byte n-grams of 1 to 4 (UTF-8, capitals folded, hashed to 22 bits), presence only,
k(x, z) = |G(x) & G(z)| / sqrt(|G(x)| |G(z)|), where G(x) holds those n-grams of x that any landmark has: sizes count
known n-grams only, so a text's unknown ones don't make it less like every landmark. Nyström: a few landmark texts span
the space; one-versus-rest kernel ridge regression is solved there. As k is an inner product of
normalised presence vectors, kernel values against the landmarks times the regression's coefficients are one matrix
(n-grams x languages), so a batch of texts is scored by one product of its presence matrix with it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkloom.llm import common, textvec

LENGTHS = (1, 2, 3, 4)
HASH_BITS = 22
LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"


def _spectrum(block: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(doc, hashed n-gram) of every position, one length after another; n-grams don't cross documents."""
    low = textvec.fold(np.frombuffer(b"".join(block), np.uint8)).astype(np.uint32)
    sizes = np.array([len(x) for x in block])
    doc = np.repeat(np.arange(len(block), dtype=np.int32), sizes)
    code = low
    for n in LENGTHS:
        if n > 1:
            if low.size < n:
                return
            code = (code[:-1] << np.uint32(8)) | low[n - 1 :]
        h = (code + np.uint32(n)) * np.uint32(0x9E3779B1)
        h = ((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77)) >> np.uint32(32 - HASH_BITS)
        inside = doc[: code.size] == doc[n - 1 :]
        yield (doc[: code.size], h) if inside.all() else (doc[: code.size][inside], h[inside])


@dataclass(frozen=True)
class KernelModel:
    """grams: sorted hashes of the landmarks' n-grams; weights: one row for each, one column for each language."""

    langs: list[str]
    grams: np.ndarray
    weights: np.ndarray

    def lookup(self) -> np.ndarray:
        table = np.full(1 << HASH_BITS, -1, np.int32)
        table[self.grams] = np.arange(self.grams.size)
        return table

    def presence(self, block: list[bytes], table: np.ndarray) -> np.ndarray:
        out = np.zeros((len(block), self.grams.size), bool)
        for doc, h in _spectrum(block):
            at = table[h]
            known = at >= 0
            out[doc[known], at[known]] = True
        return out

    def outputs(self, texts: Sequence[str | None], table: np.ndarray) -> np.ndarray:
        """Regression outputs, a row for each text."""
        out = np.zeros((len(texts), len(self.langs)))
        for start, block in textvec.blocks(texts, 1 << 18):
            for k in range(0, len(block), 64):
                x = self.presence(block[k : k + 64], table).astype(np.float32)
                out[start + k : start + k + len(x)] = (x @ self.weights) / np.sqrt(np.maximum(x.sum(1), 1))[:, None]
        return out

    def predict(self, texts: Sequence[str | None], table: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score (softmax of the outputs, sharpened) of each text."""
        y = 6 * self.outputs(texts, table)
        p = np.exp(y - y.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        known = np.array([bool(t) and LETTER.search(t) is not None for t in texts], bool)
        return [self.langs[b] if k else UNKNOWN for b, k in zip(best, known)], np.where(known, p.max(1), 0.0)


def train(rows: Sequence[tuple[str, str]], landmarks: int = 96, ridge: float = 1e-3) -> KernelModel | None:
    """Fit on (text, lang). Landmarks are dealt to the languages in turn; None without usable rows."""
    rows = [r for r in rows if r[0] and LETTER.search(r[0])]
    langs = sorted({lang for _, lang in rows})
    if not langs:
        return None
    by = {x: [t for t, y in rows if y == x] for x in langs}
    each = max(1, landmarks // len(langs))
    # medium texts: long enough to show the language, short enough to keep the n-grams few
    marks = [t.encode("utf-8", "surrogatepass") for x in langs for t in sorted(by[x], key=lambda t: (abs(len(t) - 2000), t))[:each]]
    grams = np.unique(np.concatenate([h for _, h in _spectrum(marks)])).astype(np.int64)
    model = KernelModel(langs, grams, np.zeros((grams.size, len(langs)), np.float32))
    table = model.lookup()

    def units(block: list[bytes]) -> np.ndarray:
        x = model.presence(block, table).astype(np.float32)
        return x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))

    z = units(marks)
    values, vectors = np.linalg.eigh((z @ z.T).astype(np.float64))
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])  # W^(-1/2) on its range
    y = np.array([[1.0 if lang == x else -1.0 for x in langs] for _, lang in rows])
    gram, target = np.zeros((root.shape[1],) * 2), np.zeros((root.shape[1], len(langs)))
    at = 0
    for _, block in textvec.blocks([t for t, _ in rows], 1 << 18):
        for k in range(0, len(block), 64):
            phi = (units(block[k : k + 64]) @ z.T) @ root
            gram += phi.T @ phi
            target += phi.T @ y[at : at + len(phi)]
            at += len(phi)
    coef = root @ np.linalg.solve(gram + ridge * len(rows) * np.eye(len(gram)), target)
    return KernelModel(langs, grams, (z.T @ coef).astype(np.float32))


def sample_rows(docs: DataFrame, most: int, most_chars: int, least: int = 50) -> list[tuple[str, str]]:
    """(text, lang) of about `most` rows that aren't held out, in sorted order.

    Every language takes part: its rows are taken by a hash with a share of its own, so that a language has about as large
    a part of the sample as of all rows, but at least `least` rows, or all it has. Texts over `most_chars` are left out of
    training; of a language without a shorter one the shortest text is taken.
    """
    rows = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.length("text") > 0) & ~common.held_out())
    fits = F.length("text") <= most_chars
    # one row for each language
    langs = rows.groupBy("lang").agg(F.count_if(fits).alias("n"), F.min_by("text", F.struct(F.length("text"), "text")).alias("shortest")).collect()
    total = sum(r["n"] for r in langs)
    shares = [(r["lang"], min(1.0, max(least, most * r["n"] / total) / r["n"])) for r in langs if r["n"]]
    out = [(r["shortest"], r["lang"]) for r in langs if not r["n"]]
    if shares:
        wanted = F.broadcast(docs.sparkSession.createDataFrame(shares, "lang string, share double"))
        chosen = rows.where(fits).join(wanted, "lang").where(common.unit_hash("doc_id", F.lit("lang")) <= F.col("share")).select("text", "lang")
        out += [(r["text"], r["lang"]) for r in chosen.collect()]
    return sorted(out)


def languages(docs: DataFrame, sample: int = 3000, sample_chars: int = 20_000, landmarks: int = 96) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs.

    Training takes about `sample` rows with a language (never held-out ones), of every language some; whole texts of all
    rows are scored. Null
    text or a text without a letter: `und`, score 0; so is every row where no row has a language. Null doc_id: kept, not
    held out. Repeated rows are scored alike, an empty table gives no rows, other columns are ignored.
    """
    model = train(sample_rows(docs, sample, sample_chars), landmarks)
    if model is None:
        return docs.select("doc_id", common.held_out().alias("held_out"), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))

    @F.pandas_udf("lang string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        table = model.lookup()
        for texts in batches:
            lang, score = model.predict(texts.tolist(), table)
            yield pd.DataFrame({"lang": lang, "score": score})

    out = docs.select("doc_id", common.held_out().alias("held_out"), predict("text").alias("_p"))
    return out.select("doc_id", "held_out", F.col("_p.lang").alias("lang_pred"), F.col("_p.score").alias("score"))


def op10_langid_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(common.table(spark, sf_dir, "documents"))
