"""Logistic regression over hashed sparse features, trained with follow-the-regularised-leader (FTRL-proximal)."""

from __future__ import annotations

from dataclasses import dataclass
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkloom.llm import common, textvec


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


@dataclass(frozen=True)
class Space:
    """Which features a text has: n-grams of tokens and of token shapes, and word beginnings, present or absent, in 2**bits places."""

    orders: tuple[int, ...] = (1, 2)
    shape_orders: tuple[int, ...] = ()
    words_only: bool = False
    bits: int = 20
    prefixes: tuple[int, ...] = ()  # bytes

    def rows(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        """Sorted distinct feature ids of each text."""
        out: list[np.ndarray] = []
        for _, block in textvec.blocks(texts):
            doc, ids = self._pairs(block)
            keys = np.unique((doc.astype(np.int64) << self.bits) | ids)
            at = np.searchsorted(keys >> self.bits, np.arange(1, len(block)))
            out.extend(np.split(keys & ((1 << self.bits) - 1), at))
        return out

    def column(self, text: str | Column) -> Column:
        """rows() of a text column, in Python workers: array<int>."""
        space = self

        @F.pandas_udf("array<int>")
        def ids(texts: pd.Series) -> pd.Series:
            return pd.Series([x.astype(np.int32) for x in space.rows(texts.tolist())], dtype=object)

        return ids(text)

    def _pairs(self, block: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        common.let_go()
        tokens = textvec.Tokens(block, shapes=bool(self.shape_orders), words_only=self.words_only)
        return textvec.features(tokens, self.orders, self.shape_orders, self.bits, self.prefixes)

    def scores(self, texts: Sequence[str | None], weights: np.ndarray, bias: float) -> np.ndarray:
        """Sparse dot products of all texts: only features of weight other than 0 are made distinct and summed."""
        out = np.full(len(texts), bias)
        live = weights != 0
        for start, block in textvec.blocks(texts):
            doc, ids = self._pairs(block)
            hit = live[ids]
            keys = np.unique((doc[hit].astype(np.int64) << self.bits) | ids[hit])
            out[start : start + len(block)] += np.bincount(keys >> self.bits, weights[keys & ((1 << self.bits) - 1)], len(block))
        return out


@dataclass
class FTRL:
    """Per-coordinate FTRL-proximal with L1 and L2; the bias is a coordinate without penalty."""

    size: int
    alpha: float = 0.1
    beta: float = 1.0
    l1: float = 3.0
    l2: float = 1.0

    def __post_init__(self):
        self.z, self.n = np.zeros(self.size + 1), np.zeros(self.size + 1)

    def weights(self, ids: np.ndarray) -> np.ndarray:
        z, n = self.z[ids], self.n[ids]
        l1 = np.where(ids == self.size, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def push(self, ids: np.ndarray, grad: np.ndarray, w: np.ndarray) -> None:
        """Update with the gradient at weights w."""
        n = self.n[ids]
        more = n + grad * grad
        self.z[ids] += grad - (np.sqrt(more) - np.sqrt(n)) / self.alpha * w
        self.n[ids] = more

    def learn(self, ids: np.ndarray, y: int, weight: float = 1.0) -> None:
        w = self.weights(ids)
        self.push(ids, np.full(ids.size, weight * (sigmoid(w.sum()) - y)), w)

    def all_weights(self) -> tuple[np.ndarray, np.ndarray, float]:
        """(ids, their weights, bias): only weights other than 0."""
        ids = np.flatnonzero(np.abs(self.z[:-1]) > self.l1)
        w = self.weights(ids)
        return ids[w != 0], w[w != 0], float(self.weights(np.array([self.size]))[0])


@dataclass(frozen=True)
class Examples:
    """Labels, and for each labelled text one or more lists of feature ids: lists[which] holds all texts' ids and bounds."""

    y: np.ndarray
    lists: tuple[tuple[np.ndarray, np.ndarray], ...]

    def __len__(self) -> int:
        return len(self.y)

    def row(self, i: int, which: int = 0) -> np.ndarray:
        ids, at = self.lists[which]
        return ids[at[i] : at[i + 1]]

    @classmethod
    def of(cls, y: Sequence[int], *lists: Sequence[np.ndarray]) -> Examples:
        """From arrays in the driver's memory."""
        flat = [(np.concatenate([*x, np.empty(0, np.int32)]).astype(np.int32), np.cumsum([0, *map(len, x)])) for x in lists]
        return cls(np.asarray(y, np.int8), tuple(flat))


def collected(rows: DataFrame, *columns: str) -> Examples:
    """_y and the array<int> columns of rows(_id, _y, ...), in the order of a hash of _id.

    The executors have made the ids: no text reaches the driver, and a feature takes 4 bytes there.
    """
    t = rows.select(F.xxhash64("_id").alias("_h"), "_id", "_y", *columns).orderBy("_h", "_id").drop("_h", "_id").toArrow()
    out = []
    for c in columns:
        chunks = t.column(c).chunks
        ids = [x.flatten().to_numpy() for x in chunks]
        sizes = [x.value_lengths().to_numpy().astype(np.int64) for x in chunks]
        out.append((np.concatenate([*ids, np.empty(0, np.int32)]), np.concatenate(([0], np.cumsum(np.concatenate([*sizes, np.empty(0, np.int64)]))))))
        t = t.drop_columns([c])
    return Examples(t.column("_y").to_numpy().astype(np.int8), tuple(out))
