"""Operator 4: quality classifier, hashed word n-gram logistic regression trained with FTRL updates."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkloom.llm import common
from inkloom.llm.linear import FTRL, Examples, Space, collected, sigmoid


@dataclass(frozen=True)
class QualityModel:
    """Weights of a trained classifier; only those other than 0 are held."""

    space: Space
    ids: np.ndarray
    values: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        w = np.zeros(1 << self.space.bits)
        w[self.ids] = self.values
        return w

    def probabilities(self, texts) -> np.ndarray:
        return sigmoid(self.space.scores(texts, self.dense(), self.bias))

    def column(self, text: str | Column) -> Column:
        """The score of a text column, batch by batch in Python workers; null counts as empty."""
        space, ids, values, bias = self.space, self.ids, self.values, self.bias

        @F.pandas_udf("double")
        def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            w = np.zeros(1 << space.bits)
            w[ids] = values
            for texts in batches:
                yield pd.Series(sigmoid(space.scores(texts.tolist(), w, bias)))

        return score(text)


def train(rows: Examples, space: Space, epochs: int = 3, alpha: float = 0.05, l1: float = 3.0, l2: float = 1.0) -> QualityModel:
    """Fit on feature ids and labels. Without rows the model scores every text 0.5; with one class, towards that class."""
    learner = FTRL(1 << space.bits, alpha=alpha, l1=l1, l2=l2)
    bias = np.array([1 << space.bits])
    for epoch in range(epochs):
        for k in np.random.default_rng(epoch).permutation(len(rows)):
            learner.learn(np.concatenate((rows.row(k), bias)), int(rows.y[k]))
    return QualityModel(space, *learner.all_weights())


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = 8000, sample_chars: int = 40_000, bits: int = 20) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs.

    Training takes about `sample` labelled rows of at most `sample_chars` characters (see labelled_rows); scoring takes
    every row and whole texts. Null or empty text: the score of a text without n-grams (the bias). Null doc_id:
    kept, not held out. Repeated rows are scored alike, an empty table gives no rows, other columns are ignored.
    """
    space = Space(orders=(1, 2), shape_orders=(1, 2, 3), bits=bits)
    rows = common.labelled_rows(docs, labels, "quality", sample, sample_chars)
    model = train(collected(rows.withColumn("_x", space.column("_t")), "_x"), space)
    scored = docs.select("doc_id", common.held_out().alias("held_out"), model.column("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op4_quality_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
