"""Operator 8: toxicity classifier with counterfactual regularisation.

Logistic regression over hashed words and their first 4, 5 and 6 bytes (FTRL). For every training text a counterfactual is
made by swapping identity terms for others of their kind, and each step adds the gradient of
strength * (score(x) - score(x'))^2, so that mentions of a group alone can't carry a score.

Terms are of two sorts. IDENTITY lists groups in four languages. As no list knows every corpus, further kinds are mined:
words that are about as frequent in texts of either label name nothing toxic by themselves; those of one frequency band
and first byte form a kind. A text without any term gets a neutral mention added, so the pair (mention, no mention) exists
in any corpus.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkloom.llm import common
from inkloom.llm.linear import FTRL, Examples, Space, collected
from inkloom.llm.quality import QualityModel

#: Identity terms by kind (English, German, French, Spanish); a term is swapped for another of its kind and language.
IDENTITY = {
    "gender_en": ("women", "men", "girls", "boys", "woman", "man", "transgender", "female", "male"),
    "gender_de": ("frauen", "männer", "mädchen", "jungen", "transpersonen"),
    "gender_fr": ("femmes", "hommes", "filles", "garçons", "transgenres"),
    "gender_es": ("mujeres", "hombres", "chicas", "chicos", "transexuales"),
    "religion_en": ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "muslims", "christians", "jews"),
    "religion_de": ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"),
    "religion_fr": ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
    "religion_es": ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
    "origin_en": ("black", "white", "asian", "african", "european", "mexican", "arab", "immigrant", "immigrants"),
    "origin_de": ("schwarze", "weiße", "asiaten", "afrikaner", "araber", "migranten"),
    "origin_fr": ("noirs", "blancs", "asiatiques", "africains", "arabes", "immigrés"),
    "origin_es": ("negros", "blancos", "asiáticos", "africanos", "árabes", "inmigrantes"),
    "orientation_en": ("gay", "lesbian", "straight", "bisexual", "queer", "heterosexual"),
    "orientation_de": ("schwule", "lesben", "heteros", "bisexuelle"),
    "orientation_fr": ("homosexuels", "lesbiennes", "hétérosexuels", "bisexuels"),
    "orientation_es": ("homosexuales", "lesbianas", "heterosexuales", "bisexuales"),
    "age_ability_en": ("old", "young", "elderly", "disabled", "deaf", "blind", "autistic"),
}
WORD = re.compile(r"[^\W\d_]+")


class Terms:
    """Which words are swapped for which: {word: its kind's words}."""

    def __init__(self, mined: Sequence[Sequence[str]] = ()):
        self.of: dict[str, tuple[str, ...]] = {}
        self.listed = [w for words in IDENTITY.values() for w in words]
        for words in (*IDENTITY.values(), *mined):
            for w in words:
                if len(words) > 1:
                    self.of.setdefault(w, tuple(words))

    def counterfactual(self, text: str, pick: int) -> str:
        """The text with every term swapped for another of its kind; without one, with a neutral mention added."""
        found = False

        def other(m: re.Match) -> str:
            nonlocal found
            words = self.of.get(m[0].lower())
            if words is None or m[0].lower() not in words:
                return m[0]
            found = True
            return words[(words.index(m[0].lower()) + 1 + pick % (len(words) - 1)) % len(words)]

        swapped = WORD.sub(other, text)
        return swapped if found else f"{text} {self.listed[pick % len(self.listed)]}"

    def mentions(self, text: str) -> str:
        """The text with one more neutral mention."""
        return f"{text} {self.listed[len(text) % len(self.listed)]}"


def mined_terms(rows: DataFrame, least: int = 20, ratio: float = 1.5, most: int = 2000) -> list[list[str]]:
    """Kinds of words that occur alike in texts of label 1 and 0, from rows(_t, _y) of the training sample.

    A word of `least` texts or more counts if its shares among the two labels' texts differ by less than `ratio`. Kinds:
    the frequency's power of two and the first letter. At most `most` words, the most frequent ones, take part: they only
    shape the training penalty.
    """
    n = rows.agg(F.count_if(F.col("_y") == 1).alias("a"), F.count_if(F.col("_y") == 0).alias("b")).first()
    if not n or not n["a"] or not n["b"]:
        return []
    words = rows.select("_y", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("_t"), F.lit(r"\p{L}+"), F.lit(0)))).alias("w"))
    counts = words.groupBy("w").agg(F.count_if(F.col("_y") == 1).alias("a"), F.count_if(F.col("_y") == 0).alias("b"))
    one, two = F.col("a") / F.lit(n["a"]), F.col("b") / F.lit(n["b"])
    alike = counts.where((F.col("a") + F.col("b") >= least) & (one < two * ratio) & (two < one * ratio))
    found = alike.orderBy(F.desc(F.col("a") + F.col("b")), "w").limit(most).collect()
    kinds: dict[tuple[int, str], list[str]] = {}
    for r in found:
        kinds.setdefault(((r["a"] + r["b"]).bit_length(), r["w"][0]), []).append(r["w"])
    return [words for words in kinds.values() if len(words) > 1]


def differences(mine: Sequence[np.ndarray], other: Sequence[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(ids that only the counterfactual has, ids that only the text has) of each pair."""
    return [np.setdiff1d(b, a, assume_unique=True) for a, b in zip(mine, other)], [np.setdiff1d(a, b, assume_unique=True) for a, b in zip(mine, other)]


def examples(rows: Sequence[tuple[str, int]], space: Space, terms: Terms) -> Examples:
    """What fit() collects, of (text, label) in the driver's memory."""
    mine = space.rows([t for t, _ in rows])
    other = space.rows([terms.counterfactual(t, k) for k, (t, _) in enumerate(rows)])
    return Examples.of([y for _, y in rows], mine, *differences(mine, other))


def train(rows: Examples, space: Space, epochs: int = 4, alpha: float = 0.3, l1: float = 6.0, l2: float = 1.0, strength: float = 0.3, positive: float = 3.0) -> QualityModel:
    """Fit on the ids of texts (list 0) and what their counterfactuals have more (1) and less (2); strength 0: no penalty.

    positive: weight of label 1.
    """
    learner = FTRL(1 << space.bits, alpha=alpha, l1=l1, l2=l2)
    bias = np.array([1 << space.bits])
    for epoch in range(epochs):
        for k in np.random.default_rng(epoch).permutation(len(rows)):
            x, y = rows.row(k), int(rows.y[k])
            learner.learn(np.concatenate((x, bias)), y, positive if y else 1.0)
            if strength:
                more, less = rows.row(k, 1), rows.row(k, 2)
                ids = np.concatenate((more, less))
                sign = np.concatenate((np.ones(more.size), -np.ones(less.size)))
                w = learner.weights(ids)
                gap = float(w @ sign)
                if gap:
                    learner.push(ids, 2 * strength * gap * sign, w)
    return QualityModel(space, *learner.all_weights())


def fit(docs: DataFrame, labels: DataFrame, sample: int = 10_000, sample_chars: int = 40_000, bits: int = 20, strength: float = 0.3) -> QualityModel:
    """A model from about `sample` labelled rows that aren't held out; their features are made on the executors."""
    space = Space(orders=(1,), words_only=True, bits=bits, prefixes=(4, 5, 6))
    rows = common.written(common.labelled_rows(docs, labels, "toxic", sample, sample_chars), "toxic-sample")
    terms = Terms(mined_terms(rows))

    @F.pandas_udf("x array<int>, more array<int>, less array<int>")
    def pairs(texts: pd.Series, ids: pd.Series) -> pd.DataFrame:
        mine = space.rows(texts.tolist())
        more, less = differences(mine, space.rows([terms.counterfactual(t, int(i)) for t, i in zip(texts, ids)]))
        return pd.DataFrame({c: pd.Series([x.astype(np.int32) for x in v], dtype=object) for c, v in (("x", mine), ("more", more), ("less", less))})

    found = rows.select("_id", "_y", pairs("_t", F.pmod(F.xxhash64("_id"), F.lit(1 << 20))).alias("_p")).select("_id", "_y", "_p.*")
    model = train(collected(found, "x", "more", "less"), space, strength=strength)
    common.release(rows)
    return model


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, sample: int = 10_000, strength: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs.

    Training takes about `sample` labelled rows; scoring takes every row and whole texts. Null or empty text: the score of
    a text without words (the bias, low where most labels are 0). Null doc_id: kept, not held out. Repeated rows are
    scored alike, an empty table gives no rows, other columns are ignored. Without labels every score is 0.5.
    """
    model = fit(docs, labels, sample, strength=strength)
    scored = docs.select("doc_id", common.held_out().alias("held_out"), model.column("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame, training: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score under the threshold, with all their columns; `training`: the texts to learn from.

    Without any usable label nothing is known and every row stays.
    """
    model = fit(docs if training is None else training, labels)
    if not model.ids.size:
        return docs
    return docs.where(model.column("text") < threshold)


def op8_toxicity_counterfactual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
