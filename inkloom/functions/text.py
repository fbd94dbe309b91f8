"""Text metrics as column expressions. Every function takes a string column; null counts as empty."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The word pattern and the style lexicons that results are defined by.
WORD = r"[A-Za-z0-9][A-Za-z0-9'\-]*"
HEDGES = (
    "arguably", "somewhat", "generally", "largely", "broadly", "roughly",
    "approximately", "tends to", "appears to", "seems to", "suggests that",
    "may indicate", "could be", "might be", "potentially", "possibly",
    "to some extent", "in some cases", "in many cases",
)
INFORMAL = (
    "don't", "doesn't", "didn't", "can't", "won't", "isn't", "aren't",
    "wasn't", "weren't", "it's", "that's", "gonna", "wanna", "kinda",
    "a lot of", "lots of", "stuff", "things", "okay", "basically",
    "pretty good", "really good", "big deal", "by the way",
)
TEMPLATES = (
    "in this paper, we", "in this study, we", "this paper presents",
    "this paper proposes", "this paper introduces", "we propose a novel",
    "it is important to note", "it is worth noting", "it should be noted",
    "in conclusion,", "furthermore,", "moreover,", "additionally,",
    "as a result,", "in other words,", "overall,", "lastly,",
    "in recent years", "plays a crucial role", "plays an important role",
    "has gained significant attention", "in the field of",
)
CONTRIBUTION = (
    "novel", "first", "contribution", "we propose", "we introduce",
    "we present", "we develop", "we design", "we build", "our approach",
    "state-of-the-art", "outperform", "improves", "significantly",
)
GRAM_STOP = (
    "and", "the", "of", "to", "in", "a", "is", "for", "on", "with", "that", "this", "we", "as", "by", "are", "was", "were", "it", "an", "at", "be", "or", "from",
    "can", "our", "their", "its", "has", "have", "not", "but", "so", "if", "than", "then", "also", "such", "which", "these", "those", "using", "used", "based",
    "shown", "show", "results", "result", "data", "figure", "table",
)


def text_of(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def words(c: str | Column) -> Column:
    return F.regexp_extract_all(text_of(c), F.lit(WORD), F.lit(0))


def lower_words(c: str | Column) -> Column:
    return words(F.lower(text_of(c)))


def sentences(c: str | Column) -> Column:
    """Pieces between sentence ends followed by white space, without empty ones."""
    return F.filter(F.split(text_of(c), r"(?<=[.!?])\s+"), lambda s: s.rlike(r"\S"))


def lines(c: str | Column) -> Column:
    return F.filter(F.split(text_of(c), "\n"), lambda s: s.rlike(r"\S"))


def mean(a: Column) -> Column:
    """0 for an empty array."""
    return F.when(F.size(a) > 0, total(a) / F.size(a)).otherwise(F.lit(0.0))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def stdev(a: Column, m: Column) -> Column:
    """Sample standard deviation of an array with mean m; 0 under two values."""
    squares = F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - m) * (x - m))
    return F.when(F.size(a) > 1, F.sqrt(squares / (F.size(a) - 1))).otherwise(F.lit(0.0))


def syllables(word: Column) -> Column:
    w = F.lower(word)
    n = F.regexp_count(w, F.lit("[aeiouy]+"))
    silent = w.endswith("e") & (F.length(w) > 3) & ~w.rlike("[aeiou]e$")
    return F.when(n == 0, 1).when(silent, F.greatest(n - 1, F.lit(1))).otherwise(n)


def occurrences(text: Column, term: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / len(term)).cast("int")


def term_count(c: str | Column, terms: Sequence[str]) -> Column:
    """Occurrences of all terms in the lower-cased text; a single word must follow a space (or start the text)."""
    low = F.concat(F.lit(" "), F.lower(text_of(c)), F.lit(" "))
    out = F.lit(0)
    for t in terms:
        out = out + occurrences(low, t if " " in t else f" {t}")
    return out


def grams(tokens: Column, n: int) -> Column:
    """All runs of n tokens, joined by spaces. Items are got one by one: slice() copies the whole array each time."""
    last = F.size(tokens) - n
    places = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.concat_ws(" ", *[F.get(tokens, i + k) for k in range(n)]))
