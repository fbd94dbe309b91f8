"""Pieces of DuckDB SQL shared by the oracles."""

from __future__ import annotations

import re
from collections.abc import Sequence

from inkloom.operators import rules

WORDS = r"regexp_extract_all({0}, '[A-Za-z0-9][A-Za-z0-9''\-]*')"


def words(x: str) -> str:
    return WORDS.format(x)


def sentences(x: str) -> str:
    return rf"list_filter(string_split(regexp_replace({x}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: regexp_matches(s, '\S'))"


def lines(x: str) -> str:
    return rf"list_filter(string_split({x}, chr(10)), lambda s: regexp_matches(s, '\S'))"


def gram_rows(table: str, key: str, tokens: str, n: int) -> str:
    """key, pos, gram: all runs of n tokens; `tokens` makes a list of a row of the table."""
    parts = ", ".join(["w", *(f"lead(w, {k}) over o" for k in range(1, n))])
    return f"""select {key}, pos, gram from (
        select {key}, pos, concat_ws(' ', {parts}) as gram, lead(w, {n - 1}) over o as last
        from (select {key}, unnest(t) as w, generate_subscripts(t, 1) as pos from (select {key}, {tokens} as t from {table}))
        window o as (partition by {key} order by pos)) where last is not null"""


def occurrences(x: str, term: str) -> str:
    t = term.replace("'", "''")
    return f"((length({x}) - length(replace({x}, '{t}', ''))) // {len(term)})"


def term_count(x: str, terms: Sequence[str]) -> str:
    low = f"(' ' || lower({x}) || ' ')"
    return "(" + " + ".join(occurrences(low, t if " " in t else f" {t}") for t in terms) + ")"


def quoted(items: Sequence[str]) -> str:
    return "[" + ", ".join("'" + s.replace("'", "''") + "'" for s in items) + "]"


#: Text whose accented letters are underscores: RE2's word bounds know ASCII only, and so find the same bounds as others.
PLAIN = "regexp_replace({0}, '[À-ÖØ-öø-ʯ]', '_', 'g')"


def text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _subject(pattern: str) -> tuple[str, str]:
    column, p = rules.subject(pattern)
    return (f"{column}_plain" if r"\b" in p else column), p


def found(pattern: str) -> str:
    """Whether a rule's pattern is found in a row with low, text, low_plain and text_plain."""
    column, p = _subject(pattern)
    return f"regexp_matches({column}, {text(p)})"


def matches(patterns: Sequence[str]) -> str:
    each = [(column, p) for column, p in map(_subject, patterns)]
    return " + ".join(f"len(regexp_extract_all({c}, {text(p)}))" for c, p in each)
