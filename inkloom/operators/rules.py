"""Checks as data: a rule fires when its patterns are found, or aren't, as it says.

All rules of a run are evaluated together. A batch of texts is read once for the strings that matches of their patterns
must hold, and for words and tokens (strings.summary(), a numeric kernel). After that a pattern is searched for one
alternative at a time: one that is a few plain strings is decided by the strings found, any other by its regular expression,
in texts that hold all strings that a match must hold. Each distinct expression is compiled once for a batch and searched by
Arrow in all texts at once that need it; texts with signs of which regular expressions think differently (strings.plain())
are left to Spark's.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkloom.functions import strings as S
from inkloom.functions import text as T


class OnLow(str):
    """A pattern for the lower-cased text, capitals and all: one with a capital is never found there. It decides results."""


class OnText(str):
    """A pattern for the text as it is. A plain string is a pattern that ignores case."""


@dataclass(frozen=True)
class Rule:
    """Fires when all of `need` and none of `lack` are found, and all further conditions hold.

    unless: pairs (found, missing): a text with the first and without the second is let off. counts: pairs (patterns,
    least): so many matches in all; count_most and per_1000 (matches for 1000 words, more than) bound the first pair.
    distinct, fewer: of these patterns fewer than so many are found. {n} in the title is the first pair's count.
    """

    category: str
    severity: str
    title: str
    need: tuple[str, ...]
    lack: tuple[str, ...]
    confidence: float
    action: str
    least_words: int = 0
    least_tokens: int = 0
    unless: tuple[tuple[str, str], ...] = ()
    counts: tuple[tuple[tuple[str, ...], int], ...] = ()
    count_most: int | None = None
    per_1000: float | None = None
    distinct: tuple[str, ...] = ()
    fewer: int = 0


# Patterns, titles, severities and confidences that results are defined by.
_STATS = OnLow(r"statistical\s+analysis|analy(?:zed|sis)|\bp\s*[<>=]|regression|t[- ]test|ANOVA|chi-?square|mean|median|SD|CI\b")
_ML = r"neural\s+network|deep\s+learning|machine\s+learning|trained\s+(?:our|the)\s+model|dataset|benchmark"
_REPO = OnLow(r"zenodo|figshare|dryad|github|gitlab|kaggle|osf\.io|ieee\s+dataport|mendeley|data\s+in\s+brief|4TU")
_SUPPLEMENT = OnLow(r"supplementary|supporting\s+(?:information|material)|supplemental|SI\s*(?:section|material)|e-?component|additional\s+(?:figures|files)")
_LIVING = r"participants?|patients?|subjects?|cohort|clinical|women|men|animals?|mice|rats?"
_SEX = r"\b(?:sex|gender)\b|male|female|\bf\b|\bm\b|men and women|boys and girls"
_TRIAL = r"clinical\s+trial|randomized|intervention|drug|vaccine|dos"
_TOOLS = r"chatgpt|gpt-?4|gpt-?5|claude|gemini|bard|copilot|llama|mistral|deepseek|midjourney|dall-?e|stable\s+diffusion|grammarly|quillbot|writefull|elicit|consensus|scite|epsilon"

RULES = (
    Rule("Stats Plan", "Medium", "Missing-data handling not described", (_STATS, r"participants?|patients?|subjects?|survey|questionnaire"), (r"missing\s+data|incomplete\s+data|non-?response|loss\s+to\s+follow-?up|attrition|imputation|multiple\s+imputation|complete-?case",), 0.70, "Describe how missing data were handled"),
    Rule("Stats Plan", "Low", "Outlier handling not described", (_STATS, OnLow(r"mean|regression|t[- ]test|ANOVA|outlier")), (r"outlier|extreme\s+value|trimmed|winsor|robust\s+(?:estimat|regression)",), 0.55, "State the definition and treatment of outliers"),
    Rule("Stats Plan", "Low", "No pre-specified analysis plan evident", (_STATS, r"explor|post-?hoc|secondary\s+analys"), (r"pre-?specified|pre-?registered|analysis\s+plan|primary\s+outcome|secondary\s+outcome|hypothes[ei]s\s+(?:was|were)\s+stated",), 0.55, "State which analyses were planned"),
    Rule("Safety Ethics", "High", "Pathogen/infectious work without biosafety level", (r"pathogen|virus|bacteria|culture|infectious|bsl-?\d",), (r"bsl-?\d|biosafety\s+level|institutional\s+biosafety",), 0.80, "State the biosafety level and its approval"),
    Rule("Safety Ethics", "Medium", "Trial without safety-monitoring statement", (_TRIAL,), (OnLow(r"data\s+safety\s+monitoring|DSMB|safety\s+committee|adverse\s+event"),), 0.65, "Describe safety oversight"),
    Rule("Safety Ethics", "Medium", "No adverse-event reporting", (_TRIAL,), (r"adverse\s+(?:event|effect)|side\s+effect|complication",), 0.60, "Add a paragraph on adverse events"),
    Rule("Supplementary", "High", "Data reported as 'not shown'", (r"data\s+(?:not\s+shown|not\s+presented|omitted)|results?\s+(?:not\s+shown|not\s+presented)|figure\s+not\s+shown|not\s+shown\s+here",), (), 0.85, "Move these data into the supplement"),
    Rule("Supplementary", "Medium", "No supplementary material section", (), (_SUPPLEMENT,), 0.65, "Add a section or state that there is none"),
    Rule("Supplementary", "Low", "Supplementary items not numbered", (_SUPPLEMENT,), (r"(?:supplementary|supporting|supplemental|additional)\s+(?:figure|table|fig|tab)\.?\s*[A-Z]?\d|Fig\.?\s*S\d|Table\s*S\d|Figure\s*S\d",), 0.70, "Number the items and cite each"),
    Rule("Repro Env", "Medium", "ML paper without code-availability statement", (_ML,), (r"code\s+(?:is|are|will\s+be)?\s*(?:publicly\s+)?available|github\.com|gitlab\.com|zenodo|software\s+availability|code\s+repository|open\s+source",), 0.75, "Release the code and say where"),
    Rule("Repro Env", "Low", "No computational-environment specification", (_ML,), (r"docker|conda|pip\s+install|environment\.yml|requirements\.txt|virtual\s+environment|python\s+\d",), 0.60, "Pin the versions of all dependencies"),
    Rule("Repro Env", "Medium", "Study protocol not registered", (r"clinical\s+trial|randomized|protocol",), (OnLow(r"registered|registration\s+number|ClinicalTrials\.gov|PROSPERO|OSF"),), 0.70, "Register the study and include the number"),
    Rule("Repro Env", "Low", "Train/test split not described", (_ML, r"train(?:ed|ing)\b.{0,80}(?:test|validation)|(?:test|validation)\s+set"), (r"hold-?out|cross-?validation|split|leakage|stratified",), 0.55, "Describe how the data were split"),
    Rule("SAGER", "Medium", "Sex/gender not reported", (_LIVING,), (_SEX,), 0.65, "Report the composition of the sample"),
    Rule("SAGER", "Low", "Sex reported but results not disaggregated", (_LIVING, _SEX, r"\b(?:male|female)\b"), (r"by (?:sex|gender)|sex-?stratified|stratified by|per (?:sex|gender)|separately for (?:male|female)|in (?:men|women)\b|in (?:males|females)\b",), 0.55, "Add stratified results or say why not"),
    Rule("Data License", "Medium", "No data availability or sharing statement", (), (r"data\s+availability|availability\s+of\s+data|data\s+sharing", _REPO), 0.75, "Add a statement that names the repository"),
    Rule("Data License", "Low", "Shared data without an open license", (_REPO,), (OnLow(r"creative\s+commons|CC[- ]?BY|CC0|open\s+license|license[d]?\s+under|public\s+domain|open\s+(?:access|data)"),), 0.65, "State the licence"),
    Rule("Data License", "Low", "Dataset without version indication", (_REPO,), (r"version|v\d+(?:\.\d+)?|released\s+(?:on|in)|updated",), 0.55, "Cite the version and its date"),
    Rule("Data License", "Medium", "Proprietary or protected data format mentioned", (r"proprietary\s+format|password-?protected|encrypted\s+file|licensed\s+software\s+(?:format|file)",), (), 0.70, "Convert the data to open formats"),
    Rule("Figure Quality", "High", "Western blots without markers/controls", (r"western\s+blot|immunoblot",), (r"molecular\s+(?:weight|mass)\s+marker|protein\s+ladder|kda\s+marker|loading\s+control|actin|gapdh|tubulin",), 0.80, "Show markers and loading controls"),
    Rule("Figure Quality", "Medium", "Cropped blots without uncropped originals", (r"western\s+blot|immunoblot",), (r"cropped|uncropped|full-?length\s+blot|original\s+blot",), 0.65, "Supply the uncropped images"),
    Rule("Figure Quality", "Medium", "Microscopy images without scale bar/magnification", (r"microscop|histolog|immunofluoresc|confocal|staining|stained",), (r"scale\s+bar|magnification|objective\s+(?:lens|\d+x)|nan?ometer|micron|micrometer|µm|um\b",), 0.75, "State the scale"),
    Rule("Figure Quality", "Medium", "Box plots without individual data points", (r"box[- ]?plot|box-?whisker",), (r"individual\s+(?:data\s+)?points|scatter|raw\s+data|all\s+points|overlay(?:ed)?\s+points|notches?\b",), 0.65, "Overlay the data points"),
    Rule("Figure Quality", "Low", "Possible red-green color coding in figures", (r"red[- ]green|green[- ]red", r"figure|plot|graph|color"), (), 0.55, "Use a palette that all can read"),
    Rule("Figure Quality", "Low", "Error bars not defined in captions", (r"error\s+bars?",), (OnLow(r"(?:represent|show|indicate|denote)s?\s+(?:the\s+)?(?:standard\s+)?(?:deviation|error)|\b(?:SD|SEM|SE)\b|95%\s*CI"),), 0.60, "Define the bars"),
    Rule("Submission", "Medium", "No Limitations section", (), (r"limitations?",), 0.80, "Add a section on threats to validity", 100),
    Rule("Submission", "Low", "No Future Work mentioned", (), (r"future\s+work|future\s+direction|future\s+research|conclusion",), 0.60, "Add an outlook", 100),
    Rule("Submission", "Low", "No ORCID iD found", (), (r"orcid|0000[- ]000[0-9][- ]000[0-9]",), 0.60, "Add the ids of all authors", 100),
    Rule("Submission", "Medium", "No keywords/index terms found", (), (r"(?:keywords?|index\s+terms?)\s*[:\-—]",), 0.85, "Add four to six keywords", 100),
    Rule("Submission", "High", "No corresponding author email", (), (r"[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}",), 0.95, "Add an address", 100),
    Rule("Submission", "High", "No explicit contribution statement", (), (r"contribut|novelty|what\s+this|we\s+(?:propose|present|introduce|develop)|our\s+(?:contribut|key)",), 0.85, "State what is new", 100),
    Rule("Submission", "High", "Clinical research without trial registration", (r"clinical\s+trial|patient\s+s?|cohort\s+study|randomiz",), (r"clinicaltrials\.gov|isrctn|registered|registration\s+(?:number|no)",), 0.80, "Register the trial", 100),
    Rule("AI Disclosure", "High", "AI tool named without disclosure statement", (_TOOLS,), (r"disclos|declared|decline|we\s+used\s+.+for\s+(?:language|grammar|writing)|assisted\s+(?:the\s+)?(?:drafting|writing|language)",), 0.85, "Say how the tool was used"),
    Rule("AI Disclosure", "High", "AI-generated figures without disclosure", (r"midjourney|dall-?e|stable\s+diffusion|ai-?generated\s+(?:image|figure)",), (r"disclos|declar|noted\s+that",), 0.90, "Disclose the images"),
    Rule("Safety Ethics", "Medium", "HIPAA data without de-identification statement", (OnText(r"hipaa|protected\s+health\s+information|PHI\b"),), (OnLow(r"de-?identif|anonymiz|limited\s+data\s+set|waiver"),), 0.70, "State the de-identification method (Safe Harbor/Expert Determination)"),
    Rule("Safety Ethics", "Medium", "EU personal data without GDPR safeguards", (OnText(r"GDPR|personal\s+data|EU\s+patients|european\s+patients"),), (OnLow(r"consent|anonymiz|pseudonymiz|ethical\s+approval|data\s+protection"),), 0.70, "State the lawful basis, consent, and data-protection measures"),
    Rule("SAGER", "Low", "Possible sex/gender terminology confusion", (_LIVING, _SEX, OnLow(r"\bgender\b"), OnLow(r"biological|hormon|chromosom|XX|XY")), (), 0.50, "Check that 'sex' and 'gender' are used correctly per SAGER"),
    Rule("Data License", "Low", "Data DOI present but not cited", (OnLow(r"doi\s*[:/]|https?://doi\.org|data\.dryad|zenodo\.org/records"),), (OnLow(r"cite(?:d| this| the)|citation:\s*\[?\d|please\s+cite"),), 0.55, "Add the recommended citation for the dataset"),
    Rule("Data License", "Low", "No raw data or format description", (OnLow(r"dataset|collected\s+data|our\s+data"),), (OnLow(r"raw\s+data|original\s+measurements|underlying\s+data|source\s+data|individual\s+(?:participant|patient)\s+data|\.(?:csv|tsv|json|xml|parquet|hdf5?|mat|npy|nc)|machine-?readable|open\s+format"),), 0.60, "Describe the raw data and file formats"),
    Rule("AI Disclosure", "Medium", "AI-assisted analysis without human-verification statement", (OnLow(r"(?:machine|deep)\s+learning.{0,40}(?:analyz|classif|predict)"), OnLow(r"chatgpt|gpt-?4|gpt-?5|llm")), (OnLow(r"validat|manual(?:ly)?\s+(?:verif|review|check)|human\s+(?:review|verification)"),), 0.65, "State that humans verified all AI-assisted outputs"),
    Rule("AI Disclosure", "Low", "EU-context paper without EU AI Act note", (OnText(r"european|EU\s+funder|Horizon"), OnLow(r"chatgpt|gpt-?4|gpt-?5|claude|gemini|llm")), (OnText(r"EU\s+AI\s+Act"),), 0.50, "Check EU AI Act transparency duties for AI-generated content"),
    Rule("AI Disclosure", "Critical", "AI appears to be listed as an author", (OnLow(r"(?:chatgpt|gpt-?4|gpt-?5|claude|gemini|llm)\s*(?:,|\band\b)?\s*[A-Z]?\s*[a-z]*\s*et\s+al|\bAI\b\s+(?:as\s+)?(?:co-?)?author"),), (), 0.80, "Remove any AI attribution from the author list; disclose tool use in Methods/Acknowledgments instead"),
)


@lru_cache(maxsize=1)
def all_rules() -> tuple[Rule, ...]:
    from inkloom.operators import engines, guidelines

    return (*RULES, *guidelines.RULES, *engines.RULES)


def lowered(pattern: str) -> str:
    """The pattern with its literals in lower case; escapes such as \\S keep their case."""
    return re.sub(r"\\.|[A-Z]", lambda m: m[0] if m[0][0] == "\\" else m[0].lower(), pattern)


def subject(pattern: str) -> tuple[str, str]:
    """(column, pattern to search there): "low" or "text"."""
    if isinstance(pattern, OnText):
        return "text", str(pattern)
    return "low", str(pattern) if isinstance(pattern, OnLow) else lowered(pattern)


@lru_cache(maxsize=None)
def literals(pattern: str) -> tuple[str, ...]:
    """Strings of which every match holds at least one; none: nothing is known (or too little to be of use)."""
    from re import _constants as C
    from re import _parser as parser

    def rarity(s: str) -> int:
        """0 for what nearly every text holds."""
        return min(len(s), 3) if len(s) > 1 else 2 * (not s.isalnum() and s not in " .,-\n\t")

    def better(x: frozenset | None, y: frozenset | None) -> frozenset | None:
        if not x or not y:
            return x or y
        return max(x, y, key=lambda s: (min(map(rarity, s)), -len(s), min(map(len, s))))

    def of(items: Iterable) -> frozenset | None:
        best, run = None, ""
        for op, value in items:
            if op is C.LITERAL:
                run += chr(value)
                continue
            if op is C.AT:
                continue
            best, run = better(best, frozenset([run]) if run else None), ""
            if op is C.BRANCH:
                parts = [of(x) for x in value[1]]
                if all(parts):
                    best = better(best, frozenset().union(*parts))
            elif op is C.IN and all(o is C.LITERAL for o, _ in value):
                best = better(best, frozenset(chr(x) for _, x in value))
            elif op is C.SUBPATTERN:
                best = better(best, of(value[-1]))
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and value[0] > 0:
                best = better(best, of(value[2]))
        return better(best, frozenset([run]) if run else None)

    found = of(parser.parse(pattern)) or frozenset()
    return tuple(sorted(found)) if found and min(map(rarity, found)) and len(found) <= 40 else ()


def unicode_bounds(pattern: str) -> str:
    """Word bounds that take all letters as word signs, whatever the Java version."""
    return f"(?U){pattern}" if r"\b" in pattern else pattern


def quoted(s: str) -> str:
    """A string literal of Spark's SQL."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


@lru_cache(maxsize=8)
def _places(known: tuple[str, ...]) -> dict[str, int]:
    return {s: k for k, s in enumerate(known)}


def masks(strings: Iterable[str], known: Sequence[str]) -> list[tuple[int, int]]:
    """(number, bits): where strings.summary() marks the strings."""
    place, out = _places(tuple(known)), {}
    for s in strings:
        k = place[s.lower()]
        out[k // S.BITS] = out.get(k // S.BITS, 0) | 1 << k % S.BITS
    return sorted(out.items())


def any_of(column: str, strings: Iterable[str], known: Sequence[str]) -> str:
    """SQL: whether the column holds any of the strings, all of which are among the `known` ones (in lower case)."""
    strings = tuple(strings)
    there = " or ".join(f"(hits[{2 + n}] & {mask}L) != 0" for n, mask in masks(strings, known))
    if column == "low":
        return f"({there})"
    return f"(({there}) and ({' or '.join(f'contains({column}, {quoted(x.strip(S.EDGE))})' for x in strings)}))"


def alternatives(pattern: str) -> list[str]:
    """Patterns of which one is found in exactly the texts where this one is: its outermost alternatives."""
    if re.search(r"\\[1-9]|\(\?(?:P|[a-zA-Z]+[:)])", pattern):
        return [pattern]  # groups are referred to, or flags set
    parts, depth, start, k = [], 0, 0, 0
    while k < len(pattern):
        c = pattern[k]
        if c == "\\":
            k += 1
        elif c == "[":
            k += 2 if pattern[k + 1] == "^" else 1
            while pattern[k + 1] != "]":  # a bracket that comes first stands for itself
                k += 2 if pattern[k + 1] == "\\" else 1
            k += 1
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and depth == 0:
            parts.append(pattern[start:k])
            start = k + 1
        k += 1
    return [*parts, pattern[start:]]


def shortest(strings: Iterable[str]) -> list[str]:
    """Those of the strings that hold no other of them: a text holds one of these if it holds one of all."""
    out = []
    for s in sorted(set(strings), key=lambda s: (len(s), s)):
        if not any(x in s for x in out):
            out.append(s)
    return out


def spelled(items: Iterable, most: int = 24) -> set[str] | None:
    """All strings that a parsed pattern matches; None: more than `most`, or not known."""
    from re import _constants as C

    out = {""}
    for op, value in items:
        if op is C.LITERAL:
            each = {chr(value)}
        elif op is C.IN and all(o is C.LITERAL for o, _ in value):
            each = {chr(x) for _, x in value}
        elif op is C.BRANCH:
            parts = [spelled(x, most) for x in value[1]]
            each = None if None in parts else set().union(*parts)
        elif op is C.SUBPATTERN:
            each = spelled(value[-1], most)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and value[:2] == (0, 1):
            each = spelled(value[2], most)
            each = None if each is None else {"", *each}
        else:
            return None
        if each is None or len(out) * len(each) > most:
            return None
        out = {a + b for a in out for b in each}
    return out


def held(items: Iterable, most: int = 24) -> list[set[str]]:
    """Sets of strings: every match of a parsed pattern holds one of each set."""
    from re import _constants as C

    out, run = [], {""}
    for op, value in items:
        if op in (C.AT, C.ASSERT, C.ASSERT_NOT):
            continue
        each = spelled([(op, value)], most)
        if each is not None and len(run) * len(each) <= most:
            run = {a + b for a in run for b in each}
            continue
        out.append(run)
        run = each or {""}
        if each is not None:
            continue
        if op is C.BRANCH:
            parts = [best(held(x, most)) for x in value[1]]
            out += [set().union(*parts)] if all(parts) else []
        elif op is C.SUBPATTERN:
            out += held(value[-1], most)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and value[0] > 0:
            out += held(value[2], most)
    return [x for x in (*out, run) if x and "" not in x]


def whole(items: Sequence) -> set[str] | None:
    """All strings that a parsed pattern matches, word bounds at its ends marked by strings.EDGE; None: not known."""
    from re import _constants as C

    bound = [items[k][0] is C.AT and items[k][1] is C.AT_BOUNDARY for k in (0, -1)] if len(items) > 1 else [False, False]
    inner = spelled(items[bound[0] : len(items) - bound[1]])
    if not any(bound) or inner is None:
        return None
    sign = lambda c: re.fullmatch("[A-Za-z0-9_]", c)
    return {S.EDGE * bool(bound[0] and sign(x[0])) + x + S.EDGE * bool(bound[1] and sign(x[-1])) for x in inner if x} if "" not in inner else None


def rarity(strings: Iterable[str]) -> float:
    """The higher, the fewer texts are likely to hold one of the strings."""
    return min((min(len(s), 6) + 2 * (not (s.isalnum() and s.isascii()) and s not in " .,-\n\t") for s in strings), default=0) - 0.05 * len(list(strings))


def common(strings: Iterable[str]) -> bool:
    """Whether nearly every English text holds one of the strings, and most of them often: to find them all takes long."""
    return not _COMMON.isdisjoint(strings)


_COMMON = frozenset(x for x in (*T.GRAM_STOP, "here", "were", "who", "what") if len(x) > 2)


@lru_cache(maxsize=None)
def needed(pattern: str) -> tuple[str, ...]:
    """literals(), but for those that are common: the best ones of each alternative."""
    from re import _parser as parser

    some = literals(pattern)
    if not common(some):
        return some
    each = [best([set(x) for x in map(shortest, held(list(parser.parse(part)))) if not common(x)]) for part in alternatives(pattern)]
    return tuple(sorted(set().union(*each))) if all(rarity(x) > 2 for x in each) else some


def best(sets: list[set[str]]) -> set[str]:
    return max(sets, key=rarity, default=set())


@lru_cache(maxsize=None)
def pieces(pattern: str, lower: bool) -> tuple[tuple[str, ...], tuple[tuple[tuple[tuple[str, ...], ...], str], ...]]:
    """(strings, ((sets, regular expression), ...)): the pattern is found in a text that holds one of the strings, or one of
    each of the sets and a match of the expression besides. lower: the text is in lower case, so no capital is found.
    """
    from re import _constants as C
    from re import _parser as parser

    plain, others = set(), []
    for part in alternatives(pattern):
        items = list(parser.parse(part))
        for end in (0, -1):  # what may be missing at an end makes no difference
            while items and items[end][0] in (C.MAX_REPEAT, C.MIN_REPEAT) and items[end][1][0] == 0:
                items.pop(end)
        possible = lambda strings: {s for s in strings if not (lower and re.search("[A-Z]", s))}
        strings = spelled(items)
        if strings is not None:
            plain |= possible(strings)
            continue
        bounded = whole(items)
        sets = [possible(x) for x in held(items)] if bounded is None else [possible(bounded)]
        if all(sets):
            sets = sorted(filter(lambda x: rarity(x) > 2, map(shortest, sets)), key=rarity, reverse=True)[:3]
            sets = [x for x in sets if not common(x)] or sets
            others.append((tuple(map(tuple, sets)), part))
    strings = tuple(shortest(plain))
    implied = lambda sets: any(all(any(s in x for s in strings) for x in each) for each in sets)
    return strings, tuple(x for x in others if not implied(x[0]))


def hits(known: Sequence[str]) -> Column:
    """The column `hits` that any_of() asks, of the column low: its words, its tokens, and a bit for each known string."""
    strings = tuple(known)

    @F.arrow_udf("array<long>")
    def summary(low: pa.Array) -> pa.Array:
        return S.summary(low, strings)

    return summary("low")


def known_strings(rules: Sequence[Rule]) -> tuple[str, ...]:
    """All strings, in lower case, that found() and matches() ask for. Those asked for together stand together."""
    out = {}
    for r in rules:
        for pattern in _asked(r):
            column, p = subject(pattern)
            strings, others = pieces(p, column == "low")
            out |= dict.fromkeys(s.lower() for s in (*strings, *(s for sets, _ in others for x in sets for s in x)))
        for pattern in (p for c in r.counts for p in c[0]):
            out |= dict.fromkeys(s.lower() for s in needed(subject(pattern)[1]))
    return tuple(out)


def found(pattern: str, known: Sequence[str]) -> str:
    """SQL: whether a pattern is found in a row with the columns low, text and hits."""
    column, p = subject(pattern)
    strings, others = pieces(p, column == "low")
    flags = unicode_bounds(p)[: -len(p)]  # those of the whole pattern hold for each part
    each = [any_of(column, strings, known)] if strings else []
    for sets, part in others:
        each.append("(" + " and ".join([*(any_of(column, x, known) for x in sets), f"{column} rlike {quoted(flags + part)}"]) + ")")
    return f"({' or '.join(each) or 'false'})"


def arrows(expression: str) -> tuple[bool, str] | None:
    """(whether it is for strings.bounded() texts, the expression for Arrow); None: only Spark finds the same in plain() texts.

    Arrow knows ASCII word signs only, so accented letters are underscores where these count; they must not be asked for there.
    """
    plain = expression.removeprefix("(?U)")
    if not re.search(r"\\[bBwW]", plain) or expression == plain and not re.search(r"\\[bB]", plain):
        return False, plain
    return None if plain == expression or re.search(r"_|\[\^[^\]]*\\[wW]|[À-ÖØ-öø-ſ]", plain) else (True, plain)


class Evaluation:
    """Rules as numeric kernels over a batch of texts: what strings leave open is asked of regular expressions in between."""

    def __init__(self, rules: Sequence[Rule]):
        self.rules, self.known = tuple(rules), known_strings(rules)
        self.expressions: dict[str, dict[str, int]] = {"low": {}, "text": {}}
        self.counted: dict[str, dict[str, int]] = {"low": {}, "text": {}}
        self.patterns: dict[str, tuple] = {}
        for r in self.rules:
            for p in _asked(r):
                self.patterns.setdefault((type(p), p), self._pattern(p))
            for p in (p for c in r.counts for p in c[0]):
                column, q = subject(p)
                self.counted[column].setdefault(unicode_bounds(q), len(self.counted[column]))
        self.asked = {k: (self.counted if k.startswith("n_") else self.expressions)[k.removeprefix("n_")] for k in _KINDS}
        self.arrows = {k: [arrows(x) for x in known] for k, known in self.asked.items()}

    def _pattern(self, pattern: str) -> tuple:
        """(column, strings that decide, ((sets of strings, expression), ...)); strings are never enough for the text as it is."""
        column, p = subject(pattern)
        strings, others = pieces(p, column == "low")
        flags = unicode_bounds(p)[: -len(p)]
        others = [(sets, flags + part) for sets, part in others]
        if column == "text" and strings:
            others.append(((strings,), "|".join(map(re.escape, strings))))
        number = self.expressions[column]
        parts = tuple((tuple(masks(x, self.known) for x in sets), number.setdefault(part, len(number))) for sets, part in others)
        return column, masks(strings, self.known) if column == "low" else [], parts

    def open(self, hits: np.ndarray, filled: np.ndarray, seen: dict | None = None) -> dict[str, np.ndarray]:
        """For each text the expressions to search ("low", "text") and to count ("n_low", "n_text"): matrices of booleans."""
        out = {k: np.zeros((len(hits), len(x)), bool, "F") for k, x in self.asked.items()}
        seen = {} if seen is None else seen
        for r in self.rules:
            may = self._may(r, hits, filled, seen)
            if not may.any():
                continue
            for p in _asked(r):
                column, sure, parts, _ = self._looked(p, hits, seen)
                for guard, k in parts:
                    out[column][:, k] |= may & guard & ~sure
            for p in (p for c in r.counts for p in c[0]):
                column, q = subject(p)
                some = needed(q)
                out[f"n_{column}"][:, self.counted[column][unicode_bounds(q)]] |= may & (_any(hits, masks(some, self.known)) if some else True)
        return out

    def searched(self, low: pa.Array, text: pa.Array, todo: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """The results that open() asks for: matrices of numbers. All texts are plain()."""
        out = {kind: np.zeros(wanted.shape, np.int64 if kind.startswith("n_") else bool, "F") for kind, wanted in todo.items()}
        for column, texts in (("low", low), ("text", text)):
            kinds = (column, f"n_{column}")
            need = np.zeros(len(texts), bool)
            for kind in kinds:
                for k in (k for k, x in enumerate(self.arrows[kind]) if x is not None and x[0]):
                    need |= todo[kind][:, k]
            place, bounded = np.cumsum(need) - 1, S.bounded(texts.filter(pa.array(need)))
            for kind in kinds:
                for k in np.flatnonzero(todo[kind].any(0)):
                    rows, (by_bounds, expression) = np.flatnonzero(todo[kind][:, k]), self.arrows[kind][k]
                    some = bounded.take(pa.array(place[rows])) if by_bounds else texts if len(rows) == len(texts) else texts.take(pa.array(rows))
                    if kind == column:
                        there = pa.compute.match_substring_regex(some, expression)
                    else:  # Arrow's own count forgets what stands before a match
                        there = pa.compute.count_substring(pa.compute.replace_substring_regex(some, expression, S.EDGE), S.EDGE)
                    out[kind][rows, k] = there.to_numpy(zero_copy_only=False)
        return out

    def _looked(self, p: str, hits: np.ndarray, seen: dict) -> tuple:
        """(column, found for sure, ((guard, expression), ...), possibly found), by the strings alone."""
        key = (type(p), p)
        if key not in seen:
            column, strings, parts = self.patterns[key]
            sure = _any(hits, strings)
            guards, possible = [], sure.copy()
            for sets, k in parts:
                guard = _any(hits, sets[0]) if sets else np.ones(len(hits), bool)
                for x in sets[1:]:
                    guard &= _any(hits, x)
                guards.append((guard, k))
                possible |= guard
            seen[key] = column, sure, guards, possible
        return seen[key]

    def _may(self, r: Rule, hits: np.ndarray, filled: np.ndarray, seen: dict) -> np.ndarray:
        if r in seen:
            return seen[r]
        look = lambda p: self._looked(p, hits, seen)
        may = filled & (hits[:, 0] >= r.least_words) & (hits[:, 1] >= r.least_tokens)
        for p in r.need:
            may = may & look(p)[3]
        for p in r.lack:
            may = may & ~look(p)[1]
        for a, b in r.unless:
            may = may & ~(look(a)[1] & ~look(b)[3])
        seen[r] = may
        return may

    def fired(self, hits: np.ndarray, filled: np.ndarray, there: dict[str, np.ndarray], seen: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(texts x rules booleans, the first counts); there: results in the order of open(), seen: what it kept of these texts."""
        seen, exact = {} if seen is None else seen, {}

        def found(p: str) -> np.ndarray:
            key = (type(p), p)
            if key not in exact:
                column, sure, parts, _ = self._looked(p, hits, seen)
                exact[key] = sure.copy()
                for _, k in parts:
                    exact[key] |= there[column][:, k].astype(bool, copy=False)
            return exact[key]

        def matches(patterns: Sequence[str]) -> np.ndarray:
            each = [subject(p) for p in patterns]
            return sum(there[f"n_{column}"][:, self.counted[column][unicode_bounds(q)]] for column, q in each)

        fires, first = np.zeros((len(hits), len(self.rules)), bool, "F"), np.zeros((len(hits), len(self.rules)), np.int64, "F")
        for k, r in enumerate(self.rules):
            hit = self._may(r, hits, filled, seen)
            if not hit.any():
                continue
            for p in r.need:
                hit = hit & found(p)
            for p in r.lack:
                hit = hit & ~found(p)
            for a, b in r.unless:
                hit = hit & ~(found(a) & ~found(b))
            for j, (patterns, least) in enumerate(r.counts):
                n = matches(patterns)
                hit = hit & (n >= least)
                if j == 0:
                    first[:, k] = n
                    hit = hit & (n <= r.count_most) if r.count_most is not None else hit
                    hit = hit & (n * 1000.0 > hits[:, 0] * r.per_1000) if r.per_1000 is not None else hit
            if r.distinct:
                hit = hit & (sum(found(p).astype(int) for p in r.distinct) < r.fewer)
            fires[:, k] = hit
        return fires, first


def _asked(r: Rule) -> tuple[str, ...]:
    return (*r.need, *r.lack, *r.distinct, *(p for u in r.unless for p in u))


def _any(hits: np.ndarray, masks: Sequence[tuple[int, int]]) -> np.ndarray:
    out = np.zeros(len(hits), bool)
    for n, mask in masks:
        out |= (hits[:, 2 + n] & mask) != 0
    return out


@lru_cache(maxsize=8)
def evaluation(rules: tuple[Rule, ...]) -> Evaluation:
    return Evaluation(rules)


def _lists(rows: np.ndarray, values: pa.Array, null: np.ndarray | None = None) -> pa.Array:
    """A list for each row of a matrix of booleans: the values at its true places, in their order."""
    return pa.ListArray.from_arrays(pa.array(np.append(0, rows.sum(1).cumsum()), pa.int32()), values, mask=None if null is None else pa.array(null))


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


_KINDS = ("low", "text", "n_low", "n_text")


def _fired(fires: np.ndarray, n: np.ndarray, decided: np.ndarray) -> pa.Array:
    """list<struct<seq, n>> for each row, null where `decided` isn't true; fires and n have the decided rows only."""
    at, every = np.nonzero(fires), np.zeros((len(decided), fires.shape[1]), bool)
    every[decided] = fires
    return _lists(every, pa.StructArray.from_arrays([pa.array(at[1], pa.int32()), pa.array(n[at])], ["seq", "n"]), ~decided)


def _tallied(fires: np.ndarray, groups: Sequence[int], decided: np.ndarray) -> pa.Array:
    """list<long> for each row, null where `decided` isn't true: how many rules of each group fire."""
    every, groups = np.zeros((len(decided), max(groups) + 1), np.int64), np.array(groups)
    for k in range(every.shape[1]):
        every[decided, k] = np.count_nonzero(fires[:, groups == k], axis=1)
    return _lists(np.repeat(decided[:, None], every.shape[1], 1), pa.array(every[decided].ravel()), ~decided)


def look(rules: tuple[Rule, ...], texts: pa.Array, groups: Sequence[int] | None = None) -> pa.Array:
    """x: the rules that fire (or how many of each group do), null for texts left to Spark; for these hits and the numbers of
    expressions to search (_KINDS).
    """
    e = evaluation(rules)
    plain = S.plain(texts)
    low = S.lower(texts, plain)
    hits = S.summary(low, e.known)
    table, filled = np.asfortranarray(_matrix(hits, 2 + -(-len(e.known) // S.BITS))), pa.compute.binary_length(texts).to_numpy(zero_copy_only=False) > 0
    seen: dict = {}
    todo = e.open(table, filled, seen)
    for k in _KINDS:
        for j in (j for j, x in enumerate(e.arrows[k]) if x is None):
            plain &= ~todo[k][:, j]
    if plain.all():
        fires, n = e.fired(table, filled, e.searched(low, texts, todo), seen)
    else:
        mask = pa.array(plain)
        fires, n = e.fired(table[plain], filled[plain], e.searched(low.filter(mask), texts.filter(mask), {k: todo[k][plain] for k in _KINDS}))
    open_ = {k: todo[k] & ~plain[:, None] for k in _KINDS}
    each = [_lists(open_[k], pa.array(np.nonzero(open_[k])[1], pa.int32())) for k in _KINDS]
    kept = _lists(np.repeat(~plain[:, None], table.shape[1], 1), pa.array(table[~plain].ravel()), plain)
    x = _fired(fires, n, plain) if groups is None else _tallied(fires, groups, plain)
    return pa.StructArray.from_arrays([x, kept, *each], ["x", "hits", *_KINDS])


def decide(rules: tuple[Rule, ...], left: pa.Array, groups: Sequence[int] | None = None) -> pa.Array:
    """look()'s x of the texts left to Spark, null for all others (where `left` is empty).

    left: how many expressions of each kind are searched; then hits, all expressions' numbers, and what Spark's searches found.
    """
    e, open_ = evaluation(rules), left.value_lengths().to_numpy(zero_copy_only=False) > 0
    n, kinds, width = open_.sum(), len(_KINDS), 2 + -(-len(evaluation(rules).known) // S.BITS)
    there, table = {k: np.zeros((n, len(e.asked[k])), np.int64, "F") for k in _KINDS}, np.zeros((n, width), np.int64, "F")
    rows = left.filter(pa.array(open_))
    values, ends = rows.flatten().to_numpy(zero_copy_only=False), np.append(0, rows.value_lengths().to_numpy(zero_copy_only=False).cumsum())
    for i in range(n):
        own = values[ends[i] : ends[i + 1]]
        table[i] = own[kinds : kinds + width]
        numbers, found = own[kinds + width :].reshape(2, -1)
        to = own[:kinds].cumsum()
        for k, a, b in zip(_KINDS, np.append(0, to), to):
            there[k][i, numbers[a:b]] = found[a:b]
    fires, first = e.fired(table, np.ones(n, bool), there)
    return _fired(fires, first, open_) if groups is None else _tallied(fires, groups, open_)


def _evaluated(docs: DataFrame, rules: tuple[Rule, ...], groups: tuple[int, ...] | None = None) -> DataFrame:
    """doc_id, x: one row for each of docs, with the numbers of the rules that fire (seq, n), or how many of each group do."""
    ev, kind = evaluation(rules), "array<struct<seq int, n long>>" if groups is None else "array<long>"

    @F.arrow_udf(f"x {kind}, hits array<long>, " + ", ".join(f"{k} array<int>" for k in _KINDS))
    def looked(text: pa.Array) -> pa.Array:
        return look(rules, text, groups)

    @F.arrow_udf(kind)
    def decided(left: pa.Array) -> pa.Array:
        return decide(rules, left, groups)

    def asked(kind: str) -> Column:
        column, known = kind.removeprefix("n_"), ev.asked[kind]
        each = F.array(*map(F.lit, known)) if known else F.array(F.lit(""))
        one = lambda i: F.regexp_count(column, F.get(each, i)) if kind.startswith("n_") else F.rlike(F.col(column), F.get(each, i))
        return F.transform(f"looked.{kind}", lambda i: one(i).cast("long"))

    d = docs.select("doc_id", T.text_of("text").alias("text")).select("doc_id", "text", looked("text").alias("looked"))
    d = d.select("doc_id", "text", F.when(F.col("looked.x").isNull(), F.lower("text")).alias("low"), "looked")
    numbers = [F.col(f"looked.{k}").cast("array<long>") for k in _KINDS]
    left = F.concat(F.array(*(F.size(x).cast("long") for x in numbers)), "looked.hits", *numbers, *map(asked, _KINDS))  # one column: each costs time in every row
    # an empty array for all others: Arrow goes over all nulls so far with each row that is written
    d = d.select("doc_id", F.col("looked.x").alias("x"), F.when(F.col("looked.x").isNull(), left).otherwise(F.array().cast("array<long>")).alias("left"))
    return d.select("doc_id", F.coalesce("x", decided("left")).alias("x"))


def checked(docs: DataFrame, rules: Sequence[Rule] | None = None) -> DataFrame:
    """doc_id, f: one row for each of docs, with the array of its findings (seq, category, severity, title, confidence, action)."""
    rules = tuple(rules or all_rules())
    d = _evaluated(docs, rules)
    of = lambda name, x: F.get(F.array(*[F.lit(getattr(r, name)) for r in rules]), x["seq"]).alias(name)
    title = lambda x: F.replace(of("title", x), F.lit("{n}"), x["n"].cast("string")).alias("title")
    return d.select("doc_id", F.transform("x", lambda x: F.struct(x["seq"].alias("seq"), of("category", x), of("severity", x), title(x), of("confidence", x), of("action", x))).alias("f"))


def tallied(docs: DataFrame, severities: Sequence[str], rules: Sequence[Rule] | None = None) -> DataFrame:
    """doc_id, x: one row for each of docs, with how many rules of each severity fire, and at last of any other. No findings are made."""
    rules, names = tuple(rules or all_rules()), list(severities)
    return _evaluated(docs, rules, tuple(names.index(r.severity) if r.severity in names else len(names) for r in rules))


def findings(docs: DataFrame, rules: Sequence[Rule] | None = None) -> DataFrame:
    """doc_id, seq, category, severity, title, confidence, action: a row for each rule that fires."""
    d = checked(docs, rules).select("doc_id", F.explode_outer("f").alias("f")).where(F.col("f").isNotNull())
    return d.select("doc_id", "f.*")
