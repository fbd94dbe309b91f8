"""Operator 9: personal data by candidate gradient boosting, in DataFrame functions only.

High-recall generators propose overlapping spans of four kinds. Base spans (the kind's pattern and check) always stay.
The other candidates are judged by boosted trees of depth 2 over format and context features; the features have few
values, so one aggregation gives the number of candidates, and of real ones, for every combination of values, and the
trees are fitted on this small table: exactly the result of fitting on all candidates. The trees become one column
expression.

Labels don't come from the base patterns alone. seeds() makes sentences with personal data that no base pattern takes
(`name (at) host (dot) org`, `1 . 2 . 3 . 4`, national numbers after a cue, cards with other separators) among numbers that
look alike but are none (dates, versions, part numbers, sums that fail); their labels are known. All documents add their
candidates: base matches as real ones, and candidates without any evidence (no cue, no mark, no check passed) as others;
what lies between isn't used to learn, but is what the trees decide on. Thresholds are calibrated for each kind on rows
that the trees haven't seen (crc32 of the id mod 5 is 0): the least score from which on at least PRECISION of the
candidates are real.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkloom.llm import common

KINDS = ("email", "ip", "card", "phone")
#: The base patterns. Possessive forms and the look-behinds match the same spans without backtracking over long runs;
#: the card pattern asks for 12 digits at once, as shorter runs fail the check anyway.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Generators of further candidates, wider than the base patterns.
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?:\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]{2,63}+){1,5}+|\x20at\x20[A-Za-z0-9-]{1,63}+(?:\x20dot\x20[A-Za-z0-9-]{2,63}+){1,5}+)",
    "ip": r"(?<![0-9])[0-9]{1,3}+(?:\x20?(?:[.,:]|\[\.\]|\(\.\)|\(dot\)|\[dot\])\x20?[0-9]{1,3}+){3}+(?![0-9])",
    "card": r"(?<![0-9])[0-9]{3,6}+(?:[\x20./_-]?[0-9]{2,6}+){1,5}+(?![0-9])",
    "phone": r"(?<![0-9])(?:(?:\+|00)?[0-9]{1,3}+[\x20.-]?)?\(?[0-9]{2,4}+\)?[\x20.-]?[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])",
}
#: A text without the sign can't match the kind's generator.
SIGNS = {"email": r"@|\(at\)|\[at\]|\x20dot\x20", "ip": r"[0-9]\x20?[.,:(\[]", "card": "[0-9]{3}", "phone": "[0-9]{3}"}
ANY_SIGN = "|".join(SIGNS.values())
#: Words shortly before a span that tell its kind.
CUES = {
    "email": r"(?i)(mail|contact|correo|courriel|kontakt)[^\n]{0,12}$",
    "ip": r"(?i)(\bip|host|server|serveur|servidor|address)[^\n]{0,12}$",
    "card": r"(?i)(card|visa|mastercard|amex|karte|carte|tarjeta)[^\n]{0,12}$",
    "phone": r"(?i)(phone|\btel|call|fax|mobile|handy|telefon|téléphone|teléfono|móvil)[^\n]{0,12}$",
}
FEATURES = ("kind", "digits", "parts", "luhn", "octets", "mark", "same", "tail", "before", "after", "cue", "lead")
PRECISION = 0.95
CELL_LIMIT = 200_000


def located(text: Column, pattern: str) -> Column:
    """array<struct<start, end, s>> of all matches, leftmost and not overlapping, in code points."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = F.zip_with(found, gaps, lambda s, g: F.struct(s.alias("s"), F.length(g).alias("gap"), F.length(s).alias("n")))
    none = F.array().cast("array<struct<start:int,end:int,s:string>>")

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + p["gap"]
        here = F.struct(start.alias("start"), (start + p["n"]).alias("end"), p["s"].alias("s"))
        return F.struct((start + p["n"]).alias("at"), F.concat(acc["out"], F.array(here)).alias("out"))

    # the last gap has no match of its own
    real = F.filter(pairs, lambda p: p["s"].isNotNull())
    return F.aggregate(real, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])


def only_digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(s: Column) -> Column:
    """Whether the digits of s pass the Luhn check."""
    d = F.reverse(only_digits(s))

    def step(acc: Column, i: Column) -> Column:
        x = F.substring(d, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return acc + F.when(x > 9, x - 9).otherwise(x)

    places = F.when(F.length(d) > 0, F.sequence(F.lit(1), F.length(d))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, F.lit(0), step) % 10 == 0


CHECKS: dict[str, Callable[[Column], Column]] = {
    "email": lambda s: F.lit(True),
    "ip": lambda s: F.forall(F.split(s, r"\."), lambda p: p.rlike("^0*(25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})$")),
    "card": lambda s: F.length(only_digits(s)).between(12, 19) & luhn(s),
    "phone": lambda s: F.length(only_digits(s)).between(9, 15),
}
#: The base pattern for a candidate's whole text.
WHOLE = {
    "email": r"^[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)++$",
    "ip": r"^[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++$",
    "card": r"^[0-9](?:[\x20-]?[0-9])++$",
    "phone": r"^\+[0-9][\x20().0-9-]+[0-9]$",
}


def with_base(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds _t (null text: empty) and _base_<kind>, the base spans of each kind."""
    out = docs.withColumn("_t", F.coalesce(F.col(text), F.lit("")))
    none = F.array().cast("array<struct<start:int,end:int,s:string>>")
    for kind in KINDS:
        gate = F.instr("_t", "@") > 0 if kind == "email" else F.instr("_t", "+") > 0 if kind == "phone" else F.col("_t").rlike("[0-9][ -]?[0-9]" if kind == "card" else r"[0-9]\.[0-9]")
        spans = F.filter(located(F.col("_t"), BASE[kind]), lambda x: CHECKS[kind](x["s"]))
        out = out.withColumn(f"_base_{kind}", F.when(gate, spans).otherwise(none))
    return out


def candidates(rows: DataFrame, text: str = "_t") -> Column:
    """array<struct<kind, start, end, s, features..., valid>> of the wide generators.

    Features: digits, parts (runs of letters and digits), luhn (12 to 19 digits that pass), octets (four numbers up to
    255), mark (how at and dot are written: 1 @, 2 in brackets, 3 as words, 4 only
    dots, spaced or not), tail (letters at the end), same (all separators alike: 1; several: 2),
    before and after (the next sign on each side), cue (1: a word of the kind stands before; 2: one of another kind), lead.
    """
    t, each = F.col(text), []
    for number, kind in enumerate(KINDS):
        found = F.when(t.rlike(SIGNS[kind]), located(t, WIDE[kind]))

        def look(x: Column) -> Column:
            s, left = x["s"], F.substring(t, F.greatest(x["start"] - 23, F.lit(1)), F.least(x["start"], F.lit(24)))
            digits, after = F.length(only_digits(s)), F.substring(t, x["end"] + 1, F.lit(1))
            side = lambda c: F.when(c == "", 0).when(c.rlike(r"^[\s]$"), 1).when(c.rlike("^[0-9A-Za-z]$"), 2).when(c.rlike(r"^[\"'=:]$"), 3).otherwise(4)
            numbers = F.filter(F.split(s, "[^0-9]+"), lambda p: p != "")
            octets = (F.size(numbers) == 4) & F.forall(numbers, lambda p: p.rlike("^0*(25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})$"))
            gaps = F.array_distinct(F.filter(F.split(s, "[0-9A-Za-z]+"), lambda p: p != ""))
            cue = F.when(left.rlike(CUES[kind]), 1).when(left.rlike("|".join(v for k, v in CUES.items() if k != kind)), 2).otherwise(0)
            return F.struct(
                F.lit(number).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), s.alias("s"),
                F.least(digits, F.lit(20)).alias("digits"),
                F.least(F.size(F.split(s, r"[^0-9A-Za-z]+")), F.lit(7)).alias("parts"),
                F.when(digits.between(12, 19) & luhn(s), 1).otherwise(0).alias("luhn"),
                F.when(octets, 1).otherwise(0).alias("octets"),
                F.when(s.rlike(r"[(\[](?:at|dot|\.)[)\]]"), 2).when(s.rlike(r"\x20at\x20|\x20dot\x20"), 3).when(s.contains("@"), 1).when(F.forall(gaps, lambda g: F.trim(g) == "."), 4).otherwise(0).alias("mark"),
                F.least(F.length(F.regexp_extract(s, "[A-Za-z]*$", 0)), F.lit(7)).alias("tail"),
                F.least(F.size(gaps), F.lit(2)).alias("same"),
                side(F.when(x["start"] > 0, F.substring(left, -1, 1)).otherwise("")).alias("before"), side(after).alias("after"),
                cue.alias("cue"),
                F.when(s.startswith("+"), 1).when(s.startswith("0"), 3).otherwise(0).alias("lead"),
                (s.rlike(WHOLE[kind]) & CHECKS[kind](s)).alias("valid"),
            )

        each.append(F.coalesce(F.transform(found, look), F.array()))
    return F.concat(*each)


def seeds(most: int = 3000) -> list[tuple[int, str, int, bool]]:
    """(id, text, kind, real): `most` made sentences that hold one candidate of the kind each, real personal data or not.

    Names, numbers and surroundings follow from the id by arithmetic, so the set is the same everywhere.
    """
    names, hosts, ends = ("jo", "ann.lee", "k_meier", "paul77", "info", "m-diaz", "sales.eu"), ("mail", "posteo", "site-x", "uni4", "corp"), ("com", "org", "net", "de", "info")
    cues = {0: ("mail: ", "contact ", "e-mail "), 1: ("ip ", "host: ", "server "), 2: ("card ", "visa: ", "Karte "), 3: ("tel. ", "phone: ", "call ", "fax ")}
    fill = ("the report of the group was late", "and so on", "as listed", "in the second part", "und weiter", "pour la suite")
    out = []

    def digits(x: int, n: int) -> str:
        s = str(pow(7, x + 11, 10**n + 9) % 10**n).rjust(n, "3")
        return s if s[0] != "0" else f"5{s[1:]}"

    def checked(s: str, ok: bool) -> str:
        total = sum(d if k % 2 else (2 * d - 9 * (d > 4)) for k, d in enumerate(int(c) for c in reversed(s)))
        return s + str((-total + (0 if ok else 3)) % 10)

    for i in range(most):
        kind, real, x = i % 4, i // 4 % 2 == 0, i // 8
        cue = cues[kind][x % len(cues[kind])] if x % 3 else ""
        if kind == 0:
            at, dot = ((" (at) ", " (dot) "), ("(at)", "(dot)"), (" [at] ", " [dot] "), (" at ", " dot "), ("[at]", "."), (" @ ", "."))[x % 6]
            s = f"{names[x % 7]}{at}{hosts[x % 5]}{dot}{ends[x // 3 % 5]}"
            if not real:  # handles, prices and schedules
                cue, s = "", (f"x{x % 90} @ {x % 9}.{x % 50 + 10}", f"{x % 12 + 1} @ {x % 30}. {x % 60 + 10}", f"f@{x % 7}. Then", f"look at this dot {('product', 'matrix', 'pattern')[x // 4 % 3]}")[x % 4]
        elif kind == 1:
            sep = (" . ", "[.]", "(.)", ". ", " (dot) ", " .")[x % 6]
            s = sep.join(str(x * k % 256) for k in (3, 7, 11, 13))
            if not real:  # versions, sections, times, lists of numbers
                cue, s = "", (f"{x % 9}:{x % 50 + 10}:{x % 40 + 11}:{x % 89}", f"{x % 5},{x % 7},{x % 9},{x % 6}", f"{x % 600 + 300}, {x % 90}, {x % 40}, {x % 7}", f"{x % 4} : {x % 9} : {x % 8} : {x % 5}")[x % 4]
        elif kind == 2:
            raw = checked(digits(x, 15), real)
            sep = (".", "/", "_", "-.")[x % 3]
            s = sep.join(raw[k : k + 4] for k in range(0, 16, 4))
            if not real and x % 2:  # part numbers and dates
                cue, s = "", (f"{digits(x, 4)}.{x % 12 + 10}.{x % 20 + 10}", f"{digits(x, 6)}-{digits(x + 5, 4)}", digits(x, 8))[x % 3]
        else:
            cue = cues[3][x % 4]
            a, b, c = digits(x, 3), digits(x + 1, 3), digits(x + 2, 4)
            s = (f"({a}) {b}-{c}", f"0{a}-{b}-{c}", f"{a}.{b}.{c}", f"0049 {a} {b} {c}")[x % 4]
            if not real:  # the same shapes without a cue, and ranges
                cue, s = "", (f"{a} {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{c} {a}-{b}")[x % 4]
        out.append((i, f"{fill[x % 6]} {cue}{s} {fill[(x + 2) % 6]}", kind, real))
    return out


class Trees:
    """Boosted regression trees of depth 2 on the log-odds of a candidate's being real, fitted on a table of cells."""

    def __init__(self, cells: list[tuple[tuple[int, ...], float, float]], calibration: list[tuple[tuple[int, ...], float, float]] | None = None, rounds: int = 40, rate: float = 0.3):
        """cells: (features, candidates, real ones among them); thresholds come from `calibration` (None: from cells)."""
        self.trees: list[tuple] = []
        total, positive = sum(n for _, n, _ in cells), sum(p for _, _, p in cells)
        share = min(max(positive / total, 1e-6), 1 - 1e-6) if total else 0.5
        self.start = math.log(share / (1 - share))
        raw = [self.start] * len(cells)
        for _ in range(rounds if positive and positive < total else 0):
            sums = []
            for (_, n, p), f in zip(cells, raw):
                q = 1 / (1 + math.exp(-f))
                sums.append((p - n * q, n * q * (1 - q)))
            tree = self._grow(cells, sums, list(range(len(cells))), 2, rate)
            self.trees.append(tree)
            raw = [f + self._value(tree, x) for f, (x, _, _) in zip(raw, cells)]
        held = cells if calibration is None else calibration
        self.thresholds = self._calibrate(held, [self.score(x) for x, _, _ in held])

    def score(self, x: tuple[int, ...]) -> float:
        return self.start + sum(self._value(t, x) for t in self.trees)

    def _grow(self, cells, sums, rows, depth, rate):
        g, h = sum(sums[i][0] for i in rows), sum(sums[i][1] for i in rows)
        leaf = rate * g / (h + 1.0)
        if not depth:
            return leaf
        best = (1e-9, None, None)
        for f in range(len(FEATURES)):
            bins = defaultdict(lambda: [0.0, 0.0])
            for i in rows:
                bins[cells[i][0][f]][0] += sums[i][0]
                bins[cells[i][0][f]][1] += sums[i][1]
            a = b = 0.0
            for v in sorted(bins)[:-1]:
                a, b = a + bins[v][0], b + bins[v][1]
                gain = a * a / (b + 1) + (g - a) ** 2 / (h - b + 1) - g * g / (h + 1)
                if gain > best[0]:
                    best = gain, f, v
        if best[1] is None:
            return leaf
        _, f, v = best
        parts = [i for i in rows if cells[i][0][f] <= v], [i for i in rows if cells[i][0][f] > v]
        return f, v, *(self._grow(cells, sums, p, depth - 1, rate) for p in parts)

    def _value(self, tree, x) -> float:
        while isinstance(tree, tuple):
            tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
        return tree

    def _calibrate(self, cells, raw) -> list[float]:
        """Per kind the least score from which on at least PRECISION of the candidates are real; none: infinity."""
        out = []
        for kind in range(len(KINDS)):
            rows = defaultdict(lambda: [0.0, 0.0])
            for f, (x, n, p) in zip(raw, cells):
                if x[0] == kind:
                    rows[f][0] += n
                    rows[f][1] += p
            n, p, least = 0.0, 0.0, math.inf
            for f in sorted(rows, reverse=True):
                n, p = n + rows[f][0], p + rows[f][1]
                if p < PRECISION * n:
                    break
                least = f
            out.append(least)
        return out

    def column(self, x: Column) -> Column:
        def of(tree) -> Column:
            if not isinstance(tree, tuple):
                return F.lit(float(tree))
            return F.when(x[FEATURES[tree[0]]] <= tree[1], of(tree[2])).otherwise(of(tree[3]))

        out = F.lit(float(self.start))
        for tree in self.trees:
            out = out + of(tree)
        return out

    def selects(self, x: Column) -> Column:
        score, chosen = self.column(x), F.lit(False)
        for kind, least in enumerate(self.thresholds):
            if least < math.inf:
                chosen = chosen | ((x["kind"] == kind) & (score >= least - 1e-9))
        return chosen


def cells_of(rows: DataFrame, label: Column, unseen: Column) -> tuple[list, list]:
    """(cells to learn from, cells to calibrate on) of rows with c, the candidates; null labels are left out."""
    kept = rows.select(F.explode_outer("c").alias("c"), *[x for x in rows.columns if x != "c"]).where(F.col("c").isNotNull())
    kept = kept.select(*[F.col(f"c.{f}").alias(f) for f in FEATURES], label.alias("_y"), unseen.alias("_held")).where(F.col("_y").isNotNull())
    cells = kept.groupBy(*FEATURES, "_held").agg(F.count("*").alias("n"), F.sum(F.col("_y").cast("int")).alias("p"))
    found = cells.orderBy(F.desc("n"), "_held", *FEATURES).limit(CELL_LIMIT).collect()  # the features' values allow no more
    out = ([], [])
    for r in sorted(found):
        out[r["_held"]].append((tuple(r[f] for f in FEATURES), float(r["n"]), float(r["p"])))
    return out


def scaled(cells: list, most: list[float]) -> list:
    """Cells whose candidates add up to at most most[kind] for each kind."""
    total = defaultdict(float)
    for x, n, _ in cells:
        total[x[0]] += n
    return [(x, n * (k := min(1.0, most[x[0]] / total[x[0]])), p * k) for x, n, p in cells]


def fit(docs: DataFrame) -> Trees:
    """Trees from the made sentences and the candidates of all documents.

    Only tables of cells (a few thousand rows) leave the executors. Documents weigh at most as much as the sentences do.
    """
    made = docs.sparkSession.createDataFrame(seeds(), "id long, _t string, kind int, real boolean")
    made = made.select("id", "kind", "real", candidates(made).alias("c"))
    learn, check = cells_of(made, F.when(F.col("c.kind") == F.col("kind"), F.col("real")).otherwise(F.lit(False)), common.held_out("id"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_t")).where(F.col("_t").rlike(ANY_SIGN))
    rows = rows.select("doc_id", candidates(rows).alias("c"))
    c = F.col("c")
    no_evidence = (c["cue"] == 0) & c["mark"].isin(0, 4) & (c["luhn"] == 0) & ((c["octets"] == 0) | (c["kind"] != KINDS.index("ip")))
    more, more_check = cells_of(rows, F.when(c["valid"], F.lit(True)).when(no_evidence, F.lit(False)), common.held_out("doc_id"))
    weight = lambda cells: [sum(n for x, n, _ in cells if x[0] == k) for k in range(len(KINDS))]
    return Trees(learn + scaled(more, weight(learn)), check + scaled(more_check, weight(check)))


def spans(docs: DataFrame, trees: Trees | None = None) -> DataFrame:
    """docs (without columns of these names) with _t, _base_<kind>, _base and _spans.

    _spans: array<struct<start, kind (its place in KINDS), end>> by start, then kind. Further spans never overlap a base
    span; where two of them overlap, the one that starts first stays (at the same start, the kind listed first).
    """
    based = with_base(docs)
    trees = trees or fit(docs)
    plain = [F.transform(f"_base_{k}", lambda x: F.struct(x["start"].alias("start"), F.lit(n).alias("kind"), x["end"].alias("end"))) for n, k in enumerate(KINDS)]
    based = based.withColumn("_base", F.array_sort(F.concat(*plain)))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    if any(x < math.inf for x in trees.thresholds):
        chosen = F.filter(candidates(based), trees.selects)
        chosen = F.transform(chosen, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
        free = F.filter(chosen, lambda x: ~F.exists("_base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))

        def step(acc: Column, x: Column) -> Column:
            later = x["start"] >= acc["at"]
            return F.struct(F.when(later, x["end"]).otherwise(acc["at"]).alias("at"), F.when(later, F.concat(acc["out"], F.array(x))).otherwise(acc["out"]).alias("out"))

        more = F.aggregate(F.array_sort(free), F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])
        more = F.when(F.col("_t").rlike(ANY_SIGN), more).otherwise(none)
    else:
        more = none
    return based.withColumn("_more", more).withColumn("_spans", F.array_sort(F.concat("_base", "_more")))


def listed(column: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(column, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_<kind> (base spans), base_sha256 and spans of every row of docs.

    Null or empty text: no spans (the digest of the empty string). Null doc_ids and repeated rows stay; an empty table
    gives no rows; other columns are ignored. Long texts are searched whole.
    """
    found = spans(docs.select("doc_id", "text"))
    return found.select(
        "doc_id", *[F.size(f"_base_{k}").cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(listed("_base"), 256).alias("base_sha256"), listed("_spans").alias("spans")
    )


def redacted(docs: DataFrame, trees: Trees | None = None) -> DataFrame:
    """docs with every span of text replaced by its kind in brackets; overlapping spans are joined under the first kind.

    Null texts stay null. All columns stay, whatever their names; n_chars, where there is one, is the new length.
    """
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")

    last = lambda acc: F.try_element_at(acc, F.lit(-1))

    def joined(acc: Column, x: Column) -> Column:
        merged = F.struct(last(acc)["start"].alias("start"), last(acc)["kind"].alias("kind"), F.greatest(last(acc)["end"], x["end"]).alias("end"))
        apart = F.size(acc) == 0
        return F.when(apart | (last(acc)["end"] <= x["start"]), F.concat(acc, F.array(x))).otherwise(F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(merged)))

    # the caller's columns go by their places, so none of them can clash with the columns made here
    mine = docs.toDF(*[{"text": "text", "doc_id": "doc_id"}.get(c, f"caller_{i}") for i, c in enumerate(docs.columns)])
    out = spans(mine, trees).withColumn("_cut", F.aggregate("_spans", none, joined))
    ends = F.concat(F.array(F.lit(0)), F.transform("_cut", lambda x: x["end"]))
    pieces = F.transform("_cut", lambda x, i: F.concat(F.substring(F.col("_t"), F.get(ends, i) + 1, x["start"] - F.get(ends, i)), F.get(names, x["kind"])))
    rest = F.substring(F.col("_t"), F.element_at(ends, -1) + 1, F.length("_t"))
    clean = F.when(F.col("text").isNotNull(), F.when(F.size("_cut") == 0, F.col("text")).otherwise(F.concat(F.array_join(pieces, ""), rest)))
    out = out.withColumn("_clean", clean)
    given = dict(zip(docs.columns, mine.columns))
    return out.select(*[F.col("_clean").alias("text") if c == "text" else F.length("_clean").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(given[c]).alias(c) for c in docs.columns])


def op9_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(common.table(spark, sf_dir, "documents"))
