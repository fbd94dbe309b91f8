"""Queries over reported statistics, phrases and names: whole texts, each followed by statements with numbers made from doc_id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkloom.operators import dictionaries, forensics
from inkloom.plans import sql as S
from inkloom.plans.text_queries import spread


def described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A randomised trial's numbers: means and deviations of 1 to 7 scales, p-values, triples and baseline pairs."""
    d, k = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")), F.col("doc_id")
    two = lambda x: F.lpad(F.pmod(x, F.lit(100)).cast("string"), 2, "0")
    text = F.concat(
        F.coalesce("text", F.lit("")), F.lit("\nA randomised trial on a 1-7 scale. M = 3."), two(k), F.lit(", SD = "), k % 4, F.lit("."), two(k * 7), F.lit(", N = "), k % 30 + 5,
        F.lit(". p = 0.0"), k % 5, F.lit(", p < 0.01, p = 0.03"), k % 10, F.lit(", p = 0.04"), k % 3, F.lit(", p = 0.02"), k % 7, F.lit(", p < 0.05; "),
        F.lit("mean = "), k % 6, F.lit(".5 (SD = "), k % 9 + 1, F.lit(".25), n = "), k % 20 + 3, F.lit("; average = 4.0 (sd = 0."), k % 8 + 1, F.lit("), n = 12. "),
        *[x for i in range(8) for x in (F.lit(f"{40 + i}."), (k * (i + 1)) % 10, F.lit(" ("), k % 5 + 1, F.lit(".5) vs "), k % 3 + 39 + i, F.lit(".2 (1.5), "))],
    )
    return d.select("doc_id", text.alias("text"))


def spun(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that hold one to four phrases of the table and a cell line, by doc_id."""
    d, k = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")), F.col("doc_id")
    one = F.array(*[F.lit(p) for p, _ in dictionaries.PHRASES])
    n = len(dictionaries.PHRASES)
    lines = F.array(*[F.lit(x[1][0]) for x in dictionaries.CELL_LINES])
    said = [x for j in range(4) for x in (F.when(F.pmod(k, F.lit(5)) > j, F.concat(F.lit(" "), F.get(one, F.pmod(k + j * (k % 4), F.lit(n)).cast("int")))).otherwise(F.lit("")),)]
    text = F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), *said, F.when(k % 7 == 0, F.lit(" translated from another language")).otherwise(F.lit("")), F.lit(". Cell culture of "), F.get(lines, F.pmod(k, F.lit(len(dictionaries.CELL_LINES))).cast("int")), F.when(k % 3 == 0, F.lit(", mycoplasma free")).otherwise(F.lit("")), F.lit("."))
    return d.select("doc_id", text.alias("text"))


QUERIES = {
    "impossible_deviations": lambda s, d: forensics.impossible_deviations(described(s, d)),
    "p_curve": lambda s, d: forensics.p_curve(described(s, d)),
    "variance_checks": lambda s, d: forensics.variance_checks(described(s, d)),
    "baseline_balance": lambda s, d: forensics.baseline_balance(described(s, d)),
    "tortured_phrases": lambda s, d: dictionaries.tortured_phrases(spun(s, d), dictionaries.phrases(s)),
    "cell_lines": lambda s, d: dictionaries.cell_lines(spun(s, d)),
}

_PAIRS = " || ".join(f"'{40 + i}.' || (doc_id * {i + 1} % 10) || ' (' || (doc_id % 5 + 1) || '.5) vs ' || (doc_id % 3 + {39 + i}) || '.2 (1.5), '" for i in range(8))
_DESCRIBED = f"""m as (select doc_id, coalesce(text, '') || chr(10) || 'A randomised trial on a 1-7 scale. M = 3.' || lpad((doc_id % 100)::varchar, 2, '0') || ', SD = ' || (doc_id % 4) || '.' || lpad((doc_id * 7 % 100)::varchar, 2, '0') || ', N = ' || (doc_id % 30 + 5)
    || '. p = 0.0' || (doc_id % 5) || ', p < 0.01, p = 0.03' || (doc_id % 10) || ', p = 0.04' || (doc_id % 3) || ', p = 0.02' || (doc_id % 7) || ', p < 0.05; ' || 'mean = ' || (doc_id % 6) || '.5 (SD = ' || (doc_id % 9 + 1) || '.25), n = ' || (doc_id % 20 + 3)
    || '; average = 4.0 (sd = 0.' || (doc_id % 8 + 1) || '), n = 12. ' || {_PAIRS} as text from documents),
    t as (select * from m where len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) >= 200)"""
_TRIPLE = " union all ".join(
    f"select doc_id, regexp_extract(s, {S.text(p)}, 1)::double as mean, regexp_extract(s, {S.text(p)}, 2)::double as sd, regexp_extract(s, {S.text(p)}, 3)::double as n from (select doc_id, unnest(regexp_extract_all(text, {S.text(p)})) as s from t)" for p in forensics.TRIPLES
)
_P = S.text(forensics.PAIR)
_KNOWN = ", ".join(f"({S.text(p)}, {len(p.split())})" for p, _ in dictionaries.PHRASES)
_N = len(dictionaries.PHRASES)
_SPUN = f"""m as (select doc_id, coalesce(text, '') || chr(10) || {" || ".join(f"case when doc_id % 5 > {j} then ' ' || {S.quoted([p for p, _ in dictionaries.PHRASES])}[1 + (doc_id + {j} * (doc_id % 4)) % {_N}] else '' end" for j in range(4))}
    || case when doc_id % 7 = 0 then ' translated from another language' else '' end || '. Cell culture of ' || {S.quoted([x[1][0] for x in dictionaries.CELL_LINES])}[1 + doc_id % {len(dictionaries.CELL_LINES)}] || case when doc_id % 3 = 0 then ', mycoplasma free' else '' end || '.' as text from documents)"""
_LINES = ", ".join(f"case when regexp_matches(low, {S.text(dictionaries.name_pattern((line, *aliases)))}) then {S.text(line)} end" for line, aliases, _ in dictionaries.CELL_LINES)

ORACLES = {
    "p_curve": rf"""with {_DESCRIBED}, p as (select doc_id, list_filter(list_transform(regexp_extract_all(text, {S.text(forensics.P_VALUE)}, 1), lambda x: try_cast(x as double)), lambda x: x > 0 and x < 0.05) as p from t),
        c as (select doc_id, len(list_filter(p, lambda x: x < 0.025))::int as low, len(list_filter(p, lambda x: x >= 0.025))::int as high from p), z as (select *, (low - (low + high) / 2) / sqrt((low + high) / 4) as z from c where low + high >= 5)
        select doc_id, low, high, round(z, 6) as z, case when z < -{forensics.Z_10}::double then 'suspicious' when z > {forensics.Z_05}::double then 'healthy' else 'none' end as verdict from z""",
    "variance_checks": rf"""with {_DESCRIBED}, x as (select * from ({_TRIPLE}) where sd > 0 and n > 2)
        select doc_id, count(*)::int as n_triples, round(max(sd) / min(sd), 6) as sd_ratio, max(sd) / min(sd) > 4 as unequal, (count(*) filter (mean > 0 and sd > mean) + count(*) filter (mean > 0 and sd > mean * 3))::int as n_impossible from x group by doc_id""",
    "baseline_balance": rf"""with {_DESCRIBED}, s as (select doc_id, unnest(regexp_extract_all(text, {_P})) as s from t where regexp_matches(text, {S.text(forensics.RANDOMIZED)})),
        x as (select doc_id, regexp_extract(s, {_P}, 1)::double as a, regexp_extract(s, {_P}, 2)::double as sa, regexp_extract(s, {_P}, 3)::double as b, regexp_extract(s, {_P}, 4)::double as sb from s),
        z as (select doc_id, abs(a - b) / sqrt((sa * sa + sb * sb) / 2) as z from x where sa >= 0.05 and sb >= 0.05),
        g as (select doc_id, count(*)::int as n_pairs, max(z) as m, (count(*) filter (z < {forensics.Z_60}::double))::int as n_alike from z group by doc_id)
        select doc_id, n_pairs, round(m, 6) as max_z, n_alike, m > 4 as implausible, n_pairs >= 8 and n_alike >= greatest(5, floor(n_pairs * 0.6::double)) as too_even from g where n_pairs >= 4""",
    "tortured_phrases": rf"""with {_SPUN}, w as (select doc_id, regexp_extract_all(lower(text), '[a-z]+') as w, regexp_matches(lower(text), {S.text(dictionaries.DECLARED)}) as declared from m),
        t as (select * from w where len(w) >= 150), k(gram, k) as (values {_KNOWN}), u as (select doc_id, declared, w, unnest(range(1, len(w) + 1)) as i from t), n as (select distinct k from k),
        g as (select doc_id, declared, array_to_string(w[i:i + k - 1], ' ') as gram from u, n where i + k - 1 <= len(w)), h as (select doc_id, declared, count(distinct gram) as n_phrases, count(*) as n_hits from g join k using (gram) group by all)
        select doc_id, n_phrases, n_hits, case when n_phrases >= 3 then 'High' when n_phrases = 2 then 'Medium' else 'Low' end as severity,
        case when n_phrases >= 3 then case when declared then 0.55 else 0.80 end else case when declared then 0.35 else 0.60 end end::double as confidence from h""",
    "cell_lines": rf"""with {_SPUN}, l as (select doc_id, lower(text) as low, regexp_matches(text, {S.text(dictionaries.AUTHENTICATED)}) as authenticated from m where regexp_matches(text, {S.text(dictionaries.BIOMEDICAL)}))
        select doc_id, unnest(list_filter([{_LINES}], lambda x: x is not null)) as line, authenticated from l""",
}
