"""Queries over style findings, identifiers looked up in snapshots, and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkloom.functions import text as T
from inkloom.operators import findings as R
from inkloom.operators import lookups, metrics, prose
from inkloom.operators import references as refs
from inkloom.plans import manuscript_queries as M
from inkloom.plans import reference_queries, text_queries
from inkloom.plans import sql as S
from inkloom.sources import reports


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_queries.read(spark, sf_dir, "documents")


def styled(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    return prose.style_findings(d, metrics.repetition_density(d))


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts, each followed by identifiers made from doc_id."""
    k = F.col("doc_id")
    said = F.concat(F.lit("\nSee 10.1234/AB"), k % 40, F.lit(", 10.5555/x.y"), k % 3, F.lit(" and 10.1234/ab"), k % 40, F.lit(". ORCID 0000-0002-1825-"), F.lpad((k % 50).cast("string"), 4, "0"), F.lit("; NCT0000"), F.lpad((k % 1000).cast("string"), 4, "0"), F.lit(", RRID: AB_"), k % 90 + 10, F.lit("; ISSN 1234-56"), k % 10, F.lit("X"))
    return documents(spark, sf_dir).select("doc_id", F.concat(F.coalesce("text", F.lit("")), said).alias("text"))


def snapshot(spark: SparkSession) -> DataFrame:
    """What a service knew of some of these identifiers; one DOI is retracted."""
    i = F.col("id")
    dois = spark.range(30).select(F.lit("doi").alias("kind"), F.concat(F.lit("10.1234/ab"), i).alias("key"), F.when(i % 3 == 0, "absent").otherwise("present").alias("status"), F.when(i == 7, F.create_map(F.lit("retracted"), F.lit("true"))).alias("payload"))
    trials = spark.range(400).select(F.lit("trial").alias("kind"), F.concat(F.lit("nct0000"), F.lpad(i.cast("string"), 4, "0")).alias("key"), F.when(i % 5 == 0, "absent").when(i % 7 == 0, "error").otherwise("present").alias("status"), F.lit(None).cast("map<string,string>").alias("payload"))
    return dois.unionByName(trials)


QUERIES = {
    "style_findings": lambda s, d: styled(s, d).select("doc_id", F.explode_outer("f").alias("f")).where(F.col("f").isNotNull()).select("doc_id", "f.severity", "f.title", "f.confidence"),
    "style_signals": lambda s, d: prose.style_signals(documents(s, d), metrics.repetition_density(documents(s, d))),
    "identifier_lookup": lambda s, d: lookups.lookup_summary(named(s, d), snapshot(s)),
    "report_markdown": lambda s, d: reports.markdown(M.checked(s, d)),
    "report_html": lambda s, d: reports.html(M.checked(s, d)),
    "report_json": lambda s, d: reports.as_json(M.checked(s, d)),
    "batch_lines": lambda s, d: reports.batch_lines(R.batch(M.checked(s, d))),
    "bibtex": lambda s, d: reports.bibtex(refs.reference_rows(reference_queries.cited(s, d))),
}

_T = "coalesce(text, '')"
_O = text_queries.ORACLES
_WORD = "[\\wÀ-ÖØ-öø-ʯ]+"
_BASE = f"""rd as ({_O['readability']}), ps as ({_O['passive_ratio']}), pu as ({_O['punctuation_profile']}), lx as ({_O['lexicon_counts']}), bu as ({_O['burstiness']}), tt as ({_O['type_token_ratio']}), de as ({_O['repeated_phrase_density']}),
    wc as ({_O['word_count']}), sl as ({_O['sentence_length_stats']})"""
_INFORMAL = " or ".join(f"contains(low, {S.text(t)})" for t in T.INFORMAL)
_RULES = (
    ("Medium", "Prose is very hard to read", 0.60, "grade > 14 or reading_ease < 25"), ("Low", "Heavy passive voice", 0.50, "passive_ratio > 0.35"), ("Medium", "Excessive run-on sentences", 0.70, "len(n) > 0 and len(list_filter(n, lambda x: x > 45)) / greatest(len(n), 1) > 0.12"),
    ("Low", "Sentence fragments detected", 0.50, "len(list_filter(n, lambda x: x >= 1 and x <= 3)) > 3"), ("Low", "Exclamation marks in academic text", 0.90, "exclamation > 0"), ("Medium", "Missing space after punctuation", 0.90, "regexp_matches(t, '[.!?][A-Za-z]')"),
    ("Low", "Double spaces detected", 0.90, "regexp_matches(t, '[^ ]  +[^ ]')"), ("Medium", "Repeated words (typos)", 0.90, "repeats"), ("Medium", "Informal / conversational language", 0.85, _INFORMAL), ("Info", "Frequent hedging language", 0.60, "hedges > 0"),
    ("Low", "Generic template phrasing", 0.55, "templates >= 5"), ("Medium", "Repeated phrases / redundant prose", 0.65, "coalesce(density, 0) > 0.05"),
)
_STYLE = f"""with recursive {_BASE}, t as (select doc_id, {_T} as t, lower({_T}) as low, {S.sentences(_T)} as s from documents),
    u as (select *, list_transform(list_filter(s, lambda x: not regexp_matches(trim(x), '^\\d+(?:\\.\\d+)*(?:[.)]?)$')), lambda x: len({S.words('x')})) as n, regexp_extract_all(low, '{_WORD}|[ \\t]+|[^\\wÀ-ÖØ-öø-ʯ \\t]+') as k from t),
    v as (select *, len(list_filter(range(1, len(k) - 1), lambda i: k[i] = k[i + 2] and regexp_full_match(k[i], '{_WORD}') and regexp_full_match(k[i + 1], '[ \\t]+'))) > 0 as repeats from u),
    x as (select * from v join rd using (doc_id) join ps using (doc_id) join pu using (doc_id) join lx using (doc_id) join wc using (doc_id) left join de using (doc_id) where word_count >= 30)"""
_SIGNAL = ", ".join((
    "case when burstiness > 0 then greatest(0, least(1, (0.45::double - burstiness) / 0.35::double)) else 0 end", "case when ttr > 0 then greatest(0, least(1, (0.5::double - ttr) / 0.25::double)) else 0 end",
    "case when mean_words > 24 then greatest(0, least(1, (mean_words - 24) / 16)) else 0 end", "greatest(0, least(1, (templates - 2) / 8))", "greatest(0, least(1, (coalesce(density, 0) - 0.04::double) / 0.10::double))",
    "greatest(0, least(1, (semicolon / greatest(sentence_count, 1) - 0.5::double) / 1.5::double))"))
_NAMED = f"""m as (select doc_id, {_T} || chr(10) || 'See 10.1234/AB' || (doc_id % 40) || ', 10.5555/x.y' || (doc_id % 3) || ' and 10.1234/ab' || (doc_id % 40) || '. ORCID 0000-0002-1825-' || lpad((doc_id % 50)::varchar, 4, '0') || '; NCT0000' || lpad((doc_id % 1000)::varchar, 4, '0')
    || ', RRID: AB_' || (doc_id % 90 + 10) || '; ISSN 1234-56' || (doc_id % 10) || 'X' as text from documents)"""
_IDS = " union ".join(f"select doc_id, '{kind}' as kind, regexp_replace(regexp_replace(lower(unnest(regexp_extract_all(text, {S.text(p)}, 1))), '\\s+', '', 'g'), '[.)]+$', '') as key from m" for kind, p in lookups.IDENTIFIERS.items())
_LINE = "rpad(substring(doc_id::varchar, 1, 31), 32, ' ') || ' ' || lpad(readiness::varchar, 5, ' ') || ' ' || lpad(critical::varchar, 4, ' ') || ' ' || lpad(high::varchar, 4, ' ') || ' ' || lpad(medium::varchar, 4, ' ') || ' ' || lpad(low::varchar, 4, ' ') || '  ' || substring(top_findings, 1, 60)"
_PERCENT = "round_even(confidence * 100, 0)::int || case when round_even(confidence * 100, 0) < 50 then '% (uncertain)' else '%' end"

ORACLES = {
    "style_findings": f"{_STYLE}, y as (select doc_id, unnest(list_filter([{', '.join(f'case when {hit} then {k} end' for k, (_, _, _, hit) in enumerate(_RULES))}], lambda i: i is not null)) as k from x) select doc_id, severity, title, confidence from y join (values {', '.join(f'({k}, {S.text(s)}, {S.text(t)}, {c}::double)' for k, (s, t, c, _) in enumerate(_RULES))}) r(k, severity, title, confidence) using (k)",
    "style_signals": f"""with {_BASE}, x as (select doc_id, [{_SIGNAL}] as v from wc join sl using (doc_id) join pu using (doc_id) join lx using (doc_id) join bu using (doc_id) join tt using (doc_id) left join de using (doc_id) where word_count >= 100),
        y as (select doc_id, v, least(1, sqrt(list_sum(list_transform(v, lambda z: z * z))) / 1.8::double) as score, len(list_filter(v, lambda z: z >= 0.35::double))::int as active from x)
        select doc_id, round(score, 6) as score, active, active >= 2 and score >= 0.55::double as elevated, array_to_string(list_filter(list_transform(range(1, 7), lambda i: case when v[i] >= 0.6::double then {S.quoted(list(prose.SIGNALS))}[i] end), lambda z: z is not null), '; ') as flags from y""",
    "identifier_lookup": f"""with {_NAMED}, i as ({_IDS}), k as (select 'doi' as kind, '10.1234/ab' || i as key, case when i % 3 = 0 then 'absent' else 'present' end as status, i = 7 as retracted from range(30) r(i)
        union all select 'trial', 'nct0000' || lpad(i::varchar, 4, '0'), case when i % 5 = 0 then 'absent' when i % 7 = 0 then 'unknown' else 'present' end, false from range(400) r(i)),
        j as (select doc_id, kind, coalesce(status, 'unknown') as status, coalesce(retracted, false) as retracted from i left join k using (kind, key))
        select doc_id, kind, count(*) as n, count(*) filter (status = 'present') as present, count(*) filter (status = 'absent') as absent, count(*) filter (status = 'unknown') as unknown, count(*) filter (retracted) as retracted from j group by all""",
    "report_markdown": f"""with f as {M._findings()}, {M._READY}, r as ({M._RANKED}), l as (select doc_id, string_agg('- **' || severity || '** ' || title || ' (' || {_PERCENT} || ')', chr(10) order by place) as body from r group by doc_id)
        select doc_id, '# Report on ' || doc_id || chr(10) || chr(10) || 'Readiness: ' || readiness || '/100' || chr(10) || chr(10) || coalesce(body, 'No findings.') as report from ready left join l using (doc_id)""",
    "report_html": f"""with f as {M._findings()}, {M._READY}, r as ({M._RANKED}), l as (select doc_id, string_agg('<tr><td>' || severity || '</td><td>' || replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</td></tr>', '' order by place) as body from r group by doc_id)
        select doc_id, '<h1>Report on ' || doc_id || '</h1><p>' || readiness || '/100</p><table>' || coalesce(body, '') || '</table>' as report from ready left join l using (doc_id)""",
    "report_json": f"""with f as {M._findings()}, {M._READY}, c as ({M._COUNTS}), l as (select doc_id, list({{'category': category, 'severity': upper(severity), 'title': title, 'detail': '', 'evidence': '', 'action': action, 'confidence': round(confidence, 2), 'location': '', 'source': ''}} order by seq) as l from f group by doc_id)
        select doc_id, to_json({{'document': doc_id::varchar, 'venue': 'generic', 'readiness_score': readiness, 'stats': {{{', '.join(f"'{x[0].lower()}': {x[0].lower()}" for x in R.SEVERITIES)}, 'findings': findings}}, 'findings': coalesce(l, [])}})::varchar as report from ready join c using (doc_id) left join l using (doc_id)""",
    "bibtex": rf"""with {reference_queries._ROWS}, a as (select doc_id, ref_no, raw, trim(regexp_extract(raw, '^([^,.(]+(?:,\s*[A-Z]\.?)*)', 1)) as author, regexp_extract(raw, '((?:19|20)\d{{2}})', 1) as year from refs),
        n as (select *, lower(regexp_replace(string_split_regex(author, '\s+')[-1], '[^A-Za-z0-9]', '', 'g')) as name from a)
        select doc_id, ref_no, '@article{{' || case when name = '' then 'ref' || ref_no else name end || case when year = '' then 'nd' else year end || '_' || ref_no || ',' || chr(10) || '  author = {{' || author || '}},' || chr(10) || '  title = {{' || trim(raw) || '}},' || chr(10) || '  year = {{' || year || '}}' || chr(10) || '}}' as entry from n""",
    "batch_lines": f"select doc_id, readiness, {_LINE} as line from ({M.ORACLES['batch_report']})",
}
