"""Queries over the tables documents and benchmark, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkloom.functions import text as T
from inkloom.operators import duplicates, metrics, similarity
from inkloom.plans import sql as S


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name == "documents" else df


def spread(df: DataFrame) -> DataFrame:
    """Deals out rows that come in fewer partitions than there are cores (a small file is one task); else df as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def over_documents(f):
    return lambda spark, sf_dir: f(read(spark, sf_dir, "documents"))


def over_corpus(f):
    return lambda spark, sf_dir: f(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES = {
    "word_count": over_documents(metrics.word_counts),
    "sentence_length_stats": over_documents(metrics.sentence_lengths),
    "readability": over_documents(metrics.readability),
    "type_token_ratio": over_documents(metrics.type_token_ratio),
    "burstiness": over_documents(metrics.burstiness),
    "punctuation_profile": over_documents(metrics.punctuation),
    "lexicon_counts": over_documents(metrics.lexicon_counts),
    "passive_ratio": over_documents(metrics.passive_ratio),
    "repeated_ngrams": over_documents(metrics.repeated_grams),
    "repeated_phrase_density": over_documents(metrics.repetition_density),
    "acronyms": over_documents(metrics.acronyms),
    "duplicate_paragraphs": over_documents(duplicates.duplicate_paragraphs),
    "whitespace_variant_paragraphs": over_documents(duplicates.spacing_variants),
    "duplicate_sentences": over_documents(duplicates.duplicate_sentences),
    "repeated_phrases": over_documents(duplicates.repeated_phrases),
    "corpus_overlap": over_corpus(similarity.corpus_overlap),
    "corpus_union_overlap": over_corpus(similarity.union_overlap),
    "longest_shared_run": over_corpus(similarity.longest_shared_run),
    "matched_runs_14": over_corpus(similarity.matched_runs),
    "sentence_jaccard": over_corpus(similarity.sentence_jaccard),
    "tfidf_cosine": over_corpus(similarity.tfidf_cosine),
}

_T = "coalesce(text, '')"
_LENGTHS = f"list_transform({S.sentences(_T)}, lambda s: len({S.words('s')})::double)"
_LOW = S.words(f"lower({_T})")
_ITEMS = f"select distinct item_id, gram from ({S.gram_rows('benchmark', 'item_id', _LOW, 8)})"
_GRAMS = f"select doc_id, gram, count(*) over (partition by doc_id) as n_grams from (select distinct doc_id, gram from ({S.gram_rows('documents', 'doc_id', _LOW, 8)}))"


def _sentence_rows(table: str, key: str) -> str:
    return f"""select {key}, s, len(w) as n, unnest(w) as tok from (
        select {key}, s, list_distinct(list_filter({S.words('lower(x)')}, lambda w: length(w) >= 4)) as w from (
            select {key}, unnest(x) as x, generate_subscripts(x, 1) - 1 as s from (select {key}, {S.sentences(_T)} as x from {table}))) where len(w) >= 6"""


def _counts(table: str, key: str) -> str:
    return f"select {key}, tok, count(*) as tf from (select {key}, unnest({S.words(f'lower({_T})')}) as tok from {table}) where length(tok) >= 4 group by all"


ORACLES = {
    "passive_ratio": rf"""with p as (select doc_id, lower({S.PLAIN.format(_T)}) as p from documents),
        c as (select doc_id, len(regexp_extract_all(p, '\b(am|is|are|was|were|been|being|be)\s+(?:\w+\s+){{0,3}}(\w+ed|\w+en)\b')) as be, len(regexp_extract_all(p, '\b\w+(?:ed|ing|es|s)\b')) as verbs from p)
        select doc_id, case when be > 0 then round(be / greatest(verbs, 1), 6) else 0.0::double end as passive_ratio from c""",
    "word_count": f"select doc_id, len({S.words(_T)})::int as word_count, len({S.sentences(_T)})::int as sentence_count from documents",
    "sentence_length_stats": f"""with n as (select doc_id, {_LENGTHS} as n from documents)
        select doc_id, len(n)::int as sentences, round(coalesce(list_avg(n), 0), 6) as mean_words,
               round(coalesce(case when len(n) > 1 then list_stddev_samp(n) end, 0), 6) as sd_words, coalesce(list_max(n), 0)::int as max_words from n""",
    "readability": f"""with d as (select doc_id, {S.words(_T)} as w, greatest(len({S.sentences(_T)}), 1) as s from documents),
        e as (select doc_id, s, len(w) as n, greatest(coalesce(list_sum(list_transform(w, lambda x:
            case when len(regexp_extract_all(lower(x), '[aeiouy]+')) = 0 then 1
                 when lower(x) like '%e' and length(x) > 3 and not regexp_matches(lower(x), '[aeiou]e$') then greatest(len(regexp_extract_all(lower(x), '[aeiouy]+')) - 1, 1)
                 else len(regexp_extract_all(lower(x), '[aeiouy]+')) end)), 0), 1)::int as syllables from d)
        select doc_id, syllables, case when n > 0 then round(206.835::double - 1.015::double * (n / s) - 84.6::double * (syllables / n), 6) end as reading_ease,
               case when n > 0 then round(0.39::double * (n / s) + 11.8::double * (syllables / n) - 15.59::double, 6) end as grade from e""",
    "type_token_ratio": f"with d as (select doc_id, {S.words(_T)} as w from documents) select doc_id, case when len(w) >= 50 then round(len(list_distinct(w)) / len(w), 6) else 0 end::double as ttr from d",
    "burstiness": f"""with n as (select doc_id, list_filter({_LENGTHS}, lambda x: x > 0) as n from documents)
        select doc_id, case when len(n) >= 8 then round(list_stddev_samp(n) / list_avg(n), 6) else 0 end::double as burstiness from n""",
    "punctuation_profile": f"""with d as (select doc_id, {_T} as t from documents)
        select doc_id, (2 * {S.occurrences('t', '—')})::int as em_dash, {S.occurrences('t', ';')}::int as semicolon, {S.occurrences('t', ':')}::int as colon,
               {S.occurrences('t', '!')}::int as exclamation, ({S.occurrences('t', '"')} + {S.occurrences('t', '“')} + {S.occurrences('t', '”')})::int as quotes,
               len(regexp_extract_all(t, '\\([^)]*\\)'))::int as parentheses, {S.occurrences('t', ',')}::int as comma from d""",
    "lexicon_counts": f"select doc_id, {', '.join(f'{S.term_count(_T, terms)}::int as {n}' for n, terms in (('hedges', T.HEDGES), ('informal', T.INFORMAL), ('templates', T.TEMPLATES), ('contribution', T.CONTRIBUTION)))} from documents",
    "repeated_ngrams": f"""with g as ({' union all '.join(S.gram_rows('documents', 'doc_id', _LOW, n) for n in (4, 5, 6))})
        select doc_id, gram, count(*) as n from g where not list_has_any(string_split(gram, ' '), {S.quoted(T.GRAM_STOP)}) group by all having count(*) >= 2""",
    "duplicate_paragraphs": f"""with p as (select doc_id, unnest({S.lines(_T)}) as p from documents),
        k as (select doc_id, array_to_string(w, ' ') as key from (select doc_id, {S.words('lower(p)')} as w from p) where len(w) >= 30),
        c as (select doc_id, key, count(*) as c from k group by all having count(*) > 1)
        select doc_id, sum(c - 1)::bigint as n_duplicates from c group by doc_id""",
    "whitespace_variant_paragraphs": rf"""with p as (select doc_id, regexp_replace(lower(p), '\s+', '', 'g') as key from (select doc_id, unnest({S.lines(_T)}) as p from documents)),
        c as (select doc_id, key from p where length(key) >= 60 group by all having count(*) > 1)
        select doc_id, count(*) as n_groups from c group by doc_id""",
    "duplicate_sentences": rf"""with s as (select doc_id, regexp_replace(s, '^\s+|\s+$', '', 'g') as s from (select doc_id, unnest({S.sentences(_T)}) as s from documents)),
        c as (select doc_id, regexp_replace(lower(s), '\.+$', '') as key from s where length(s) > 20 group by doc_id, key having count(*) > 1)
        select doc_id, count(*) as n_sentences from c group by doc_id""",
    "repeated_phrases": f"""with g as ({S.gram_rows('documents', 'doc_id', f"list_filter(string_split_regex(lower({_T}), '[ \\t\\n\\f\\r]+'), lambda x: x <> '')", 5)})
        select doc_id, gram as phrase, count(*) as n from g where length(gram) > 25 group by all having count(*) >= 3""",
    "acronyms": rf"""with a as (select doc_id, unnest(regexp_extract_all({_T}, '[\p{{L}}\p{{N}}_]+')) as acronym from documents)
        select doc_id, acronym, count(*) as n from a where regexp_matches(acronym, '^[A-Z]{{2,6}}$') group by all having count(*) >= 3""",
    "corpus_overlap": f"""with d as ({_GRAMS}), c as ({_ITEMS}),
        f as (select doc_id, item_id, count(*) / max(n_grams) as f from d join c using (gram) group by all)
        select doc_id, item_id, round(f, 6) as fraction, case when f >= 0.45 then 'critical' when f >= 0.25 then 'medium' when f >= 0.15 then 'low' else 'none' end as band from f""",
    "corpus_union_overlap": f"""with d as ({_GRAMS}), c as ({_ITEMS})
        select doc_id, max(n_grams)::int as n_grams, count(*) as n_shared from d where gram in (select gram from c) group by doc_id""",
    "longest_shared_run": f"""with d as ({S.gram_rows('documents', 'doc_id', _LOW, 8)}), c as ({S.gram_rows('benchmark', 'item_id', _LOW, 8)}),
        p as (select distinct doc_id, item_id, d.pos - c.pos as d, d.pos as i from d join c using (gram)),
        r as (select doc_id, item_id, d, i - row_number() over (partition by doc_id, item_id, d order by i) as isle from p),
        n as (select doc_id, item_id, d, isle, count(*) as c from r group by all)
        select doc_id, item_id, max(c) + 7 as run from n group by all""",
    "matched_runs_14": f"""with t as (select doc_id, unnest(w) as w, generate_subscripts(w, 1) as pos from (select doc_id, {S.words(f'lower({_T})')} as w from documents)),
        k as (select distinct unnest({S.words(f'lower({_T})')}) as w from benchmark),
        h as (select doc_id, pos - row_number() over (partition by doc_id order by pos) as isle from t where w in (select w from k)),
        r as (select doc_id, isle, count(*) as c from h group by all having count(*) >= 14)
        select doc_id, count(*) as n_runs, max(c) as longest from r group by doc_id""",
    "sentence_jaccard": f"""with d as ({_sentence_rows('documents', 'doc_id')}), c as ({_sentence_rows('benchmark', 'item_id')}),
        j as (select doc_id, d.s as s, item_id, c.s as t, count(*) as k, max(d.n) as a, max(c.n) as b from d join c using (tok) group by doc_id, d.s, item_id, c.s)
        select doc_id, count(distinct s) as n_matched from j where k >= 0.55::double * (a + b - k) - 1e-9 group by doc_id""",
    "tfidf_cosine": f"""with d as ({_counts('documents', 'doc_id')}), c as ({_counts('benchmark', 'item_id')}),
        df as (select tok, count(*) as df from (select tok from d union all select tok from c) group by tok),
        n as (select (select count(*) from documents) + (select count(*) from benchmark) as big_n),
        idf as (select tok, ln(big_n / df) + 1 as idf from df, n),
        dx as (select doc_id, tok, tf * idf as y from d join idf using (tok)), cx as (select item_id, tok, tf * idf as x from c join idf using (tok)),
        dn as (select doc_id, sqrt(sum(y * y)) as a from dx group by doc_id), cn as (select item_id, sqrt(sum(x * x)) as b from cx group by item_id),
        o as (select doc_id, item_id, sum(x * y) / (any_value(a) * any_value(b)) as cosine from dx join cx using (tok) join dn using (doc_id) join cn using (item_id) group by all)
        select doc_id, item_id, round(cosine, 6) as cosine from o where cosine >= 0.55""",
}
ORACLES["repeated_phrase_density"] = f"with g as ({ORACLES['repeated_ngrams']}) select doc_id, round((sum(n) - count(*)) / sum(n), 6) as density from g group by doc_id"
