"""Queries over sections, venues, numbers and addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkloom.operators import structure as R
from inkloom.plans import sql as S

_T = "coalesce(text, '')"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def sectioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with headings before the whole text, its first 400 characters and a sentence of numbers."""
    t, k = F.coalesce("text", F.lit("")), F.col("doc_id")
    text = F.concat(F.lit("# 1. Introduction\n"), t, F.lit("\n## 1.1 Methods:\n"), F.substring(t, 1, 400), F.lit("\n# Results\nWe had "), k % 9, F.lit(" patients and then "), k % 7, F.lit(" patients, 3 nodes."))
    return documents(spark, sf_dir).select("doc_id", text.alias("text"))


def with_venue(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(v[0]) for v in R.VENUES])
    return documents(spark, sf_dir).select("doc_id", F.get(names, F.pmod("doc_id", F.lit(len(R.VENUES))).cast("int")).alias("venue"), "text")


QUERIES = {
    "section_split": lambda s, d: R.sections(sectioned(s, d)),
    "section_overlap": lambda s, d: R.section_overlap(sectioned(s, d)),
    "venue_compliance": lambda s, d: R.compliance(with_venue(s, d), R.venues(s)),
    "number_conflicts": lambda s, d: R.units(sectioned(s, d)),
    "shared_addresses": lambda s, d: R.shared_addresses(documents(s, d)),
}

_M = f"""m as (select doc_id, '# 1. Introduction' || chr(10) || {_T} || chr(10) || '## 1.1 Methods:' || chr(10) || substring({_T}, 1, 400) || chr(10) || '# Results' || chr(10) || 'We had ' || (doc_id % 9) || ' patients and then ' || (doc_id % 7) || ' patients, 3 nodes.' as text from documents)"""
_NULL = lambda x: "null" if x is None else x
_VENUES = ", ".join(f"('{v}', {_NULL(w)}, {_NULL(p)})" for v, w, p, _, _ in R.VENUES)

ORACLES = {
    "section_split": rf"""with {_M}, p as (select doc_id, unnest(x) as x, generate_subscripts(x, 1) as p from (select doc_id, string_split(text, chr(10)) as x from m)),
        h as (select *, regexp_matches(x, '^#{{1,6}}\s+\S') as head from p),
        s as (select *, sum(head::int) over (partition by doc_id order by p rows unbounded preceding)::bigint as section from h)
        select doc_id, section, max(case when head then trim(lower(regexp_replace(regexp_replace(x, '^#+\s+', ''), '^\d+(\.\d+)*\.?\s+|:$', '', 'g'))) end) as heading,
               sum(case when head then 0 else len({S.words('x')}) end)::bigint as words from s where section > 0 group by doc_id, section""",
    "section_overlap": rf"""with {_M}, p as (select doc_id, unnest(x) as x, generate_subscripts(x, 1) - 1 as k from (select doc_id, string_split(regexp_replace(text, '\n(#{{1,6}}\s)', chr(1) || '\1', 'g'), chr(1)) as x from m)),
        w as (select doc_id, k, list_distinct(list_filter({S.words('lower(x)')}, lambda w: length(w) >= 4)) as w from p),
        v as (select *, lead(w) over (partition by doc_id order by k) as v from w)
        select doc_id, k::int as a, (k + 1)::int as b, round(len(list_intersect(w, v)) / greatest(len(list_distinct(list_concat(w, v))), 1), 6) as jaccard from v
        where v is not null and round(len(list_intersect(w, v)) / greatest(len(list_distinct(list_concat(w, v))), 1), 6) >= 0.2""",
    "venue_compliance": f"""with v(venue, word_limit, page_limit) as (values {_VENUES}), n as (select *, row_number() over () - 1 as k from v),
        d as (select doc_id, {S.quoted([v[0] for v in R.VENUES])}[1 + doc_id % {len(R.VENUES)}] as venue, len({S.words(_T)})::int as words from documents)
        select doc_id, venue, words, coalesce(words > word_limit, false) as over_words, coalesce(greatest(1, words / 500) > page_limit, false) as over_pages from d join n using (venue)""",
    "number_conflicts": rf"""with {_M}, r as (select doc_id, unnest(regexp_extract_all(lower(text), '(\d+(?:\.\d+)?)\s*(?:participant|subject|sample|patient|node|instance|epoch|layer|feature|model)s?')) as s from m),
        u as (select doc_id, regexp_extract(s, '^(\d+(?:\.\d+)?)', 1) as v, regexp_extract(s, '([a-z]+?)s?$', 1) as unit from r)
        select doc_id, unit, count(distinct v) as n_values from u group by all having count(distinct v) > 1""",
    "shared_addresses": rf"""with a as (select distinct doc_id, unnest(regexp_extract_all(lower({_T}), '[a-z0-9._%+-]{{1,64}}@[a-z0-9-]+(?:\.[a-z0-9-]+)+')) as address from documents),
        b as (select *, string_split(address, '@')[-1] as domain from a), c as (select domain, count(distinct doc_id) as n_domain from b group by domain)
        select address, count(*) as n_docs, any_value(n_domain) as n_domain from b join c using (domain) group by address""",
}
