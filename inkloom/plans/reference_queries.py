"""Queries over reference lists: notes with citations and references whose numbers are made from doc_id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkloom.operators import references as R
from inkloom.plans import sql as S


def cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    text = F.concat(
        F.lit("Seen in ["), k % 5 + 1, F.lit(", "), k % 7 + 2, F.lit("] and ["), k % 3 + 4, F.lit("].\nAlso ["), k % 4 + 1, F.lit(", "), k % 6 + 3, F.lit(", "), k % 9 + 1, F.lit("].\nReferences\n"),
        F.lit("[1] A. Author, On things, Journal of Things, pp. "), k % 50 + 10, F.lit("-"), k % 70 + 10, F.lit(", "), k % 60 + 1980, F.lit(", 10.1234/x"), k % 2, F.lit("\n"),
        F.lit("[2] B. Author, More of the same things, 10.1234/x1\n"), F.lit("[3] "), F.coalesce(F.regexp_replace("text", "\n", " "), F.lit("")),
    )
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", text.alias("text"))


def screening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as references against whole benchmark texts as titles."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    refs = docs.select("doc_id", F.lit(1).alias("ref_no"), F.coalesce("text", F.lit("")).alias("raw"))
    titles = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("title_id"), F.coalesce("text", F.lit("")).alias("title"))
    return R.screened(refs, titles)


QUERIES = {
    "citation_gaps": lambda s, d: R.citation_gaps(cited(s, d)),
    "cocitation_edges": lambda s, d: R.cocitations(cited(s, d)),
    "cocitation_triangles": lambda s, d: R.triangles(cited(s, d)),
    "reference_split": lambda s, d: R.reference_rows(cited(s, d)),
    "reference_flags": lambda s, d: R.reference_flags(cited(s, d)),
    "title_screening": screening,
    "citation_check": lambda s, d: R.citation_check(cited(s, d)),
    "citation_clusters": lambda s, d: R.citation_clusters(cited(s, d)),
}

_CITED = """select doc_id, 'Seen in [' || (doc_id % 5 + 1) || ', ' || (doc_id % 7 + 2) || '] and [' || (doc_id % 3 + 4) || '].' || chr(10) || 'Also [' || (doc_id % 4 + 1) || ', ' || (doc_id % 6 + 3) || ', ' || (doc_id % 9 + 1) || '].' || chr(10) || 'References' || chr(10)
    || '[1] A. Author, On things, Journal of Things, pp. ' || (doc_id % 50 + 10) || '-' || (doc_id % 70 + 10) || ', ' || (doc_id % 60 + 1980) || ', 10.1234/x' || (doc_id % 2) || chr(10) || '[2] B. Author, More of the same things, 10.1234/x1' || chr(10) || '[3] ' || coalesce(replace(text, chr(10), ' '), '') as text from documents"""
_NUMBERS = rf"""m as ({_CITED}), p as (select doc_id, unnest(x) as x, generate_subscripts(x, 1) as p from (select doc_id, {S.lines('text')} as x from m)),
    c as (select doc_id, p, unnest(regexp_extract_all(x, '\[(\d{{1,3}}(?:\s*,\s*\d{{1,3}})*)\]', 1)) as c from p),
    n as (select distinct doc_id, p, ref::int as ref from (select doc_id, p, unnest(string_split_regex(c, '\s*,\s*')) as ref from c))"""
_EDGES = f"{_NUMBERS}, e as (select distinct x.doc_id, x.ref as a, y.ref as b from n x join n y on x.doc_id = y.doc_id and x.p = y.p and x.ref < y.ref)"
_LISTED = rf"""x as (select doc_id, unnest({S.lines('text')}) as x from m),
    r as (select doc_id, regexp_extract(x, '^\[(\d+)\]', 1)::int as ref_no, regexp_extract(x, '^\[\d+\]\s+(.*)$', 1) as raw from x where regexp_matches(x, '^\[\d+\]\s+\S')),
    refs as (select * from r where length(raw) > 15)"""
_ROWS = f"m as ({_CITED}), {_LISTED}"
_TOKENS = "list_distinct(list_filter({}, lambda w: length(w) >= 4))"

ORACLES = {
    "citation_gaps": f"""with {_NUMBERS}, g as (select doc_id, unnest(range(1, max(ref) + 1))::int as missing from n group by doc_id)
        select doc_id, missing from g anti join (select doc_id, ref as missing from n) using (doc_id, missing)""",
    "cocitation_edges": f"with {_EDGES} select * from e",
    "cocitation_triangles": f"with {_EDGES} select x.doc_id, count(*) as n_triangles from e x join e y on x.doc_id = y.doc_id and x.b = y.a join e z on z.doc_id = x.doc_id and z.a = x.a and z.b = y.b group by x.doc_id",
    "citation_check": f"""with {_NUMBERS}, u as (select distinct n.doc_id, ref from n join p z on z.doc_id = n.doc_id and z.p = n.p where not regexp_matches(z.x, '^\\[\\d+\\]\\s+\\S')), {_LISTED.replace('x as', 'y as', 1).replace(' from x ', ' from y ')}, l as (select distinct doc_id, ref_no as ref from refs)
        select doc_id, ref, 'not listed' as state from u anti join l using (doc_id, ref) where doc_id in (select doc_id from l) union all select doc_id, ref, 'never cited' from l anti join u using (doc_id, ref)""",
    "citation_clusters": f"""with recursive {_EDGES}, b as (select doc_id, a, b from e union select doc_id, b, a from e),
        r(doc_id, node, seen) as (select distinct doc_id, a, a from b union select r.doc_id, r.node, b.b from r join b on r.doc_id = b.doc_id and r.seen = b.a),
        k as (select doc_id, node, min(seen) as cluster from r group by all), z as (select doc_id, cluster, count(*) as size from k group by all)
        select doc_id, count(*) as n_clusters, max(size) as largest from z where size >= 3 group by doc_id""",
    "reference_split": f"with {_ROWS} select * from refs",
    "reference_flags": rf"""with {_ROWS}, d as (select *, lower(regexp_extract(raw, '(10\.\d{{4,9}}/[^\s,;]+)', 1)) as doi, regexp_replace(raw, '10\.\d{{4,9}}/[^\s,;]+', '', 'g') as bare from refs),
        y as (select *, regexp_extract_all(bare, '(?:^|[^0-9])((?:19|20)\d{{2}})(?:$|[^0-9-])', 1) as years, regexp_extract(bare, 'pp?\.\s*(\d{{1,6}})\s*[-–]\s*(\d{{1,6}})', 1) as a, regexp_extract(bare, 'pp?\.\s*(\d{{1,6}})\s*[-–]\s*(\d{{1,6}})', 2) as b,
            count(*) over (partition by doc_id, doi) as n from d)
        select doc_id, ref_no, coalesce(list_max(list_transform(years, lambda v: v::int)) > 2026, false) as future_year, coalesce(try_cast(a as int) > try_cast(b as int), false) as backwards_pages, len(years) = 0 as no_year, doi <> '' and n > 1 as repeated_doi from y""",
    "title_screening": f"""with t as (select item_id as title_id, unnest({_TOKENS.format(S.words("lower(coalesce(text, ''))"))}) as w from benchmark),
        g as (select w from t group by w having count(*) > (select count(*) from benchmark) * 0.005 and count(*) > 2), u as (select * from t anti join g using (w)),
        z as (select title_id, count(*) as size from u group by title_id), r as (select doc_id, unnest({_TOKENS.format(S.words("lower(coalesce(text, ''))"))}) as w from documents),
        k as (select doc_id, title_id, count(*) as k from r join u using (w) group by all)
        select doc_id, 1 as ref_no, min(title_id) as title_id from k join z using (title_id) where k >= 4 or k >= 3 and k * 2 >= size group by doc_id""",
}
