"""Queries over manuscripts: a document's text and a closing note that depends on doc_id, so that all rules can fire."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkloom.operators import findings as R
from inkloom.operators import metrics, numbers, rules, statistics
from inkloom.plans import sql as S
from inkloom.plans.text_queries import spread
from inkloom.sources import manuscripts as sources
from inkloom.streaming import rolling

NOTES = (
    "", "We report a case. Informed consent was obtained.", "A systematic review and meta-analysis of cohort studies. We searched PubMed; a scoping review and a network meta-analysis with IPD.", "A clinical trial of a drug in patients; the mean was analyzed. The patients were enrolled; approved by the Example University IRB.",
    "Mice were studied in an animal study with blinding.", "Our dataset was trained on a test set; code is available on GitHub, CC-BY, version 2.", "Data not shown. Supplementary Table S1. Adapted from [3]. Funded by NIH and the Wellcome Trust, grant number R01AB12.",
    "Bacteria culture at BSL-2. Data availability: Zenodo. CRISPR. Presented at a conference; see the preprint on arXiv.", "This protocol has eligibility criteria and is registered. AI as intervention.", "Semi-structured interviews with participants; male and female, transcripts of audio recordings, gender and XX hormones.",
    "Supplementary material in a proprietary format. Regression, outlier, post-hoc. Bayesian posterior with a confidence interval, Kaplan-Meier, hazard ratio.", "Machine learning benchmark, conda, cross-validation, neural network. Our proposed method: grid search and hyperparameter tuning, 97% accuracy under class imbalance.",
    "A randomized controlled trial of AI, cluster randomized, a pragmatic trial. The intervention had training sessions. p < 0.05, highly significant, significantly different, marginally significant.", "A cohort study, observational, with electronic health records, GWAS and SNP, heritability, and a biomarker exposure; smoking causes harm.",
    "Diagnostic accuracy by deep learning; a prediction model; cost-effectiveness with QALY and a Markov simulation model.", "qPCR and digital PCR, RNA-seq, cell lines, tumor marker, quality improvement by PDSA, thematic synthesis.",
    "Theorem 1. Obviously trivially true; it is easy to see. The proof is clearly omitted; in order to optimize normalization, optimization and generalization.", "Finite element solver with material properties. Horizon Europe, KAKENHI, NSFC, UGC, National Research Foundation of Korea.",
    "Conflict of interest: no conflict. Supported by a grant; patent. Methodology, software. ChatGPT et al. It is worth noting that we delve into placeholder text. References: doi: none.", "Novel, novel and novel; unique, unique, unique. We propose and we proposed. Guaranteed acceptance; you are invited to submit. This may, might, could, possibly seem likely.",
    "N = 12 participants were surveyed, robust; n = 12; statistical power. GDPR and PHI. machine learning to classify with an llm, european.",
    "Response to reviewers. Reviewer 1: the reviewer is wrong. Regression, r = 1.4, p = 0.000, see Fig. ?? and Error! Reference source not found. TODO: add your repo here.",
)


def manuscripts(spark: SparkSession, sf_dir: str, shift: int = 0) -> DataFrame:
    d = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    note = F.get(F.array(*[F.lit(n) for n in NOTES]), F.pmod(F.col("doc_id") + shift, F.lit(len(NOTES))).cast("int"))
    return d.select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), note).alias("text"))


def checked(spark: SparkSession, sf_dir: str, shift: int = 0) -> DataFrame:
    return rules.checked(manuscripts(spark, sf_dir, shift))


def rule_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.findings(manuscripts(spark, sf_dir)).select("doc_id", "category", "severity", "title", "confidence")


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


def orcid_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Check characters of 15-digit ids made from doc_id."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.lpad(F.pmod(F.col("doc_id") * 7919 + 104729, F.lit(10**12)).cast("string"), 15, "0").alias("digits"))
    return d.select("doc_id", numbers.mod11_check(F.col("digits")).alias("check_character"))


def stated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts, each followed by statements of tests and means with numbers made from doc_id."""
    d, k = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")), F.col("doc_id").cast("string")
    said = F.concat(F.lit("t("), F.pmod("doc_id", F.lit(60)) + 10, F.lit(") = 2."), F.pmod("doc_id", F.lit(10)), F.lit(", p = .04. N = "), F.pmod("doc_id", F.lit(40)) + 10, F.lit(". M = 3."), F.lpad(F.pmod(k.cast("long"), F.lit(100)).cast("string"), 2, "0"), F.lit("; mean = 4."), F.lpad(F.pmod(k.cast("long") * 7, F.lit(100)).cast("string"), 2, "0"), F.lit("."))
    return d.select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), said).alias("text"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


QUERIES = {
    "reported_tests": lambda s, d: statistics.reported_tests(stated(s, d)),
    "impossible_means": lambda s, d: statistics.impossible_means(stated(s, d)),
    "conversation_word_count": lambda s, d: metrics.word_counts(sources.from_conversations(s.read.parquet(f"{d}/conversations.parquet"))),
    "event_windows": lambda s, d: rolling.window_counts(events(s, d)),
    "event_sessions": lambda s, d: rolling.sessions(events(s, d)),
    "rule_findings": rule_findings,
    "severity_counts": lambda s, d: R.rule_counts(manuscripts(s, d)),
    "readiness_score": lambda s, d: R.readiness(checked(s, d)),
    "batch_report": lambda s, d: R.batch(checked(s, d)),
    "fix_plan": lambda s, d: R.fix_plan(checked(s, d)),
    "plan_totals": lambda s, d: R.plan_totals(checked(s, d)),
    "revision_diff": lambda s, d: R.revision_diff(checked(s, d), checked(s, d, 1)),
    "ignored_findings": lambda s, d: R.severity_counts(R.ignored(checked(s, d), IGNORED)),
    "first_digits": lambda s, d: numbers.first_digits(lineitem(s, d), "l_extendedprice", "l_returnflag"),
    "last_digits": lambda s, d: numbers.last_digits(lineitem(s, d), "l_extendedprice", "l_returnflag"),
    "orcid_checksum": orcid_checksum,
}


#: Titles that ignored_findings leaves out.
IGNORED = ["^no .* mentioned", "orcid", "reporting|missing"]


def _condition(r: rules.Rule) -> str:
    tests = ["length(low) > 0"]
    tests += [f"n_words >= {r.least_words}"] * bool(r.least_words) + [f"n_tokens >= {r.least_tokens}"] * bool(r.least_tokens)
    tests += [S.found(p) for p in r.need] + [f"not {S.found(p)}" for p in r.lack] + [f"not ({S.found(a)} and not {S.found(b)})" for a, b in r.unless]
    for k, (patterns, least) in enumerate(r.counts):
        tests.append(f"{S.matches(patterns)} >= {least}")
        if k == 0 and r.count_most is not None:
            tests.append(f"{S.matches(patterns)} <= {r.count_most}")
        if k == 0 and r.per_1000 is not None:
            tests.append(f"({S.matches(patterns)}) * 1000.0::double > n_words * {r.per_1000}::double")
    if r.distinct:
        tests.append(f"({' + '.join(S.found(p) + '::int' for p in r.distinct)}) < {r.fewer}")
    return " and ".join(tests)


def _title(r: rules.Rule) -> str:
    return S.text(r.title) if "{n}" not in r.title else "replace(" + S.text(r.title) + ", '{n}', (" + S.matches(r.counts[0][0]) + ")::varchar)"


def _findings(shift: int = 0) -> str:
    m = f"select doc_id, coalesce(text, '') || chr(10) || {S.quoted(NOTES)}[1 + (doc_id + {shift}) % {len(NOTES)}] as text from documents"
    each = rules.all_rules()
    cases = ", ".join(f"case when {_condition(r)} then {{'seq': {k}, 'title': {_title(r)}}} end" for k, r in enumerate(each))
    known = ", ".join(f"({k}, {S.text(r.category)}, {S.text(r.severity)}, {r.confidence}::double, {S.text(r.action)})" for k, r in enumerate(each))
    return f"""(with t as ({m}), l as (select doc_id, text, lower(text) as low from t),
        m as materialized (select *, {S.PLAIN.format('low')} as low_plain, {S.PLAIN.format('text')} as text_plain, len({S.words('low')}) as n_words, len(list_filter(string_split_regex(low, '\\s+'), lambda w: w <> '')) as n_tokens from l),
        c as (select doc_id, unnest(list_filter([{cases}], lambda x: x is not null)) as x from m)
        select doc_id, x.seq as seq, category, severity, x.title as title, confidence, action from c join (values {known}) k(seq, category, severity, confidence, action) on x.seq = k.seq)"""


_DIM = "(values " + ", ".join(f"('{s}', {w}::double, {r}, {c}::double, {m}::double)" for s, w, r, c, m in R.SEVERITIES) + ") v(severity, weight, rank, scale, most)"
_READY = f"""tier as (select doc_id, severity, sum(weight * confidence) as raw, any_value(scale) as scale, any_value(most) as most from f join {_DIM} using (severity) group by all),
    pen as (select doc_id, sum(most * (1 - exp(-raw / scale))) as penalty from tier group by doc_id),
    cat as (select doc_id, count(*) filter (n >= 2) / count(*) as ratio from (select doc_id, category, count(*) as n from f group by all) group by doc_id),
    ready as (select d.doc_id, coalesce(greatest(least(round_even(100 - penalty * (0.7::double + 0.3::double * ratio), 0), 100), 0), 100)::int as readiness from documents d left join pen using (doc_id) left join cat using (doc_id))"""
_COUNTS = "select d.doc_id, " + ", ".join(f"count(*) filter (severity = '{s[0]}') as {s[0].lower()}" for s in R.SEVERITIES) + ", count(severity) as findings from documents d left join f using (doc_id) group by d.doc_id"
_RANKED = f"select f.*, row_number() over (partition by doc_id order by rank, confidence desc, seq) as place from f join {_DIM} using (severity)"
_PLAN = f"""r as ({_RANKED}),
    k as (select *, row_number() over (partition by doc_id, regexp_replace(lower(title), '[^a-z0-9]+', '', 'g') order by place) as copy from r),
    plan as (select doc_id, row_number() over (partition by doc_id order by place)::int as step, title,
        case when len(list_filter(string_split_regex(action, '\\s+'), lambda w: w <> '')) <= 12 then 30 when regexp_matches(lower(action), 'add|state|include|declare|provide|register|deposit|report') then 30
             when regexp_matches(lower(action), 'rewrite|restructure|expand|re-analy|collect|conduct') then 150 else 90 end::int as minutes from k where copy = 1)"""

ORACLES = {
    # Student's distribution has a closed form for whole degrees of freedom
    "reported_tests": """with d as (select doc_id, (doc_id % 60 + 10)::int as df, 2 + (doc_id % 10) / 10 as v from documents), w as (select *, unnest([0, -0.05, 0.05]) as h from d),
        a as (select *, atan((v + h) / sqrt(df)) as a from w),
        s as (select doc_id, df, v, h, a, list_sum(list_transform(range(0, (df - df % 2) // 2), lambda k:
            case when df % 2 = 0 then exp(lgamma(k + 0.5) - lgamma(k + 1)) / sqrt(pi()) * pow(cos(a), 2 * k) else exp(lgamma(k + 1) - lgamma(k + 1.5)) * sqrt(pi()) / 2 * pow(cos(a), 2 * k + 1) end)) as s from a),
        p as (select doc_id, df, v, h, 1 - case when df % 2 = 0 then sin(a) * s else 2 / pi() * (a + sin(a) * s) end as p from s)
        select doc_id, 't' as kind, df::double as df1, null::double as df2, v::double as value, '=' as sign, 0.04::double as reported, round(max(p) filter (h = 0), 6) as p, max(p) filter (h > 0) > 0.05 as decision_error from p group by doc_id, df, v""",
    "impossible_means": """with e as (select doc_id, unnest(['3.' || lpad((doc_id % 100)::varchar, 2, '0'), '4.' || lpad((doc_id * 7 % 100)::varchar, 2, '0')]) as mean, (doc_id % 40 + 10)::int as n from documents), d as (select * from e),
        k as (select *, round_even(mean::double * n, 0)::bigint as k from d)
        select doc_id, mean, n, printf('%.2f', (k - 1) / n) = mean or printf('%.2f', k / n) = mean or printf('%.2f', (k + 1) / n) = mean as possible from k""",
    "conversation_word_count": f"""with c as (select conv_id as doc_id, string_agg(coalesce(text, ''), chr(10) order by turn) as text from conversations group by conv_id)
        select doc_id, len({S.words('text')})::int as word_count, len({S.sentences('text')})::int as sentence_count from c""",
    "event_windows": "select date_trunc('hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all",
    "event_sessions": """with e as (select user_id, ts, case when ts < lag(ts) over w + interval 30 minutes then 0 else 1 end as first from events window w as (partition by user_id order by ts)),
        s as (select user_id, ts, sum(first) over (partition by user_id order by ts rows unbounded preceding) as k from e)
        select user_id, min(ts) as start, count(*) as n from s group by user_id, k""",
    "rule_findings": f"select doc_id, category, severity, title, confidence from {_findings()}",
    "severity_counts": f"with f as {_findings()} {_COUNTS}",
    "ignored_findings": f"with f as (select * from {_findings()} where not regexp_matches(lower(title), {S.text('|'.join(f'(?:{p})' for p in IGNORED))})) {_COUNTS}",
    "readiness_score": f"with f as {_findings()}, {_READY} select * from ready",
    "batch_report": f"""with f as {_findings()}, {_READY}, c as ({_COUNTS}), r as ({_RANKED}),
        t as (select doc_id, string_agg(severity || ': ' || title, ' | ' order by place) as top_findings from r where place <= 3 group by doc_id)
        select doc_id, readiness, {', '.join(f'coalesce({s[0].lower()}, 0) as {s[0].lower()}' for s in R.SEVERITIES)}, coalesce(findings, 0) as findings, coalesce(top_findings, '') as top_findings
        from ready left join c using (doc_id) left join t using (doc_id)""",
    "fix_plan": f"""with f as {_findings()}, {_PLAN} select * from plan""",
    "plan_totals": f"""with f as {_findings()}, {_PLAN} select doc_id, count(*) as steps, sum(minutes)::bigint as minutes, round(sum(minutes) / 60, 1) as hours from plan group by doc_id""",
    "revision_diff": f"""with x as {_findings()}, y as {_findings(1)},
        a as (select doc_id, category, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) as key, min_by(title, seq) as title from x group by all),
        b as (select doc_id, category, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) as key, min_by(title, seq) as title from y group by all)
        select doc_id, category, title, 'new' as state from b anti join a using (doc_id, category, key)
        union all select doc_id, category, title, 'still open' from b semi join a using (doc_id, category, key)
        union all select doc_id, category, title, 'fixed' from a anti join b using (doc_id, category, key)""",
    "first_digits": f"""with d as (select l_returnflag, regexp_extract(printf('%.6f', abs(l_extendedprice::double)), '[1-9]') as d from lineitem),
        c as (select l_returnflag, d::int as k, count(*) as c from d where d <> '' group by all),
        n as (select l_returnflag, sum(c)::bigint as n from c group by all),
        e as (select l_returnflag, n, unnest(range(1, 10)) as k from n)
        select l_returnflag, n, round(sum(power(coalesce(c, 0) / n - log10(1 + 1 / k), 2) / log10(1 + 1 / k)), 6) as chi_square
        from e left join c using (l_returnflag, k) group by all""",
    "last_digits": """with d as (select l_returnflag, round(l_extendedprice::double * 100)::bigint % 10 as d from lineitem), n as (select l_returnflag, count(*) as n, """
    + ", ".join(f"count(*) filter (d = {k}) as d{k}" for k in range(10))
    + " from d group by all) select l_returnflag, n, round("
    + " + ".join(f"power(d{k} / n - 0.1::double, 2) / 0.1::double" for k in range(10))
    + ", 6) as chi_square, round((d0 + d5) / n, 6) as round_share from n",
    "orcid_checksum": """with d as (select doc_id, lpad(((doc_id * 7919 + 104729) % 1000000000000)::varchar, 15, '0') as s from documents),
        t as (select doc_id, (12 - list_reduce(list_prepend(0::bigint, list_transform(string_split(s, ''), lambda c: c::bigint)), lambda a, b: (a + b) * 2 % 11)) % 11 as r from d)
        select doc_id, case when r = 10 then 'X' else r::varchar end as check_character from t""",
}
