"""What is done with findings: repair, scores, counts, rankings, plans and the comparison of two revisions.

A document's findings are one array in its row (rules.checked()), so all of this runs inside the row: no shuffle, and the
rules are evaluated once whatever is asked of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkloom.operators.rules import Rule, tallied

# Label, weight, rank, scale and largest penalty of each severity.
SEVERITIES = (("Critical", 40.0, 0, 60.0, 60.0), ("High", 20.0, 1, 150.0, 45.0), ("Medium", 8.0, 2, 300.0, 25.0), ("Low", 3.0, 3, 200.0, 18.0), ("Info", 0.0, 4, 1.0, 0.0))
_f = "f"


def of_severity(c: Column, place: int) -> Column:
    out = F.lit(None)
    for s in reversed(SEVERITIES):
        out = F.when(c == s[0], F.lit(s[place])).otherwise(out)
    return out


def repaired(findings: DataFrame) -> DataFrame:
    """Confidences as numbers from 0 to 1 (what isn't a number: 0.5), severities in title case (unknown: Low)."""
    number = F.expr("try_cast(confidence as double)")
    number = F.when(number.isNull() | F.isnan(number), 0.5).otherwise(F.greatest(F.least(number, F.lit(1.0)), F.lit(0.0)))
    label = F.initcap(F.trim(F.coalesce("severity", F.lit(""))))
    return findings.withColumn("confidence", number).withColumn("severity", F.when(label.isin([s[0] for s in SEVERITIES]), label).otherwise("Low"))


def gathered(docs: DataFrame, findings: DataFrame) -> DataFrame:
    """doc_id, f: findings of any source (doc_id, seq, category, severity, title, confidence, action) as an array for each document."""
    fields = ("seq", "category", "severity", "title", "confidence", "action")
    f = findings.groupBy("doc_id").agg(F.collect_list(F.struct(*fields)).alias(_f))
    none = F.array().cast("array<struct<seq:int,category:string,severity:string,title:string,confidence:double,action:string>>")
    return docs.select("doc_id").join(f, "doc_id", "left").withColumn(_f, F.coalesce(_f, none))


def ignored(checked: DataFrame, patterns: list[str]) -> DataFrame:
    """checked() without the findings whose title matches any of the patterns (case is ignored)."""
    if not patterns:
        return checked
    return checked.withColumn(_f, F.filter(_f, lambda x: ~x["title"].rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns))))


def percent(confidence: Column) -> Column:
    """A confidence as it is printed: a rounded percentage, marked as uncertain under 50."""
    p = F.bround(F.greatest(F.least(confidence, F.lit(1.0)), F.lit(0.0)) * 100).cast("int")
    return F.concat(p.cast("string"), F.when(p < 50, "% (uncertain)").otherwise("%"))


def let(value: Column, of) -> Column:
    """of(value), the value evaluated once however often `of` uses it."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def repeated_items(items: Column) -> Column:
    """How many different items an array holds more than once: those whose first place isn't their last."""
    return F.size(F.filter(F.array_distinct(items), lambda x: F.array_position(items, x) + F.array_position(F.reverse(items), x) <= F.size(items)))


def readiness_of(f: Column) -> Column:
    """100 less saturating penalties by severity, scaled by how clustered the categories are."""
    penalty = F.lit(0.0)
    for label, weight, _, scale, most in SEVERITIES:
        raw = F.aggregate(F.filter(f, lambda x: x["severity"] == label), F.lit(0.0), lambda acc, x: acc + weight * x["confidence"])
        penalty = penalty + most * (1 - F.exp(-raw / scale))
    clustered = let(F.transform(f, lambda x: x["category"]), lambda c: 0.3 * repeated_items(c) / F.greatest(F.size(F.array_distinct(c)), F.lit(1)))
    score = F.bround(100 - penalty * (0.7 + clustered))
    return F.when(F.size(f) == 0, 100).otherwise(F.greatest(F.least(score, F.lit(100.0)), F.lit(0.0)).cast("int"))


def readiness(checked: DataFrame) -> DataFrame:
    return checked.select("doc_id", readiness_of(F.col(_f)).alias("readiness"))


def counts_of(f: Column) -> list[Column]:
    each = [F.size(F.filter(f, lambda x: x["severity"] == s[0])).cast("long").alias(s[0].lower()) for s in SEVERITIES]
    return [*each, F.size(f).cast("long").alias("findings")]


def severity_counts(checked: DataFrame) -> DataFrame:
    """doc_id, a count for each severity, findings."""
    return checked.select("doc_id", *counts_of(F.col(_f)))


def rule_counts(docs: DataFrame, rules: Sequence[Rule] | None = None) -> DataFrame:
    """severity_counts() of the rules' findings in docs, from the rules that fire: the findings themselves aren't made."""
    n = lambda k: F.coalesce(F.get("x", F.lit(k)), F.lit(0).cast("long"))
    each = [n(k).alias(s[0].lower()) for k, s in enumerate(SEVERITIES)]
    return tallied(docs, [s[0] for s in SEVERITIES], rules).select("doc_id", *each, sum((n(k) for k in range(1, len(SEVERITIES) + 1)), n(0)).alias("findings"))


def ranked_of(f: Column) -> Column:
    """The findings by severity, then confidence, then emission order."""
    key = F.transform(f, lambda x: F.struct(of_severity(x["severity"], 2).alias("rank"), (-x["confidence"]).alias("less"), x["seq"].alias("seq"), x["severity"].alias("severity"), x["title"].alias("title"), x["action"].alias("action")))
    return F.array_sort(key)


def top_of(f: Column, n: int = 3) -> Column:
    """The first n findings as "Severity: title", joined by bars."""
    return F.array_join(F.transform(F.slice(ranked_of(f), 1, n), lambda x: F.concat_ws(": ", x["severity"], x["title"])), " | ")


def batch(checked: DataFrame) -> DataFrame:
    """doc_id, readiness, counts, top_findings: one row for each document."""
    f = F.col(_f)
    return checked.select("doc_id", readiness_of(f).alias("readiness"), *counts_of(f), top_of(f).alias("top_findings"))


def minutes_of(action: Column) -> Column:
    words = F.size(F.filter(F.split(action, r"\s+"), lambda w: w != ""))
    act = F.lower(action)
    return F.when(words <= 12, 30).when(act.rlike("add|state|include|declare|provide|register|deposit|report"), 30).when(act.rlike("rewrite|restructure|expand|re-analy|collect|conduct"), 150).otherwise(90)


def plan_of(f: Column) -> Column:
    """The findings of distinct normalised titles in order."""
    key = lambda x: F.regexp_replace(F.lower(x["title"]), "[^a-z0-9]+", "")
    return let(ranked_of(f), lambda r: let(F.transform(r, key), lambda k: F.filter(r, lambda x, i: F.array_position(k, F.get(k, i)) == i + 1)))


def fix_plan(checked: DataFrame) -> DataFrame:
    """doc_id, step, title, minutes: findings of distinct normalised titles in order, with an estimate of the work."""
    steps = checked.select("doc_id", F.posexplode_outer(plan_of(F.col(_f))).alias("step", "x")).where(F.col("x").isNotNull())
    return steps.select("doc_id", (F.col("step") + 1).alias("step"), F.col("x.title").alias("title"), minutes_of(F.col("x.action")).alias("minutes"))


def plan_totals(checked: DataFrame) -> DataFrame:
    """doc_id, steps, minutes, hours: the whole plan's work. A row's steps are summed in it, before rows are grouped by doc_id."""
    minutes = lambda plan: F.aggregate(plan, F.lit(0).cast("long"), lambda acc, x: acc + minutes_of(x["action"]))
    total = let(plan_of(F.col(_f)), lambda plan: F.struct(F.size(plan).cast("long").alias("steps"), minutes(plan).alias("minutes")))
    each = checked.select("doc_id", total.alias("t")).groupBy("doc_id").agg(F.sum("t.steps").alias("steps"), F.sum("t.minutes").alias("minutes"))
    return each.where(F.col("steps") > 0).withColumn("hours", F.round(F.col("minutes") / 60, 1))


def revision_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """doc_id, category, title, state: fixed, still open or new, by category and normalised title."""
    def keyed(checked: DataFrame, name: str) -> DataFrame:
        key = lambda x: F.struct(x["category"].alias("category"), F.trim(F.regexp_replace(F.lower(x["title"]), "[^a-z0-9]+", " ")).alias("key"), x["title"].alias("title"))
        each = F.transform(F.array_sort(F.transform(_f, lambda x: F.struct(x["seq"].alias("seq"), key(x).alias("x")))), lambda y: y["x"])
        # the first finding of each category and key; the array is a column of its own, or it would be made again for each item
        return checked.select("doc_id", each.alias("e")).select("doc_id", F.filter("e", lambda x, i: ~F.exists(F.slice("e", F.lit(1), i), lambda y: (y["category"] == x["category"]) & (y["key"] == x["key"]))).alias(name))

    both = keyed(before, "a").join(keyed(after, "b"), "doc_id", "full")
    none = F.array().cast("array<struct<category:string,key:string,title:string>>")
    a, b = F.coalesce("a", none), F.coalesce("b", none)
    has = lambda other, x: F.exists(other, lambda y: (y["category"] == x["category"]) & (y["key"] == x["key"]))
    row = lambda x, state: F.struct(x["category"].alias("category"), x["title"].alias("title"), F.lit(state).alias("state"))
    out = F.concat(
        F.transform(F.filter(b, lambda x: ~has(a, x)), lambda x: row(x, "new")),
        F.transform(F.filter(b, lambda x: has(a, x)), lambda x: row(x, "still open")),
        F.transform(F.filter(a, lambda x: ~has(b, x)), lambda x: row(x, "fixed")),
    )
    return both.select("doc_id", F.explode_outer(out).alias("x")).where(F.col("x").isNotNull()).select("doc_id", "x.*")
