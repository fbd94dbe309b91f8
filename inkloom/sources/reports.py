"""Reports of checked documents as text, one row for each: Markdown, HTML, JSON with fixed fields, batch lines, BibTeX."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkloom.operators import findings as R


def _escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def markdown(checked: DataFrame) -> DataFrame:
    """doc_id, report: a heading, the score and the findings in order."""
    lines = F.transform(R.ranked_of(F.col("f")), lambda x: F.concat(F.lit("- **"), x["severity"], F.lit("** "), x["title"], F.lit(" ("), R.percent(-x["less"]), F.lit(")")))
    head = F.concat(F.lit("# Report on "), F.col("doc_id").cast("string"), F.lit("\n\nReadiness: "), R.readiness_of(F.col("f")).cast("string"), F.lit("/100\n\n"))
    return checked.select("doc_id", F.concat(head, F.when(F.size("f") == 0, "No findings.").otherwise(F.array_join(lines, "\n"))).alias("report"))


def html(checked: DataFrame) -> DataFrame:
    """doc_id, report: the same as a page; titles are escaped."""
    rows = F.transform(R.ranked_of(F.col("f")), lambda x: F.concat(F.lit("<tr><td>"), x["severity"], F.lit("</td><td>"), _escaped(x["title"]), F.lit("</td></tr>")))
    head = F.concat(F.lit("<h1>Report on "), F.col("doc_id").cast("string"), F.lit("</h1><p>"), R.readiness_of(F.col("f")).cast("string"), F.lit("/100</p><table>"))
    return checked.select("doc_id", F.concat(head, F.array_join(rows, ""), F.lit("</table>")).alias("report"))


def as_json(checked: DataFrame, venue: str = "generic") -> DataFrame:
    """doc_id, report: document, venue, readiness_score, stats and the findings with all their fields."""
    blank = F.lit("")
    each = F.transform("f", lambda x: F.struct(x["category"].alias("category"), F.upper(x["severity"]).alias("severity"), x["title"].alias("title"), blank.alias("detail"), blank.alias("evidence"), x["action"].alias("action"), F.round(x["confidence"], 2).alias("confidence"), blank.alias("location"), blank.alias("source")))
    row = F.struct(F.col("doc_id").cast("string").alias("document"), F.lit(venue).alias("venue"), R.readiness_of(F.col("f")).alias("readiness_score"), F.struct(*R.counts_of(F.col("f"))).alias("stats"), each.alias("findings"))
    return checked.select("doc_id", F.to_json(row).alias("report"))


def batch_lines(batch: DataFrame) -> DataFrame:
    """doc_id, line: the console table's lines, to be sorted worst first (readiness, then doc_id)."""
    pad = lambda c, n: F.lpad(F.col(c).cast("string"), n, " ")
    line = F.concat(F.rpad(F.substring(F.col("doc_id").cast("string"), 1, 31), 32, " "), F.lit(" "), pad("readiness", 5), F.lit(" "), pad("critical", 4), F.lit(" "), pad("high", 4), F.lit(" "), pad("medium", 4), F.lit(" "), pad("low", 4), F.lit("  "), F.substring("top_findings", 1, 60))
    return batch.select("doc_id", "readiness", line.alias("line"))


def bibtex(references: DataFrame) -> DataFrame:
    """doc_id, ref_no, entry of reference rows (doc_id, ref_no, raw): first name, year and title as far as they are found."""
    author = F.trim(F.regexp_extract("raw", r"^([^,.(]+(?:,\s*[A-Z]\.?)*)", 1))
    year = F.regexp_extract("raw", r"((?:19|20)\d{2})", 1)
    name = F.lower(F.regexp_replace(F.element_at(F.split(author, r"\s+"), -1), "[^A-Za-z0-9]", ""))
    key = F.concat(F.when(name == "", F.concat(F.lit("ref"), F.col("ref_no").cast("string"))).otherwise(name), F.when(year == "", "nd").otherwise(year), F.lit("_"), F.col("ref_no").cast("string"))
    entry = F.concat(F.lit("@article{"), key, F.lit(",\n  author = {"), author, F.lit("},\n  title = {"), F.trim("raw"), F.lit("},\n  year = {"), year, F.lit("}\n}"))
    return references.select("doc_id", "ref_no", entry.alias("entry"))
