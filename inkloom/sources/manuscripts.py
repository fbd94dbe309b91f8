"""Files and tables as manuscripts, and findings as files."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORDPROCESSING = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SCHEMA = "name string, file_type string, paragraphs array<string>, error string"


def paragraphs_of(name: str, data: bytes) -> tuple[str, list[str], str | None]:
    """(type, paragraphs, error) of a file's bytes; a broken file gives an error, never an exception."""
    kind = name.rpartition(".")[2].lower()
    try:
        if kind == "docx":
            root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
            found = ("".join(t.text or "" for t in p.iter(f"{WORDPROCESSING}t")) for p in root.iter(f"{WORDPROCESSING}p"))
        elif kind in ("txt", "md", "markdown", "tex"):
            import re

            found = re.split(r"\n\s*\n", data.decode("utf-8", "replace"))
        else:
            return kind, [], f"unsupported: {kind}"
        return kind, [p.strip() for p in found if p.strip()], None
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
        return kind, [], str(e) or type(e).__name__


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """name, file_type, paragraphs, text, error of every file under a folder, one row each."""
    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p.rpartition("/")[2], *paragraphs_of(p, bytes(c))) for p, c in zip(b["path"], b["content"])]
            yield pd.DataFrame(rows, columns=["name", "file_type", "paragraphs", "error"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInPandas(load, SCHEMA).withColumn("text", F.array_join("paragraphs", "\n"))


def from_conversations(turns: DataFrame) -> DataFrame:
    """doc_id, text: a conversation's turns in order, as lines."""
    listed = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return turns.groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_join(F.transform(listed, lambda x: F.coalesce(x["text"], F.lit(""))), "\n").alias("text"))


def write_report(report: DataFrame, path: str, kind: str = "csv") -> None:
    """A report or findings as csv (with header), json or parquet."""
    report.write.option("header", True).mode("overwrite").format(kind).save(path)
