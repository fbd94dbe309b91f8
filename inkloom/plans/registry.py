"""Queries of the library and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from inkloom.plans import forensic_queries, manuscript_queries, reference_queries, report_queries, structure_queries, text_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**text_queries.QUERIES, **manuscript_queries.QUERIES, **reference_queries.QUERIES, **structure_queries.QUERIES, **forensic_queries.QUERIES, **report_queries.QUERIES}
ORACLES: dict[str, str] = {**text_queries.ORACLES, **manuscript_queries.ORACLES, **reference_queries.ORACLES, **structure_queries.ORACLES, **forensic_queries.ORACLES, **report_queries.ORACLES}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["batch_report"](spark, sf_dir)
