"""Queries of problem 10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import spans
from corvane.session import table


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.pairs(*spans.shared_spans(table(spark, sf_dir, "documents")))


def p10_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's shared portion."""
    return spans.portions(table(spark, sf_dir, "documents"))


QUERIES = {"p10_found": p10_found, "p10_shared": p10_shared}
SQL: dict[str, str] = {}
