"""Queries of problem 4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import markup
from corvane.session import table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.found(table(spark, sf_dir, "documents"))


def p4_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clean texts."""
    return markup.clean(table(spark, sf_dir, "documents")).select("doc_id", "text").distinct()


def p4_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vote on container paths per host."""
    return markup.vote(table(spark, sf_dir, "documents"))


QUERIES = {"p4_found": p4_found, "p4_text": p4_text, "p4_paths": p4_paths}
SQL: dict[str, str] = {}
