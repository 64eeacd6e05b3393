"""Queries of problem 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import wrappers
from corvane.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.boilerplate(table(spark, sf_dir, "documents"))


def p1_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main body of each page."""
    return wrappers.main_text(table(spark, sf_dir, "documents"))


QUERIES = {"p1_found": p1_found, "p1_text": p1_text}
SQL: dict[str, str] = {}
