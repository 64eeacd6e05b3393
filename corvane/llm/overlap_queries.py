"""Queries of problem 3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import overlap
from corvane.session import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.pairs(overlap.overlaps(table(spark, sf_dir, "exports"), table(spark, sf_dir, "eval")))


def p3_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "eval")
    return overlap.counts(overlap.overlaps(table(spark, sf_dir, "exports"), held), held)


QUERIES = {"p3_found": p3_found, "p3_counts": p3_counts}
SQL: dict[str, str] = {}
