"""Queries of problem 8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import leaks
from corvane.session import table


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "item_id")


def p8_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest match of each document and item, and where it stands."""
    return leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per item: the documents that hold it, and its longest leaked passage in words."""
    found = leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"), F.max("words").alias("longest"))


def p8_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the documents that remain."""
    return leaks.without_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id")


QUERIES = {"p8_found": p8_found, "p8_longest": p8_longest, "p8_items": p8_items, "p8_clean": p8_clean}
SQL: dict[str, str] = {}
