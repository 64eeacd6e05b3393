"""Queries of problem 6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import history
from corvane.session import new_shared_path, table


def _repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.repeats(table(spark, sf_dir, "chunks"), new_shared_path(spark, "history"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _repeats(spark, sf_dir).select(F.least("id", "earlier").alias("id_a"), F.greatest("id", "earlier").alias("id_b")).distinct()


def p6_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per batch: chunks that repeat an earlier one, and the earlier chunks they repeat."""
    return _repeats(spark, sf_dir).groupBy("batch_no").agg(F.count_distinct("id").alias("repeats"), F.count_distinct("earlier").alias("repeated"))


QUERIES = {"p6_found": p6_found, "p6_batches": p6_batches}
SQL: dict[str, str] = {}
