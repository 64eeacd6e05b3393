"""Queries of problem 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import defects
from corvane.session import table

COLUMNS = ["id", "instruction", "output", "generator"]


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return defects.defects(table(spark, sf_dir, "records").select(*COLUMNS).union(table(spark, sf_dir, "quarantine").select(*COLUMNS)))


def p5_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per defect."""
    return p5_found(spark, sf_dir).groupBy("defect").agg(F.count(F.lit(1)).alias("rows"))


QUERIES = {"p5_found": p5_found, "p5_counts": p5_counts}
SQL: dict[str, str] = {}
