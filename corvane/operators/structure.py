"""Documents to chunks, and chunks to records without a model."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import chunking
from corvane.functions import text as T

CHUNK = "id string, doc_id string, at int, heading string, text string"


def chunk(documents: DataFrame, most: int = chunking.MAX_CHARS, overlap: int = chunking.OVERLAP, least: int = chunking.MIN_CHARS) -> DataFrame:
    """(id, doc_id, at, heading, text) of the chunks of ``documents`` (id, text). Null texts have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, i, h, t) for d, text in zip(b["id"], b["clean"]) for i, (h, t) in enumerate(chunking.chunks(text, most, overlap, least))]
            yield pd.DataFrame(rows, columns=["doc_id", "at", "heading", "text"])

    rows = documents.where("id is not null").select("id", T.clean_text(F.col("text")).alias("clean")).where("clean <> ''")
    cut = rows.mapInPandas(run, "doc_id string, at int, heading string, text string")
    key = T.short_id(F.col("doc_id"), F.col("at").cast("string"), F.substring("text", 1, 64))
    return cut.select(key.alias("id"), "doc_id", "at", "heading", "text")


def extract_steps(chunks: DataFrame) -> DataFrame:
    """(chunk_id, instruction, output) of chunks (id, title, heading, text) with two or more numbered
    lines, renumbered."""
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"^\s*\d+[.)]\s+.+$"))
    steps = F.transform(lines, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), F.regexp_replace(x, r"^\s*\d+[.)]\s+", "")))
    topic = F.coalesce(F.nullif(F.element_at(F.split(F.coalesce("heading", F.lit("")), " › "), -1), F.lit("")), F.col("title"), F.lit("this task"))
    rows = chunks.withColumn("steps", steps).where(F.size("steps") >= 2)
    return rows.select(F.col("id").alias("chunk_id"), F.concat(F.lit("What are the steps for "), topic, F.lit("?")).alias("instruction"), F.array_join("steps", "\n").alias("output"))


def extract_errors(chunks: DataFrame) -> DataFrame:
    """(chunk_id, instruction, output) of chunks with an error line of more than 25 characters."""
    line = F.get(F.filter(F.split("text", "\n"), lambda x: x.rlike(T.ERROR_LINE) & (F.length(F.trim(x)) > 25)), 0)
    rows = chunks.withColumn("line", F.trim(line)).where("line is not null")
    return rows.select(F.col("id").alias("chunk_id"), F.concat(F.lit("How do I resolve: "), T.truncated(F.col("line"), 220)).alias("instruction"), F.col("text").alias("output"))
