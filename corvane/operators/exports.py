"""Training formats of records, and a knowledge base that keeps what others wrote into it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX = "corvane://"


def _text(c: str) -> Column:
    return F.coalesce(c, F.lit(""))


def alpaca(records: DataFrame, cite: bool = True) -> DataFrame:
    """(id, instruction, input, output); the output ends with its source where there is a url."""
    source = F.concat(F.lit("\n\nSource: "), _text("source_title"), F.lit(" <"), F.col("source_url"), F.lit(">"))
    out = F.concat(_text("output"), F.when((_text("source_url") != "") & F.lit(cite), source).otherwise(F.lit("")))
    return records.select("id", _text("instruction").alias("instruction"), _text("input").alias("input"), out.alias("output"))


def sharegpt(records: DataFrame) -> DataFrame:
    """(id, conversations, source): two turns, of human and gpt."""
    turn = lambda who, c: F.struct(F.lit(who).alias("from"), _text(c).alias("value"))
    return records.select("id", F.array(turn("human", "instruction"), turn("gpt", "output")).alias("conversations"), F.col("source_url").alias("source"))


def chatml(records: DataFrame, system: str = "") -> DataFrame:
    """(id, messages, metadata): an optional system message, then user and assistant."""
    turn = lambda who, c: F.struct(F.lit(who).alias("role"), c.alias("content"))
    first = [turn("system", F.lit(system))] if system else []
    messages = F.array(*first, turn("user", _text("instruction")), turn("assistant", _text("output")))
    return records.select("id", messages.alias("messages"), F.struct(F.col("source_url").alias("source"), "score").alias("metadata"))


def rag_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.select("id", "title", "url", "text", "tokens")


def kb_merge(base: DataFrame, chunks: DataFrame) -> DataFrame:
    """Entries (url, title, text): those of ``base`` that are not ours stay, ours are replaced by
    ``chunks``."""
    ours = chunks.select(F.concat(F.lit(PREFIX), "id").alias("url"), "title", "text")
    return base.where(F.col("url").isNull() | ~F.col("url").startswith(PREFIX)).select("url", "title", "text").unionByName(ours)


def write_jsonl(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object a line, nulls left out; ``mode`` append adds to what is there."""
    rows.write.mode(mode).json(path)


def append_new(rows: DataFrame, path: str) -> int:
    """Appends the rows whose id ``path`` (JSON lines) lacks; returns how many. A repeat adds nothing."""
    from corvane.session import filesystem

    spark = rows.sparkSession
    fs, p = filesystem(spark, path)
    fresh = rows.dropDuplicates(["id"])
    if fs.exists(p):
        fresh = fresh.join(spark.read.schema("id string").json(path), "id", "left_anti")
    n = fresh.count()
    if n:
        fresh.write.mode("append").json(path)
    return n


def read_jsonl(spark, path: str, schema: str) -> DataFrame:
    """Rows of the schema's fields; blank and malformed lines are dropped, other fields ignored."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
