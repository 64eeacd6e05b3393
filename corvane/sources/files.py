"""Files as documents: walk, kinds by extension, text of the plain formats, and a registry of readers."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as T

# Kinds by extension, and sizes: bytes that are read at most, characters that are kept at least.
KINDS = {"md": "markdown", "markdown": "markdown", "rst": "text", "txt": "text", "log": "text", "html": "html", "htm": "html", "csv": "csv", "tsv": "csv", "json": "json", "jsonl": "json", "yaml": "text", "yml": "text"}
MAX_BYTES, MIN_CHARS = 80 * 1024 * 1024, 40
SCHEMA = "path string, kind string, title string, text string, fingerprint string"

READERS: dict[str, Callable[[SparkSession, dict], DataFrame]] = {}


def reader(name: str):
    """Registers a source: a function of the session and its options that gives documents."""

    def add(f):
        READERS[name] = f
        return f

    return add


def kind_of(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    return table[F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))]


def csv_text(data: str, delimiter: str = ",") -> str:
    """Header and rows with " | " between the cells, and a rule under the header."""
    rows = [" | ".join(c.strip() for c in r) for r in csv.reader(io.StringIO(data), delimiter=delimiter) if any(c.strip() for c in r)]
    return "\n".join([*rows[:1], "-" * 40, *rows[1:]]) if rows else ""


def json_text(data: str) -> str:
    """Pretty-printed JSON, or the text as it is where it is none."""
    try:
        return json.dumps(json.loads(data), indent=2, ensure_ascii=False)
    except ValueError:
        return data


@reader("files")
def files(spark: SparkSession, options: dict) -> DataFrame:
    """Documents (SCHEMA) below options["path"], of options["glob"]. Files that are too large, of no
    known kind, or with hardly any text are left out; a file that cannot be decoded keeps what can be."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", options.get("glob", "*")).load(options["path"])
    found = found.where((F.col("length") <= MAX_BYTES) & ~F.col("path").rlike(r"/\.[^/]+/")).withColumn("kind", kind_of(F.col("path"))).where("kind is not null")
    mark = F.substring(F.sha2(F.concat_ws(":", "path", F.col("length").cast("string"), F.unix_micros("modificationTime").cast("string")), 256), 1, 16)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = []
            for path, kind, data in zip(b["path"], b["kind"], b["content"]):
                text = bytes(data).decode("utf-8", "replace").removeprefix("﻿")
                texts.append(csv_text(text, "\t" if path.endswith(".tsv") else ",") if kind == "csv" else json_text(text) if kind == "json" else text)
            yield b[["path", "kind", "fingerprint"]].assign(text=texts)[["path", "kind", "text", "fingerprint"]]

    read = found.withColumn("fingerprint", mark).select("path", "kind", "content", "fingerprint").mapInPandas(parse, "path string, kind string, text string, fingerprint string")
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1), "[_-]+", " ")
    read = read.withColumn("text", T.clean_text(F.col("text"))).where(F.length("text") >= MIN_CHARS)
    return read.select("path", "kind", stem.alias("title"), "text", "fingerprint")


def collect(spark: SparkSession, blocks: list[dict], only: str | None = None) -> DataFrame:
    """Documents of all enabled ``blocks`` (type, name, enabled, options of the reader), or of those of
    the type or name ``only``. A source that fails to open is left out, its error printed."""
    out = spark.createDataFrame([], SCHEMA + ", source string")
    for b in blocks:
        name = b.get("name", b.get("type"))
        if not b.get("enabled", True) or b.get("type") not in READERS or only not in (None, b["type"], name):
            continue
        try:
            out = out.unionByName(READERS[b["type"]](spark, b).withColumn("source", F.lit(name)))
        except Exception as e:  # one source must not stop the others
            print(f"source {name}: {e}")
    return out
