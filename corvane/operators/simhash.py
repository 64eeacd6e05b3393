"""SimHash of texts, near pairs by bands, and first-wins deduplication by equality."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import normalized

#: words of a shingle; bands of a hash; bits that near hashes may differ in
SHINGLE, BANDS, NEAR_TEXTS, NEAR_QUESTIONS = 3, 8, 6, 3
_SHIFTS = np.arange(64, dtype=np.uint64)


def simhash(text: str) -> int:
    """Signed 64-bit SimHash of normalised words: each bit is what most shingles' hashes (the first
    eight bytes of SHA-256) have there, 0 on a tie and for no words."""
    words = text.split(" ") if text else []
    if not words:
        return 0
    grams = [" ".join(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))]
    hashes = np.array([int.from_bytes(hashlib.sha256(g.encode()).digest()[:8], "big") for g in grams], dtype=np.uint64)
    votes = ((hashes[:, None] >> _SHIFTS) & np.uint64(1)).sum(axis=0)
    return int(((2 * votes > len(grams)).astype(np.uint64) << _SHIFTS).sum(dtype=np.uint64).view(np.int64))


def with_simhash(rows: DataFrame, text: str, name: str = "simhash") -> DataFrame:
    """``rows`` with the SimHash of a column; each distinct text is hashed once. Null counts as empty."""
    keyed = rows.withColumn("_t", normalized(F.coalesce(text, F.lit(""))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"_k": b["_t"], name: [simhash(t) for t in b["_t"]]})

    hashed = keyed.select("_t").distinct().mapInPandas(run, f"_k string, {name} long")
    return keyed.join(hashed, F.col("_t") == F.col("_k")).drop("_t", "_k")


def bands(h: Column) -> Column:
    """The bands of a hash: (number, bits) structs."""
    return F.array(*[F.struct(F.lit(i).alias("band"), F.shiftrightunsigned(h, 8 * i).bitwiseAND(255).alias("bits")) for i in range(BANDS)])


def first_of_equal(rows: DataFrame, text: str, *order: str) -> DataFrame:
    """``rows`` but for those whose normalised text an earlier row has."""
    w = Window.partitionBy(F.sha2(normalized(F.coalesce(text, F.lit(""))), 256)).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def met(old: DataFrame, new: DataFrame, most: int) -> DataFrame:
    """Distinct hashes of ``new`` (simhash) that a hash of ``old`` (simhash) comes near to: they share a
    band and differ in ``most`` bits at most. 0 is near to nothing. Both sides are reduced to distinct
    hashes first, so copies cost nothing."""
    a, b = (x.select("simhash").where("simhash <> 0").distinct() for x in (old, new))
    left = a.select(F.col("simhash").alias("o"), F.explode(bands(F.col("simhash"))).alias("b"))
    right = b.select("simhash", F.explode(bands(F.col("simhash"))).alias("b"))
    return left.join(right, "b").where(F.bit_count(F.col("o").bitwiseXOR(F.col("simhash"))) <= most).select("simhash").distinct()
