"""Words as TESTDATA.md defines them, and hashes of runs of words."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = "[a-z0-9]+"


def canonical(col: Column) -> Column:
    """The words of a text joined by one space: case, punctuation and white space do not count."""
    return F.array_join(F.regexp_extract_all(F.lower(col), F.lit(WORD), F.lit(0)), " ")


def run_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """64-bit hashes of all runs of ``length`` in an array of 64-bit word hashes."""
    n = len(words) - length + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(length):
            h = (h ^ words[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return h
