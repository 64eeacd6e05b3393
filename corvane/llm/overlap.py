"""Same or near-same records on both sides of a split.

Records are canonicalised (lower case, words only) and hashed; equal hashes join at once. A pair
at most a tenth apart is found by hashes as well: let k be the greatest number of word edits
that a text of n words can be away from any partner. Cut into k // 2 + 1 pieces, one piece at
least is hit by one edit at most, so the piece and its counterpart have equal hashes, either
whole or with one word left out. Each such candidate is then measured, so the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.words import canonical

#: two texts are near if their edits are at most one in so many words of the longer
PER_EDIT = 10


def most_edits(n: int) -> int:
    """The most edits that may lie between a text of n words and a partner of any length."""
    return n // (PER_EDIT - 1)


def pieces(n: int) -> list[tuple[int, int]]:
    """The pieces into which a text of n words is cut, as (start, end)."""
    m = most_edits(n) // 2 + 1
    return [(i * n // m, (i + 1) * n // m) for i in range(m)]


def _shorter(words: list[str]) -> set[int]:
    """Hashes of the words, whole and with any one left out."""
    texts = {" ".join(words)} | {" ".join(words[:i] + words[i + 1 :]) for i in range(len(words))}
    return {xxhash.xxh64_intdigest(t) - 2**63 for t in texts}


def piece_hashes(words: list[str]) -> set[int]:
    """Hashes of a text that stays where it is; none if it can have no unequal partner."""
    n = len(words)
    return set().union(*(_shorter(words[a:b]) for a, b in pieces(n))) if most_edits(n) else set()


def probe_hashes(words: list[str]) -> set[int]:
    """Hashes of every part of a text that may be the counterpart of a piece of a partner: pieces
    of texts up to k words longer or shorter, shifted by up to k, a word longer or shorter."""
    n, k = len(words), most_edits(len(words))
    spots = set()
    for other in range(n - k, n + k + 1) if k else ():
        e = max(n, other) // PER_EDIT
        if not e or abs(n - other) > e:
            continue
        for a, b in pieces(other):
            if b - a == other:
                spots.add((0, n))
                continue
            spots |= {(max(0, a + s), min(n, b + s + d)) for s in range(-e, e + 1) for d in (-1, 0, 1)}
    return set().union(*(_shorter(words[a:b]) for a, b in spots if a < b))


def apart(a: list[str], b: list[str], most: int) -> bool:
    """Whether more than ``most`` insertions, deletions and substitutions lie between a and b."""
    if abs(len(a) - len(b)) > most:
        return True
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        lo, hi = max(1, i - most), min(len(b), i + most)
        new = [most + 1] * (len(b) + 1)
        new[0] = i
        for j in range(lo, hi + 1):
            new[j] = min(row[j - 1] + (x != b[j - 1]), row[j] + 1, new[j - 1] + 1)
        if min(new[lo - 1 : hi + 1]) > most:
            return True
        row = new
    return row[-1] > most


def _emit(hashes, name: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [(h, key) for key, text in zip(b["key"], b["text"]) for h in hashes(text.split(" "))]
            yield pd.DataFrame(got, columns=["piece", name])

    return run


@F.pandas_udf(T.BooleanType())
def _near(a: pd.Series, b: pd.Series) -> pd.Series:
    pairs = ((x.split(" "), y.split(" ")) for x, y in zip(a, b))
    return pd.Series([not apart(x, y, max(len(x), len(y)) // PER_EDIT) for x, y in pairs], dtype=bool)


def _rows(records: DataFrame, *more: str) -> DataFrame:
    rows = records.select(F.col("id").cast("string").alias("id"), canonical(F.col("instruction")).alias("text"), *more)
    return rows.where("id is not null and text <> ''").select("id", F.md5("text").alias("key"), "text", *more).distinct()


def overlaps(train: DataFrame, held: DataFrame) -> DataFrame:
    """(train_id, held_id, split, source, same) of all pairs of a ``train`` and a ``held`` row whose
    instructions are equal (same) or at most a tenth of the words apart.

    split and source are the held row's. Nulls: rows without id or words in the instruction match
    nothing; split and source may be null. Exact repeats of a row count once. Other columns are
    ignored. Empty tables give no rows. Very long texts cost about 20 hashes for each of their
    words on the train side, and 20 * k * k on the held side, k being a tenth of their words.

    Scale: both sides are reduced to distinct canonical texts first, so copies, however many, are
    hashed and measured once and come back by one join at the end; that join and the one on the
    hashes are left to AQE's skew handling, they need no broadcast.
    """
    t, h = _rows(train), _rows(held, "split", "source")
    t_texts, h_texts = t.select("key", "text").distinct(), h.select("key", "text").distinct()
    index = t_texts.mapInPandas(_emit(piece_hashes, "t_key"), "piece long, t_key string")
    probes = h_texts.mapInPandas(_emit(probe_hashes, "h_key"), "piece long, h_key string")
    met = index.join(probes, "piece").where("t_key <> h_key").select("t_key", "h_key").distinct()
    met = met.join(t_texts.select(F.col("key").alias("t_key"), F.col("text").alias("t_text")), "t_key")
    met = met.join(h_texts.select(F.col("key").alias("h_key"), F.col("text").alias("h_text")), "h_key")
    near = met.where(_near("t_text", "h_text")).select("t_key", "h_key")
    t_rows = t.select(F.col("key").alias("t_key"), F.col("id").alias("train_id"))
    h_rows = h.select(F.col("key").alias("h_key"), F.col("id").alias("held_id"), "split", "source")
    equal = t_rows.join(h_rows, F.col("t_key") == F.col("h_key")).withColumn("same", F.lit(True))
    other = near.join(t_rows, "t_key").join(h_rows, "h_key").withColumn("same", F.lit(False))
    cols = ["train_id", "held_id", "split", "source", "same"]
    return equal.select(*cols).union(other.select(*cols)).distinct()


def pairs(found: DataFrame) -> DataFrame:
    """(id_a, id_b) of :func:`overlaps`, the smaller id first."""
    return found.select(F.least("train_id", "held_id").alias("id_a"), F.greatest("train_id", "held_id").alias("id_b")).distinct()


def counts(found: DataFrame, held: DataFrame) -> DataFrame:
    """Per split and source of ``held``: its rows, those met on the train side exactly and at all,
    and the matches. Redelivered rows count once; null splits and sources are groups of their own."""
    rows = held.select(F.col("id").cast("string").alias("held_id"), "split", "source").where("held_id is not null").distinct()
    met = found.select(F.col("held_id").alias("m_id"), F.col("split").alias("m_split"), F.col("source").alias("m_source"), "same")
    met = met.groupBy("m_id", "m_split", "m_source").agg(F.count(F.lit(1)).alias("n"), F.count_if("same").alias("n_same"))
    on = (F.col("held_id") == F.col("m_id")) & F.col("split").eqNullSafe(F.col("m_split")) & F.col("source").eqNullSafe(F.col("m_source"))
    per = rows.join(met, on, "left")
    return per.groupBy("split", "source").agg(
        F.count(F.lit(1)).alias("held_rows"),
        F.count_if(F.col("n") > 0).alias("leaked_rows"),
        F.count_if(F.col("n_same") > 0).alias("leaked_exactly"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("matches"),
        F.coalesce(F.sum("n_same"), F.lit(0)).alias("exact_matches"),
    )
