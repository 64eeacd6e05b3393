"""Evaluation texts inside of training text, by suffix arrays of the training shards.

Each batch of documents is a shard: its texts, markup taken out, become one string with one
character for each word, and the sorted starts of its suffixes are the shard's suffix array. Every
suffix of every test item is looked up by binary search, which gives all places where its first
words stand verbatim, and from there the longest match. Words that no test item has cannot be
part of a match; stretches between them that are shorter than any possible match are left out
of the array.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.inline import strip_inline

#: consecutive words of an item that make a leak; shorter items must be whole
LEAST_WORDS = 12
#: characters of test items that are broadcast at once; more are done in further passes
BLOCK_CHARS = 32_000_000
_WORD = re.compile("[a-z0-9]+")
#: the character of a word that no item has
_NONE = "\0"


def suffix_array(text: str, starts: list[int], depth: int) -> list[int]:
    """``starts`` in the order of the suffixes of ``text``, as far as their first ``depth`` tell."""
    return sorted(starts, key=lambda i: text[i : i + depth])


def places(text: str, array: list[int], pattern: str) -> list[int]:
    """Where ``pattern`` stands in ``text``, by binary search in its suffix array."""
    n = len(pattern)
    lo = bisect_left(array, pattern, key=lambda i: text[i : i + n])
    return array[lo : bisect_right(array, pattern, lo=lo, key=lambda i: text[i : i + n])]


def common_prefix(a: str, i: int, b: str, j: int) -> int:
    """Length of the longest common prefix of a[i:] and b[j:]."""
    n, most = 0, min(len(a) - i, len(b) - j)
    while n < most and a[i + n] == b[j + n]:
        n += 1
    return n


class Items:
    """Test items with one character for each word."""

    def __init__(self, rows: list[tuple]):
        self.codes: dict[str, str] = {}
        self.texts = []
        for item, text in sorted(set(rows), key=str):
            words = _WORD.findall((text or "").lower())
            if words:
                self.texts.append((item, "".join(self.codes.setdefault(w, chr(len(self.codes) + 1)) for w in words)))
        self.depth = max((len(t) for _, t in self.texts), default=0)
        self.patterns: dict[str, list[tuple[int, int]]] = {}
        for k, (_, t) in enumerate(self.texts):
            n = min(LEAST_WORDS, len(t))
            for i in range(len(t) - n + 1):
                self.patterns.setdefault(t[i : i + n], []).append((k, i))
        least = min((len(p) for p in self.patterns), default=1)
        self.stretch = re.compile(f"[^{_NONE}]{{{least},}}")

    def search(self, docs: list, texts: list[str]) -> list[tuple]:
        """(doc, item, words of the longest match, its first word in the item, in the doc)."""
        owner, parts, at, size = [], [], [], 0
        get = self.codes.get
        for doc, text in zip(docs, texts):
            coded = "".join([get(w, _NONE) for w in _WORD.findall(strip_inline(text).lower())])
            for m in self.stretch.finditer(coded):
                owner.append((doc, m.start()))
                parts.append(m[0])
                at.append(size)
                size += len(m[0]) + 1
        shard = _NONE.join(parts)
        array = suffix_array(shard, [i for a, p in zip(at, parts) for i in range(a, a + len(p))], self.depth)
        best: dict[tuple, tuple] = {}
        for pattern, where in self.patterns.items():
            for i in places(shard, array, pattern):
                k = bisect_right(at, i) - 1
                doc, first = owner[k]
                for item, j in where:
                    key = (doc, self.texts[item][0])
                    n = len(pattern) + common_prefix(shard, i + len(pattern), self.texts[item][1], j + len(pattern))
                    best[key] = max(best.get(key, (0, 0, 0)), (n, -j, -(first + i - at[k])))
        return [(*key, n, -j, -i) for key, (n, j, i) in best.items()]


def leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, words, item_word, doc_word): each document with each item of which it has
    LEAST_WORDS consecutive words, or all if the item has fewer; words is the length of the
    longest match, the other two its first word in either text, counted from 0 with markup left out.

    ``documents``: doc_id, text; ``benchmark``: item_id, text; other columns are ignored. Rows with
    a null id and texts that are null or without words match nothing; repeated rows count once;
    empty tables give no rows. Texts are searched whole, however long.

    Scale: one pass over the corpus without a shuffle of texts. Of the items BLOCK_CHARS are
    broadcast at most; more of them are searched in blocks, one pass each.
    """
    doc_type = documents.schema["doc_id"].dataType.simpleString()
    item_type = benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {doc_type}, item_id {item_type}, words int, item_word int, doc_word int"
    items = benchmark.where("item_id is not null and text is not null").select("item_id", "text")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = size // BLOCK_CHARS + 1
    corpus = documents.where("doc_id is not null and text is not null").select("doc_id", "text")
    found = []
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()
        shared = documents.sparkSession.sparkContext.broadcast(Items([tuple(r) for r in rows]))

        def search(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame(shared.value.search(list(b["doc_id"]), list(b["text"])), columns=["doc_id", "item_id", "words", "item_word", "doc_word"])

        found.append(corpus.mapInPandas(search, schema))
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    # a document that came twice, with equal or other text, keeps its longest match
    best = out.groupBy("doc_id", "item_id").agg(F.max(F.struct("words", -F.col("item_word"), -F.col("doc_word"))).alias("m"))
    return best.select("doc_id", "item_id", F.col("m.words").alias("words"), (-F.col("m")["col2"]).alias("item_word"), (-F.col("m")["col3"]).alias("doc_word"))


def without_leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``documents`` without those that hold a passage of ``benchmark``; all columns stay."""
    bad = leaks(documents, benchmark).select("doc_id").distinct()
    return documents.join(bad, "doc_id", "left_anti")
