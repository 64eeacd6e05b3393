"""Mixing sources to target weights, by tokens.

Texts are tokenised and packed into blocks of a fixed number of tokens, each source for itself. A
source gets slots in proportion to its weight; how many of them fall to each output shard is drawn
from a multinomial distribution, conditioned on the source's total so that the shares hold. The
slots of a source run through its blocks in a pseudorandom permutation, a new one for every
repetition, and blocks are joined to slots by their index.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane import session

#: place of a public vocabulary as ranks; every executor must find it there
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the tokenizer of that vocabulary splits a text before merging bytes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: id between two texts; the vocabulary leaves it free
END = 50256
#: tokens of a block, blocks of an output shard
BLOCK, SHARD = 1024, 256

_encodings: dict[str, object] = {}


def encoding(path: str):
    """The tokenizer of a file of ranks, built once per Python process."""
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def source_name(source: Column) -> Column:
    """Case, surrounding spaces and underscores do not tell sources apart."""
    return F.regexp_replace(F.lower(F.regexp_replace(source, r"^\s+|\s+$", "")), r"[_\s]+", "-")


def pack(documents: DataFrame, vocabulary: str = VOCABULARY, block: int = BLOCK) -> DataFrame:
    """(source, part, seq, n_tokens, documents, tokens): the texts of each source one after the other,
    each ended by END, in blocks of ``block`` tokens. tokens are 16-bit numbers, little-endian. A
    task packs what it reads, so no text is shuffled; its last block of a source may be shorter."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        encode = encoding(vocabulary).encode_ordinary
        rest: dict[str, tuple[np.ndarray, int]] = {}
        seq: dict[str, int] = {}
        columns = ["source", "part", "seq", "n_tokens", "documents", "tokens"]
        for b in batches:
            out = []
            for source, texts in b.groupby("source")["text"]:
                old, docs = rest.get(source, (np.empty(0, dtype="<u2"), 0))
                parts, size = [old], len(old)
                for t in texts:
                    ids = np.asarray([*encode(t), END], dtype="<u2")
                    parts.append(ids)
                    size, docs = size + len(ids), docs + 1
                    if size >= block:
                        run_ = np.concatenate(parts)
                        for i in range(0, size - size % block, block):
                            seq[source] = seq.get(source, -1) + 1
                            out.append((source, part, seq[source], block, docs if i == 0 else 0, run_[i : i + block].tobytes()))
                        parts, size, docs = [run_[size - size % block :]], size % block, 0
                rest[source] = (np.concatenate(parts), docs)
            yield pd.DataFrame(out, columns=columns)
        tail = [(s, part, seq.get(s, -1) + 1, len(r), d, r.tobytes()) for s, (r, d) in rest.items() if len(r)]
        yield pd.DataFrame(tail, columns=columns)

    rows = documents.where("text is not null and text <> ''").select("source", "text")
    return rows.mapInPandas(run, "source string, part int, seq int, n_tokens int, documents int, tokens binary")


def plan(sources: list[dict], total: float | None = None) -> tuple[list[dict], float]:
    """Tokens per source: ``sources`` have weight, max_repeats, tokens and blocks. Without ``total``
    it is the largest at which every source that has texts gets its share within its repeats. With
    a larger total, capped sources give all they may and the others share the rest by weight."""
    live = [s for s in sources if s["tokens"] > 0 and s["weight"] > 0 and s["max_repeats"] > 0]
    weights = sum(s["weight"] for s in live)
    most = {s["source"]: s["tokens"] * s["max_repeats"] for s in live}
    if total is None:
        total = min((most[s["source"]] * weights / s["weight"] for s in live), default=0.0)
    want: dict[str, float] = {}
    open_, left = list(live), total
    while open_:
        share = sum(s["weight"] for s in open_)
        full = [s for s in open_ if left * s["weight"] / share > most[s["source"]] * (1 + 1e-12)]
        if not full:
            want |= {s["source"]: left * s["weight"] / share for s in open_}
            break
        for s in full:
            want[s["source"]] = float(most[s["source"]])
            left -= most[s["source"]]
        open_ = [s for s in open_ if s not in full]
    out = []
    for s in sources:
        tokens = want.get(s["source"], 0.0)
        slots = min(round(tokens * s["blocks"] / s["tokens"]), s["blocks"] * s["max_repeats"]) if tokens else 0
        out.append(s | {"want": tokens, "slots": slots, "capped": tokens > 0 and tokens >= most[s["source"]] * (1 - 1e-12)})
    return out, total


def _rng(*key: object) -> np.random.Generator:
    return np.random.default_rng(xxhash.xxh64_intdigest("/".join(map(str, key))))


def shard_counts(slots: list[int], shard: int, shards: int, size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots of each source in an output shard, and in all shards before it. A multinomial draw
    given the totals is a walk down a binary tree: at each node the slots of its sources are
    split between its halves by a multivariate hypergeometric draw that the node's place seeds, so
    any shard is drawn alone, in log2(shards) steps, and all shards fit together."""
    have, before = np.asarray(slots, dtype="int64"), np.zeros(len(slots), dtype="int64")
    lo, hi, rest = 0, shards, int(sum(slots))
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = min((mid - lo) * size, rest)
        rng, part, open_, take = _rng("shard", seed, lo, hi), np.zeros_like(have), rest, left
        for i, n in enumerate(have):  # one hypergeometric draw for each source, given the ones before
            others = open_ - int(n)
            part[i] = rng.hypergeometric(int(n), others, take) if 0 < take and n else 0
            open_, take = others, take - int(part[i])
        if shard < mid:
            have, hi, rest = part, mid, left
        else:
            before, have, lo, rest = before + part, have - part, mid, rest - left
    return have, before


def permuted(i: np.ndarray, n: int, *key: object) -> np.ndarray:
    """Images of ``i`` under a pseudorandom permutation of 0 … n - 1: four rounds of a Feistel
    network over the next even number of bits, walked on while the image is n or more."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [np.uint64(xxhash.xxh64_intdigest("/".join(map(str, (*key, r))))) for r in range(4)]
    x = i.astype(np.uint64)
    todo = np.ones(len(x), dtype=bool)
    with np.errstate(over="ignore"):
        while todo.any():
            left, right = x[todo] >> np.uint64(half), x[todo] & mask
            for k in keys:
                f = (right ^ k) * np.uint64(0x9E3779B97F4A7C15)
                f ^= f >> np.uint64(31)
                f *= np.uint64(0xBF58476D1CE4E5B9)
                left, right = right, left ^ ((f >> np.uint64(33)) & mask)
            x[todo] = (left << np.uint64(half)) | right
            todo[todo] = x[todo] >= n
    return x.astype("int64")


def mix(documents: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 0, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """The mix (shard, slot, source, block, use, n_tokens, tokens) and the report (source, target,
    planned, actual, tokens, available_tokens, documents, blocks, uses, max_repeats, capped).

    ``documents``: text, source; ``targets``: source, weight, max_repeats; other columns are
    ignored. target is the weight as given. A source without texts cannot give its share, which
    goes to the others by weight: planned and actual are shares of the mix. Documents of sources
    without a target are not used. Null sources have no target; null or empty texts have no tokens;
    null, zero or negative weights or repeats use nothing of a source. Repeated target rows count
    once. Repeated document rows are texts of their own. Empty tables give an empty mix.

    Scale: texts are tokenised where they are read, blocks are written once to the shared folder, at
    two bytes a token, and only slots and blocks are joined, on (source, block), keys that occur at
    most max_repeats times. The driver holds one row per target source.
    """
    spark = documents.sparkSession
    wanted = targets.select(source_name(F.col("source")).alias("source"), F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce("max_repeats", F.lit(0)).alias("max_repeats"))
    wanted = {r["source"]: r.asDict() for r in wanted.where("source is not null").distinct().orderBy("source", "weight").collect()}
    names = list(wanted)
    named = documents.select(source_name(F.col("source")).alias("source"), "text").where(F.col("source").isin(names))
    packed = session.stored(pack(named, vocabulary), "blocks")
    sizes = packed.groupBy("source", "part").agg(F.count(F.lit(1)).alias("blocks"), F.sum("n_tokens").alias("tokens"), F.sum("documents").alias("documents"))
    order = Window.partitionBy("source").orderBy("part")
    offsets = sizes.withColumn("first", F.sum("blocks").over(order) - F.col("blocks"))
    offsets = session.stored(offsets, "offsets")
    have = {r["source"]: r.asDict() for r in offsets.groupBy("source").agg(F.sum("blocks").alias("blocks"), F.sum("tokens").alias("tokens"), F.sum("documents").alias("documents")).collect()}
    empty = {"blocks": 0, "tokens": 0, "documents": 0}
    sources, _ = plan([wanted[n] | empty | have.get(n, {}) for n in names], total)
    slots = [s["slots"] for s in sources]
    shards = -(-sum(slots) // SHARD)
    indexed = packed.join(offsets.select("source", "part", "first"), ["source", "part"]).withColumn("block", F.col("first") + F.col("seq"))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for shard in b["id"]:
                count, before = shard_counts(slots, int(shard), shards, SHARD, seed)
                out, place = [], _rng("place", seed, shard).permutation(int(count.sum()))
                at = 0
                for k, s in enumerate(sources):
                    j = np.arange(before[k], before[k] + count[k])
                    for use in np.unique(j // max(1, s["blocks"])):
                        i = j[j // s["blocks"] == use] % s["blocks"]
                        out.append(pd.DataFrame({"shard": shard, "slot": place[at : at + len(i)], "source": s["source"], "block": permuted(i, s["blocks"], seed, s["source"], use), "use": int(use)}))
                        at += len(i)
                if out:
                    yield pd.concat(out).astype({"source": object})

    drawn = spark.range(shards, numPartitions=max(1, min(shards, 200))).mapInPandas(draw, "shard long, slot int, source string, block long, use int")
    drawn = session.stored(drawn, "slots")  # the planner must know its size
    mixed = drawn.join(indexed.select("source", "block", "n_tokens", "tokens"), ["source", "block"]).select("shard", "slot", "source", "block", "use", "n_tokens", "tokens")
    used = drawn.join(indexed.select("source", "block", "n_tokens"), ["source", "block"]).groupBy("source").agg(F.sum("n_tokens").alias("tokens"), (F.max("use") + 1).alias("uses"))
    rows = [(s["source"], float(s["weight"]), s["want"], s["tokens"], s["documents"], s["blocks"], s["max_repeats"], s["capped"]) for s in sources]
    facts = spark.createDataFrame(rows, "source string, target double, want double, available_tokens long, documents long, blocks long, max_repeats int, capped boolean")
    whole = Window.partitionBy()
    report = facts.join(used, "source", "left").select(
        "source",
        "target",
        F.coalesce(F.round(F.col("want") / F.sum("want").over(whole), 6), F.lit(0.0)).alias("planned"),
        F.coalesce(F.round(F.col("tokens") / F.sum("tokens").over(whole), 6), F.lit(0.0)).alias("actual"),
        F.coalesce("tokens", F.lit(0)).alias("tokens"),
        "available_tokens",
        "documents",
        "blocks",
        F.coalesce("uses", F.lit(0)).alias("uses"),
        "max_repeats",
        "capped",
    )
    return mixed, report
