"""New batches against all that was accepted before.

Every batch becomes an immutable segment in the shared folder: its distinct texts with the hashes of
their three-word runs, and suffix arrays over these texts, that is, the starts of all suffixes
in the order of their first three words (as 64-bit hashes), in shards of bounded size. A new
batch looks its runs up by binary search, rarest first; two texts with a similarity of NEAR share
k at least of any (1 - NEAR) * n + k runs of the one with n, so that many are enough. How much of
a record each met text covers is then counted on the stored runs; raw texts of earlier batches are
not read again. Segments of like size are merged, so there are about log2(batches) of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane import session
from corvane.llm.words import canonical

#: least share of the three-word runs of two texts that both have
NEAR = 0.7
#: suffixes in a shard, on average, and buckets of the counts by which runs are ordered
SHARD, BUCKETS, SLICES = 4_000_000, 1 << 20, 64
TEXTS = "key string, n int, grams array<long>"
ARRAYS = "shard int, suffixes long, grams binary, at binary, texts binary, sizes binary, maps binary"
#: met pairs (64 bytes each) that are broadcast at most
BROADCAST = 500_000
#: bits by which texts are told apart before they are measured
MAP = 256
#: looked-up runs that a text must share to be measured; more runs are looked up accordingly
HITS = 1
#: texts whose suffixes are searched in one task of a shard at most
PROBES = 1_000_000


def shared(n: int) -> int:
    """So many of the looked-up runs of a text with n runs every near text has."""
    return min(HITS, math.ceil(NEAR * n - 1e-9))


def needed(n: int) -> int:
    """So many runs of a text with n runs must be looked up for that: a near text lacks n - NEAR * n
    of all at most."""
    return n - math.ceil(NEAR * n - 1e-9) + shared(n)


def words_of(chunks: DataFrame, *more: str) -> DataFrame:
    """(id, words) of ``chunks`` (id, text): the form in which a batch is checked."""
    rows = chunks.select(F.col("id").cast("string").alias("id"), canonical(F.col("text")).alias("words"), *more)
    return rows.where("id is not null and words <> ''")


def texts_of(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, n, grams) of the distinct texts of ``rows`` (id, words) and (key, id) of the rows."""
    rows = rows.withColumn("key", F.md5("words"))
    w = F.split("words", " ")
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - 2), lambda i: F.xxhash64(F.element_at("w", i), F.element_at("w", i + 1), F.element_at("w", i + 2))))
    texts = rows.select("key", "words").distinct().withColumn("w", w)
    texts = texts.withColumn("grams", F.when(F.size("w") >= 3, grams).otherwise(F.array().cast("array<long>")))
    return texts.select("key", F.size("grams").alias("n"), "grams"), rows.select("key", "id").distinct()


def bitmaps(grams: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """MAP bits for each of n texts, set by its runs. A bit that one of two texts lacks stands for a
    run that it lacks, so the bits in which they differ bound their similarity from above."""
    bits = np.zeros((n, MAP // 64), dtype=np.uint64)
    place = (grams.view(np.uint64) >> np.uint64(24)) % np.uint64(MAP)
    np.bitwise_or.at(bits, (owner, (place // np.uint64(64)).astype(int)), np.uint64(1) << (place % np.uint64(64)))
    return bits


def build(shards: int):
    """Suffix arrays of each batch of texts: one per shard of first runs. ``grams`` are the run
    hashes in order, ``at`` the text of each, ``texts`` 16 bytes of each text's key, ``sizes`` its runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grams, sizes = runs_of(b)
            if not len(grams):
                continue
            at = np.repeat(np.arange(len(sizes), dtype="int32"), sizes)
            keys = np.frombuffer(bytes.fromhex("".join(b.column("key").to_pylist())), dtype="V16")
            maps = bitmaps(grams, at, len(sizes))
            out = []
            for shard in range(shards):
                mine = np.flatnonzero(grams % shards == shard)
                mine = mine[np.argsort(grams[mine], kind="stable")]
                used, local = np.unique(at[mine], return_inverse=True)
                out.append((shard, len(mine), grams[mine].tobytes(), local.astype("int32").tobytes(), keys[used].tobytes(), sizes[used].tobytes(), maps[used].tobytes()))
            columns = [pa.array(c, t) for c, t in zip(zip(*out), [pa.int32(), pa.int64(), *[pa.binary()] * 5])]
            yield pa.RecordBatch.from_arrays(columns, ["shard", "suffixes", "grams", "at", "texts", "sizes", "maps"])

    return run


def runs_of(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All runs of a batch of texts, one after the other, and how many each text has."""
    lists = b.column("grams")
    return lists.flatten().to_numpy(zero_copy_only=False).astype("int64"), np.diff(lists.offsets.to_numpy()).astype("int32")


def count_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs by bucket, in SLICES rows."""
    counts = np.zeros(BUCKETS, dtype="int64")
    for b in batches:
        counts += np.bincount(runs_of(b)[0] % BUCKETS, minlength=BUCKETS)
    yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([x.tobytes() for x in np.split(counts, SLICES)], pa.binary())], ["slice", "counts"])


def add_slices(rows: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(x, dtype="int64") for x in rows["counts"])
    return pd.DataFrame({"slice": [rows["slice"].iloc[0]], "counts": [total.tobytes()]})


def search(shard: pd.DataFrame, probes: pd.DataFrame) -> pd.DataFrame:
    """(q, key, size, hits) of the texts of a shard that have probed runs and can be near by size."""
    names, size_of = probes["q"].to_numpy(), probes["size"].to_numpy()
    codes = np.repeat(np.arange(len(names)), probes["grams"].map(len))
    grams, sizes = np.concatenate([np.empty(0, dtype="int64"), *probes["grams"]]).astype("int64"), size_of[codes]
    mine = np.frombuffer(b"".join(probes["map"]), dtype=np.uint64).reshape(-1, MAP // 64)
    out = []
    for g, a, t, s, x in zip(shard["grams"], shard["at"], shard["texts"], shard["sizes"], shard["maps"]):
        maps = np.frombuffer(x, dtype=np.uint64).reshape(-1, MAP // 64)
        array, at = np.frombuffer(g, dtype="int64"), np.frombuffer(a, dtype="int32")
        lengths = np.frombuffer(s, dtype="int32")
        lo, hi = np.searchsorted(array, grams, side="left"), np.searchsorted(array, grams, side="right")
        hits = np.flatnonzero(hi > lo)
        spread = hi[hits] - lo[hits]
        which = np.repeat(hits, spread)
        text = at[np.arange(len(which)) - np.repeat(np.cumsum(spread) - spread, spread) + np.repeat(lo[hits], spread)]
        n, m = sizes[which], lengths[text]
        near = np.minimum(n, m) >= NEAR * np.maximum(n, m) - 1e-9
        which, text = which[near], text[near]
        apart = np.bitwise_count(mine[codes[which]] ^ maps[text]).sum(axis=1)
        near = apart <= (sizes[which] + lengths[text]) * (1 - NEAR) / (1 + NEAR) + 1e-9
        pairs, times = np.unique(codes[which[near]].astype("int64") * max(1, len(lengths)) + text[near], return_counts=True)
        q, k = np.divmod(pairs, max(1, len(lengths)))
        keys = [t[16 * i : 16 * i + 16].hex() for i in k.tolist()]
        out += zip(names[q].tolist(), keys, size_of[q].tolist(), times.tolist())
    return pd.DataFrame(out, columns=["q", "key", "size", "hits"])


class History:
    """Segments below ``root`` in a folder that all executors share. A segment is written under a
    name of its own and counts once it is listed here, so a failed write leaves nothing behind."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.segments: list[tuple[str, int, int]] = []  # path, texts, shards
        self.counts = np.zeros(BUCKETS, dtype="int64")  # runs by bucket, of all batches
        self.members: list[tuple[str, str]] = []  # batch, path
        self.passing: list[str] = []
        self.written = 0

    def _path(self) -> str:
        self.written += 1
        return f"{self.root}/{self.written:06d}"

    def _keep(self, df: DataFrame) -> DataFrame:
        """``df`` as a table that goes when the batch is done."""
        path = self._path()
        df.write.parquet(path)
        self.passing.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _delete(self, path: str) -> None:
        fs, p = session.filesystem(self.spark, path)
        fs.delete(p, True)

    def _texts(self) -> DataFrame:
        return self.spark.read.schema(TEXTS).parquet(*[f"{p}/texts" for p, _, _ in self.segments])

    def _segment(self, path: str, texts: DataFrame) -> None:
        """Writes ``texts`` and their suffix arrays to ``path``: each task sorts what it reads."""
        texts.write.parquet(f"{path}/texts")
        texts = self.spark.read.schema(TEXTS).parquet(f"{path}/texts")
        size = texts.agg(F.count(F.lit(1)).alias("texts"), F.coalesce(F.sum("n"), F.lit(0)).alias("runs")).first()
        shards = max(1, size["runs"] // SHARD)
        texts.mapInArrow(build(shards), ARRAYS).write.parquet(f"{path}/arrays")
        self.segments.append((path, size["texts"], shards))

    def _count(self, texts: DataFrame) -> None:
        """Adds the runs of ``texts`` to the counts, of which there are BUCKETS."""
        slices = texts.select("grams").mapInArrow(count_runs, "slice int, counts binary")
        for r in slices.groupBy("slice").applyInPandas(add_slices, "slice int, counts binary").collect():
            width = BUCKETS // SLICES
            self.counts[r["slice"] * width : (r["slice"] + 1) * width] += np.frombuffer(r["counts"], dtype="int64")

    def _probes(self, texts: DataFrame) -> DataFrame:
        counts = self.spark.sparkContext.broadcast(self.counts)

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                grams, sizes = runs_of(b)
                maps = bitmaps(grams, np.repeat(np.arange(len(sizes)), sizes), len(sizes))
                often = counts.value[grams % BUCKETS]
                rare, at = [], 0
                for n in sizes.tolist():
                    order = np.argsort(often[at : at + n], kind="stable")[: needed(n)]
                    rare.append(grams[at : at + n][order])
                    at += n
                out = [b.column("key"), pa.array(sizes, pa.int32()), pa.array([m.tobytes() for m in maps], pa.binary()), pa.array(rare, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(out, ["q", "size", "map", "grams"])

        return texts.where("n > 0").select("key", "grams").mapInArrow(choose, "q string, size int, map binary, grams array<long>")

    def near(self, texts: DataFrame) -> DataFrame:
        """(q, key) of texts and the accepted texts that are equal or near."""
        old = self._texts().select("key", "n", "grams")
        equal = texts.select("key").join(old.select("key"), "key").select(F.col("key").alias("q"), "key")
        probes = self._keep(self._probes(texts))
        met, number = None, probes.agg(F.coalesce(F.sum(F.size("grams")), F.lit(0))).first()[0]
        for path, _, shards in self.segments:
            arrays = self.spark.read.schema(ARRAYS).parquet(f"{path}/arrays")
            # a shard that a frequent run makes too large is split into parts, and one with very many
            # probes is searched in blocks of them
            sizes = arrays.groupBy("shard").agg((F.sum("suffixes") / (2 * SHARD)).cast("int").alias("more"))
            blocks = max(1, number // (PROBES * shards))
            parted = arrays.join(F.broadcast(sizes) if shards <= SLICES else sizes, "shard").withColumn("part", F.pmod(F.xxhash64("texts"), F.col("more") + 1))
            parted = parted.drop("more").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
            routed = probes.withColumn("p_shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
            routed = routed.withColumn("grams", F.filter("grams", lambda g: F.pmod(g, F.lit(shards)) == F.col("p_shard"))).where(F.size("grams") > 0)
            routed = routed.join(F.broadcast(sizes) if shards <= SLICES else sizes, F.col("p_shard") == F.col("shard")).withColumn("p_part", F.explode(F.sequence(F.lit(0), "more")))
            routed = routed.withColumn("p_block", F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int"))
            routed = routed.select("q", "grams", "size", "map", "p_shard", F.col("p_part").cast("long").alias("p_part"), "p_block")
            found = parted.groupBy("shard", "part", "block").cogroup(routed.groupBy("p_shard", "p_part", "p_block")).applyInPandas(search, "q string, key string, size int, hits long")
            met = found if met is None else met.union(found)
        met = met.where("q <> key").groupBy("q", "key", "size").agg(F.sum("hits").alias("hits"))
        met = met.where(F.col("hits") >= F.least(F.lit(HITS), F.ceil(F.lit(NEAR) * F.col("size") - 1e-9))).select("q", "key")
        met = self._keep(met)
        # what is met is joined where it lies if its size allows, else by key
        small = F.broadcast if met.count() <= BROADCAST else lambda x: x
        pairs = old.join(small(met), "key").join(small(met.select("q").distinct()).join(texts.select(F.col("key").alias("q"), F.col("grams").alias("mine"), F.col("n").alias("q_n")), "q"), "q")
        both = F.size(F.array_intersect("mine", "grams"))
        near = pairs.withColumn("both", both).where(F.col("both") >= F.lit(NEAR) * (F.col("q_n") + F.col("n") - F.col("both")) - 1e-9)
        return near.select("q", "key").union(equal).distinct()

    def _merge(self) -> None:
        """Merges the newest segment while the one before is no larger, so that their sizes fall and a
        text is merged about log2(texts) times at most; the old ones go once the new one
        is listed."""
        while len(self.segments) > 1 and self.segments[-2][1] <= self.segments[-1][1]:
            kept, old = self.segments[:-2], self.segments[-2:]
            both = self.spark.read.schema(TEXTS).parquet(*[f"{p}/texts" for p, _, _ in old]).distinct()
            self._segment(self._path(), both)
            self.segments = [*kept, self.segments[-1]]
            for p, _, _ in old:
                self._delete(p)

    def check(self, batch: str, rows: DataFrame) -> DataFrame:
        """(id, earlier, earlier_batch) of the repeats in a new batch, rows of :func:`words_of`, which
        is then accepted."""
        texts, members = texts_of(rows)
        path = self._path()
        members.write.parquet(f"{path}/members")
        members = self.spark.read.schema("key string, id string").parquet(f"{path}/members")
        earlier, self.segments = self.segments, []
        self._segment(f"{path}/segment", texts)
        mine, self.segments = self.segments, earlier
        texts = self.spark.read.schema(TEXTS).parquet(f"{path}/segment/texts")
        found = None
        if self.segments:
            near = session.stored(self.near(texts), "near")
            while self.passing:
                self._delete(self.passing.pop())
            old = None
            for name, place in self.members:
                rows = self.spark.read.schema("key string, id string").parquet(place).select("key", F.col("id").alias("earlier"), F.lit(name).alias("earlier_batch"))
                old = rows if old is None else old.union(rows)
            found = members.select(F.col("key").alias("q"), "id").join(near, "q").join(old, "key").where("id <> earlier").select("id", "earlier", "earlier_batch")
        self.members.append((batch, f"{path}/members"))
        self.segments += mine
        self._count(texts)
        self._merge()
        session.release(self.spark)
        return found if found is not None else self.spark.createDataFrame([], "id string, earlier string, earlier_batch string")


def repeats(chunks: DataFrame, root: str) -> DataFrame:
    """(id, batch_no, earlier, earlier_batch) of all repeats in ``chunks`` (id, text, batch_no), the
    batches being checked in order, each against those before it.

    Nulls: rows without id, batch_no or words in the text match nothing. Texts of one or two words
    repeat only by being equal. Redelivered rows count once; other columns are ignored; an empty
    table gives no rows. Similarity compares 64-bit hashes of runs.

    Scale: the table is split by batch once; after that, a batch costs its own size, the runs it
    looks up and the texts it meets. Copies of one text are searched once. Shards and their
    probes are bounded, so a frequent run or a large batch is spread over tasks.
    """
    spark = chunks.sparkSession
    rows = words_of(chunks.where("batch_no is not null"), "batch_no")
    arrived = f"{root}/arrived"
    rows.write.partitionBy("batch_no").parquet(arrived)
    numbers = sorted(r[0] for r in chunks.select("batch_no").where("batch_no is not null").distinct().collect())
    history, out = History(spark, f"{root}/history"), None
    for b in numbers:
        place = f"{arrived}/batch_no={b}"
        fs, p = session.filesystem(spark, place)
        schema = "id string, words string"
        batch = spark.read.schema(schema).parquet(place) if fs.exists(p) else spark.createDataFrame([], schema)
        found = history.check(str(b), batch).withColumn("batch_no", F.lit(b))
        out = found if out is None else out.union(found)
        if fs.exists(p):
            fs.delete(p, True)
    if out is None:
        return spark.createDataFrame([], "id string, batch_no int, earlier string, earlier_batch string")
    return out.select("id", "batch_no", "earlier", "earlier_batch").distinct()
