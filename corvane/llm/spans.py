"""Long exact spans shared between records, by suffix automata of reference shards.

Texts are winnowed first: of every SPAN characters at least one anchor, the hash of a run of
characters, is kept, and which one depends on these characters alone. So two texts with a common
span of SPAN characters have a common anchor in it, and nothing is lost by pairing texts through
their anchors. Paired texts are then measured: reference shards, small packs of texts, become
suffix automata, their partners are streamed through, and the matching statistics show each
maximal common span of SPAN or more characters, and in which references it stands.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane import session

#: least length of a span in characters (code points)
SPAN = 200
#: characters of an anchor; a window of SPAN characters holds SPAN - ANCHOR + 1 of them
ANCHOR = 100
#: references of a shard, partners streamed through it by one task, characters of an automaton
REFS, PARTNERS, PACK = 16, 500, 60_000

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)


def _powers(base: int, n: int) -> np.ndarray:
    x = np.full(n, base, dtype=np.uint64)
    x[:1] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(x)


class Powers:
    """Powers of the hash's base and of its inverse, as many as the longest text so far needed."""

    def __init__(self) -> None:
        self.up = self.down = np.empty(0, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = _powers(_BASE, 2 * n), _powers(_INVERSE, 2 * n)
        return self.up[:n], self.down[:n]


def _sliding(x: np.ndarray, w: int, best: np.ufunc) -> np.ndarray:
    """Minimum or maximum of each window of w values."""
    p = 1
    while 2 * p <= w:
        x = best(x[:-p], x[p:])
        p *= 2
    return best(x[: len(x) - (w - p)], x[w - p :]) if w > p else x


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _hashed(text: str, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Sums from which :func:`_runs` has the hash of any run of characters."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    up, down = powers.get(len(codes) + 1)
    total = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum((codes + np.uint64(1)) * up[:-1], out=total[1:])
    return total, down


def _runs(total: np.ndarray, down: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    return _mixed((total[start + length] - total[start]) * down[start])


def _anchors(total: np.ndarray, down: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(total) - 1
    if n < SPAN:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    h = _mixed((total[ANCHOR:] - total[:-ANCHOR]) * down[: n - ANCHOR + 1])
    w = SPAN - ANCHOR + 1
    least = np.zeros(len(h) + w - 1, dtype=np.uint64)
    least[w - 1 : len(h)] = _sliding(h, w, np.minimum)
    at = np.flatnonzero(_sliding(least, w, np.maximum) == h)
    return at, h[at].view(np.int64)


def anchors(text: str, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of a text: every run of ANCHOR characters whose hash is
    the least in some window of SPAN characters."""
    return _anchors(*_hashed(text, powers))


#: runs of characters left and right of an anchor whose hashes go with it
LEFT, RIGHT = (33, 67), (34, 67)


def surrounded(text: str, powers: Powers) -> np.ndarray:
    """(hash, surroundings) of the anchors. Surroundings are 32 bits of the anchor before, with its
    distance, 0 if there is none or the two do not touch, and a byte each for the runs LEFT and
    RIGHT of the anchor, 0 where the text has no such run."""
    total, down = _hashed(text, powers)
    at, h = _anchors(total, down)
    if not len(at):
        return np.empty((2, 0), dtype=np.int64)
    gap = np.diff(at, prepend=at[0] - ANCHOR - 1)
    before = _mixed(np.concatenate([[0], h[:-1]]).view(np.uint64) ^ (gap.astype(np.uint64) * np.uint64(_BASE))) & np.uint64(0xFFFFFFFF)
    around = np.where(gap > ANCHOR, np.uint64(0), np.maximum(before, np.uint64(1))) << np.uint64(32)
    n = len(total) - 1
    for k, (start, length) in enumerate([*((at - x, x) for x in LEFT), *((at + ANCHOR, x) for x in RIGHT)]):
        fits = (start >= 0) & (start + length <= n)
        byte = _runs(total, down, np.where(fits, start, 0), length) % np.uint64(255) + np.uint64(1)
        around |= np.where(fits, byte, np.uint64(0)) << np.uint64(8 * k)
    rows = np.stack([h, around.view(np.int64)])
    return np.unique(rows, axis=1) if len(np.unique(h)) < len(h) else rows


class Automaton:
    """Suffix automaton of several texts. ``owners`` of a state are the texts, as bits, in which
    the substrings of at least SPAN characters that end in it stand."""

    def __init__(self) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link, self.size, self.owners = [-1], [0], [0]

    def _state(self, edges: dict[str, int], size: int, link: int) -> int:
        self.next.append(edges)
        self.size.append(size)
        self.link.append(link)
        self.owners.append(0)
        return len(self.size) - 1

    def _split(self, p: int, c: str, q: int) -> int:
        copy = self._state(dict(self.next[q]), self.size[p] + 1, self.link[q])
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def add(self, text: str, owner: int) -> None:
        nxt, size, link = self.next, self.size, self.link
        last, bit = 0, 1 << owner
        for c in text:
            q = nxt[last].get(c)
            if q is not None:
                last = q if size[q] == size[last] + 1 else self._split(last, c, q)
            else:
                p, new = last, self._state({}, size[last] + 1, 0)
                while p >= 0 and c not in nxt[p]:
                    nxt[p][c] = new
                    p = link[p]
                if p >= 0:
                    q = nxt[p][c]
                    link[new] = q if size[q] == size[p] + 1 else self._split(p, c, q)
                last = new
            self.owners[last] |= bit

    def finish(self) -> None:
        order = sorted(range(1, len(self.size)), key=self.size.__getitem__)
        for v in reversed(order):
            self.owners[self.link[v]] |= self.owners[v]
        for v in order:  # a shorter suffix that is still long enough stands wherever this one does, and elsewhere
            if self.size[self.link[v]] >= SPAN:
                self.owners[v] = self.owners[self.link[v]]

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(owners, start, end): stretches of ``text`` of which every SPAN characters stand in all
        of these texts. Stretches for other owners overlap with them."""
        nxt, size, link, owners = self.next, self.size, self.link, self.owners
        v = n = 0
        out: list[tuple[int, int, int]] = []
        have = begin = 0
        for i, c in enumerate(text, 1):
            while v and c not in nxt[v]:
                v = link[v]
                n = size[v]
            q = nxt[v].get(c)
            if q is not None:
                v, n = q, n + 1
            bits = owners[v] if n >= SPAN else 0
            if bits != have:
                if have:
                    out.append((have, begin - SPAN, i - 1))
                have, begin = bits, i
        if have:
            out.append((have, begin - SPAN, len(text)))
        return out


def _joined(stretches: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(stretches):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _regions(text: str, at: np.ndarray, hashes: np.ndarray, shared: set[int]) -> list[tuple[int, str]]:
    """The parts of a text that a common span can lie in: around shared anchors, up to SPAN more
    characters on either side. Each is cut into pieces that overlap by SPAN - 1 characters."""
    out: list[list[int]] = []
    for p in (p for p, h in zip(at.tolist(), hashes.tolist()) if h in shared):
        a, b = max(0, p - SPAN), min(len(text), p + ANCHOR + SPAN)
        if out and out[-1][1] >= a:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    step = PACK - SPAN + 1
    return [(i, text[i : min(i + PACK, b)]) for a, b in out for i in range(a, max(a + 1, b - SPAN + 1), step)]


def measure(refs: list[tuple[int, str]], partners: list[tuple[int, str]]) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """(ref, partner, stretches of the partner) for the common spans of references and partners."""
    powers = Powers()
    found = {k: anchors(t, powers) for k, t in {**dict(refs), **dict(partners)}.items()}
    in_refs = {h for k, _ in refs for h in found[k][1].tolist()}
    in_partners = {h for k, _ in partners for h in found[k][1].tolist()}
    shared = in_refs & in_partners
    pieces = [(k, piece) for k, t in refs for _, piece in _regions(t, *found[k], shared)]
    streams = [(k, _regions(t, *found[k], shared)) for k, t in partners]
    while pieces:
        pack, size = [], 0
        while pieces and (not pack or size + len(pieces[-1][1]) <= PACK):
            pack.append(pieces.pop())
            size += len(pack[-1][1])
        auto = Automaton()
        owners = [k for k in dict.fromkeys(k for k, _ in pack)]
        for k, piece in pack:
            auto.add(piece, owners.index(k))
        auto.finish()
        for b, parts in streams:
            covered: dict[int, list[tuple[int, int]]] = {}
            for start, piece in parts:
                for bits, x, y in auto.spans(piece):
                    for n in (n for n in range(len(owners)) if bits >> n & 1):
                        covered.setdefault(n, []).append((start + x, start + y))
            for n, stretches in covered.items():
                if owners[n] != b:
                    yield owners[n], b, _joined(stretches)


def _texts(documents: DataFrame) -> DataFrame:
    rows = documents.where("doc_id is not null and text is not null").select("doc_id", "text")
    return rows.where(F.length("text") >= SPAN)


def copies(documents: DataFrame) -> DataFrame:
    """(rep, doc_id) of documents with equal texts of SPAN characters or more: the smallest doc_id
    stands for all, itself included. Kept as a table in the shared folder."""
    rows = _texts(documents).select("doc_id", F.sha2("text", 256).alias("h")).distinct()
    reps = rows.groupBy("h").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return session.stored(rows.join(reps, "h").select("rep", "doc_id"), "copies")


def candidates(texts: DataFrame) -> DataFrame:
    """(a, b), a < b, of texts (doc_id, text) with a common anchor that can lie in a common span.

    A pair is taken where the anchors before it differ or do not touch it, so once for each
    common run of anchors that touch, which lies in one common span. An anchor in a common span of
    SPAN characters has SPAN - ANCHOR = 100 of them around it: 67 to the right, 33 to the left and
    34 to the right, or 67 to the left.
    """

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers = Powers()
        for batch in batches:
            docs, rows = [], []
            for doc, text in zip(batch["doc_id"], batch["text"]):
                found = surrounded(text, powers)
                docs.append(np.full(found.shape[1], doc))
                rows.append(found)
            if docs:
                h, around = np.concatenate(rows, axis=1)
                yield pd.DataFrame({"doc": np.concatenate(docs), "h": h, "around": around})

    def byte(c: str, k: int) -> Column:
        return F.shiftright(c, 8 * k).bitwiseAND(255)

    def equal(k: int) -> Column:
        return (byte("around_a", k) == byte("around_b", k)) & (byte("around_a", k) != 0)

    kind = texts.schema["doc_id"].dataType.simpleString()
    rows = texts.mapInPandas(emit, f"doc {kind}, h long, around long")
    a, b = (rows.select(F.col("doc").alias(x), "h", F.col("around").alias(f"around_{x}")) for x in "ab")
    left, right = (F.shiftright(f"around_{x}", 32) for x in "ab")
    met = a.join(b, "h").where((F.col("a") < F.col("b")) & ((left != right) | (left == 0)) & (equal(3) | equal(0) & equal(2) | equal(1)))
    return met.select("a", "b").distinct()


def shared_spans(documents: DataFrame, both: bool = False) -> tuple[DataFrame, DataFrame]:
    """(a, b, spans) of unequal texts with common spans of SPAN characters or more, and
    :func:`copies`. a and b are doc_ids that stand for all copies of their texts, a < b; spans are
    the stretches (start, end) of b. With ``both`` each pair comes in either order.

    Nulls: rows with null doc_id or text are ignored, texts of fewer than SPAN characters share
    nothing. Repeated rows count once; other columns are ignored; empty tables give no rows. Very
    long texts are cut into overlapping pieces for the automata.

    Scale: one shuffle of about a row per fifty characters, 24 bytes each, by anchor; what is
    routed to the automata are the texts that have a partner. A reference with very many partners
    is given to several tasks. Pairs of unequal texts are as many as the result has.
    """
    classes = copies(documents)
    others = classes.where("rep <> doc_id").select("doc_id")
    texts = _texts(documents).join(others, "doc_id", "left_anti")
    met = session.stored(candidates(texts), "candidates")
    if both:
        met = met.union(met.select(F.col("b").alias("a"), F.col("a").alias("b")))
    need = session.stored(met.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "paired")
    held = session.stored(texts.join(need, "doc_id", "left_semi").dropDuplicates(["doc_id"]), "texts")
    shards = need.count() // REFS + 1
    met = met.withColumn("shard", F.pmod(F.xxhash64("a"), F.lit(shards)))
    sizes = met.groupBy("shard").agg((F.count_distinct("b") / PARTNERS).cast("int").alias("more"))
    met = met.join(sizes, "shard").withColumn("block", F.pmod(F.xxhash64("b", F.lit(7)), F.col("more") + 1))
    refs = met.select("shard", "block", F.col("a").alias("doc_id")).distinct().join(held, "doc_id")
    copy = held.select(F.col("doc_id").alias("p_id"), F.col("text").alias("p_text"))
    partners = met.select(F.col("shard").alias("p_shard"), F.col("block").alias("p_block"), F.col("b").alias("p_id")).distinct().join(copy, "p_id")

    def run(refs: pd.DataFrame, partners: pd.DataFrame) -> pd.DataFrame:
        pairs = list(zip(refs["doc_id"], refs["text"])), list(zip(partners["p_id"], partners["p_text"]))
        got = [(a, b, [{"start": x, "end": y} for x, y in spans]) for a, b, spans in measure(*pairs)]
        return pd.DataFrame(got, columns=["a", "b", "spans"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    found = refs.groupBy("shard", "block").cogroup(partners.groupBy("p_shard", "p_block")).applyInPandas(run, f"a {kind}, b {kind}, spans array<struct<start int, end int>>")
    return found if both else found.where("a < b"), classes


def pairs(found: DataFrame, classes: DataFrame) -> DataFrame:
    """(doc_id_a, doc_id_b), the smaller first, of all documents with a common span: pairs of
    :func:`shared_spans` with the copies of either side, and copies of one text."""
    reps = found.select("a", "b").distinct()
    side = [classes.select(F.col("rep").alias(x), F.col("doc_id").alias(f"doc_{x}")) for x in "ab"]
    open_ = reps.join(side[0], "a", "left").join(side[1], "b", "left").select(F.coalesce("doc_a", "a").alias("x"), F.coalesce("doc_b", "b").alias("y"))
    equal = classes.select("rep", F.col("doc_id").alias("x")).join(classes.select("rep", F.col("doc_id").alias("y")), "rep").where("x < y").select("x", "y")
    return open_.union(equal).select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b")).distinct()


def portions(documents: DataFrame) -> DataFrame:
    """(doc_id, chars, shared_chars, portion, others) of the documents that share spans: how many of
    their characters lie in spans that stand elsewhere, and how many other texts hold one of them.
    A document with a copy is shared as a whole; ``others`` counts its copies too."""
    found, classes = shared_spans(documents, both=True)
    edges = found.select(F.col("b").alias("doc_id"), "a", F.explode("spans").alias("s")).select("doc_id", "a", "s.start", "s.end")
    merged = edges.groupBy("doc_id").agg(F.count_distinct("a").alias("texts"), F.array_sort(F.collect_set(F.struct("start", "end"))).alias("s"))
    total = "aggregate(s, struct(0 as n, 0 as till), (x, y) -> struct(x.n + greatest(0, y.`end` - greatest(y.start, x.till)) as n, greatest(x.till, y.`end`) as till), x -> x.n)"
    merged = merged.select("doc_id", "texts", F.expr(total).alias("n"))
    same = classes.withColumn("copies", F.count(F.lit(1)).over(Window.partitionBy("rep")) - 1)
    lengths = _texts(documents).select("doc_id", F.length("text").alias("chars")).distinct()
    rows = lengths.join(same, "doc_id", "left").withColumn("key", F.coalesce("rep", "doc_id")).join(merged.withColumnRenamed("doc_id", "key"), "key", "left")
    rows = rows.where("n is not null or copies is not null").withColumn("shared_chars", F.when(F.col("copies") > 0, F.col("chars")).otherwise(F.col("n")))
    return rows.select("doc_id", "chars", "shared_chars", F.round(F.col("shared_chars") / F.col("chars"), 4).alias("portion"), (F.coalesce("texts", F.lit(0)) + F.coalesce("copies", F.lit(0))).alias("others"))
