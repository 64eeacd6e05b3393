"""Main content of web pages by wrapper induction.

A page is a tree: zones (head, byline, body, tail), in them blocks (runs of lines between blank
lines), in them lines. A line's label has its varying words and numbers replaced by slots; a word
varies if few pages hold it. Pages of one host are aligned pairwise by simple tree
matching. Lines that match are constant nodes; where they matched is counted per label. Labels
whose constant nodes lie outside of the body often enough are the host's template, what
remains between them is content. A host's votes are weighed with those of all hosts, which decide where it has few.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane import session

#: each page is aligned with so many that follow it in its host, where one language stands together
PARTNERS = 3
#: pages of one host that one call aligns; all are aligned, and the votes don't depend on it
BATCH = 600
#: about so many pages of a host are put in order by one task, at most
SLOT = 20_000
#: a word that fewer than this share of the pages hold is a slot
COMMON = 0.005
#: the votes of all hosts on a label count as so many votes of the host itself
PRIOR = 20
#: a label is template if so large a share of its matches is in head or byline, or in the tail
HEAD_SHARE, TAIL_SHARE = 0.25, 0.45
#: lines of more characters are prose: the last such line ends the body
PROSE = 110
ZONES = ("head", "byline", "body", "tail")
VOTES = "host string, label long, head long, byline long, body long, tail long"
#: a page's non-blank lines; block: 4 * (number of the block in its zone) + zone, -1 outside of the tree
LINES = "host string, lang string, titled boolean, line_no array<int>, label array<long>, block array<int>"

_WORD = re.compile(r"[^\W\d_]+|\d+")
_SLOTS = re.compile(r"X(?:[\s\-]*X|[\s\-]+0)*(?![^\W\d_])")
_LETTER = re.compile(r"[^\W\d_]")
_MENU = re.compile(r" ([/>|›–·»•~]) | {3,}|\t")


def host(url: Column) -> Column:
    """Host of an http or https url, lower case without port and user; null for other urls."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^\s*[hH][tT][tT][pP][sS]?://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def label(line: str, common: set[str]) -> str:
    """The line with slots for varying words and numbers. Items in a row, as in menus and
    breadcrumbs, are one node whose children vary, so the separator is all of its label."""
    line = line.strip()
    parts = _MENU.split(line)
    items, seps = parts[::2], set(parts[1::2])
    if len(items) >= 3 and len(seps) == 1 and line[0] != "|":
        sep = seps.pop()
        if sep and max(map(len, items)) <= 60:
            return f"MENU {sep}"
        if not sep and len(items) >= 4 and not any(i.strip().isdigit() for i in items):
            return "MENU"
    masked = _WORD.sub(lambda m: "0" if m[0][0].isdigit() else m[0] if m[0] in common else "X", line)
    return _SLOTS.sub("X", masked)


def lines(text: str) -> list[str]:
    return [x.rstrip("\r") for x in text.split("\n")]


def title_line(rows: list[str], title: str | None) -> int:
    """Index of the line that is the page's title, or -1."""
    want = (title or "").strip()
    return next((i for i, x in enumerate(rows) if x.strip() == want), -1) if want else -1


def tree(rows: list[str], at: int, labels: list[int]) -> list[list[list[tuple[int, int]]]]:
    """Blocks per zone, each a list of (label, line index); ``at`` is the title's line."""
    last = max((i for i, x in enumerate(rows) if len(x) > PROSE), default=at)
    zones: list[list[list[tuple[int, int]]]] = [[], [], [], []]
    zone, fresh = 0, True
    for i, x in enumerate(rows):
        if not x.strip():
            fresh, zone = True, 2 if zone == 1 else zone
            continue
        if i == at:
            zone, fresh = 1, True
            continue
        if zone >= 1 and i > max(last, at) and zone != 1:
            fresh, zone = fresh or zone != 3, 3
        elif zone == 1 and len(x) > PROSE:
            fresh, zone = True, 2
        if fresh or not zones[zone]:
            zones[zone].append([])
            fresh = False
        zones[zone][-1].append((labels[i], i))
    return zones


def match(a: list, b: list, same) -> tuple[int, list]:
    """Simple tree matching of two ordered child lists: the size of the greatest matching that
    keeps their order, and the matched leaves. ``same(x, y)`` gives both for two children."""
    n, m = len(a), len(b)
    if not n or not m:
        return 0, []
    cells = [[same(x, y) for y in b] for x in a]
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n):
        row, up, cell = best[i + 1], best[i], cells[i]
        for j in range(m):
            row[j + 1] = max(up[j] + cell[j][0], up[j + 1], row[j])
    i, j, found = n, m, []
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            found += cells[i][j][1]
    return best[n][m], found


def _leaf(x: tuple[int, int], y: tuple[int, int]) -> tuple[int, list]:
    return (1, [(x, y)]) if x[0] == y[0] else (0, [])


def _block(x: list, y: list) -> tuple[int, list]:
    if {k for k, _ in x}.isdisjoint(k for k, _ in y):
        return 0, []
    size, found = match(x, y, _leaf)
    return size + 1, found


def votes(pages: list[list], own: list[bool]) -> Counter:
    """(label, zone) -> lines of ``pages`` (trees in order) matched with one of the PARTNERS pages
    before or after; lines of pages that are not ``own`` don't count."""
    seen = Counter(k for p in pages for z in p for b in z for k in {k for k, _ in b})
    slim = [[[[x for x in b if seen[x[0]] > 1] for b in z] for z in p] for p in pages]
    slim = [[[b for b in z if b] for z in p] for p in slim]
    met: set[tuple[int, int, int, int]] = set()
    for i, p in enumerate(slim):
        for j in range(i + 1, min(i + 1 + PARTNERS, len(slim))):
            for z in range(4 if own[i] or own[j] else 0):
                for x, y in match(p[z], slim[j][z], _block)[1]:
                    met |= {(i, z, *x), (j, z, *y)}
    return Counter((k, z) for i, z, k, _ in met if own[i])


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - 2**63


def _common_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        n = Counter(w for t in b["text"] for w in set(_WORD.findall(t)) if not w[0].isdigit())
        n[""] = len(b)
        yield pd.DataFrame(list(n.items()), columns=["word", "n"])


def common_words(pages: DataFrame) -> frozenset[str]:
    """The words that are no slots, of all ``pages`` (doc_id, text); repeated rows count once."""
    counted = pages.select("doc_id", "text").distinct().select("text").mapInPandas(_common_words, "word string, n long")
    counted = session.cut_lineage(counted.groupBy("word").agg(F.sum("n").alias("n")))
    # the empty word has the number of pages
    least = max(2.0, COMMON * sum(r["n"] for r in counted.where("word = ''").collect()))
    # a word needs a share of all pages, so there are at most (words a page) / COMMON of them
    return frozenset(r["word"] for r in counted.where((F.col("n") >= least) & (F.col("word") != "")).select("word").collect())


def labelled(pages: DataFrame, common: frozenset[str]) -> DataFrame:
    """A row of doc_id and LINES for each of ``pages`` (doc_id, host, title, text, lang)."""
    shared = pages.sparkSession.sparkContext.broadcast(common)

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = []
            for doc, site, lang, title, text in zip(b["doc_id"], b["host"], b["lang"], b["title"], b["text"]):
                rows = lines(text)
                at = title_line(rows, title)
                labels = [_hash(label(x, shared.value)) if i != at and _LETTER.search(x) else 0 for i, x in enumerate(rows)]
                zones = tree(rows, at, labels) if at >= 0 else []
                block = {i: 4 * n + z for z, blocks in enumerate(zones) for n, x in enumerate(blocks) for _, i in x}
                held = [i for i, x in enumerate(rows) if x.strip()]
                got.append((doc, site, lang, at >= 0, [i + 1 for i in held], [labels[i] for i in held], [block.get(i, -1) for i in held]))
            yield pd.DataFrame(got, columns=["doc_id", "host", "lang", "titled", "line_no", "label", "block"])

    doc_type = pages.schema["doc_id"].dataType.simpleString()
    return pages.select("doc_id", "host", "lang", "title", "text").mapInPandas(emit, f"doc_id {doc_type}, {LINES}")


def _tree(labels: list[int], blocks: list[int]) -> list[list[list[tuple[int, int]]]]:
    """What ``tree`` gave, out of a row of LINES."""
    zones: list[list[list[tuple[int, int]]]] = [[], [], [], []]
    for i, (k, b) in enumerate(zip(labels, blocks)):
        if b >= 0:
            zone = zones[b % 4]
            if b // 4 == len(zone):
                zone.append([])
            zone[-1].append((k, i))
    return zones


def _ranked(pages: DataFrame) -> DataFrame:
    """``pages`` (host, lang, doc_id, label, block), each once, with their rank in their host: by lang,
    slot and doc_id. Hosts of up to SLOT pages have one slot, others more, by a hash of doc_id."""
    pages = pages.withColumn("lang", F.coalesce("lang", F.lit("\U0010ffff"))).distinct()
    sizes = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    pages = pages.join(sizes, "host").withColumn("slot", F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("pages") / SLOT))).drop("pages")
    earlier = Window.partitionBy("host").orderBy("lang", "slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = pages.groupBy("host", "lang", "slot").agg(F.count(F.lit(1)).alias("n"))
    slots = slots.select("host", "lang", "slot", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("host", "lang", "slot").orderBy("doc_id", "label", "block"))
    return pages.withColumn("nth", within).join(slots, ["host", "lang", "slot"]).withColumn("rank", F.col("before") + F.col("nth") - 1)


def induce(pages: DataFrame) -> DataFrame:
    """Votes per host and label of all rows of ``pages`` (doc_id, LINES) that have a title line.

    Every page is aligned with the PARTNERS before and after it in its host. The ranks are cut in
    batches; a batch also gets the PARTNERS pages on either side, whose votes other batches count."""
    ranked = _ranked(pages.where("titled").select("host", "lang", "doc_id", "label", "block"))
    of = lambda rank: F.floor(rank / BATCH)
    first, last = of(F.greatest(F.col("rank") - PARTNERS, F.lit(0))), of(F.col("rank") + PARTNERS)
    dealt = ranked.withColumn("batch", F.explode(F.sequence(first, last))).withColumn("own", F.col("batch") == of(F.col("rank")))

    def align(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rank")
        trees = [_tree(k.tolist(), b.tolist()) for k, b in zip(group["label"], group["block"])]
        n = votes(trees, group["own"].tolist())
        return pd.DataFrame([(key[0], k, *(n[k, z] for z in range(4))) for k in {k for k, _ in n} if k], columns=["host", "label", *ZONES])

    found = dealt.select("host", "batch", "rank", "own", "label", "block").groupBy("host", "batch").applyInPandas(align, VOTES)
    return found.groupBy("host", "label").agg(*[F.sum(z).alias(z) for z in ZONES])


def _shares(found: DataFrame) -> DataFrame:
    """(host, label, template): decided per host on its votes and the shares of all hosts; host is
    null in the rows that decide for hosts without votes on the label."""
    votes = sum(F.col(z) for z in ZONES)
    all_hosts = found.groupBy("label").agg(*[F.sum(z).alias(z) for z in ZONES])
    share = all_hosts.select("label", ((F.col("head") + F.col("byline")) / votes).alias("top"), (F.col("tail") / votes).alias("end"))
    own = found.join(share, "label").select(
        "host",
        "label",
        ((F.col("head") + F.col("byline") + PRIOR * F.col("top")) / (votes + PRIOR)).alias("top"),
        ((F.col("tail") + PRIOR * F.col("end")) / (votes + PRIOR)).alias("end"),
    )
    both = own.unionByName(share.withColumn("host", F.lit(None).cast("string")))
    return both.select("host", "label", ((F.col("top") >= HEAD_SHARE) | (F.col("end") >= TAIL_SHARE)).alias("template"))


def page_lines(documents: DataFrame) -> DataFrame:
    """(doc_id, line_no, template) of the non-blank lines of the web pages of ``documents``
    (doc_id, url, title, text, lang): whether the line belongs to the host's template.

    Rows without doc_id, with null or empty text or without an http url give nothing; a null or
    missing title only keeps the page from the fit. Repeated rows count once. Other columns are
    ignored. Lines are numbered from 1 between "\\n"; very long texts are processed whole.

    Scale: one pass over all pages counts words, one gives a hash for each line; the fit aligns all
    pages on these hashes, in batches of BATCH, so no host's size matters; the application joins
    them with the templates, on label or on host and label, its skew left to AQE.
    """
    pages = documents.select(F.col("doc_id"), host(F.col("url")).alias("host"), "title", "text", "lang")
    pages = pages.where("doc_id is not null and host is not null and text is not null and text <> ''")
    pages = session.stored(labelled(pages, common_words(pages)), "lines")
    decided = session.cut_lineage(_shares(session.cut_lineage(induce(pages))))
    by_host = decided.where("host is not null").withColumnRenamed("template", "of_host")
    pooled = decided.where("host is null").select("label", F.col("template").alias("of_all"))
    rows = pages.select("doc_id", "host", F.explode(F.arrays_zip("line_no", "label")).alias("x")).select("doc_id", "host", "x.line_no", "x.label")
    marked = rows.join(pooled, "label", "left").join(by_host, ["host", "label"], "left")
    return marked.select("doc_id", "line_no", F.coalesce("of_host", "of_all", F.lit(False)).alias("template")).distinct()


def boilerplate(documents: DataFrame) -> DataFrame:
    """(doc_id, line_no) of the lines that are not main body."""
    return page_lines(documents).where("template").select("doc_id", "line_no")


def main_text(documents: DataFrame) -> DataFrame:
    """(doc_id, text) of the web pages with their template lines taken out; blank lines at either
    end go too. Pages that are template throughout get an empty text."""
    out = boilerplate(documents).groupBy("doc_id").agg(F.collect_set("line_no").alias("out"))
    pages = documents.where(host(F.col("url")).isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    kept = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct(x.alias("x"), (i + 1).alias("i"))), lambda s: F.col("out").isNull() | ~F.array_contains("out", s["i"]))
    rows = pages.select("doc_id", "text").distinct().join(out, "doc_id", "left")
    return rows.select("doc_id", F.regexp_replace(F.array_join(F.transform(kept, lambda s: s["x"]), "\n"), r"^\s*\n|\s+$", "").alias("text"))
