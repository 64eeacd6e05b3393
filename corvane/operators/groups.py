"""Groups of records that belong together, and splits that divide none of them.

:func:`label` finds the groups by label propagation: every record takes the smallest id it can
reach, in rounds of star contraction, so a chain of n records takes about log2(n) rounds.
:func:`assign` gives whole groups to the sides of a split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane import session

SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}
#: groups of more than one in so many ids are placed one by one
LARGE = 200


def page(url: Column) -> Column:
    """Key of the page that a url names: http or https, case of the host, default port, fragment,
    trailing slash and utm_ parameters do not count. Null where the url is null or blank."""
    u = F.regexp_replace(url, r"(?s)#.*$", "")
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1))
    rest = F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    host = F.when(scheme == "", F.lit("")).otherwise(F.regexp_extract(rest, r"^[^/?]*", 0))
    tail = F.when(scheme == "", rest).otherwise(F.regexp_replace(rest, r"^[^/?]*", ""))
    host = F.concat(F.regexp_extract(host, r"^.*@", 0), F.lower(F.regexp_extract(host, r"[^@]*$", 0)))
    host = F.when(scheme == "http", F.regexp_replace(host, r":80$", "")).when(scheme == "https", F.regexp_replace(host, r":443$", "")).otherwise(host)
    path = F.regexp_replace(F.regexp_extract(tail, r"(?s)^[^?]*", 0), r"/$", "")
    query = F.array_join(F.filter(F.split(F.regexp_replace(F.regexp_extract(tail, r"(?s)\?.*$", 0), r"^\?", ""), "&"), lambda p: (p != "") & ~p.startswith("utm_")), "&")
    kept = F.when(scheme.isin("http", "https", ""), F.lit("")).otherwise(F.concat(scheme, F.lit(":")))
    slashes = F.when(scheme == "", F.lit("")).otherwise(F.lit("//"))
    key = F.concat(kept, slashes, host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))
    return F.when(~url.rlike(r"^\s*$"), F.nullif(key, F.lit("")))


def label(links: DataFrame) -> DataFrame:
    """(id, group_id) of every id of ``links`` (id, key): ids with an equal key belong together,
    also through others; group_id is the smallest id of the group. Null keys link nothing.

    Scale: a key shared by n ids gives n edges, not n * n. Each round groups and joins the edges,
    at most one per id and key, and cuts the lineage in the shared folder.
    """
    links = session.cut_lineage(links.where(F.col("id").isNotNull()).distinct())
    least = links.where(F.col("key").isNotNull()).groupBy("key").agg(F.min("id").alias("b"))
    edges = session.cut_lineage(links.join(least, "key").where("id > b").select(F.col("id").alias("a"), "b").distinct())
    while True:
        low = edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        chained = edges.select(F.col("b").alias("a")).join(low.select("a"), "a", "left_semi")
        if low.where("n > 1").isEmpty() and chained.isEmpty():
            break
        # large star: the far end of an edge moves on to the smallest id its near end knows
        up = low.select(F.col("a").alias("b"), "m")
        edges = session.cut_lineage(edges.join(up, "b", "left").select("a", F.coalesce("m", "b").alias("b")).distinct())
        # small star: all that one id knows hangs from the smallest of them
        low = edges.groupBy("a").agg(F.min("b").alias("m"))
        near = edges.join(low, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = session.cut_lineage(near.union(low.select("a", F.col("m").alias("b"))).distinct())
    ids = links.select("id").distinct()
    return ids.join(edges.select(F.col("a").alias("id"), "b"), "id", "left").select("id", F.coalesce("b", "id").alias("group_id"))


def linked(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, page) and (id, group_id) of ``records``: linked are records of one page or one chunk."""
    blank = r"^\s*$"
    rows = records.select(F.col("id").cast("string").alias("id"), page(F.col("source_url")).alias("page"), F.when(~F.col("chunk_id").rlike(blank), F.col("chunk_id")).alias("chunk"))
    rows = session.cut_lineage(rows.where(F.col("id").isNotNull()).distinct())
    keys = F.array(F.concat(F.lit("page "), "page"), F.concat(F.lit("chunk "), "chunk"))
    return rows.select("id", "page").distinct(), label(rows.select("id", F.explode(keys).alias("key")))


def divided(records: DataFrame) -> DataFrame:
    """(id, group_id) of the groups of ``records`` that hold at least two different pages, which
    a split by page would tear apart."""
    pages, groups = linked(records)
    several = pages.join(groups, "id").where(F.col("page").isNotNull()).select("group_id", "page").distinct()
    several = several.groupBy("group_id").agg(F.count(F.lit(1)).alias("pages")).where("pages > 1")
    return groups.join(several.select("group_id"), "group_id", "left_semi").select("id", "group_id")


def _quota(sizes: list[tuple[int, int]], lack: dict[str, float]) -> list[tuple[int, str, int, int]]:
    """(size, side, lo, hi): of the groups of one size, those ranked lo <= r < hi go to side, for
    sides that lack so many rows. Large sizes first, each in proportion to what the sides still lack; the last few of a size go
    one by one to the side that lacks most."""
    plan = []
    for size, count in sorted(sizes, reverse=True):
        want = {side: max(v, 0.0) for side, v in lack.items()}
        total = sum(want.values()) or 1.0
        take = {side: int(count * v / total) for side, v in want.items()}
        left = dict(lack)
        for side in take:
            left[side] -= take[side] * size
        for _ in range(count - sum(take.values())):
            side = max(left, key=left.get)
            take[side] += 1
            left[side] -= size
        lack, at = left, 0
        for side, n in take.items():
            if n:
                plan.append((size, side, at, at + n))
            at += n
    return plan


def assign(groups: DataFrame, shares: dict[str, float] = SHARES, seed: int = 0, labels: DataFrame | None = None) -> DataFrame:
    """(id, split) of ``groups`` (id, group_id): whole groups only, sides in the given shares of
    the ids as closely as the group sizes allow. The same groups and seed give the same split.

    With ``labels`` (id, label) the sides also get the labels in like proportions. The groups of more
    than one in LARGE of all ids go first, each to the side that lacks most, and what they hold of
    every label counts there. The others are strata by their most frequent label, the smallest of
    equally frequent ones; each stratum fills what the sides still lack of its label. Null labels and
    ids without a label are a label of their own.

    The driver holds LARGE groups at most with their labels, and one row per label and distinct group
    size, at most sqrt(2 * ids) rows a label.
    """
    named = groups.select("id", "group_id", F.lit("").alias("label"))
    if labels is not None:
        named = groups.join(labels.select("id", F.coalesce("label", F.lit("")).alias("label")).dropDuplicates(["id"]), "id", "left").withColumn("label", F.coalesce("label", F.lit("")))
    counts = session.cut_lineage(named.groupBy("group_id", "label").agg(F.count(F.lit(1)).alias("n")))
    best = F.min_by("label", F.struct(-F.col("n"), F.col("label")))
    sized = session.cut_lineage(counts.groupBy("group_id").agg(F.sum("n").alias("size"), best.alias("label")))
    totals = {r["label"]: r["n"] for r in counts.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    whole, parts = sum(totals.values()), sum(shares.values())
    lack = {name: {side: n * share / parts for side, share in shares.items()} for name, n in totals.items()}
    large = sized.where(F.col("size") > whole / LARGE)
    held: dict[str, dict[str, int]] = {}
    for r in counts.join(large.select("group_id"), "group_id", "left_semi").collect():
        held.setdefault(r["group_id"], {})[r["label"]] = r["n"]
    placed = []
    for key, has in sorted(held.items(), key=lambda x: (-sum(x[1].values()), x[0])):
        side = max(shares, key=lambda k: sum(v[k] for v in lack.values()))
        placed.append((key, side))
        for name, n in has.items():
            lack[name][side] -= n
    small = sized.where(F.col("size") <= whole / LARGE)
    ranked = small.withColumn("rank", F.row_number().over(Window.partitionBy("label", "size").orderBy(F.xxhash64("group_id", F.lit(seed)), "group_id")) - 1)
    strata: dict[str, list[tuple[int, int]]] = {}
    for r in small.groupBy("label", "size").count().collect():
        strata.setdefault(r["label"], []).append((r["size"], r["count"]))
    plan = []
    for name, sizes in sorted(strata.items()):
        # a stratum holds rows of other labels too, so what its sides lack is brought to its size
        want = {side: max(v, 0.0) for side, v in lack[name].items()}
        scale = sum(n * c for n, c in sizes) / (sum(want.values()) or 1.0)
        plan += [(name, *row) for row in _quota(sizes, {side: v * scale for side, v in want.items()})]
    spark = groups.sparkSession
    ranges = spark.createDataFrame(plan, "label string, size long, split string, lo long, hi long")
    sides = ranked.join(F.broadcast(ranges), ["label", "size"]).where("rank >= lo and rank < hi").select("group_id", "split")
    sides = sides.union(spark.createDataFrame(placed, "group_id string, split string"))
    return groups.join(sides, "group_id").select("id", "split")


def report(split: DataFrame, labels: DataFrame, shares: dict[str, float] = SHARES) -> DataFrame:
    """(split, target, share, records, deviation) of ``split`` (id, split): deviation is the largest
    difference between a label's share in the side and in all records."""
    named = split.join(labels.select("id", F.coalesce("label", F.lit("")).alias("label")).dropDuplicates(["id"]), "id", "left")
    counts = named.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))
    side, all_ = Window.partitionBy("split"), Window.partitionBy()
    by_label = Window.partitionBy("label")
    rows = counts.select("split", "n", F.sum("n").over(side).alias("records"), F.sum("n").over(all_).alias("total"), F.sum("n").over(by_label).alias("of_label"))
    rows = rows.withColumn("off", F.abs(F.col("n") / F.col("records") - F.col("of_label") / F.col("total")))
    target = F.create_map(*[F.lit(x) for pair in shares.items() for x in pair])[F.col("split")]
    out = rows.groupBy("split").agg(F.max("records").alias("records"), F.max("total").alias("total"), F.round(F.max("off"), 4).alias("deviation"))
    return out.select("split", target.alias("target"), F.round(F.col("records") / F.col("total"), 4).alias("share"), "records", "deviation")
