"""Train and eval sides by document: all rows of a page, or else of a chunk, on one side."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def take(sizes: list[tuple[int, int]], target: float) -> dict[int, int]:
    """How many groups of each size (size, groups) go to train: the largest first, each while it still
    fits, the first one always. If none is left for eval, one of the smallest is."""
    have, out = 0, {}
    for size, groups in sorted(sizes, reverse=True):
        fit = max(int((target - have) // size), 0 if have else 1)
        out[size] = min(groups, fit)
        have += size * out[size]
    if sum(g for _, g in sizes) > 1 and all(out[s] == g for s, g in sizes):
        out[min(out)] -= 1
    return out


def by_document(records: DataFrame, share: float = 0.9, seed: int = 42) -> DataFrame:
    """(id, side) of ``records`` (id, source_url, chunk_id). Groups of one size are taken in an order
    that the seed gives. Rows without either key are groups of their own. The driver holds one row
    per distinct group size."""
    blank = lambda c: F.when(~F.col(c).rlike(r"^\s*$"), F.col(c))
    rows = records.where("id is not null").select("id", F.coalesce(blank("source_url"), blank("chunk_id"), F.concat(F.lit("id:"), "id")).alias("key")).dropDuplicates(["id"])
    groups = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
    sizes = [(r["size"], r["count"]) for r in groups.groupBy("size").count().collect()]
    plan = take(sizes, share * sum(s * n for s, n in sizes))
    limits = records.sparkSession.createDataFrame(list(plan.items()) or [(0, 0)], "size long, most long")
    order = Window.partitionBy("size").orderBy(F.xxhash64("key", F.lit(seed)), "key")
    sides = groups.withColumn("n", F.row_number().over(order)).join(F.broadcast(limits), "size")
    return rows.join(sides.select("key", F.when(F.col("n") <= F.col("most"), "train").otherwise("eval").alias("side")), "key").select("id", "side")
