"""State of documents as merges: what changed, upsert, what goes with a changed document, leads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEPT = ["url", "kind", "source", "first_seen"]


def latest(observations: DataFrame, until: str | None = None) -> DataFrame:
    """The newest observation of each document, of those seen up to ``until``; null hashes are none."""
    rows = observations.where("id is not null and content_hash is not null")
    rows = rows.where(F.col("last_seen") <= F.lit(until).cast("timestamp")) if until else rows
    w = Window.partitionBy("id").orderBy(F.coalesce("last_changed", "last_seen").desc(), F.desc("obs_id"))
    return rows.dropDuplicates(["obs_id"]).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def changed(state: DataFrame, incoming: DataFrame) -> DataFrame:
    """Rows of ``incoming`` that ``state`` lacks or has with another hash."""
    had = state.select("id", F.col("content_hash").alias("_had"))
    return incoming.join(had, "id", "left").where(~F.col("content_hash").eqNullSafe(F.col("_had"))).drop("_had")


def upsert(state: DataFrame, incoming: DataFrame) -> DataFrame:
    """``state`` after ``incoming`` (both id, title, url, kind, source, content_hash, first_seen, last_seen,
    last_changed, revisions): new documents come in, changed ones take title and hash and count a
    revision, equal ones are only seen. Url, kind, source and first_seen stay as they were."""
    n = incoming.select("id", *[F.col(c).alias(f"n_{c}") for c in (*KEPT, "title", "content_hash", "last_seen")])
    both = state.join(n, "id", "full")
    new, other = F.col("content_hash").isNull(), F.col("n_content_hash").isNotNull() & (F.col("n_content_hash") != F.col("content_hash"))
    return both.select(
        "id",
        *[F.when(new, F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) for c in KEPT],
        *[F.when(new | other, F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) for c in ("title", "content_hash")],
        F.greatest("last_seen", "n_last_seen").alias("last_seen"),
        F.when(new | other, F.col("n_last_seen")).otherwise(F.col("last_changed")).alias("last_changed"),
        F.when(new, F.lit(1)).when(other, F.col("revisions") + 1).otherwise(F.col("revisions")).alias("revisions"),
    )
