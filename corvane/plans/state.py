"""Queries of the document state, on observations before and after one day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import state as S
from corvane.session import table


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """State at the start of the middle run, and what was observed since."""
    log = table(spark, sf_dir, "doc_states")
    middle = table(spark, sf_dir, "runs").agg(F.percentile_approx("started_at", 0.5).alias("t"))
    log = log.crossJoin(F.broadcast(middle))  # one row
    return S.latest(log.where("last_seen <= t")), S.latest(log.where("last_seen > t"))


def changed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.changed(*_sides(spark, sf_dir)).select("id", "content_hash")


def upsert_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.upsert(*_sides(spark, sf_dir))
    return out.select("id", "url", "kind", "source", "title", "content_hash", "revisions", F.unix_micros("last_seen").alias("last_seen"), F.unix_micros("first_seen").alias("first_seen"))


def incremental_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed documents that a run may skip: unchanged, and with chunks."""
    old, new = _sides(spark, sf_dir)
    same = new.join(S.changed(old, new).select("id"), "id", "left_anti")
    return same.join(table(spark, sf_dir, "chunks").select(F.col("doc_id").alias("id")), "id", "left_semi").select("id")


def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that go because their chunk's document changed."""
    gone = S.changed(*_sides(spark, sf_dir)).select(F.col("id").alias("doc_id"))
    chunks = table(spark, sf_dir, "chunks").join(gone, "doc_id", "left_semi").select(F.col("id").alias("chunk_id"))
    return table(spark, sf_dir, "records").join(chunks, "chunk_id", "left_semi").select("id").distinct()


def orphan_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "records").select(F.col("chunk_id").alias("id"))
    return table(spark, sf_dir, "chunks").select("id").distinct().join(records, "id", "left_anti")


def existence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each document has chunks."""
    has = table(spark, sf_dir, "chunks").select(F.col("doc_id").alias("id")).distinct().withColumn("has_chunks", F.lit(True))
    return table(spark, sf_dir, "documents").select("id").join(has, "id", "left").select("id", F.coalesce("has_chunks", F.lit(False)).alias("has_chunks"))


def known_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "doc_states").where("url is not null").select("source", "url").distinct()


def recent_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "runs").orderBy(F.desc("started_at"), "run_id").limit(10)
    return runs.select("run_id", "mode", "ok")


def state_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = [table(spark, sf_dir, t).agg(F.lit(t).alias("name"), F.count_distinct("id").alias("rows")) for t in ("documents", "chunks", "records", "quarantine")]
    return counts[0].union(counts[1]).union(counts[2]).union(counts[3])


QUERIES = {f.__name__: f for f in (changed_documents, upsert_documents, incremental_skip, cascade_delete, orphan_chunks, existence, known_urls, recent_runs, state_counts)}

_SIDES = """
t as (select started_at as t from runs order by started_at limit 1 offset (select (count(*) + 1) // 2 - 1 from runs where started_at is not null)),
log as (select * from (select distinct on (obs_id) * from doc_states where id is not null and content_hash is not null), t),
old as (select * from (select *, row_number() over (partition by id order by coalesce(last_changed, last_seen) desc, obs_id desc) as n from log where last_seen <= t) where n = 1),
new as (select * from (select *, row_number() over (partition by id order by coalesce(last_changed, last_seen) desc, obs_id desc) as n from log where last_seen > t) where n = 1),
changed as (select new.* from new left join old using (id) where old.id is null or new.content_hash <> old.content_hash)
"""
_PICK = ", ".join(f"case when o.id is null then n.{c} else o.{c} end as {c}" for c in ("url", "kind", "source"))
SQL = {
    "changed_documents": f"with {_SIDES} select id, content_hash from changed",
    "upsert_documents": f"""with {_SIDES} select coalesce(o.id, n.id) as id, {_PICK},
        case when o.id is null or n.content_hash <> o.content_hash then n.title else o.title end as title, coalesce(n.content_hash, o.content_hash) as content_hash,
        case when o.id is null then 1 when n.content_hash <> o.content_hash then o.revisions + 1 else o.revisions end as revisions,
        epoch_us(greatest(o.last_seen, n.last_seen)) as last_seen, epoch_us(case when o.id is null then n.first_seen else o.first_seen end) as first_seen
        from old o full join new n on o.id = n.id""",
    "incremental_skip": f"with {_SIDES} select id from new where id not in (select id from changed) and id in (select doc_id from chunks where doc_id is not null)",
    "cascade_delete": f"with {_SIDES} select distinct id from records where chunk_id in (select id from chunks where doc_id in (select id from changed))",
    "orphan_chunks": "select distinct id from chunks where id not in (select chunk_id from records where chunk_id is not null)",
    "existence": "select id, id in (select doc_id from chunks where doc_id is not null) as has_chunks from documents",
    "known_urls": "select distinct source, url from doc_states where url is not null",
    "recent_runs": "select run_id, mode, ok from runs order by started_at desc, run_id limit 10",
    "state_counts": " union all ".join(f"select '{t}' as name, count(distinct id) as rows from {t}" for t in ("documents", "chunks", "records", "quarantine")),
}
