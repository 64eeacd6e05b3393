"""Queries of the export formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import exports as X
from corvane.session import table


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "records").dropDuplicates(["id"]).where("not coalesce(quarantined, false)")


def export_alpaca(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.alpaca(_records(spark, sf_dir))


def export_sharegpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per turn."""
    rows = X.sharegpt(_records(spark, sf_dir))
    return rows.select("id", "source", F.posexplode("conversations").alias("turn", "c")).select("id", "source", "turn", F.col("c.from").alias("speaker"), F.col("c.value").alias("said"))


def export_chatml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per message, behind a system message."""
    rows = X.chatml(_records(spark, sf_dir), "You answer questions about the platform.")
    return rows.select("id", F.posexplode("messages").alias("turn", "m"), "metadata").select("id", "turn", "m.role", "m.content", "metadata.source", "metadata.score")


def rag_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.rag_chunks(table(spark, sf_dir, "chunks").dropDuplicates(["id"]))
    return rows.withColumn("tokens", F.array_join("tokens", " "))


def kb_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "documents").select("url", "title", "text")
    return X.kb_merge(base, table(spark, sf_dir, "chunks").dropDuplicates(["id"]))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _records(spark, sf_dir)
    return rows.agg(
        F.count(F.lit(1)).alias("records"),
        F.count_distinct("kind").alias("kinds"),
        F.count_distinct("source_url").alias("pages"),
        F.round(F.avg(F.coalesce("score", F.lit(0.0))), 3).alias("mean_score"),
        F.round(F.percentile(F.length("output"), 0.95), 1).alias("p95_chars"),
    )


def browse_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty newest questions and answers that mention a certificate."""
    word = F.contains(F.lower("instruction"), F.lit("certificate")) | F.contains(F.lower("output"), F.lit("certificate"))
    return _records(spark, sf_dir).where(word & (F.col("kind") == "qa")).orderBy(F.desc("created_at"), "id").limit(20).select("id", "instruction")


def human_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs written by people pass the gate with score 1 under an id made of the pair."""
    rows = table(spark, sf_dir, "exports").select("instruction", "output").where("instruction <> '' and output <> ''").distinct()
    key = F.substring(F.sha2(F.concat_ws("\x1f", F.lit("human"), "instruction", "output"), 256), 1, 16)
    return rows.select(key.alias("id"), F.concat(F.lit("human://"), key).alias("source_url"), F.lit(1.0).alias("score"))


QUERIES = {f.__name__: f for f in (export_alpaca, export_sharegpt, export_chatml, rag_chunks, kb_merge, manifest, browse_records, human_records)}

_R = "(select distinct on (id) * from records where not coalesce(quarantined, false))"
_C = "(select distinct on (id) * from chunks)"
SQL = {
    "export_alpaca": f"""select id, coalesce(instruction, '') as instruction, coalesce(input, '') as input, coalesce(output, '') || case when coalesce(source_url, '') <> ''
        then chr(10) || chr(10) || 'Source: ' || coalesce(source_title, '') || ' <' || source_url || '>' else '' end as output from {_R}""",
    "export_sharegpt": f"""select id, source_url as source, 0 as turn, 'human' as speaker, coalesce(instruction, '') as said from {_R}
        union all select id, source_url, 1, 'gpt', coalesce(output, '') from {_R}""",
    "export_chatml": f"""select id, 0 as turn, 'system' as role, 'You answer questions about the platform.' as content, source_url as source, score from {_R}
        union all select id, 1, 'user', coalesce(instruction, ''), source_url, score from {_R} union all select id, 2, 'assistant', coalesce(output, ''), source_url, score from {_R}""",
    "rag_chunks": f"select id, title, url, text, array_to_string(tokens, ' ') as tokens from {_C}",
    "kb_merge": f"select url, title, text from documents where url is null or not starts_with(url, 'corvane://') union all select 'corvane://' || id, title, text from {_C}",
    "manifest": f"""select count(*) as records, count(distinct kind) as kinds, count(distinct source_url) as pages, round(avg(coalesce(score, 0)), 3) as mean_score,
        round(quantile_cont(length(output), 0.95), 1) as p95_chars from {_R}""",
    "browse_records": f"""select id, instruction from {_R} where kind = 'qa' and (contains(lower(instruction), 'certificate') or contains(lower(output), 'certificate'))
        order by created_at desc, id limit 20""",
    "human_records": """select k as id, 'human://' || k as source_url, 1.0::double as score
        from (select left(sha256('human' || chr(31) || instruction || chr(31) || output), 16) as k from (select distinct instruction, output from exports where instruction <> '' and output <> ''))""",
}
