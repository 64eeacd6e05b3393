"""Queries of deduplication and leakage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.text import normalized
from corvane.operators import simhash as S
from corvane.session import table


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chunks").dropDuplicates(["id"])


def dedupe_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _chunks(spark, sf_dir).select("id", "batch_no", "text")
    return S.first_of_equal(rows, "text", "batch_no", "id").select("id")


def simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHashes of the chunks that were delivered with one."""
    rows = _chunks(spark, sf_dir).where("simhash is not null").select("id", "text")
    return S.with_simhash(rows, "text").select("id", "simhash")


def band_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct stored hashes per band and bits, for the buckets with more than one."""
    rows = table(spark, sf_dir, "chunks").where("simhash <> 0").select("simhash").distinct()
    each = rows.select(F.explode(S.bands(F.col("simhash"))).alias("b")).select("b.band", "b.bits")
    return each.groupBy("band", "bits").agg(F.count(F.lit(1)).alias("hashes")).where("hashes > 1")


def dedupe_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with a question of their own: equal questions keep the first by creation."""
    rows = table(spark, sf_dir, "records").dropDuplicates(["id"]).where(normalized(F.coalesce("instruction", F.lit(""))) != "")
    return S.first_of_equal(rows.select("id", "instruction", "created_at"), "instruction", "created_at", "id").select("id")


def leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out rows whose question the training side has: exactly, or with a hash close to one there."""
    train = table(spark, sf_dir, "exports").select("instruction").distinct()
    held = S.with_simhash(table(spark, sf_dir, "eval").select("id", "split", "instruction").distinct(), "instruction")
    text = normalized(F.coalesce("instruction", F.lit("")))
    equal = train.select(text.alias("n")).distinct()
    near = S.met(S.with_simhash(train, "instruction"), held, S.NEAR_QUESTIONS).withColumn("near", F.lit(True))
    rows = held.withColumn("n", text).join(equal.withColumn("same", F.lit(True)), "n", "left").join(near, "simhash", "left")
    return rows.where("same or near").select("id", "split", F.coalesce("same", F.lit(False)).alias("exact"))


def near_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incoming chunks whose hash comes near to one of the accepted history."""
    rows = S.with_simhash(_chunks(spark, sf_dir).select("id", "batch_no", "text"), "text")
    near = S.met(rows.where("batch_no = 0"), rows.where("batch_no > 0"), S.NEAR_TEXTS)
    return rows.where("batch_no > 0").join(near, "simhash", "left_semi").select("id", "batch_no")


QUERIES = {"dedupe_exact": dedupe_exact, "simhash": simhash, "band_pairs": band_pairs, "dedupe_questions": dedupe_questions, "leakage": leakage, "near_history": near_history}

_NORM = "array_to_string(regexp_extract_all(lower(coalesce({}, '')), '[a-z0-9]+'), ' ')"
SQL = {
    "dedupe_exact": f"select id from (select id, row_number() over (partition by {_NORM.format('text')} order by batch_no, id) as n from (select distinct id, batch_no, text from chunks)) where n = 1",
    "simhash": "select distinct id, simhash from chunks where simhash is not null",
    "band_pairs": """select band, bits, count(*) as hashes from (select band, ((simhash >> (8 * band)) & 255)::bigint as bits
        from (select distinct simhash from chunks where simhash <> 0), (select unnest(range(8))::int as band)) group by 1, 2 having count(*) > 1""",
    "dedupe_questions": f"""select id from (select id, row_number() over (partition by {_NORM.format('instruction')} order by created_at, id) as n
        from (select distinct id, instruction, created_at from records) where {_NORM.format('instruction')} <> '') where n = 1""",
}
