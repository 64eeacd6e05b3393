"""Queries of repair, vectors, leads, samples and the split by document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import splitting
from corvane.session import table

NEAR, BLOCK = 0.3, 20_000


def pdf_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted PDF texts without soft hyphens, page numbers and broken lines."""
    c = F.regexp_replace("text", "­", "")
    c = F.regexp_replace(c, r"(\w)-\n(\w)", "$1$2")
    c = F.regexp_replace(c, r"(?m)^[ \t]*(?:[Pp]age )?\d{1,4}[ \t]*$\n?", "")
    c = F.regexp_replace(c, r"([^.:?!;\n])\n([a-z])", "$1 $2")
    return table(spark, sf_dir, "documents").where("kind = 'pdf'").select("doc_id", c.alias("text"))


def storage_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of HTML documents without scripts, comments and tags."""
    c = F.regexp_replace("text", r"(?is)<(?:script|style)\b.*?</(?:script|style)\s*>|<!--.*?-->", " ")
    c = F.regexp_replace(F.regexp_replace(c, r"(?i)<(?:br|/p|/li|/h[1-6]|/tr|/div)\b[^<>]*>", "\n"), r"</?[a-zA-Z][^<>]*>", "")
    return table(spark, sf_dir, "documents").where("kind = 'html'").select("doc_id", c.alias("text"))


def mask_secret(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids as a settings page would show them."""
    c = F.col("id")
    dots = F.lit("•" * 12)
    return table(spark, sf_dir, "documents").select("doc_id", F.when(F.length(c) <= 8, F.repeat(F.lit("•"), F.length(c))).otherwise(F.concat(F.substring(c, 1, 4), dots, F.substring(c, -4, 4))).alias("masked"))


def hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of each stored hash to the smallest one."""
    rows = table(spark, sf_dir, "chunks").where("simhash is not null").select("id", "simhash").distinct()
    least = rows.agg(F.min("simhash").alias("least"))  # one row
    return rows.crossJoin(F.broadcast(least)).select("id", F.bit_count(F.col("simhash").bitwiseXOR(F.col("least"))).alias("distance"))


def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors near to one whose id is divisible by 100; the queries are taken in blocks of a bounded size."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    rows = rows.withColumn("norm", F.sqrt(dot(F.col("v"), F.col("v"))))
    queries = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), F.col("v").alias("qv"), F.col("norm").alias("qn"))
    blocks, out = queries.count() // BLOCK + 1, None
    for b in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b)
        near = rows.join(F.broadcast(part), F.col("q") != F.col("vec_id")).withColumn("cosine", F.when(F.col("norm") * F.col("qn") > 0, dot(F.col("v"), F.col("qv")) / (F.col("norm") * F.col("qn"))).otherwise(0.0))
        near = near.where(F.col("cosine") >= NEAR).select("q", "vec_id")
        out = near if out is None else out.union(near)
    return out


def pending_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that records cite and nobody has fetched, the most cited first; ten of them."""
    known = table(spark, sf_dir, "documents").select("url")
    leads = table(spark, sf_dir, "records").select("id", F.col("source_url").alias("url")).distinct().where("trim(url) <> ''").join(known, "url", "left_anti")
    return leads.groupBy("url").agg(F.count(F.lit(1)).alias("score")).orderBy(F.desc("score"), "url").limit(10)


def inspect_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of twelve records, the same at every call."""
    return table(spark, sf_dir, "records").select("id").distinct().orderBy(F.md5("id"), "id").limit(12)


def run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "runs")
    took = F.unix_micros("finished_at") - F.unix_micros("started_at")
    return runs.groupBy("mode").agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.col("ok") == 1).alias("good"), F.count_if(F.col("finished_at").isNull()).alias("unfinished"), F.max(took).alias("longest_us"))


def split_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.by_document(table(spark, sf_dir, "records"))


def split_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per side, which do not depend on the order of groups of one size."""
    return split_by_document(spark, sf_dir).groupBy("side").agg(F.count(F.lit(1)).alias("rows"))


QUERIES = {f.__name__: f for f in (pdf_repair, storage_markup, mask_secret, hamming, cosine_pairs, pending_leads, inspect_sample, run_stats, split_by_document, split_sizes)}

SQL = {
    "pdf_repair": r"""select doc_id, regexp_replace(regexp_replace(regexp_replace(replace(text, chr(173), ''), '([0-9A-Za-z_])-\n([0-9A-Za-z_])', '\1\2', 'g'),
        '(?m)^[ \t]*(?:[Pp]age )?\d{1,4}[ \t]*$\n?', '', 'g'), '([^.:?!;\n])\n([a-z])', '\1 \2', 'g') as text from documents where kind = 'pdf'""",
    "storage_markup": r"""select doc_id, regexp_replace(regexp_replace(regexp_replace(text, '(?is)<(?:script|style)\b.*?</(?:script|style)\s*>|<!--.*?-->', ' ', 'g'),
        '(?i)<(?:br|/p|/li|/h[1-6]|/tr|/div)\b[^<>]*>', chr(10), 'g'), '</?[a-zA-Z][^<>]*>', '', 'g') as text from documents where kind = 'html'""",
    "mask_secret": "select doc_id, case when length(id) <= 8 then repeat('•', length(id)) else left(id, 4) || repeat('•', 12) || right(id, 4) end as masked from documents",
    "hamming": "select id, bit_count(xor(simhash, (select min(simhash) from chunks)))::int as distance from (select distinct id, simhash from chunks where simhash is not null)",
    "cosine_pairs": f"select a.vec_id as q, b.vec_id from embeddings a join embeddings b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id where list_cosine_similarity(a.embedding::double[], b.embedding::double[]) >= {NEAR}",
    "pending_leads": """select url, count(*) as score from (select distinct id, source_url as url from records where trim(source_url) <> '') where url not in (select url from documents where url is not null)
        group by 1 order by 2 desc, 1 limit 10""",
    "inspect_sample": "select id from (select distinct id from records) order by md5(id), id limit 12",
    "run_stats": "select mode, count(*) as runs, count(*) filter (ok = 1) as good, count(*) filter (finished_at is null) as unfinished, max(epoch_us(finished_at) - epoch_us(started_at)) as longest_us from runs group by 1",
}
