"""Queries of the dataset analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.plans.texts import sql_strip, sql_tokens, sql_words
from corvane.session import table

LIMIT = 512


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "records").dropDuplicates(["id"])


def _tally(name: str, make):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _records(spark, sf_dir).groupBy(make().alias(name)).agg(F.count(F.lit(1)).alias("rows"), F.min("id").alias("first_id"))

    return run


def length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of the answers in estimated tokens: count, mean and exact percentiles."""
    n = T.estimated_tokens(F.col("output"))
    rows = _records(spark, sf_dir).select(n.alias("n"))
    p = F.percentile("n", F.array(*[F.lit(x) for x in (0.5, 0.9, 0.95, 0.99)]))
    out = rows.agg(F.count("n").alias("rows"), F.round(F.avg("n"), 1).alias("mean"), p.alias("p"), F.max("n").alias("maximum"), F.min("n").alias("minimum"))
    return out.select("rows", "mean", *[F.round(F.col("p")[i], 1).alias(f"p{k}") for i, k in enumerate((50, 90, 95, 99))], "maximum", "minimum")


def over_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents over a limit of tokens, of all, and the total."""
    n = T.estimated_tokens(F.col("text"))
    rows = table(spark, sf_dir, "documents").select(n.alias("n"))
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("n") > LIMIT).alias("over"), F.sum("n").cast("long").alias("tokens"))


def longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five longest documents."""
    return table(spark, sf_dir, "documents").select("doc_id", T.estimated_tokens(F.col("text")).alias("tokens")).orderBy(F.desc("tokens"), "doc_id").limit(5)


def degenerate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a form that teaches nothing good; an empty one counts as nothing else."""
    o, q = T.strip(F.coalesce("output", F.lit(""))), F.coalesce("instruction", F.lit(""))
    full = F.length(o) > 0
    tests = {
        "empty_output": ~full,
        "very_short_output": full & (F.length(o) < 40),
        "answer_looks_truncated": full & ~o.rlike(r"[.!?`)\]}:\"]$"),
        "unbalanced_code_fence": full & (T.count_of(o, "```") % 2 == 1),
        "instruction_in_output": full & (q != "") & F.contains(F.lower(o), F.substring(F.lower(q), 1, 50)),
    }
    return _records(spark, sf_dir).agg(*[F.count_if(t).alias(k) for k, t in tests.items()])


def topic_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 tokens of more than four characters that most chunks have."""
    chunks = table(spark, sf_dir, "chunks").dropDuplicates(["id"])
    words = F.array_distinct(F.filter(T.tokens(F.col("text")), lambda t: F.length(t) > 4))
    counted = chunks.select(F.explode(words).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("chunks"))
    return counted.orderBy(F.desc("chunks"), "token").limit(25)


def mean_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).groupBy("kind").agg(F.round(F.avg(F.coalesce("score", F.lit(0.0))), 3).alias("mean_score"))


def warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions under which the dataset trains badly, and whether they hold."""
    rows = _records(spark, sf_dir).select("kind", T.source_label(F.col("tags"), F.col("source_url")).alias("source"), F.coalesce("score", F.lit(0.0)).alias("score"))
    all_ = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean"))
    kind = rows.groupBy("kind").count().agg(F.max("count").alias("top_kind"))
    source = rows.groupBy("source").count().agg(F.max("count").alias("top_source"))
    facts = all_.crossJoin(kind).crossJoin(source)  # one row each
    return facts.select(
        (F.col("n") < 100).alias("too_few"),
        (F.col("n") < 500).alias("few"),
        (F.col("top_kind") > 0.8 * F.col("n")).alias("one_kind"),
        (F.col("top_source") > 0.7 * F.col("n")).alias("one_source"),
        (F.col("mean") < 0.75).alias("low_score"),
    )


def glossary_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One entry per term: the definition with the best score, then the longest, then the first id; all
    its mentions and pages."""
    rows = _records(spark, sf_dir).where("kind = 'glossary' and not coalesce(quarantined, false)")
    term = T.strip(F.regexp_replace(F.regexp_replace("instruction", "^What is ", ""), r"\?+$", ""))
    rows = rows.withColumn("term", term).where("term <> ''").withColumn("key", T.term_key(F.col("term")))
    rank = F.struct(F.coalesce("score", F.lit(0.0)).alias("s"), F.length("output").alias("l"))
    best = F.min_by(F.struct("term", "output", F.col("score").alias("score")), F.struct(-rank["s"], -rank["l"], F.col("id")))
    out = rows.groupBy("key").agg(best.alias("b"), F.count(F.lit(1)).alias("mentions"), F.count_distinct(F.nullif("source_url", F.lit(""))).alias("pages"))
    return out.select("key", "b.term", F.col("b.output").alias("definition"), F.round(F.coalesce("b.score", F.lit(0.0)), 3).alias("score"), "mentions", "pages")


QUERIES = {
    "tally_kind": _tally("kind", lambda: F.col("kind")),
    "tally_generator": _tally("generator", lambda: F.col("generator")),
    "tally_source": _tally("source", lambda: T.source_label(F.col("tags"), F.col("source_url"))),
    **{f.__name__: f for f in (length_stats, over_limit, longest, degenerate, topic_df, mean_score, warnings, glossary_merge)},
}

_R = "(select distinct on (id) * from records)"
_EST = "case when coalesce({0}, '') = '' then 0 else greatest(1, floor(greatest(length({0}) / 4, {1} * 1.3::double))::int) end"
_OUT, _DOC = _EST.format("output", sql_words("output")), _EST.format("text", sql_words("text"))
_LABEL = "coalesce(regexp_replace(list_filter(tags, lambda t: starts_with(t, 'source:'))[1], '^source:', ''), nullif(regexp_extract(coalesce(source_url, ''), '^(human|input)://', 1), ''), 'unknown')"
_O = sql_strip("coalesce(output, '')")
_TERM = sql_strip(r"regexp_replace(regexp_replace(instruction, '^What is ', ''), '\?+$', '')")
SQL = {
    "tally_kind": f"select kind, count(*) as rows, min(id) as first_id from {_R} group by 1",
    "tally_generator": f"select generator, count(*) as rows, min(id) as first_id from {_R} group by 1",
    "tally_source": f"select {_LABEL} as source, count(*) as rows, min(id) as first_id from {_R} group by 1",
    "length_stats": f"""select count(n) as rows, round(avg(n), 1) as mean, round(quantile_cont(n, 0.5), 1) as p50, round(quantile_cont(n, 0.9), 1) as p90, round(quantile_cont(n, 0.95), 1) as p95,
        round(quantile_cont(n, 0.99), 1) as p99, max(n) as maximum, min(n) as minimum from (select {_OUT} as n from {_R})""",
    "over_limit": f"select count(*) as rows, count(*) filter (n > {LIMIT}) as over, sum(n)::bigint as tokens from (select {_DOC} as n from documents)",
    "longest": f"select doc_id, {_DOC} as tokens from documents order by 2 desc, 1 limit 5",
    "degenerate": f"""select count(*) filter (o = '') as empty_output, count(*) filter (o <> '' and length(o) < 40) as very_short_output,
        count(*) filter (o <> '' and not regexp_matches(o, '[.!?`)\\]}}:"]$')) as answer_looks_truncated,
        count(*) filter (((length(o) - length(replace(o, '```', ''))) // 3) % 2 = 1) as unbalanced_code_fence,
        count(*) filter (o <> '' and coalesce(instruction, '') <> '' and contains(lower(o), left(lower(instruction), 50))) as instruction_in_output
        from (select instruction, {_O} as o from {_R})""",
    "topic_df": f"""select token, count(*) as chunks from (select unnest(list_distinct(list_filter({sql_tokens('text')}, lambda t: length(t) > 4))) as token from (select distinct id, text from chunks))
        group by 1 order by 2 desc, 1 limit 25""",
    "mean_score": f"select kind, round(avg(coalesce(score, 0)), 3) as mean_score from {_R} group by 1",
    "warnings": f"""with r as (select kind, {_LABEL} as source, coalesce(score, 0) as score from {_R})
        select n < 100 as too_few, n < 500 as few, (select max(c) from (select count(*) as c from r group by kind)) > 0.8 * n as one_kind,
        (select max(c) from (select count(*) as c from r group by source)) > 0.7 * n as one_source, mean < 0.75 as low_score from (select count(*) as n, avg(score) as mean from r)""",
    "glossary_merge": f"""with g as (select *, trim(regexp_replace(lower(term), '[^a-z0-9]+', ' ', 'g')) as k from (select *, {_TERM} as term from {_R} where kind = 'glossary' and not coalesce(quarantined, false)) where term <> ''),
        h as (select *, case when length(k) > 3 and ends_with(k, 's') and not ends_with(k, 'ss') then left(k, length(k) - 1) else k end as key from g),
        best as (select *, row_number() over (partition by key order by coalesce(score, 0) desc, length(output) desc nulls last, id) as n from h)
        select b.key, b.term, b.output as definition, round(coalesce(b.score, 0), 3) as score, m.mentions, m.pages
        from best b join (select key, count(*) as mentions, count(distinct nullif(source_url, '')) as pages from h group by 1) m using (key) where n = 1""",
}
