"""Queries of the quality gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import quality as Q
from corvane.plans.texts import sql_strip, sql_tokens, sql_words
from corvane.session import table

COLUMNS = ["id", "instruction", "output", "context"]


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "records").select(*COLUMNS).union(table(spark, sf_dir, "quarantine").select(*COLUMNS))
    return both.dropDuplicates(["id"])


def heuristic_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, a = (T.strip(F.coalesce(c, F.lit(""))) for c in ("instruction", "output"))
    return _rows(spark, sf_dir).select("id", Q.heuristic(q, a).alias("v")).select("id", "v.ok", "v.score", "v.reason")


def grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).select("id", F.round(Q.grounding(F.coalesce("output", F.lit("")), F.col("context")), 6).alias("grounding"))


def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.gate(_rows(spark, sf_dir)).select("id", F.round("score", 6).alias("score"), "score_reason", "quarantined")


def reject_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most frequent reasons."""
    bad = Q.gate(_rows(spark, sf_dir)).where("quarantined").groupBy("score_reason").agg(F.count(F.lit(1)).alias("rows"))
    return bad.orderBy(F.desc("rows"), "score_reason").limit(5)


QUERIES = {"heuristic_gate": heuristic_gate, "grounding": grounding, "quality_gate": quality_gate, "reject_reasons": reject_reasons}


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_META = " ".join(f"when regexp_matches(q, {_quoted(p)}) then 'question refers to the source text' when regexp_matches(left(a, 200), {_quoted(p)}) then 'answer is meta or a non-answer'" for p in Q.META)
_NORM = "list_distinct(list_filter(list_transform({}, lambda t: regexp_replace(t, '^[.,;:!?()]+|[.,;:!?()]+$', '', 'g')), lambda t: t <> ''))"
_BASE = f"""
rows as (select distinct id, {sql_strip("coalesce(instruction, '')")} as q, {sql_strip("coalesce(output, '')")} as a, coalesce(output, '') as output, context
         from (select id, instruction, output, context from records union all select id, instruction, output, context from quarantine)),
judged as (select *, case when length(q) < 12 then 'question too short' when length(a) < 2 then 'answer too short' when length(a) > 2000 then 'answer too long'
    when lower(q) = lower(a) or (starts_with(lower(a), left(lower(q), 60)) and length(a) < length(q) * 1.5) then 'answer restates the question' {_META}
    when regexp_matches(a, {_quoted(Q.CHROME)}) and length(a) < 400 then 'answer is page chrome'
    when ((length(a) - length(replace(a, '```', ''))) // 3) % 2 = 1 then 'unbalanced code fence'
    when length(q) - length(replace(q, '?', '')) > 3 then 'question is a multi-question blob'
    when {sql_words('a')} > 0 and length(regexp_replace(a, '{T.SPACE}', '', 'g')) > 18 * {sql_words('a')} then 'answer looks like garbled extraction' else 'heuristics ok' end as reason from rows),
toks as (select *, {_NORM.format(sql_tokens(f"regexp_replace(output, {_quoted(Q.PLACEHOLDER)}, ' ', 'g')"))} as mine, {_NORM.format(sql_tokens('context'))} as theirs from judged),
parts as (select *, list_filter(mine, lambda t: regexp_matches(t, '[0-9/_.\\-]')) as hard from toks),
shares as (select *, len(list_intersect(mine, theirs)) / len(mine) as overlap, case when len(hard) > 0 then len(list_intersect(hard, theirs)) / len(hard) end as strict from parts),
grounded as (select *, case when coalesce(context, '') = '' then 1.0 when len(mine) = 0 then 0.0 when len(hard) = 0 then overlap else greatest(overlap, strict * 0.75::double + overlap * 0.25::double) end as g from shares),
scored as (select *, case reason when 'heuristics ok' then 0.75 when 'answer too long' then 0.2 when 'answer looks like garbled extraction' then 0.2 when 'unbalanced code fence' then 0.3
    when 'question is a multi-question blob' then 0.3 when 'question too short' then 0.0 when 'answer too short' then 0.0 when 'answer restates the question' then 0.0 else 0.1 end::double as s from grounded),
gated as (select id, case when reason <> 'heuristics ok' then s when g >= 0.35 then least(1.0, 0.5 + g * 0.5) else round(g, 3) end as score,
    case when reason <> 'heuristics ok' then reason when g >= 0.35 then 'grounded' else 'ungrounded' end as score_reason from scored)
"""
SQL = {
    "heuristic_gate": f"with {_BASE} select id, reason = 'heuristics ok' as ok, s as score, reason from scored",
    "grounding": f"with {_BASE} select id, round(g::double, 6) as grounding from grounded",
    "quality_gate": f"with {_BASE} select id, round(score::double, 6) as score, score_reason, not (score_reason = 'grounded' and score >= 0.6) as quarantined from gated",
    "reject_reasons": f"with {_BASE} select score_reason, count(*) as rows from gated where not (score_reason = 'grounded' and score >= 0.6) group by 1 order by 2 desc, 1 limit 5",
}
