"""Quality gate of records: ordered rules, then how far the answer is grounded in its context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as T

# Thresholds and patterns of the gate, in the order in which they decide.
MIN_QUESTION, MIN_ANSWER, MAX_ANSWER, MIN_SCORE, MIN_GROUNDED = 12, 2, 2000, 0.6, 0.35
META = [
    r"(?i)\bthe (?:given |provided )?(?:source|text|document|passage|context)\b",
    r"(?i)\baccording to the (?:above|text|source|document)\b",
    r"(?i)\bas (?:mentioned|stated|described) (?:above|in the text)\b",
    r"(?i)\bi (?:do not|don't) have (?:enough|the) (?:information|context)\b",
    r"(?i)\b(?:is |are )?not (?:specified|mentioned|provided|stated) in the\b",
    r"(?i)^\s*(?:n/?a|none|unknown|no answer)\s*$",
]
CHROME = r"(?i)(cookie|privacy policy|all rights reserved|skip to (?:main )?content|sign in|subscribe|newsletter|©\s*\d{4})"
PLACEHOLDER = r"(?i)[<{\[][a-z0-9_.\- ]{2,40}[>}\]]"


def _fail(score: float, reason: str) -> Column:
    return F.struct(F.lit(False).alias("ok"), F.lit(score).alias("score"), F.lit(reason).alias("reason"))


def heuristic(q: Column, a: Column) -> Column:
    """Struct (ok, score, reason) of the first rule that holds for a stripped pair."""
    same = (F.lower(q) == F.lower(a)) | (F.startswith(F.lower(a), F.substring(F.lower(q), 1, 60)) & (F.length(a) < F.length(q) * 1.5))
    rules = [
        (F.length(q) < MIN_QUESTION, 0.0, "question too short"),
        (F.length(a) < MIN_ANSWER, 0.0, "answer too short"),
        (F.length(a) > MAX_ANSWER, 0.2, "answer too long"),
        (same, 0.0, "answer restates the question"),
    ]
    for p in META:
        rules.append((q.rlike(p), 0.1, "question refers to the source text"))
        rules.append((F.substring(a, 1, 200).rlike(p), 0.1, "answer is meta or a non-answer"))
    n = F.size(T.words(a))
    rules += [
        (a.rlike(CHROME) & (F.length(a) < 400), 0.1, "answer is page chrome"),
        (T.count_of(a, "```") % 2 == 1, 0.3, "unbalanced code fence"),
        (T.count_of(q, "?") > 3, 0.3, "question is a multi-question blob"),
        ((n > 0) & (F.length(F.regexp_replace(a, T.SPACE, "")) > 18 * n), 0.2, "answer looks like garbled extraction"),
    ]
    out = None
    for test, score, reason in rules:
        out = F.when(test, _fail(score, reason)) if out is None else out.when(test, _fail(score, reason))
    return out.otherwise(F.struct(F.lit(True).alias("ok"), F.lit(0.75).alias("score"), F.lit("heuristics ok").alias("reason")))


def grounding(output: Column, context: Column) -> Column:
    """Share of the answer's tokens that its context has; identifiers weigh most."""
    mine, theirs = T.norm_tokens(F.regexp_replace(output, PLACEHOLDER, " ")), T.norm_tokens(context)
    hard = F.filter(mine, lambda t: t.rlike(r"[0-9/_.\-]"))
    overlap = F.size(F.array_intersect(mine, theirs)) / F.size(mine)
    strict = F.size(F.array_intersect(hard, theirs)) / F.size(hard)
    scored = F.when(F.size(hard) == 0, overlap).otherwise(F.greatest(overlap, strict * 0.75 + overlap * 0.25))
    return F.when(F.coalesce(context, F.lit("")) == "", F.lit(1.0)).when(F.size(mine) == 0, F.lit(0.0)).otherwise(scored)


def gate(records: DataFrame) -> DataFrame:
    """``records`` with score, score_reason and quarantined set anew by the rules and, where these
    hold, by the grounding. A null instruction or output counts as empty, a null context as none."""
    q, a = (T.strip(F.coalesce(c, F.lit(""))) for c in ("instruction", "output"))
    rows = records.withColumn("_v", heuristic(q, a)).withColumn("_g", grounding(F.coalesce("output", F.lit("")), F.col("context")))
    grounded = F.col("_g") >= MIN_GROUNDED
    score = F.when(~F.col("_v.ok"), F.col("_v.score")).when(grounded, F.least(F.lit(1.0), 0.5 + F.col("_g") * 0.5)).otherwise(F.round("_g", 3))
    reason = F.when(~F.col("_v.ok"), F.col("_v.reason")).when(grounded, F.lit("grounded")).otherwise(F.lit("ungrounded"))
    rows = rows.withColumn("score", score).withColumn("score_reason", reason)
    return rows.withColumn("quarantined", ~(F.col("_v.ok") & grounded & (F.col("score") >= MIN_SCORE))).drop("_v", "_g")
