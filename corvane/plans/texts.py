"""Queries of the text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.session import table


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _column(name: str, make):
    return lambda spark, sf_dir: _documents(spark, sf_dir).select("doc_id", make().alias(name))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "records").dropDuplicates(["id"])


def useful_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    term = F.regexp_replace(F.regexp_replace("instruction", "^What is ", ""), r"\?+$", "")
    return _records(spark, sf_dir).select("id", T.useful_term(term).alias("useful"), T.term_key(term).alias("term_key"))


def error_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    return lines.where(F.col("line").rlike(T.ERROR_LINE)).select("doc_id", (F.col("at") + 1).alias("line_no"), F.md5("line").alias("line_hash"))


def route_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of records that a chunk is used for, in order."""
    chunks = table(spark, sf_dir, "chunks").dropDuplicates(["id"])
    hard = F.coalesce((F.col("kind") == "runbook") | F.array_contains("tags", "runbook"), F.lit(False)) | F.coalesce(F.col("text").rlike(T.ERROR_LINE), F.lit(False))
    return chunks.select("id", F.when(hard, "troubleshooting,qa,instruction,glossary").otherwise("qa,instruction,glossary").alias("kinds"))


QUERIES = {
    "clean_text": _column("clean", lambda: T.clean_text(F.col("text"))),
    "tokenize": _column("tokens", lambda: F.array_join(T.tokens(F.col("text")), " ")),
    "normalize": _column("normalized", lambda: T.normalized(F.col("text"))),
    "content_hash": _column("content_hash", lambda: F.sha2("text", 256)),
    "short_id": _column("short", lambda: T.short_id(F.coalesce("url", F.lit("")), F.coalesce("title", F.lit("")))),
    "estimate_tokens": _column("tokens", lambda: T.estimated_tokens(F.col("text"))),
    "truncate": _column("short", lambda: T.truncated(F.col("text"), 90)),
    "useful_term": useful_term,
    "error_lines": error_lines,
    "route_kinds": route_kinds,
}

STOP = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{T.SPACE}+|{T.SPACE}+$', '', 'g')"


def sql_tokens(x: str) -> str:
    return rf"list_filter(regexp_extract_all(lower({x}), '[a-z0-9_.\-/]+'), lambda t: length(t) > 1 and not list_contains({STOP}, t))"


def sql_words(x: str) -> str:
    return f"len(regexp_extract_all({x}, '{T.NO_SPACE}+'))"


_CLEAN = r"regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g')"
_CLEAN = rf"regexp_replace({_CLEAN}, '[\x00-\x08\x0e-\x1f\x7f]', ' ', 'g')"
_CLEAN = rf"regexp_replace({_CLEAN}, '[ \t\x0b\f\r]+', ' ', 'g')"
_CLEAN = rf"regexp_replace({_CLEAN}, '{T.LINE_SPACE}*\n{T.LINE_SPACE}*', chr(10), 'g')"
_CLEAN = sql_strip(rf"regexp_replace({_CLEAN}, '\n{{3,}}', chr(10) || chr(10), 'g')")
_TERM = r"regexp_replace(regexp_replace(instruction, '^What is ', ''), '\?+$', '')"
_KEY = f"trim(regexp_replace(lower({_TERM}), '[^a-z0-9]+', ' ', 'g'))"

SQL = {
    "clean_text": f"select doc_id, {_CLEAN} as clean from documents",
    "tokenize": f"select doc_id, array_to_string({sql_tokens('text')}, ' ') as tokens from documents",
    "normalize": "select doc_id, array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') as normalized from documents",
    "content_hash": "select doc_id, sha256(text) as content_hash from documents",
    "short_id": "select doc_id, left(sha256(coalesce(url, '') || chr(31) || coalesce(title, '')), 16) as short from documents",
    "estimate_tokens": f"select doc_id, case when coalesce(text, '') = '' then 0 else greatest(1, floor(greatest(length(text) / 4, {sql_words('text')} * 1.3::double))::int) end as tokens from documents",
    "truncate": f"""select doc_id, case when length(t) <= 90 then t when pos > 54 then left(left(t, 90), pos) || ' …' else left(t, 90) || ' …' end as short
        from (select doc_id, t, case when instr(reverse(left(t, 90)), ' ') > 0 then 90 - instr(reverse(left(t, 90)), ' ') else -1 end as pos
              from (select doc_id, {sql_strip('text')} as t from documents))""",
    "useful_term": f"""select id, coalesce(length(t) between 2 and 60 and not regexp_matches(t, '{T.NO_TERM}') and {sql_words('t')} <= 6 and regexp_matches(t, '\\p{{L}}'), false) as useful,
        case when length(k) > 3 and ends_with(k, 's') and not ends_with(k, 'ss') then left(k, length(k) - 1) else k end as term_key
        from (select distinct id, {_TERM} as t, {_KEY} as k from records)""",
    "error_lines": f"""select doc_id, line_no, md5(line) as line_hash from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as line_no from documents)
        where regexp_matches(line, '{T.ERROR_LINE}')""",
    "route_kinds": f"""select distinct id, case when coalesce(kind = 'runbook' or list_contains(tags, 'runbook'), false) or coalesce(regexp_matches(text, '{T.ERROR_LINE}'), false)
        then 'troubleshooting,qa,instruction,glossary' else 'qa,instruction,glossary' end as kinds from chunks""",
}
