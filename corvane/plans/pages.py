"""Queries of pages, links, chunks and extractive records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import structure, web
from corvane.session import table

DOMAINS, DENY = ["tarnwick.example", "lumafeld.example"], [r"/blog/"]
QUERY = "certificate runbook access token"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chunks").dropDuplicates(["id"])


def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", web.allowed(F.col("url"), DOMAINS, DENY).alias("allowed"))


def rank_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _documents(spark, sf_dir).select("doc_id", "url", "title", F.lit("").alias("snippet"), (F.col("doc_id") % 10).cast("int").alias("rank")).where("url is not null")
    return web.rank(rows, QUERY).select("doc_id", "score")


def html_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.regexp_extract("text", r"(?is)<title[^>]*>(.*?)</title>", 1)
    return _documents(spark, sf_dir).select("doc_id", title.alias("title")).where("title <> ''")


def link_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web.links(_documents(spark, sf_dir).select("url", "text"))


def crawl_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What three steps over stored links reach from the pages of one host."""
    pages = _documents(spark, sf_dir).select("url", "text")
    seeds = pages.where(web.host(F.col("url")) == "docs.tarnwick.example").select("url")
    return web.crawl(seeds, web.links(pages), 3)


def chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.chunk(_documents(spark, sf_dir).select("id", "text"))


def extract_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _chunks(spark, sf_dir)
    steps = structure.extract_steps(chunks).withColumn("kind", F.lit("instruction"))
    return steps.union(structure.extract_errors(chunks).withColumn("kind", F.lit("troubleshooting")))


def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short hash of place, size and time of each document."""
    parts = F.concat_ws(":", F.coalesce("url", F.lit("")), F.length("text").cast("string"), F.unix_micros("fetched_at").cast("string"))
    return _documents(spark, sf_dir).where("text is not null and fetched_at is not null").select("doc_id", F.substring(F.sha2(parts, 256), 1, 16).alias("fingerprint"))


QUERIES = {f.__name__: f for f in (url_filter, rank_urls, html_title, link_extract, crawl_bfs, chunk, extract_records, fingerprint)}

_HOST = r"regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)', 1)), '^www\.', '')"
_BARE = rf"regexp_replace({_HOST}, ':\d+$', '')"
_IN = " or ".join(f"{_BARE} = '{d}' or ends_with({_BARE}, '.{d}')" for d in DOMAINS)
_JUNK = " or ".join(f"h = '{d}' or ends_with(h, '.{d}')" for d in web.JUNK)
_HINT = " or ".join(f"contains(lower(url), '{p}')" for p in web.PREFERRED)
_TERMS = QUERY.split()
_HITS = " + ".join(f"contains(hay, '{t}')::int" for t in _TERMS)
_LINKS = r"""select distinct url, case when regexp_matches(href, '^https?://') then href when starts_with(href, '//') then 'https:' || href
    when starts_with(href, '/') and regexp_extract(url, '^(https?://[^/?#]+)', 1) <> '' then regexp_extract(url, '^(https?://[^/?#]+)', 1) || href end as target
    from (select url, unnest(regexp_extract_all(text, '(?i)<a\s[^<>]*href\s*=\s*["'']([^"''#<>]+)', 1)) as href from documents where url is not null)"""
_STEPS = r"list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^\s*\d+[.)]\s+.+$'))"
_ERR = f"trim(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{T.ERROR_LINE}') and length(trim(x)) > 25)[1])"
_CUT = "regexp_replace(line, '^\\s+|\\s+$', '', 'g')"
SQL = {
    "url_filter": f"select doc_id, coalesce(({_IN}) and not regexp_matches(url, '(?i)/blog/'), false) as allowed from documents",
    "rank_urls": rf"""select doc_id, round(1.0::double - r * 0.03::double + case when {_HINT} then 0.45 else 0.0 end::double + 0.35::double * ({_HITS}) / {len(_TERMS)}
        + case when ends_with(lower(url), '.pdf') then 0.15 else 0.0 end::double - case when regexp_matches(url, '/(tag|category|archive|page)/\d*') then 0.4 else 0.0 end::double, 3) as score
        from (select doc_id, url, {_HOST} as h, lower(coalesce(title, '') || ' ') as hay, doc_id % 10 as r from documents where url is not null) where not ({_JUNK})""",
    "html_title": "select doc_id, title from (select doc_id, regexp_extract(text, '(?is)<title[^>]*>(.*?)</title>', 1) as title from documents) where title <> ''",
    "link_extract": f"select * from ({_LINKS}) where target is not null",
    "crawl_bfs": f"""with recursive edges as (select * from ({_LINKS}) where target is not null),
        reach as (select distinct url, 0 as depth from documents where {_HOST} = 'docs.tarnwick.example' union select e.target, r.depth + 1 from reach r join edges e using (url) where r.depth < 3)
        select url, min(depth) as depth from reach group by 1""",
    "extract_records": rf"""with c as (select distinct on (id) * from chunks)
        select id as chunk_id, 'What are the steps for ' || coalesce(nullif(string_split(coalesce(heading, ''), ' › ')[-1], ''), title, 'this task') || '?' as instruction,
        array_to_string(list_transform({_STEPS}, lambda x, i: i::varchar || '. ' || regexp_replace(x, '^\s*\d+[.)]\s+', '')), chr(10)) as output, 'instruction' as kind from c where len({_STEPS}) >= 2
        union all select id, 'How do I resolve: ' || case when length({_CUT}) <= 220 then {_CUT} when pos > 132 then left(left({_CUT}, 220), pos) || ' …' else left({_CUT}, 220) || ' …' end, text, 'troubleshooting'
        from (select *, case when instr(reverse(left({_CUT}, 220)), ' ') > 0 then 220 - instr(reverse(left({_CUT}, 220)), ' ') else -1 end as pos from (select *, {_ERR} as line from c)) where line is not null""",
    "fingerprint": "select doc_id, left(sha256(coalesce(url, '') || ':' || length(text) || ':' || epoch_us(fetched_at)), 16) as fingerprint from documents where text is not null and fetched_at is not null",
}
