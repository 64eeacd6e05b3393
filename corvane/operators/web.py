"""Pages and their links as tables: policy of urls, titles, links, ranking, breadth-first reach."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane import session

# Hosts that are never worth it, hints of first-hand documentation, and weights.
JUNK = "pinterest.com facebook.com x.com twitter.com instagram.com quora.com slideshare.net scribd.com coursehero.com".split()
PREFERRED = "docs. developer. documentation /docs/ support. kb. github.com gitlab.com readthedocs man7.org kubernetes.io".split()


def host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)", 1)), r"^www\.", "")


def allowed(url: Column, domains: list[str], deny: list[str]) -> Column:
    """Whether the host is one of ``domains`` or below it and no pattern of ``deny`` occurs."""
    h = F.regexp_replace(host(url), r":\d+$", "")
    inside = F.lit(False)
    for d in domains:
        inside = inside | (h == d) | h.endswith("." + d)
    for p in deny:
        inside = inside & ~url.rlike(f"(?i){p}")
    return F.coalesce(inside, F.lit(False))


def rank(results: DataFrame, query: str) -> DataFrame:
    """``results`` (url, title, snippet, rank) without junk hosts, with a score: the engine's order,
    documentation, words of the query, PDF, archive pages."""
    terms = sorted({t for t in re.findall(r"[a-z0-9]+", query.lower()) if len(t) > 2})
    url, h = F.lower("url"), host(F.col("url"))
    hay = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("snippet", F.lit(""))))
    hits = sum((F.contains(hay, F.lit(t)).cast("int") for t in terms), F.lit(0))
    hint = F.lit(False)
    for p in PREFERRED:
        hint = hint | F.contains(url, F.lit(p))
    junk = F.lit(False)
    for d in JUNK:
        junk = junk | (h == d) | h.endswith("." + d)
    score = 1.0 - F.col("rank") * 0.03 + F.when(hint, 0.45).otherwise(0.0) + 0.35 * hits / max(1, len(terms))
    score = score + F.when(url.endswith(".pdf"), 0.15).otherwise(0.0) - F.when(F.col("url").rlike(r"/(tag|category|archive|page)/\d*"), 0.4).otherwise(0.0)
    return results.where(~junk).withColumn("score", F.round(score, 3))


def links(pages: DataFrame) -> DataFrame:
    """(url, target) of the anchors in ``pages`` (url, text): distinct, absolute, without fragment;
    only http and https, also where the page's url makes a rooted target so."""
    hrefs = F.regexp_extract_all("text", F.lit(r"(?i)<a\s[^<>]*href\s*=\s*[\"']([^\"'#<>]+)"), F.lit(1))
    rows = pages.where("url is not null").select("url", F.explode(F.array_distinct(hrefs)).alias("href"))
    origin = F.regexp_extract("url", r"^(https?://[^/?#]+)", 1)
    target = F.when(F.col("href").rlike("^https?://"), F.col("href")).when(F.col("href").startswith("//"), F.concat(F.lit("https:"), "href")).when(F.col("href").startswith("/") & (origin != ""), F.concat(origin, "href"))
    return rows.select("url", target.alias("target")).where("target is not null").distinct()


def crawl(seeds: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """(url, depth) of what is reached from ``seeds`` (url) over ``edges`` (url, target) in ``depth``
    steps; each round joins only the newest urls, and cuts its lineage."""
    seen = session.cut_lineage(seeds.where("url is not null").select("url").distinct().withColumn("depth", F.lit(0)))
    newest = seen
    for d in range(1, depth + 1):
        found = edges.join(newest.select("url"), "url", "left_semi").select(F.col("target").alias("url")).distinct()
        newest = session.cut_lineage(found.join(seen.select("url"), "url", "left_anti").withColumn("depth", F.lit(d)))
        if newest.isEmpty():
            break
        seen = session.cut_lineage(seen.union(newest))
    return seen
