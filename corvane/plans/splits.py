"""Queries of the grouping and splitting operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.operators import groups
from corvane.session import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.divided(table(spark, sf_dir, "records"))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "records").selectExpr("cast(id as string) as id", "kind as label")


def p2_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record with its side of the split, kinds in like proportions on all sides."""
    return groups.assign(groups.linked(table(spark, sf_dir, "records"))[1], labels=_labels(spark, sf_dir))


def p2_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of each side, and how far its kinds deviate from all records."""
    return groups.report(p2_split(spark, sf_dir), _labels(spark, sf_dir))


QUERIES = {"p2_found": p2_found, "p2_split": p2_split, "p2_shares": p2_shares}
SQL = {
    "p2_found": r"""with recursive
cut as (select distinct id, chunk_id, source_url, regexp_replace(source_url, '#.*$', '') as u from records where id is not null),
parts as (select id, chunk_id, source_url, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) as s,
                 regexp_replace(u, '^[A-Za-z][A-Za-z0-9+.-]*://', '') as r from cut),
split as (select *, case when s = '' then '' else lower(regexp_extract(r, '^[^/?]*')) end as h,
                 case when s = '' then r else regexp_replace(r, '^[^/?]*', '') end as t from parts),
keyed as (select id, nullif(trim(chunk_id), '') as chunk, case when trim(source_url) <> '' then
                 (case when s in ('http', 'https', '') then '' else s || ':' end) || (case when s = '' then '' else '//' end)
                 || (case s when 'http' then regexp_replace(h, ':80$', '') when 'https' then regexp_replace(h, ':443$', '') else h end)
                 || regexp_replace(split_part(t, '?', 1), '/$', '')
                 || coalesce('?' || nullif(array_to_string(list_filter(string_split(regexp_replace(regexp_extract(t, '\?.*$'), '^\?', ''), '&'),
                            lambda p: p <> '' and not starts_with(p, 'utm_')), '&'), ''), '') end as page from split),
links as (select id, 'p' || page as k from keyed where page is not null union select id, 'c' || chunk from keyed where chunk is not null),
edges as (select distinct a.id as x, b.id as y from links a join (select k, min(id) as id from links group by k) b using (k)),
both_ways as (select x, y from edges union select y, x from edges),
reach as (select id as x, id as y from keyed union select r.x, e.y from reach r join both_ways e on r.y = e.x),
grouped as (select x as id, min(y) as group_id from reach group by x),
several as (select group_id from grouped join keyed using (id) group by 1 having count(distinct page) > 1)
select id, group_id from grouped where group_id in (select group_id from several)""",
}
