"""Queries of the incremental operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import ledger
from corvane.session import new_shared_path, table


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each successful run has to process, by a durable ledger led through all runs."""
    led = ledger.WorkLedger(spark, new_shared_path(spark, "ledger"))
    return ledger.drive(led, table(spark, sf_dir, "doc_states"), table(spark, sf_dir, "runs"))


def p7_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of p7_found, computed at once from the log of observations."""
    return ledger.due(table(spark, sf_dir, "doc_states"), table(spark, sf_dir, "runs"))


def p7_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per run: versions it settled and versions whose lease it let expire."""
    history = ledger.replay(table(spark, sf_dir, "doc_states"), table(spark, sf_dir, "runs"))
    return history.groupBy("run_id", "state").agg(F.count(F.lit(1)).alias("items"))


QUERIES = {"p7_found": p7_found, "p7_replay": p7_replay, "p7_leases": p7_leases}

_CURRENT = r"""
good as (select run_id, started_at, row_number() over (order by started_at, run_id) as k
         from runs where ok = 1 and finished_at is not null and started_at is not null),
obs as (select distinct id, obs_id, last_seen, coalesce(last_changed, last_seen) as at,
               trim(regexp_replace(lower(trim(content_hash)), '^sha256:', '')) as h
        from doc_states where content_hash is not null and id is not null),
cur as (select g.k, g.run_id, o.id, arg_max(o.h, (o.at, o.obs_id)) as h
        from good g join obs o on o.last_seen <= g.started_at group by 1, 2, 3)
"""
_DUE = f"with {_CURRENT} select run_id, id from (select *, lag(h) over (partition by id order by k) as had from cur) where had is null or had <> h"
SQL = {"p7_found": _DUE, "p7_replay": _DUE}

_ALL = r"""
every as (select run_id, started_at, coalesce(ok = 1, false) and finished_at is not null as good, row_number() over (order by started_at, run_id) as k
          from runs where started_at is not null and run_id is not null),
obs as (select distinct id, obs_id, last_seen, coalesce(last_changed, last_seen) as at,
               trim(regexp_replace(lower(trim(content_hash)), '^sha256:', '')) as h
        from doc_states where content_hash is not null and id is not null),
cur as (select e.k, e.run_id, e.good, o.id, arg_max(o.h, (o.at, o.obs_id)) as h
        from every e join obs o on o.last_seen <= e.started_at group by 1, 2, 3, 4),
seen as (select *, last_value(case when good then h end ignore nulls) over (partition by id order by k rows between unbounded preceding and 1 preceding) as had from cur)
"""
SQL["p7_leases"] = f"with {_ALL} select run_id, case when good then 'done' else 'expired' end as state, count(*) as items from seen where had is null or had <> h group by 1, 2"
