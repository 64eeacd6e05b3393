import datetime as dt

import pytest

from corvane.operators import ledger

DAY = dt.datetime(2025, 1, 1)


@pytest.mark.parametrize("count", [30, 100, 600])
def test_null_last_seen_is_ignored_at_any_number_of_runs(spark, count):
    runs = [(f"r{k:03d}", DAY + dt.timedelta(hours=k), DAY + dt.timedelta(hours=k, minutes=1), 1) for k in range(count)]
    runs = spark.createDataFrame(runs, "run_id string, started_at timestamp, finished_at timestamp, ok int")
    at = lambda h: DAY + dt.timedelta(hours=h)
    states = [(1, "d", "a", at(1), at(1)), (2, "d", "b", None, at(2)), (3, "e", "c", None, at(1)), (4, "d", "f", at(count - 2), at(9))]
    states = spark.createDataFrame(states, "obs_id long, id string, content_hash string, last_seen timestamp, last_changed timestamp")
    got = sorted(tuple(r) for r in ledger.replay(states, runs).select("run_id", "id", "content_hash", "state").collect())
    assert got == [("r001", "d", "a", "done"), (f"r{count - 2:03d}", "d", "f", "done")]
