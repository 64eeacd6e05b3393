import __spark_entry__ as entry


def test_ledger_led_through_the_runs_equals_replay(spark, sf):
    found = entry.queries()["p7_replay"](spark, sf)
    driven = entry.queries()["p7_found"](spark, sf)
    got = sorted(map(tuple, driven.collect()))
    assert got and got == sorted(map(tuple, found.collect()))
