import pytest

from corvane.operators import ledger


def _process(led, token):
    rows = sorted(tuple(r) for r in led.leased(token).select("id", "content_hash").collect())
    led.complete(token, 0.0)
    return rows


@pytest.fixture
def led(spark, tmp_path):
    return ledger.WorkLedger(spark, str(tmp_path / "ledger"))


def _items(spark, *rows):
    return spark.createDataFrame(list(rows), "id string, content_hash string")


def test_return_to_an_earlier_hash_is_pending_again(spark, led):
    got = []
    for batch, h in enumerate("ABA"):
        led.enqueue(f"b{batch}", _items(spark, ("d", h), ("e", "x")))
        got.append(_process(led, led.lease(0.0, 10.0)))
    assert got == [[("d", "a"), ("e", "x")], [("d", "b")], [("d", "a")]]
    assert led.pending(0.0).isEmpty()


def test_only_the_newest_version_is_pending(spark, led):
    led.enqueue("b0", _items(spark, ("d", "a")))
    _process(led, led.lease(0.0, 10.0))
    led.enqueue("b1", _items(spark, ("d", "b")))
    assert [r["content_hash"] for r in led.pending(0.0).collect()] == ["b"]
    led.enqueue("b2", _items(spark, ("d", "a")))
    assert led.pending(0.0).isEmpty()  # back before anybody took b


def test_order_of_observation_beats_order_of_arrival(spark, led):
    schema = "id string, content_hash string, at long, obs_id long"
    led.enqueue("z", spark.createDataFrame([("d", "new", 20, 7)], schema))
    led.enqueue("a", spark.createDataFrame([("d", "late", 10, 8)], schema))
    assert [r["content_hash"] for r in led.pending(0.0).collect()] == ["new"]


def test_return_while_other_versions_are_leased(spark, led):
    led.enqueue("b0", _items(spark, ("d", "a")))
    first = led.lease(0.0, 100.0)
    led.enqueue("b1", _items(spark, ("d", "b")))
    second = led.lease(1.0, 100.0)
    led.enqueue("b2", _items(spark, ("d", "a")))
    assert led.pending(2.0).count() == 1  # the newest lease holds b
    led.complete(second, 2.0)
    led.complete(first, 2.0)
    assert [r["content_hash"] for r in led.pending(3.0).collect()] == ["a"]
