import pytest

from corvane import session
from corvane.operators import ledger


def test_crash_between_claim_and_token_does_not_block(spark, tmp_path):
    led = ledger.WorkLedger(spark, str(tmp_path / "ledger"))
    led.enqueue("b", spark.createDataFrame([("d", "a")], "id string, content_hash string"))
    fs, p = session.filesystem(spark, f"{led.root}/claims/{1:08d}")
    fs.create(p, False).close()  # a driver that died after its claim
    led.pending(0.0).write.parquet(f"{led.root}/leases/token={2:08d}")
    fs.create(session.filesystem(spark, f"{led.root}/claims/{2:08d}")[1], False).close()  # and one after its lease
    token = led.lease(0.0, 10.0)
    assert token == 3 and led.leased(token).count() == 1
    led.complete(token, 1.0)
    assert led.pending(1.0).isEmpty()


def test_claim_taken_in_the_meantime_is_passed_over(spark, tmp_path, monkeypatch):
    led = ledger.WorkLedger(spark, str(tmp_path / "ledger"))
    led.enqueue("b", spark.createDataFrame([("d", "a")], "id string, content_hash string"))
    fs, p = session.filesystem(spark, f"{led.root}/claims/{1:08d}")
    real, first = led._newest, []

    def newest():
        token = real()
        if not first:
            first.append(fs.create(p, False).close())
        return token

    monkeypatch.setattr(led, "_newest", newest)
    assert led.lease(0.0, 10.0) == 2


def test_overtaken_claim_cannot_settle(spark, tmp_path):
    led = ledger.WorkLedger(spark, str(tmp_path / "ledger"))
    led.enqueue("b", spark.createDataFrame([("d", "a")], "id string, content_hash string"))
    # token 1 is slow: it has its claim and its items, but its token appears after token 2
    led.pending(0.0).write.parquet(f"{led.root}/leases/token={1:08d}")
    fs, p = session.filesystem(spark, f"{led.root}/claims/{1:08d}")
    fs.create(p, False).close()
    assert led.lease(0.0, 100.0) == 2
    fs.mkdirs(session.filesystem(spark, f"{led.root}/tokens/1@100.0")[1])
    with pytest.raises(ledger.StaleToken):
        led.complete(1, 1.0)
    led.complete(2, 1.0)
    assert led.pending(1.0).isEmpty()
