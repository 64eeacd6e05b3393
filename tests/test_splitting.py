from corvane.operators import splitting


def test_take_fills_train_with_the_largest_groups():
    assert splitting.take([(6, 10)], 48) == {6: 8}
    assert splitting.take([(15, 1), (3, 1)], 14.4) == {15: 1, 3: 0}
    assert splitting.take([(1, 2)], 2) == {1: 1}  # eval is not left empty
    assert splitting.take([(10, 1)], 8) == {10: 1} and splitting.take([], 0) == {}


def test_documents_are_not_divided(spark):
    rows = [(f"{d}-{i}", f"https://h/{d}" if d % 3 else None, f"c{d}") for d in range(20) for i in range(1 + d % 5)] + [("z", " ", None), (None, "https://h/1", "c")]
    got = dict(map(tuple, splitting.by_document(spark.createDataFrame(rows, "id string, source_url string, chunk_id string"), 0.8).collect()))
    assert len(got) == len(rows) - 1 and set(got.values()) == {"train", "eval"}
    assert all(len({got[f"{d}-{i}"] for i in range(1 + d % 5)}) == 1 for d in range(20))
    assert got == dict(map(tuple, splitting.by_document(spark.createDataFrame(rows[::-1], "id string, source_url string, chunk_id string"), 0.8).collect()))
    assert splitting.by_document(spark.createDataFrame([], "id string, source_url string, chunk_id string")).count() == 0
