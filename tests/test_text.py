from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import exports, quality, simhash


def _one(spark, make, *values):
    rows = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in rows.select(make(F.col("x"))).collect()]


def test_clean_text_keeps_paragraphs(spark):
    assert _one(spark, T.clean_text, "a\t b\r\n\r\n\r\n\r\nc\x07d ", None, "") == ["a b\n\nc d", "", ""]


def test_tokens_keep_paths_and_flags(spark):
    assert _one(spark, T.tokens, "Run /opt/app/x.sh with --dry-run at the v1.2", None) == [["run", "/opt/app/x.sh", "--dry-run", "v1.2"], None]


def test_estimated_tokens(spark):
    assert _one(spark, T.estimated_tokens, "", None, "x", "one two three four") == [0, 0, 1, 5]


def test_truncated_cuts_at_a_space(spark):
    assert _one(spark, lambda c: T.truncated(c, 10), "abcdefgh ijkl", "abc defghijklm", " short ") == ["abcdefgh …", "abc defghi …", "short"]


def test_terms(spark):
    assert _one(spark, T.term_key, "GPU-Nodes", "pass", "Class") == ["gpu node", "pass", "class"]
    assert _one(spark, T.useful_term, "GPU node", "the node", "x", None, "123") == [True, False, False, False, False]


def test_simhash_of_near_texts_is_close():
    a, b, c = (simhash.simhash(t) for t in ("restart the model server and wait for the probe " * 6, "restart the model server and wait for the probe " * 6 + "again", "a different text about storage classes and quotas " * 6))
    assert bin((a ^ b) & (2**64 - 1)).count("1") < bin((a ^ c) & (2**64 - 1)).count("1") and simhash.simhash("") == 0


def test_gate(spark):
    rows = [("1", "What does the source text say here?", "fine answer", ""), ("2", "How do I restart the server?", "Run systemctl restart model-server now.", "Run systemctl restart model-server now."), ("3", "How do I restart the server?", None, "x"), ("4", "How do I restart it all?", "Use zorg --purge /var/lib/none", "nothing about that here")]
    got = {r["id"]: r for r in quality.gate(spark.createDataFrame(rows, "id string, instruction string, output string, context string")).collect()}
    assert [got[i]["quarantined"] for i in "1234"] == [True, False, True, True]
    assert got["2"]["score"] == 1.0 and got["3"]["score_reason"] == "answer too short" and got["4"]["score_reason"] == "ungrounded"


def test_append_new_adds_nothing_twice(spark, tmp_path):
    rows = spark.createDataFrame([(str(i), "x") for i in range(30)], "id string, text string")
    path = str(tmp_path / "records")
    assert [exports.append_new(rows, path), exports.append_new(rows, path)] == [30, 0]
    assert exports.append_new(spark.createDataFrame([(str(i), "y") for i in range(25, 40)], "id string, text string"), path) == 10
    assert exports.read_jsonl(spark, path, "id string, text string").count() == 40
