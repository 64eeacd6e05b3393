import json

from corvane.functions import chunking
from corvane.operators import structure, web
from corvane.sources import files
from corvane.streaming import refresh


def test_files_become_documents(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / ".git").mkdir()
    (tmp_path / "a/my_first-note.md").write_text("# Note\n\n" + "text of the note, " * 5)
    (tmp_path / "a/t.csv").write_text("key,value\nalpha,1\nbeta,2\ngamma with a longer name,3\n")
    (tmp_path / "a/j.json").write_text(json.dumps({"key": "a value that is long enough to be kept"}))
    (tmp_path / "a/short.txt").write_text("short")
    (tmp_path / "a/x.bin").write_text("x" * 100)
    (tmp_path / ".git/y.md").write_text("y" * 100)
    rows = {r["title"]: r for r in files.collect(spark, [{"type": "files", "name": "notes", "path": str(tmp_path)}, {"type": "files", "path": str(tmp_path / "none")}, {"type": "other"}, {"type": "files", "enabled": False, "path": "/"}]).collect()}
    assert set(rows) == {"my first note", "t", "j"} and rows["t"]["text"].startswith("key | value\n-----") and rows["j"]["source"] == "notes"
    assert files.collect(spark, [{"type": "files", "name": "notes", "path": str(tmp_path)}], only="else").count() == 0


def test_chunks_keep_headings_and_sizes():
    text = "# Top\n\nIntro words.\n\n## First\n\n" + "A sentence of the first part. " * 30 + "\n\nSecond\n------\n\n" + "word " * 400
    got = chunking.chunks(text, 300, 40, 50)
    assert {h for h, _ in got} == {"Top › First", "Top › Second"} and all(len(t) <= 380 for _, t in got)
    assert chunking.chunks("   ", 300, 40, 50) == [] and len(chunking.chunks("short", 300, 40, 50)) == 1
    assert "".join(got[-1][1].split())[-4:] == "word"


def test_chunk_ids_are_stable_and_unique(spark):
    docs = spark.createDataFrame([("a", "# T\n\n" + "Some words here. " * 300), ("b", None), ("c", "")], "id string, text string")
    one, two = (sorted(r["id"] for r in structure.chunk(docs).collect()) for _ in range(2))
    assert one == two and len(set(one)) == len(one) > 1


def test_crawl_stops_at_depth(spark):
    edges = spark.createDataFrame([(str(i), str(i + 1)) for i in range(9)] + [("3", "0")], "url string, target string")
    got = dict(map(tuple, web.crawl(spark.createDataFrame([("0",)], "url string"), edges, 4).collect()))
    assert got == {str(i): i for i in range(5)}


def test_refresh_takes_each_document_once(spark, tmp_path):
    inbox, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    (tmp_path / "in").mkdir()
    write = lambda n, ids: (tmp_path / f"in/{n}.json").write_text("".join(json.dumps({"id": i, "text": f"text of {i} " * 30}) + "\n" for i in ids))
    write(1, ["a", "b"])
    refresh.refresh(spark, inbox, out, ck, full_every=2).awaitTermination()
    write(2, ["c"])
    try:
        refresh.refresh(spark, inbox, out, ck, healthy=lambda: False, full_every=2).awaitTermination()
        raise AssertionError("an unhealthy batch must fail")
    except Exception as e:
        assert "not healthy" in str(e)
    refresh.refresh(spark, inbox, out, ck, full_every=2).awaitTermination()
    rows = spark.read.option("basePath", out).parquet(f"{out}/batch=*").collect()
    assert sorted(r["doc_id"] for r in rows) == ["a", "b", "c"] and spark.read.parquet(f"{out}/full").count() == 3
