import os

import duckdb

import __spark_entry__ as entry
from corvane.operators import groups


def test_page_key(spark):
    same = ["https://Docs.Example/a/b", "http://docs.example:80/a/b/", "https://docs.example:443/a/b?utm_source=x&utm_campaign=y#z"]
    other = ["https://docs.example/a/B", "https://docs.example:8080/a/b", "https://docs.example/a/b?page=2&utm_source=x", "file:///a/b"]
    rows = spark.createDataFrame([(u,) for u in same + other + ["", "  ", None]], "u string")
    got = [r[0] for r in rows.select(groups.page(rows.u)).collect()]
    assert len(set(got[:3])) == 1 and len(set(got)) == 6 and got[-3:] == [None, None, None]


def test_label_follows_long_chains(spark):
    # a chain of 200 records in mixed order of ids, a hub of 50, and one alone
    order = sorted(range(200), key=lambda i: (i * 37) % 101 * 1000 + i)
    chain = [(f"r{order[i]:03d}", f"k{j}") for i in range(200) for j in (i, i + 1)]
    hub = [(f"s{i:02d}", "hub") for i in range(50)]
    links = spark.createDataFrame(chain + hub + [("t", None)], "id string, key string")
    got = dict(map(tuple, groups.label(links).collect()))
    assert got == {f"r{i:03d}": "r000" for i in range(200)} | {f"s{i:02d}": "s00" for i in range(50)} | {"t": "t"}


def test_assign_keeps_groups_and_shares(spark):
    rows = [(f"{g}-{i}", f"g{g}") for g in range(300) for i in range(100 if g == 0 else 1 + g % 4)]
    sides = dict(map(tuple, groups.assign(spark.createDataFrame(rows, "id string, group_id string")).collect()))
    assert len(sides) == len(rows)
    assert all(len({sides[i] for i, g in rows if g == f"g{k}"}) == 1 for k in range(300))
    for side, share in groups.SHARES.items():
        assert abs(sum(s == side for s in sides.values()) - share * len(rows)) <= 1


def test_p2_found_matches_sql(spark, sf):
    got = {tuple(r) for r in entry.queries()["p2_found"](spark, sf).collect()}
    db = duckdb.connect()
    db.sql(f"create view records as from '{os.path.join(sf, 'records.parquet')}'")
    assert got and got == set(db.sql(entry.oracle_sql()["p2_found"]).fetchall())


def test_p2_split_divides_no_group(spark, sf):
    _, grouped = groups.linked(spark.read.parquet(f"{sf}/records.parquet"))
    split = entry.queries()["p2_split"](spark, sf)
    assert grouped.join(split, "id").groupBy("group_id").agg({"split": "count"}).count() > 1
    assert grouped.join(split, "id").select("group_id", "split").distinct().groupBy("group_id").count().where("count > 1").isEmpty()
    assert split.count() == grouped.count()


def test_assign_spreads_labels_evenly(spark):
    rows = [(f"{g}-{i}", f"g{g}", "abc"[g % 3] if i else None) for g in range(600) for i in range(1 + g % 5)]
    grouped = spark.createDataFrame([r[:2] for r in rows], "id string, group_id string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "id string, label string")
    split = groups.assign(grouped, labels=labels)
    sides = dict(map(tuple, split.collect()))
    assert len(sides) == len(rows) and all(len({sides[i] for i, g, _ in rows if g == f"g{k}"}) == 1 for k in range(0, 600, 7))
    for r in groups.report(split, labels).collect():
        assert abs(r["share"] - r["target"]) < 0.01 and r["deviation"] < 0.06
    none = spark.createDataFrame([], "id string, group_id string")
    assert groups.assign(none).count() == 0 and groups.assign(none, labels=labels).count() == 0
