from kestrel.operators import upsert as up


def test_upsert_keeps_first_seen_and_takes_latest(spark):
    cur = spark.createDataFrame([("m1", "Old name", "live", None, 0), ("m2", "Other", "done", "A", 0)],
                                "match_id string, name string, status string, winner string, seq int")
    new = spark.createDataFrame([("m1", "New name", "Result", "B", 1), ("m3", "Third", "live", None, 1)],
                                "match_id string, name string, status string, winner string, seq int")
    r = {x["match_id"]: x for x in up.upsert(cur, new, ["match_id"], ["name"], ["status", "winner"],
                                             ["seq"]).collect()}
    assert (r["m1"]["name"], r["m1"]["status"], r["m1"]["winner"]) == ("Old name", "Result", "B")
    assert r["m2"]["status"] == "done" and r["m3"]["name"] == "Third"


def test_latest_snapshot(spark):
    df = spark.createDataFrame([("k", 1, "a"), ("k", 3, "c"), ("k", 2, "b"), ("j", 1, "z")],
                               "key string, t int, v string")
    r = {x["key"]: x["v"] for x in up.latest_snapshot(df, ["key"], ["t"]).collect()}
    assert r == {"k": "c", "j": "z"}


def test_versioned_tables_and_load_once(spark, scratch):
    path = f"{scratch}/tbl"
    assert up.read_current(spark, path) is None
    df = spark.createDataFrame([(1,)], "x int")
    assert up.load_once(path, spark, lambda: df) is True
    assert up.load_once(path, spark, lambda: df) is False
    up.replace_table(spark.createDataFrame([(2,), (3,)], "x int"), path)
    assert up.versions(spark, path) == [0, 1]
    assert sorted(r["x"] for r in up.read_current(spark, path).collect()) == [2, 3]


def test_fk_split(spark):
    child = spark.createDataFrame([(1, "a"), (2, "b")], "match_id int, v string")
    parent = spark.createDataFrame([(1,)], "match_id int")
    ok, orphans = up.fk_split(child, parent, "match_id")
    assert [r["v"] for r in ok.collect()] == ["a"] and [r["v"] for r in orphans.collect()] == ["b"]
