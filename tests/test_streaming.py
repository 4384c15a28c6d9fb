import os

from pyspark.sql import functions as F

from kestrel.sources import fixtures as fx
from kestrel.streaming import feed

SF = "/root/testdata/sf0.001"


def test_stream_equals_batch_over_file_splits(spark, scratch):
    """Three snapshot files, one micro-batch each; the third repeats a third
    of the keys with a finished status. The streamed upsert must equal the
    batch answer: first-seen immutable columns, last-seen status/winner."""
    orders = fx.read_table(spark, SF, "orders")
    src = os.path.join(scratch, "orders_parts")
    again = orders.filter("o_orderkey % 3 = 0").withColumn("o_orderstatus", F.lit("F"))
    orders.filter("o_orderkey % 3 = 0").write.parquet(f"{src}/part=0")
    orders.filter("o_orderkey % 3 = 1").write.parquet(f"{src}/part=1")
    orders.filter("o_orderkey % 3 = 2").unionByName(again).write.parquet(f"{src}/part=2")
    stream = spark.readStream.schema(orders.schema).option("maxFilesPerTrigger", 1) \
        .parquet(f"{src}/part=*/*.parquet")
    rows = fx.project_matches(stream).withColumn(
        "_seq", F.when(F.col("status") == "completed", 1).otherwise(0))   # a later line of the same poll
    got = {r["match_id"]: r.asDict() for r in feed.match_feed_table(spark, rows).collect()}
    first = {r["match_id"]: r.asDict() for r in fx.project_matches(orders).collect()}
    last_orders = orders.withColumn(
        "o_orderstatus", F.when(F.col("o_orderkey") % 3 == 0, F.lit("F")).otherwise(F.col("o_orderstatus")))
    last = {r["match_id"]: r.asDict() for r in fx.project_matches(last_orders).collect()}
    assert set(got) == set(first)
    for k, g in got.items():
        for c in ("name", "venue", "match_date", "team1", "team2", "toss_winner"):
            assert g[c] == first[k][c]
        assert (g["status"], g["winner"]) == (last[k]["status"], last[k]["winner"])
        assert g["source"] == "feed"


def test_scorecard_feed_appends_idempotent_batches(spark, scratch):
    import json
    from kestrel.operators import upsert as up
    from kestrel.sources import feed_json
    src = os.path.join(scratch, "cards")
    os.makedirs(src)
    for i in range(2):
        card = {"match_id": "9", "gamepackageJSON": {
            "scoring": [{"displayName": "A innings", "runs": str(100 + i), "wickets": "2", "overs": "12.0"}],
            "batting": [{"athlete": {"displayName": "P1"}, "team": {"displayName": "A"}, "runs": "40",
                         "ballsFaced": "20", "fours": "4", "sixes": "1", "strikeRate": "200.0"},
                        {"athlete": {"displayName": "P3"}, "team": {"displayName": "A"}, "runs": "x"}],
            "bowling": []}}
        with open(os.path.join(src, f"poll{i}.json"), "w") as f:
            f.write(json.dumps(card) + "\n")
    stream = spark.readStream.schema(feed_json.SCORECARD_SCHEMA).option("maxFilesPerTrigger", 1).json(src)
    base = os.path.join(scratch, "feed")
    q = feed.start_scorecard_feed(stream, innings_path=f"{base}/innings", stats_path=f"{base}/stats",
                                  rejects_path=f"{base}/rejects", checkpoint=f"{base}/_ck", available_now=True)
    q.awaitTermination()
    inn = spark.read.parquet(f"{base}/innings")
    assert sorted(r["runs"] for r in inn.collect()) == [100, 101]          # one line per poll (Q8)
    stats = spark.read.parquet(f"{base}/stats")
    assert stats.count() == 2                                              # P1 twice; P3 rejected
    latest = up.latest_snapshot(stats.select("match_id", "player_name", "runs", "_batch"),
                                ["match_id", "player_name"], ["_batch"])
    assert latest.count() == 1
    rej = spark.read.parquet(f"{base}/rejects/scorecards")
    assert {r["error_message"] for r in rej.collect()} == {"Cannot coerce runs: x"}


def test_windowed_quota_stream(spark, scratch):
    import datetime as dt
    t0 = dt.datetime(2024, 1, 1, 0, 0, 0)
    rows = [(i, t0 + dt.timedelta(seconds=s), 1) for i, s in enumerate([0, 10, 20, 70, 400])]
    src = os.path.join(scratch, "ev")
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long").write.parquet(src)
    ev = spark.readStream.schema("event_id long, ts timestamp, user_id long").parquet(src)
    out = os.path.join(scratch, "quota")
    q = (feed.windowed_quota(ev, period="60 seconds", slide="60 seconds").writeStream.format("parquet")
         .option("path", f"{out}/o").option("checkpointLocation", f"{out}/ck").trigger(availableNow=True).start())
    q.awaitTermination()
    got = {r["window_end"].second + 60 * r["window_end"].minute: r["in_window"]
           for r in spark.read.parquet(f"{out}/o").collect()}
    assert got == {60: 3, 120: 1}          # windows closed by the watermark (max ts 400 s - 2 min)


def test_a_later_poll_wins_within_and_across_batches(spark, scratch):
    dirs = {"table_path": f"{scratch}/t", "rejects_path": f"{scratch}/r", "checkpoint": f"{scratch}/c"}
    cols = "match_id string, name string, venue string, match_date string, team1 string, team2 string, " \
           "winner string, status string, fetched_at timestamp"

    def poll(minute, key, status, folder):
        import datetime as dt
        row = (key, "A vs B", "G", "2024-05-01", "A", "B", "", status, dt.datetime(2024, 5, 1, 10, minute))
        spark.createDataFrame([row], cols).write.mode("append").parquet(folder)
    src = f"{scratch}/src"
    for k in range(6):
        poll(1, str(k), "completed", src)
        poll(0, str(k), "Scheduled", src)
    stream = spark.readStream.schema(cols).parquet(src)
    first = feed.match_feed_table(spark, stream, dirs=dirs)
    assert {(r.match_id, r.status, r.fetched_at.minute) for r in first.collect()} == {(str(k), "completed", 1) for k in range(6)}
    import glob
    before = {f: os.path.getmtime(f) for f in glob.glob(f"{scratch}/t/batch=*/_part=*/*.parquet")}
    poll(5, "3", "abandoned", src)
    poll(0, "4", "late, but older", src)
    feed.match_feed_table(spark, spark.readStream.schema(cols).parquet(src), dirs=dirs)
    got = {r.match_id: (r.status, r.fetched_at.minute) for r in feed.read_table(spark, f"{scratch}/t").collect()}
    assert got == {**{str(k): ("completed", 1) for k in range(6)}, "3": ("abandoned", 5)}
    after = set(glob.glob(f"{scratch}/t/batch=*/_part=*/*.parquet"))
    assert set(before) <= after and 1 <= len(after - set(before)) <= 2   # only touched parts are written anew


def test_a_batch_lost_half_way_leaves_the_table_and_can_be_replayed(spark, scratch, monkeypatch):
    path = f"{scratch}/t"
    how = dict(table_path=path, rejects_path=f"{scratch}/r", key=["k"], immutable=["a"], mutable=["b"], order=["s"], validate=None, source="x")
    rows = lambda *r: spark.createDataFrame(list(r), "k int, a string, b string, s int")
    held = lambda: {r.k: (r.a, r.b) for r in feed.read_table(spark, path).collect()}
    feed.upsert_batch(rows(*[(k, "first", "one", 0) for k in range(40)]), 0, **how)
    before = held()
    write = feed.up.write_version

    def lost(*_):
        raise RuntimeError("driver lost")
    monkeypatch.setattr(feed.up, "write_version", lost)     # after the new partitions, before the commit
    import pytest
    with pytest.raises(RuntimeError):
        feed.upsert_batch(rows((1, "x", "two", 1), (99, "new", "two", 1)), 1, **how)
    assert held() == before
    monkeypatch.setattr(feed.up, "write_version", write)
    for _ in range(3):      # replays merge into themselves
        feed.upsert_batch(rows((1, "x", "two", 1), (99, "new", "two", 1)), 1, **how)
        assert held() == {**before, 1: ("first", "two"), 99: ("new", "two")}
    import glob
    named = {r["folder"] for r in feed._commit(spark, path)}
    folders = {os.path.basename(f) for f in glob.glob(f"{path}/batch=*")}
    assert named <= folders and len(folders) <= len(named) + 2      # old attempts are gone


def test_a_grown_table_gets_more_partitions(spark, scratch):
    path = f"{scratch}/t"
    how = dict(table_path=path, rejects_path=f"{scratch}/r", key=["k"], immutable=[], mutable=["b"], order=["s"], validate=None, source="x",
               partitions=2, partition_rows=20)
    for batch in range(3):
        feed.upsert_batch(spark.createDataFrame([(k, "v", batch) for k in range(30 * batch, 30 * batch + 30)], "k int, b string, s int"), batch, **how)
    assert {r["partitions"] for r in feed._commit(spark, path)} == {8}
    assert sorted(r.k for r in feed.read_table(spark, path).collect()) == list(range(90))


def test_two_polls_with_a_processing_time_trigger(spark, scratch):
    """The continuous poll: one micro-batch per interval, none overlap."""
    import time
    dirs = {"table_path": f"{scratch}/t", "rejects_path": f"{scratch}/r", "checkpoint": f"{scratch}/c"}
    schema = "k int, b string, fetched_at int, _seq int"
    src = f"{scratch}/src"
    spark.createDataFrame([(1, "first", 0, 0), (2, "first", 0, 0)], schema).write.parquet(f"{src}/p=0")
    q = feed.start_feed(spark.readStream.schema(schema).parquet(f"{src}/p=*"), key=["k"], immutable=[], mutable=["b"], interval="2 seconds", **dirs)
    try:
        def wait(want):
            for _ in range(300):
                t = feed.read_table(spark, dirs["table_path"])
                if t is not None and {r.k: r.b for r in t.collect()} == want:
                    return True
                time.sleep(0.2)
            return False
        assert wait({1: "first", 2: "first"}) and q.isActive
        spark.createDataFrame([(2, "second", 1, 0), (3, "second", 1, 0)], schema).write.parquet(f"{src}/p=1")
        assert wait({1: "first", 2: "second", 3: "second"})
        q.processAllAvailable()     # the second batch's progress is noted after its commit
        batches = [p["batchId"] for p in q.recentProgress if p["numInputRows"]]
        assert len(batches) == 2 and feed.POLL_INTERVAL == "60 seconds"
    finally:
        q.stop()


def _late_events(spark, scratch):
    import datetime as dt
    t0 = dt.datetime(2024, 1, 1)
    polls = [[(0, 0, 1), (1, 50, 1), (2, 59, 2)], [(3, 60, 1), (4, 110, 1), (5, 30, 1)], [(6, 300, 1)],
             [(7, 40, 1), (8, 290, 1), (9, 301, 1), (10, 300, 1)]]       # (7: later than the watermark)
    src = f"{scratch}/ev"
    for k, rows in enumerate(polls):
        at = os.path.join(src, f"poll={k}")
        spark.createDataFrame([(i, t0 + dt.timedelta(seconds=s), u) for i, s, u in rows], "event_id long, ts timestamp, user_id long") \
            .coalesce(1).write.parquet(at)
        for f in os.listdir(at):
            os.utime(os.path.join(at, f), (1_700_000_000 + 10 * k,) * 2)
    return src


def test_exact_quota_on_a_stream_is_that_of_the_batch(spark, scratch):
    """One poll per micro-batch, events out of order: the counts given out last are those
    of W10 over all events that were in time; a too late one is left out."""
    from kestrel.operators import requests as rq
    src = _late_events(spark, scratch)
    schema = "event_id long, ts timestamp, user_id long"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{src}/poll=*")
    dirs = {"table_path": f"{scratch}/t", "rejects_path": f"{scratch}/r", "checkpoint": f"{scratch}/c"}
    feed.exact_quota_table(stream, dirs).awaitTermination()
    got = {r.event_id: (r.user_id, r.in_window, r.remaining) for r in feed.read_table(spark, dirs["table_path"]).collect()}
    log = spark.read.schema(schema).parquet(f"{src}/poll=*").where("event_id <> 7")
    want = {r.event_id: (r.user_id, r.in_window, r.remaining) for r in rq.requests_in_window(log).collect()}
    assert got == want and got[1][1] == 3 and got[10][1] == 3


def test_windows_of_a_quota_table_over_polls_are_those_of_brute_force(spark, scratch):
    """A request is held twice however many windows it lies in; open windows are there, with later requests of
    the same span added; keys may be null."""
    import datetime as dt
    t0 = dt.datetime(2024, 1, 1, 0, 0, 30)
    polls = [[(0, 0.0, 1), (1, 0.5, 1), (2, 59.9, None), (3, 61, 2)], [(4, 65, 1), (5, 20, 1), (6, 60, None), (7, 119.999, 2)]]
    src = os.path.join(scratch, "ev")
    schema = "event_id long, ts timestamp, user_id long"
    for k, rows in enumerate(polls):
        at = os.path.join(src, f"poll={k}")
        spark.createDataFrame([(i, t0 + dt.timedelta(seconds=s), u) for i, s, u in rows] + [(100 + k, None, 1)], schema).coalesce(1).write.parquet(at)
        for f in os.listdir(at):
            os.utime(os.path.join(at, f), (1_700_000_000 + 10 * k,) * 2)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{src}/poll=*")
    for period, slide in ((60, 1), (10, 4)):
        at = f"{scratch}/{period}"
        dirs = {"table_path": f"{at}/t", "rejects_path": f"{at}/r", "checkpoint": f"{at}/c"}
        feed.quota_table(stream, dirs, period=f"{period} seconds", slide=f"{slide} seconds").awaitTermination()
        assert feed.read_table(spark, dirs["table_path"]).count() <= 2 * 8
        got = {(r.window_end, r.user_id): (r.in_window, r.remaining) for r in feed.read_quota(spark, dirs["table_path"]).collect()}
        want = {}
        base = dt.datetime(2024, 1, 1)
        for _, s, u in sum(polls, []):
            at_s = 30 + s
            for k in range(-100, 200):      # window starts are multiples of the slide since 1970, and so since midnight
                if k * slide <= at_s < k * slide + period:
                    end = base + dt.timedelta(seconds=k * slide + period)
                    want[(end, u)] = want.get((end, u), 0) + 1
        assert got == {k: (n, 10 - n) for k, n in want.items()}


def test_exact_quota_counts_many_keys_in_few_groups(spark, scratch, monkeypatch):
    """Text and null keys, equal times, requests across the ends of buckets: the counts of W10; the
    number of groups follows the time covered, not the keys."""
    import datetime as dt

    from kestrel.operators import requests as rq
    monkeypatch.setattr(feed, "QUOTA_PARTS", 2)
    monkeypatch.setattr(feed, "QUOTA_PERIODS", 2)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(k, t0 + dt.timedelta(seconds=(k * 37) % 600, microseconds=k % 3), None if k % 7 == 0 else f"u{k % 5}") for k in range(400)]
    src, schema = os.path.join(scratch, "ev"), "event_id long, ts timestamp, user_id string"
    spark.createDataFrame(rows + [(999, None, "u1")], schema).coalesce(1).write.parquet(src)
    dirs = {"table_path": f"{scratch}/t", "rejects_path": f"{scratch}/r", "checkpoint": f"{scratch}/c"}
    q = feed.exact_quota_table(spark.readStream.schema(schema).parquet(src), dirs)
    q.awaitTermination()
    got = {r.event_id: (r.user_id, r.in_window, r.remaining) for r in feed.read_table(spark, dirs["table_path"]).collect()}
    want = {r.event_id: (r.user_id, r.in_window, r.remaining) for r in rq.requests_in_window(spark.createDataFrame(rows, schema)).collect()}
    assert got == want and len(got) == 400
    states = max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["numInputRows"])
    assert states <= 2 * 6


def test_a_dense_log_is_held_in_few_rows_and_its_state_on_disk(spark, scratch):
    """Many keys in one span share its rows; the counts are those of brute force."""
    import datetime as dt
    t0 = dt.datetime(2024, 1, 1)
    rows = [(k, t0 + dt.timedelta(seconds=(k * 7) % 60, microseconds=k % 5), None if k % 501 == 0 else f"u{k % 900}") for k in range(2000)]
    src, schema = os.path.join(scratch, "ev"), "event_id long, ts timestamp, user_id string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(src)
    dirs = {"table_path": f"{scratch}/t", "rejects_path": f"{scratch}/r", "checkpoint": f"{scratch}/c"}
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    q = feed.quota_table(spark.readStream.schema(schema).parquet(src), dirs, slide="20 seconds")
    q.awaitTermination()
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    state = [p["stateOperators"][0] for p in q.recentProgress if p["numInputRows"]][0]
    assert any(k.startswith("rocksdb") for k in state["customMetrics"])
    assert feed.read_table(spark, dirs["table_path"]).count() <= 2 * feed.SPAN_PARTS        # one row per key and span: 1,800
    got = {(r.window_end, r.user_id): (r.in_window, r.remaining) for r in feed.read_quota(spark, dirs["table_path"]).collect()}
    want = {}
    for _, t, u in rows:
        for k in range(-3, 3):
            if t0 + dt.timedelta(seconds=20 * k) <= t < t0 + dt.timedelta(seconds=20 * k + 60):
                end = t0 + dt.timedelta(seconds=20 * k + 60)
                want[(end, u)] = want.get((end, u), 0) + 1
    assert got == {k: (n, max(0, 10 - n)) for k, n in want.items()}


def test_a_quota_stream_without_times_leaves_no_table(spark, scratch):
    schema = "event_id long, ts timestamp, user_id long"
    src = os.path.join(scratch, "ev")
    spark.createDataFrame([(1, None, 1)], schema).write.parquet(src)
    dirs = {"table_path": f"{scratch}/t", "rejects_path": f"{scratch}/r", "checkpoint": f"{scratch}/c"}
    feed.quota_table(spark.readStream.schema(schema).parquet(src), dirs).awaitTermination()
    assert feed.read_quota(spark, dirs["table_path"]) is None


def test_windows_unfold_in_blocks(monkeypatch):
    import pyarrow as pa
    from kestrel.streaming import spans
    held = [[{"key": 1, "at": 100}, {"key": 2, "at": 101}, {"key": 1, "at": 103}], [{"key": None, "at": 110}]]
    kind = pa.list_(pa.struct([("key", pa.int64()), ("at", pa.int64())]))
    batch = pa.RecordBatch.from_arrays([pa.array([96, 108]), pa.array(held, kind), pa.array([10, 10]), pa.array([4, 4])], names=["begin", "requests", "p", "s"])
    whole = [r for b in spans.unfold([batch]) for r in b.to_pylist()]
    monkeypatch.setattr(spans, "SPAN_CELLS", 1)     # a key at a time
    assert [r for b in spans.unfold([batch]) for r in b.to_pylist()] == whole
    want = {(b + 4 * i, k["key"]): sum(b + 4 * i <= x["at"] < b + 4 * i + 10 and x["key"] == k["key"] for x in row)
            for b, row in zip((96, 108), held) for k in row for i in range(3)}
    assert {(r["_begin"], r["_key"]): r["_n"] for r in whole} == {k: n for k, n in want.items() if n} and len(whole) == sum(n > 0 for n in want.values())


def test_the_scorecard_feed_packs_its_payloads_and_holds_no_lines(spark, monkeypatch):
    """Payload files are packed, a poll's lines are not held by the executors, and nothing of them stays."""
    import glob

    from kestrel.operators import quality
    from kestrel.plans import catalog
    held, split = [], quality.split_valid
    before = set(spark.sparkContext._jsc.sc().getPersistentRDDs().keys().mkString(",").split(","))

    def watched(checked, *a):
        if "economy" in checked.columns and "match_date" not in checked.columns:
            held.append(set(spark.sparkContext._jsc.sc().getPersistentRDDs().keys().mkString(",").split(",")) - before)
        return split(checked, *a)
    monkeypatch.setattr(quality, "split_valid", watched)
    paths = catalog._scorecard_feed(spark, SF)
    base = os.path.dirname(paths["innings_path"]).removeprefix("file:")
    assert held == [set(), set()]
    files = [f for f in glob.glob(f"{base}/payloads/**", recursive=True) if os.path.isfile(f) and "part-" in f]
    assert files and all(f.endswith(".json.gz") for f in files)
    assert not glob.glob(f"{base}/**/_lines/batch=*", recursive=True)
    polls = spark.read.parquet(paths["innings_path"]).groupBy("_batch").count().collect()
    assert sorted(r["_batch"] for r in polls) == [0, 1] and len({r["count"] for r in polls}) == 1
