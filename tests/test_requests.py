import datetime as dt

from hypothesis import given, settings
from hypothesis import strategies as st

from kestrel.operators import requests as rq

T0 = dt.datetime(2024, 1, 1, 23, 50, 0)


def _log(spark, rows):
    return spark.createDataFrame([(i, T0 + dt.timedelta(seconds=s), k) for i, (s, k) in enumerate(rows)],
                                 "event_id long, ts timestamp, user_id long")


def test_ttl_anchor(spark):
    # t = 0, 200, 301, 500 -> miss, hit, miss, hit (anchored at the computing request)
    r = rq.ttl_cache_hits(_log(spark, [(0, 1), (200, 1), (301, 1), (500, 1)])).orderBy("event_id").collect()
    assert [x["cache_hit"] for x in r] == [False, True, False, True]
    s = rq.cache_stats(rq.ttl_cache_hits(_log(spark, [(0, 1), (200, 1), (301, 1), (500, 1)]))).collect()[0]
    assert (s["hits"], s["misses"], s["hit_rate"]) == (2, 2, 50.0)


def brute_ttl(rows, ttl=300):
    out, anchor = {}, {}
    for i, (s, k) in sorted(enumerate(rows), key=lambda x: (x[1][0], x[0])):
        a = anchor.get(k)
        if a is None or s - a > ttl:
            anchor[k] = s
            out[i] = False
        else:
            out[i] = True
    return out


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3 * 86400), st.integers(0, 2)), min_size=1, max_size=60))
def test_ttl_matches_brute_force_across_days(spark, rows):
    got = {r["event_id"]: r["cache_hit"] for r in rq.ttl_cache_hits(_log(spark, rows)).collect()}
    assert got == brute_ttl(rows)


def test_quota_never_negative(spark):
    rows = [(i * 5, 7) for i in range(11)] + [(200, 7)]
    r = rq.requests_in_window(_log(spark, rows)).orderBy("event_id").collect()
    assert [x["in_window"] for x in r] == list(range(1, 12)) + [1]
    assert r[10]["remaining"] == 0 and r[11]["remaining"] == 9


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 400), st.integers(0, 1)), min_size=1, max_size=50))
def test_quota_matches_brute_force(spark, rows):
    got = {r["event_id"]: r["in_window"] for r in rq.requests_in_window(_log(spark, rows)).collect()}
    want = {i: sum(1 for s2, k2 in rows if k2 == k and s - 60 < s2 <= s) for i, (s, k) in enumerate(rows)}
    assert got == want


def test_groups_split_across_arrow_batches(spark):
    """Groups larger than an Arrow batch are carried over between batches."""
    rows = [(s * 37 % 900, k) for k in range(3) for s in range(25)]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        got = {r["event_id"]: r["cache_hit"] for r in rq.ttl_cache_hits(_log(spark, rows)).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got == brute_ttl(rows)
