"""Request-log operators, re-aimed from the reference's in-process cache and
rate limiter onto an event log (T5 anchored TTL de-duplication, A21 hit
ratio, W10 trailing quota).

T5 is the only operator whose state is order-dependent in a way no window
expresses: the first request for a key computes (miss) at time A, later
requests with t - A <= ttl reuse it (hit), the first one after that is a
miss and becomes the new anchor. It is solved exactly in three passes, each
bounded by one key-day (never one whole key):

1. per (key, day), in pandas: next(i) = first request with t > t_i + ttl and
   the chain end reached from each request that could be the day's first
   miss (only requests within ``ttl`` of the day start can be affected by an
   anchor set on an earlier day);
2. per key over the small per-day summaries (one row per active day): carry
   the anchor across days and pick each day's first miss;
3. per (key, day): walk next() from that first miss and mark the misses.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrel.operators.grouped import sorted_group_map

# Cache lifetime and the request quota (calls per period).
CACHE_TTL_SECONDS = 300
QUOTA_MAX_CALLS = 10
QUOTA_PERIOD_SECONDS = 60
_US = 1_000_000


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def _prep(log: DataFrame, key: str, ts: str, rid: str) -> DataFrame:
    return log.select(F.col(key).alias("_k"), F.col(rid).alias("_id"), _micros(ts).alias("_t"),
                      F.to_date(F.col(ts).cast("timestamp")).alias("_day"))


def _next_index(t: np.ndarray, ttl_us: int) -> np.ndarray:
    return np.searchsorted(t, t + ttl_us, side="right")


def _pass1(b: pd.DataFrame, bounds, ttl_us: int) -> pd.DataFrame:
    """Per key-day: candidate first misses and the chain end of each."""
    t_all = b["_t"].to_numpy(np.int64)
    ds_all = b["_day_start"].to_numpy(np.int64)
    keys, days, cts, ends = [], [], [], []
    for s, e in bounds:
        t = t_all[s:e]
        n = e - s
        nxt = _next_index(t, ttl_us)
        root = np.arange(n)
        for i in range(n - 1, -1, -1):       # chain end of every start, one reverse pass
            if nxt[i] < n:
                root[i] = root[nxt[i]]
        k = int(np.searchsorted(t, ds_all[s] + ttl_us, side="right"))
        cand = np.arange(min(k + 1, n))
        keys.append(b["_k"].iat[s])
        days.append(b["_day"].iat[s])
        cts.append(t[cand].tolist())
        ends.append(t[root[cand]].tolist())
    return pd.DataFrame({"_k": keys, "_day": days, "cand_t": cts, "cand_end_t": ends})


def _pass2(b: pd.DataFrame, bounds, ttl_us: int) -> pd.DataFrame:
    """Per key over its days in order: carry the anchor, pick first misses."""
    first = np.full(len(b), -1, dtype=np.int32)
    cand_t, cand_end = b["cand_t"].to_numpy(), b["cand_end_t"].to_numpy()
    for s, e in bounds:
        anchor = None
        for r in range(s, e):
            ct = np.asarray(list(cand_t[r]), dtype=np.int64)
            f = 0 if anchor is None else int(np.searchsorted(ct, anchor + ttl_us, side="right"))
            if f < len(ct):
                anchor = int(cand_end[r][f])
                first[r] = f                     # otherwise the whole day reuses the anchor
    return pd.DataFrame({"_k": b["_k"], "_day": b["_day"], "_first": first})


def _pass3(b: pd.DataFrame, bounds, ttl_us: int) -> pd.DataFrame:
    """Per key-day: walk next() from the first miss."""
    t_all = b["_t"].to_numpy(np.int64)
    first_all = b["_first"].to_numpy()
    miss = np.zeros(len(b), dtype=bool)
    for s, e in bounds:
        t = t_all[s:e]
        nxt = _next_index(t, ttl_us)
        i = int(first_all[s])
        while 0 <= i < e - s:
            miss[s + i] = True
            i = int(nxt[i])
    return pd.DataFrame({"_id": b["_id"], "cache_hit": ~miss})


def ttl_cache_hits(log: DataFrame, key: str = "user_id", ts: str = "ts", rid: str = "event_id",
                   ttl_seconds: int = CACHE_TTL_SECONDS) -> DataFrame:
    """T5: (rid, cache_hit) for every request of the log."""
    ttl_us = ttl_seconds * _US
    ev = _prep(log, key, ts, rid).withColumn("_day_start", F.unix_micros(F.col("_day").cast("timestamp")))
    key_type = ev.schema["_k"].dataType.simpleString()
    id_type = ev.schema["_id"].dataType.simpleString()
    summ = sorted_group_map(ev, ["_k", "_day"], ["_t", "_id"], lambda p, bd: _pass1(p, bd, ttl_us),
                            f"_k {key_type}, _day date, cand_t array<bigint>, cand_end_t array<bigint>")
    firsts = sorted_group_map(summ, ["_k"], ["_day"], lambda p, bd: _pass2(p, bd, ttl_us),
                              f"_k {key_type}, _day date, _first int")
    marked = sorted_group_map(ev.join(firsts, ["_k", "_day"], "inner"), ["_k", "_day"], ["_t", "_id"],
                              lambda p, bd: _pass3(p, bd, ttl_us), f"_id {id_type}, cache_hit boolean")
    return marked.select(F.col("_id").alias(rid), "cache_hit")


def cache_stats(hits: DataFrame) -> DataFrame:
    """Hits, misses and hit_rate = round(hits / total * 100, 1) (0 if
    there were no requests)."""
    a = hits.agg(F.count_if(F.col("cache_hit")).alias("hits"), F.count_if(~F.col("cache_hit")).alias("misses"))
    total = F.col("hits") + F.col("misses")
    rate = F.when(total > 0, F.rint(F.col("hits") * F.lit(1000.0) / total) / F.lit(10.0)).otherwise(F.lit(0.0))
    return a.select("hits", "misses", rate.alias("hit_rate"))


def requests_in_window(log: DataFrame, key: str = "user_id", ts: str = "ts", rid: str = "event_id",
                       period_seconds: int = QUOTA_PERIOD_SECONDS,
                       max_calls: int = QUOTA_MAX_CALLS) -> DataFrame:
    """For every request, the requests of its key in the trailing
    period (t - period, t] and the remaining quota max(0, max - n).

    Balanced for hot keys: rows are bucketed by (key, period-wide bucket);
    each row is also copied once into the next bucket as look-back (halo),
    so the range window runs per (key, bucket) and never over a whole key.
    """
    p_us = period_seconds * _US
    ev = log.select(F.col(key).alias("_k"), F.col(rid).alias("_id"), _micros(ts).alias("_t"))
    ev = ev.withColumn("_b", F.floor(F.col("_t") / F.lit(p_us)).cast("long"))
    own = ev.withColumn("_own", F.lit(True))
    halo = ev.withColumn("_b", F.col("_b") + 1).withColumn("_own", F.lit(False))
    both = own.unionByName(halo)
    w = Window.partitionBy("_k", "_b").orderBy("_t").rangeBetween(-(p_us - 1), 0)
    counted = both.withColumn("_n", F.count(F.lit(1)).over(w)).filter(F.col("_own"))
    return counted.select(F.col("_id").alias(rid), F.col("_k").alias(key), F.col("_n").alias("in_window"),
                          F.greatest(F.lit(0), F.lit(max_calls) - F.col("_n")).cast("long").alias("remaining"))
