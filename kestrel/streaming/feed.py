"""Feed ingestion with Structured Streaming (T1 poll trigger, T2 incremental
upsert, T3 quarantine of invalid rows, T4 append vs latest-snapshot; C18).

Each poll becomes part of a micro-batch of a file stream of snapshots.
``foreachBatch`` validates the batch, reduces it to one row per key (the later
poll wins, also within a batch) and upserts the result into the keyed table
(K1). The table is hash-partitioned by key and only the partitions that the
batch touches are read and written anew, so a poll costs what it brings, not the
table. New partitions go to a folder of the attempt; a commit (a small table that
names the folder of every partition) makes them current once it is complete, and
folders that neither of the last two commits names are deleted. So a driver may be
lost at any point: what the last commit names is untouched until the next one
stands. Replaying a batch is idempotent: its rows merge into themselves. Rejects of
batch N have their own folder. Micro-batches never overlap: one poll at a time.
"""

from __future__ import annotations

import contextlib
import os
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kestrel.operators import quality
from kestrel.operators import upsert as up
from kestrel.session import ensure_checkpoint_dir, ship_package
from kestrel.streaming.spans import unfold

# Fixed value: the reference polls every 60 seconds.
POLL_INTERVAL = "60 seconds"


# A table begins with so many hash partitions; it is dealt anew over twice as many
# whenever they hold more than PARTITION_ROWS rows on average.
TABLE_PARTITIONS = 16
PARTITION_ROWS = 1_000_000
PARTITION = "_part"
_COMMIT = "part int, folder string, n bigint, partitions int"


def _commit(spark: SparkSession, path: str) -> list:
    """The rows of the last complete commit: one per partition with rows."""
    done = up.versions(spark, f"{path.rstrip('/')}/_commits")
    return spark.read.schema(_COMMIT).parquet(up.version_path(f"{path.rstrip('/')}/_commits", done[-1])).collect() if done else []


def _read_parts(spark: SparkSession, path: str, rows: list) -> DataFrame:
    return spark.read.parquet(*[f"{path.rstrip('/')}/{r['folder']}/{PARTITION}={r['part']}" for r in rows])


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The keyed table at ``path`` (None before its first rows)."""
    rows = _commit(spark, path)
    return _read_parts(spark, path, rows) if rows else None


def _write_parts(df: DataFrame, path: str, batch_id: int, key: Sequence[str], partitions: int, others: list) -> list:
    """Write ``df`` to a new folder, commit it together with the partitions in
    ``others``, and return the commit's rows."""
    spark = df.sparkSession
    root, folder = path.rstrip("/"), f"batch={batch_id:08d}-{uuid.uuid4().hex[:8]}"
    df.withColumn(PARTITION, F.pmod(F.xxhash64(*key), F.lit(partitions)).cast("int")).repartition(PARTITION) \
        .write.partitionBy(PARTITION).parquet(f"{root}/{folder}")
    fs, p = up._fs(spark, f"{root}/{folder}")
    if not any(x.getPath().getName().startswith(f"{PARTITION}=") for x in fs.listStatus(p)):
        return others                                                                       # no rows: nothing to commit
    sizes = spark.read.parquet(f"{root}/{folder}").groupBy(PARTITION).count().collect()     # at most ``partitions``
    rows = [(r["part"], r["folder"], r["n"], partitions) for r in others] + [(r[PARTITION], folder, r["count"], partitions) for r in sizes]
    done = up.versions(spark, f"{root}/_commits")
    up.write_version(spark.createDataFrame(rows, _COMMIT).coalesce(1), f"{root}/_commits", done[-1] + 1 if done else 0)
    _sweep(spark, root)
    return _commit(spark, root)


def _grow(spark: SparkSession, path: str, batch_id: int, key: Sequence[str], partitions: int, partition_rows: int, rows: list) -> None:
    """Deal the table (``rows``: its last commit) over twice as many partitions if they hold too many rows."""
    if sum(r["n"] for r in rows) > partitions * partition_rows:
        _write_parts(_read_parts(spark, path, rows), path, batch_id, key, 2 * partitions, [])


def _sweep(spark: SparkSession, root: str) -> None:
    """Delete the folders that neither of the last two commits names."""
    done = up.versions(spark, f"{root}/_commits")
    named = {r["folder"] for v in done[-2:] for r in
             spark.read.schema(_COMMIT).parquet(up.version_path(f"{root}/_commits", v)).select("folder").distinct().collect()}
    fs, p = up._fs(spark, root)
    old = [s.getPath() for s in fs.listStatus(p) if s.getPath().getName().startswith("batch=") and s.getPath().getName() not in named]
    old += [up._fs(spark, up.version_path(f"{root}/_commits", v))[1] for v in done[:-2]]
    for folder in old:
        fs.delete(folder, True)


def upsert_batch(batch: DataFrame, batch_id: int, *, table_path: str, rejects_path: str, key: Sequence[str],
                 immutable: Sequence[str], mutable: Sequence[str], order: Sequence[str],
                 validate: Callable[[DataFrame], DataFrame] | None, source: str,
                 partitions: int = TABLE_PARTITIONS, partition_rows: int = PARTITION_ROWS, one_per_key: bool = False) -> None:
    """``order`` ranks the snapshots of a key (fetch time, then place in the
    payload); the batch number comes after the first of them, so that of equally
    old snapshots the later batch wins. A table's first batch is written in one pass, never
    held, if it is known to have one row per key and needs no validation."""
    spark = batch.sparkSession
    b = batch.withColumn("_batch", F.lit(batch_id).cast("long"))
    rank = [order[0], "_batch", *order[1:]]
    if one_per_key and validate is None and not _commit(spark, table_path):
        rows = _write_parts(b.select(*key, *immutable, *mutable, *rank), table_path, batch_id, key, partitions, [])
        _grow(spark, table_path, batch_id, key, partitions, partition_rows, rows)
        return
    batch.persist()
    try:
        if validate is not None:
            valid, rejects = quality.split_valid(validate(b), source, b.columns)
            rejects.write.mode("overwrite").parquet(f"{rejects_path.rstrip('/')}/batch={batch_id:08d}")
        else:
            valid = b
        held = _commit(spark, table_path)
        partitions = held[0]["partitions"] if held else partitions
        new = up.upsert(None, valid, key, immutable, mutable, rank).persist()
        part = F.pmod(F.xxhash64(*key), F.lit(partitions)).cast("int")
        touched = {r[0] for r in new.select(part).distinct().collect()}   # at most ``partitions``
        if touched:
            mine, others = [r for r in held if r["part"] in touched], [r for r in held if r["part"] not in touched]
            current = _read_parts(spark, table_path, mine) if mine else None
            merged = new if current is None else up.upsert(current, new, key, immutable, mutable, rank)   # ``new`` has one row per key
            rows = _write_parts(merged, table_path, batch_id, key, partitions, others)
            _grow(spark, table_path, batch_id, key, partitions, partition_rows, rows)
        new.unpersist()
    finally:
        batch.unpersist()


def start_feed(stream: DataFrame, *, table_path: str, rejects_path: str, checkpoint: str, key: Sequence[str],
               immutable: Sequence[str], mutable: Sequence[str], order: Sequence[str] = ("fetched_at", "_seq"),
               validate: Callable[[DataFrame], DataFrame] | None = None, source: str = "feed",
               available_now: bool = False, interval: str = POLL_INTERVAL) -> StreamingQuery:
    """Start the upserting stream. ``available_now`` drains what is
    there and stops (tests, backfills); otherwise one micro-batch per
    ``interval``."""
    def fn(df: DataFrame, batch_id: int) -> None:
        upsert_batch(df, batch_id, table_path=table_path, rejects_path=rejects_path, key=key,
                     immutable=immutable, mutable=mutable, order=order, validate=validate, source=source)
    w = stream.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=interval)
    return w.start()


def scratch_dirs(spark: SparkSession, name: str) -> dict[str, str]:
    """Fresh table / rejects / checkpoint folders under the shared folder."""
    base = os.path.join(ensure_checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")
    return {"table_path": f"{base}/table", "rejects_path": f"{base}/rejects", "checkpoint": f"{base}/_checkpoint"}


# Match feed: the table's first-seen columns and the ones a later poll may change.
MATCH_KEY = ["match_id"]
MATCH_IMMUTABLE = ["name", "venue", "match_date", "team1", "team2", "toss_winner", "source"]
MATCH_MUTABLE = ["status", "winner", "fetched_at"]
MATCH_COLUMNS = [*MATCH_KEY, *MATCH_IMMUTABLE, *MATCH_MUTABLE]


def match_snapshots(stream: DataFrame, source: str = "feed") -> DataFrame:
    """Match rows (of the scoreboard parser, or already in the table's layout) as
    snapshots of the feed: what is missing is filled in. Rows without a fetch
    time take that of their micro-batch; ``_seq`` is the place in the payload."""
    out = stream.withColumn("source", F.lit(source))
    for c, default in (("toss_winner", F.lit(None).cast("string")), ("fetched_at", F.current_timestamp()),
                       ("_seq", F.lit(0))):
        if c not in out.columns:
            out = out.withColumn(c, default)
    return out.select(*MATCH_COLUMNS, F.col("_seq").cast("long").alias("_seq"))


def feed_matches(stream: DataFrame, dirs: dict[str, str], available_now: bool = True) -> StreamingQuery:
    """Validate match snapshots with V1 and upsert them on match_id."""
    return start_feed(match_snapshots(stream), key=MATCH_KEY, immutable=MATCH_IMMUTABLE,
                      mutable=[c for c in MATCH_MUTABLE if c != "fetched_at"], validate=quality.validate_matches,
                      source="feed", available_now=available_now, **dirs)


def match_feed_table(spark: SparkSession, stream: DataFrame, available_now: bool = True,
                     dirs: dict[str, str] | None = None) -> DataFrame:
    """Run the match feed to completion and return the resulting table."""
    dirs = dirs or scratch_dirs(spark, "match-feed")
    feed_matches(stream, dirs, available_now).awaitTermination()
    cur = read_table(spark, dirs["table_path"])
    if cur is None:
        return spark.createDataFrame([], match_snapshots(spark.createDataFrame([], stream.schema)).schema).drop("_seq")
    return cur.select(*MATCH_COLUMNS)


def scorecard_batch(cards: DataFrame, batch_id: int, *, innings_path: str, stats_path: str,
                    rejects_path: str, source: str = "feed") -> None:
    """C18 scorecard side (K2, K3, K4, T4): innings lines and validated stat
    lines of one poll are appended under ``batch=N`` (idempotent on retry);
    invalid stat lines go to the rejects. Each poll appends again, as the
    reference does (Q8); :func:`kestrel.operators.upsert.latest_snapshot`
    keeps the latest poll per key for reports."""
    from kestrel.sources import feed_json
    spark, b = cards.sparkSession, F.lit(batch_id).cast("long")
    parsed = feed_json.scorecard_lines(cards)
    held = f"{rejects_path.rstrip('/')}/_lines/batch={batch_id:08d}"      # the payloads are parsed once; their lines lie packed meanwhile
    parsed.write.mode("overwrite").option("compression", "zstd").parquet(held)
    lines = spark.read.schema(parsed.schema).parquet(held)
    up.append_rows(feed_json.innings_of(lines).withColumn("_batch", b), innings_path, batch_id)
    checked = quality.validate_player_stats(feed_json.stats_of(lines))
    cols = ["match_id", "player_name", "team", "role", "runs", "balls_faced", "fours", "sixes", "strike_rate",
            "wickets", "overs_bowled", "economy"]
    valid, rejects = quality.split_valid(checked, source, cols)
    up.append_rows(valid.withColumn("_batch", b), stats_path, batch_id)
    up.append_rows(rejects, f"{rejects_path.rstrip('/')}/scorecards", batch_id)
    fs, p = up._fs(spark, held)
    fs.delete(p, True)


def start_scorecard_feed(stream: DataFrame, *, innings_path: str, stats_path: str, rejects_path: str,
                         checkpoint: str, available_now: bool = False,
                         interval: str = POLL_INTERVAL) -> StreamingQuery:
    """T1 for scorecard payloads (a file stream of JSON documents)."""
    def fn(df: DataFrame, batch_id: int) -> None:
        scorecard_batch(df, batch_id, innings_path=innings_path, stats_path=stats_path, rejects_path=rejects_path)
    w = stream.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=interval)
    return w.start()


def _micros(spark: SparkSession, interval: str) -> int:
    return spark.range(1).select((F.unix_micros(F.timestamp_micros(F.lit(0)) + F.expr(f"INTERVAL {interval}"))).alias("us")).head()["us"]


# The requests of a span are held in so many rows, by the hash of their key.
SPAN_PARTS = 64


def quota_spans(events: DataFrame, key: str = "user_id", ts: str = "ts", period: str = "60 seconds",
                slide: str = "1 second", watermark: str = "2 minutes") -> DataFrame:
    """The requests of which :func:`windowed_quota` counts the windows, one row per span and
    part of the keys: ``requests`` has the key and time of each. A span stands for the windows
    that begin in its first half, ``slide`` apart.

    A span is two periods long and spans begin one period apart, so a request lies in two
    of them, however many windows it lies in, and the state holds it twice; of a dense log
    many requests share a row."""
    spark = events.sparkSession
    p, s = _micros(spark, period), _micros(spark, slide)
    n = -(-p // s)
    agg = (events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)
           .groupBy(F.window(ts, f"{2 * n * s} microseconds", f"{n * s} microseconds").alias("_span"),
                    F.pmod(F.xxhash64(key), F.lit(SPAN_PARTS)).cast("int").alias("part"))
           .agg(F.collect_list(F.struct(F.col(key).alias("key"), F.unix_micros(ts).alias("at"))).alias("requests")))
    return agg.select(F.col("_span.start").alias("span_start"), "part", "requests") \
        .withColumns({"period_us": F.lit(p), "slide_us": F.lit(s)})


def quota_windows(spans: DataFrame, key: str = "user_id", max_calls: int = 10) -> DataFrame:
    """The windows with requests of :func:`quota_spans`, a row each."""
    ship_package(spans.sparkSession)
    kind = spans.schema["requests"].dataType.elementType["key"].dataType.simpleString()
    w = spans.select(F.unix_micros("span_start").alias("begin"), "requests", F.col("period_us").cast("long").alias("p"),
                     F.col("slide_us").cast("long").alias("s")).mapInArrow(unfold, f"_begin bigint, _key {kind}, _p bigint, _n bigint")
    return w.select(F.timestamp_micros(F.col("_begin") + F.col("_p")).alias("window_end"), F.col("_key").alias(key), F.col("_n").alias("in_window"),
                    F.greatest(F.lit(0), F.lit(max_calls) - F.col("_n")).cast("long").alias("remaining"))


def windowed_quota(events: DataFrame, key: str = "user_id", ts: str = "ts", period: str = "60 seconds",
                   slide: str = "1 second", watermark: str = "2 minutes", max_calls: int = 10) -> DataFrame:
    """T6 on a stream: requests per key in sliding event-time windows with a
    watermark for late data, and the remaining quota. Window boundaries are
    aligned to ``slide``, so this approximates the exact trailing count of
    :func:`kestrel.operators.requests.requests_in_window` (batch)."""
    # a window's count is final once the watermark has passed its span; see quota_table
    return quota_windows(quota_spans(events, key, ts, period, slide, watermark), key, max_calls)


# State on the executors' disks, with a bound on the memory that it takes there.
_DISK_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "48",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "8",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
    # in update mode a batch without rows would only clear old state, which the next batch does as well
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


@contextlib.contextmanager
def disk_state(spark: SparkSession, drain: bool):
    """Streaming queries that start in here keep their state on disk (a query takes the
    settings that hold when it starts; one with a checkpoint keeps its kind of store).
    ``drain``: no later batch is waited for, so a task closes its store when it ends."""
    conf = {**_DISK_STATE, "spark.sql.streaming.stateStore.unloadOnCommit": str(drain).lower()}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def quota_table(events: DataFrame, dirs: dict[str, str], key: str = "user_id", available_now: bool = True,
                **how) -> StreamingQuery:
    """T6 kept as a table: every trigger upserts the spans that changed, so the
    windows still open are there too, with their count so far. A row holds the requests of a
    span and part of the keys (:func:`read_quota` gives one row per window)."""
    def fn(df: DataFrame, batch_id: int) -> None:
        upsert_batch(df.withColumn("_seq", F.lit(0)), batch_id, table_path=dirs["table_path"],
                     rejects_path=dirs["rejects_path"], key=["span_start", "part"], immutable=[],
                     mutable=["requests", "period_us", "slide_us"], order=["_seq"], validate=None, source="quota", one_per_key=True)
    w = quota_spans(events, key=key, **how).writeStream.outputMode("update").foreachBatch(fn) \
        .option("checkpointLocation", dirs["checkpoint"])
    with disk_state(events.sparkSession, available_now):
        return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime=POLL_INTERVAL)).start()


def read_quota(spark: SparkSession, path: str, key: str = "user_id", max_calls: int = 10) -> DataFrame | None:
    """The windows of :func:`quota_table`, one row each (None before its first rows)."""
    spans = read_table(spark, path)
    return None if spans is None else quota_windows(spans, key, max_calls)


# ---- T6 exactly: the trailing count of every request ---------------------------------

# Requests of a stream are counted in groups of (part of the keys, so many periods).
QUOTA_PARTS = 16
QUOTA_PERIODS = 1440


def exact_quota(events: DataFrame, key: str = "user_id", ts: str = "ts", rid: str = "event_id",
                period_seconds: int = 60, watermark: str = "2 minutes", max_calls: int = 10) -> DataFrame:
    """For every request the requests of its key in the trailing period
    (t - period, t], as :func:`kestrel.operators.requests.requests_in_window`.

    Requests are counted in groups: a part of the keys, by hash, in a bucket of
    ``QUOTA_PERIODS`` periods. So the number of groups follows the time that the log
    covers, not its requests or keys. A request of a bucket's last period is copied into the
    next one as look-back. A state holds of its group the requests of the last period before
    the watermark and those after it: older ones no request in time can look back to.
    A request that arrives out of order raises the counts of those of its key in the
    period after it: they are given out again, and the sink keeps the last count of each.
    A state goes when the watermark has passed its bucket. Requests later than the
    watermark are left out, of the counts too; so are those without a time."""
    import pickle

    import numpy as np
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout
    us = period_seconds * 1_000_000
    span = QUOTA_PERIODS * us
    e = events.select(F.col(rid).alias("_id"), F.col(key).cast("string").alias("_k"), F.col(ts).cast("timestamp").alias("_ts"))
    kind = events.select(key).schema[0].dataType.simpleString()
    if e.schema["_id"].dataType.simpleString() != "bigint":
        raise ValueError("request ids must be bigint")
    t = F.unix_micros("_ts")
    own, after = F.floor(t / span).cast("long"), F.floor((t + us - 1) / span).cast("long")
    struct = lambda b, mine: F.struct(b.alias("b"), F.lit(mine).alias("own"))
    e = e.where("_ts is not null").withWatermark("_ts", watermark).withColumn("_t", t).withColumn("_b", F.explode(
        F.when(own == after, F.array(struct(own, 1))).otherwise(F.array(struct(own, 1), struct(after, 0)))))
    e = e.select("_id", "_k", "_ts", "_t", F.col("_b.b").alias("_bucket"), F.col("_b.own").alias("_own"),
                 F.pmod(F.xxhash64("_k"), F.lit(QUOTA_PARTS)).alias("_part"))

    def count(group, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        got, late = pd.concat(list(frames)), state.getCurrentWatermarkMs() * 1000
        got = got[got["_t"].to_numpy(dtype=np.int64) >= late]
        if not len(got):
            return
        rows, keys = got[["_t", "_id", "_own"]].to_numpy(dtype=np.int64), got["_k"].to_numpy(dtype=object)
        new = np.ones(len(rows), dtype=bool)
        if state.exists:
            held, names = pickle.loads(state.get[0])
            rows, keys, new = np.concatenate([held, rows]), np.concatenate([names, keys]), np.concatenate([np.zeros(len(held), dtype=bool), new])
        kept = rows[:, 0] >= late - us
        state.update((pickle.dumps((rows[kept], keys[kept])),))
        no = pd.factorize(keys, use_na_sentinel=False)[0].astype(np.int64)
        order = np.lexsort((rows[:, 1], rows[:, 0], no))
        rows, keys, new, no = rows[order], keys[order], new[order], no[order]
        first = rows[:, 0].min()
        at = no * (rows[:, 0].max() - first + us + 1) + rows[:, 0] - first      # keys lie more than a period apart
        low, high = np.searchsorted(at, at - us, side="right"), np.searchsorted(at, at, side="right")
        seen = np.concatenate([[0], np.cumsum(new)])
        out = (rows[:, 2] == 1) & (seen[high] > seen[low])
        end_ms = (int(group[1]) + 1) * span // 1000
        state.setTimeoutTimestamp(max(end_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"_id": rows[out, 1], "_k": keys[out], "in_window": (high - low)[out]})

    counted = e.groupBy("_part", "_bucket").applyInPandasWithState(
        count, "_id bigint, _k string, in_window bigint", "rows binary", "update", GroupStateTimeout.EventTimeTimeout)
    return counted.select(F.col("_id").alias(rid), F.col("_k").cast(kind).alias(key), "in_window",
                          F.greatest(F.lit(0), F.lit(max_calls) - F.col("in_window")).cast("long").alias("remaining"))


def exact_quota_table(events: DataFrame, dirs: dict[str, str], key: str = "user_id", rid: str = "event_id", available_now: bool = True,
                      **how) -> StreamingQuery:
    """T6 kept as a table, one row per request; a later, greater count replaces an earlier one."""
    def fn(df: DataFrame, batch_id: int) -> None:
        upsert_batch(df, batch_id, table_path=dirs["table_path"], rejects_path=dirs["rejects_path"], key=[rid], immutable=[key],
                     mutable=["remaining"], order=["in_window"], validate=None, source="quota")
    w = exact_quota(events, key=key, rid=rid, **how).writeStream.outputMode("update").foreachBatch(fn) \
        .option("checkpointLocation", dirs["checkpoint"])
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime=POLL_INTERVAL)).start()
