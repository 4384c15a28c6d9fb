"""Balanced label propagation: shards of equal size that keep linked documents
together (operator 3). DataFrame functions only.

Documents that share a link key are neighbours; the label of a document is its
shard. All members of a key in one shard behave alike, so the state of the
propagation is one row per (key, shard) with a count: a key with a third of all
documents is at most ``shards`` rows, and nothing ever pairs up its members.

1. Labels start from a hash of the id. A key with more documents than a shard
   may hold is split into parts of one shard's quota. The shards where a part has
   members are the neighbours' shards that it may move to.
2. Each round joins the parts that have no home with the neighbours' shard where
   most of their members are, of those that have not refused them, and asks to move all
   members there. A shard takes in whole parts up to its quota, those with most
   members there first, and refuses the others, also such as it took in before
   when nearer ones ask. Rounds end when no part without a home has a shard left to
   ask; every round refuses somebody or settles all, so they end.
3. The parts left without a home are laid out whole into the rooms left, largest
   first and tightest room first. Only if one does not fit, smaller parts make way and
   are laid out with it; only a part that no shard has room for is cut. The
   documents without neighbours fill every shard exactly to its quota, so shard
   sizes in rows differ by one at most.

Ranks (within a key, among the free documents, within a shard) are window ranks
inside hash buckets of bounded size plus the counts of the earlier buckets.

Defined results: a null text is an empty one, and equal texts are linked, empty
ones too. Rows with a null id are placed like others. Repeated rows get places
of their own. Fewer documents than shards leave shards empty.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kestrel.llm.common import bucket_count, cut, running_offsets, table

SHARDS = 40
BUCKET = 20_000


def _bucketed_rank(rows: DataFrame, by: list[str], bucket: Column, order: list[str], name: str) -> DataFrame:
    """Add the 0-based rank within ``by`` in order of (bucket, order)."""
    # dealt by key and bucket: rows that a join left dealt by the key alone would
    # stay so, with all of a frequent key in one task
    dealt = rows.withColumn("_bucket", bucket).repartition(*by, "_bucket")
    before = running_offsets(dealt, by, "_bucket", F.lit(1), "_before")
    inside = F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy(*order)) - 1
    return dealt.withColumn("_inside", inside).join(before, [*by, "_bucket"]) \
        .withColumn(name, (F.col("_inside") + F.col("_before")).cast("bigint")).drop("_bucket", "_inside", "_before")


def _granted(asked: DataFrame, shard: str, first: Column, limit: Column, buckets: int) -> DataFrame:
    """Grant ``n`` in each ``shard`` in order of ``first`` (small comes first) up to ``limit``."""
    tie = F.xxhash64("link", "part")
    dealt = asked.withColumn("_bucket", first.cast("bigint") * buckets + F.pmod(tie, F.lit(buckets)))
    before = running_offsets(dealt, [shard], "_bucket", F.col("n"), "_before")
    w = Window.partitionBy(shard, "_bucket").orderBy(tie, "link", "part", "shard") \
        .rowsBetween(Window.unboundedPreceding, -1)
    return dealt.withColumn("_inside", F.coalesce(F.sum("n").over(w), F.lit(0))) \
        .join(before, [shard, "_bucket"]) \
        .withColumn("granted", F.greatest(F.lit(0), F.least(F.col("n"), limit - F.col("_before") - F.col("_inside")))) \
        .drop("_bucket", "_before", "_inside")


def _of_shard(values: list[int], shard: str) -> Column:
    return F.element_at(F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>"), F.col(shard) + 1)


def _load(state: DataFrame, shards: int) -> tuple[list[int], int]:
    """Documents per shard (as many numbers as shards), rows of the state."""
    load, rows = [0] * shards, 0
    for r in state.groupBy("shard").agg(F.sum("n").alias("n"), F.count("*").alias("rows")).collect():
        load[r["shard"]], rows = r["n"], rows + r["rows"]
    return load, rows


def lay_out(counts: dict[int, int], room: list[int]) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """(size, upto, [(shard, n)]): where the parts of a size with a rank below
    ``upto`` (and not below an earlier one) go, largest first and into the
    tightest rooms. Parts that fit nowhere are cut over as few shards as possible."""
    room, out, left = list(room), [], []
    for size in sorted(counts, reverse=True):
        rank = 0
        for s in sorted(range(len(room)), key=lambda s: room[s]):
            k = min(counts[size] - rank, room[s] // size)
            if k > 0:
                room[s] -= k * size
                rank += k
                out.append((size, rank, [(s, size)]))
        left += [(size, r + 1) for r in range(rank, counts[size])]
    for size, upto in left:
        pieces, rest = [], size
        for s in sorted(range(len(room)), key=lambda s: -room[s]):
            n = min(rest, room[s])
            if n > 0:
                room[s] -= n
                rest -= n
                pieces.append((s, n))
        out.append((size, upto, pieces))
    return out


def _laid(loose: DataFrame, plan: list, most: int) -> DataFrame:
    """``loose(link, part, all)`` where the plan of :func:`lay_out` puts them."""
    text = json.dumps([{"all": n, "upto": upto, "pieces": [{"shard": s, "n": k} for s, k in pieces]} for n, upto, pieces in plan])
    rooms = loose.sparkSession.range(1).select(F.inline(F.from_json(
        F.lit(text), "array<struct<`all`: bigint, upto: bigint, pieces: array<struct<shard: int, n: bigint>>>>"))) \
        .groupBy("all").agg(F.sort_array(F.collect_list(F.struct("upto", "pieces"))).alias("rooms"))
    tie = F.pmod(F.xxhash64("link", "part"), F.lit(bucket_count(most, BUCKET)))
    return _bucketed_rank(loose, ["all"], tie, ["link", "part"], "rank").join(rooms, "all") \
        .withColumn("room", F.get(F.filter("rooms", lambda r: r["upto"] > F.col("rank")), F.lit(0))) \
        .select("link", "part", F.inline("room.pieces")).select("link", "part", "shard", "n")


def _together(homes: DataFrame, homeless: DataFrame, quota: list[int]) -> DataFrame:
    """``homes(link, part, shard, n)`` and the places of ``homeless(link, part, all)`` (step 3)."""
    shards = len(quota)
    counts = {r["all"]: r["count"] for r in homeless.groupBy("all").count().collect()}
    if not counts:
        return homes
    load, _ = _load(homes, shards)
    plan = lay_out(counts, [q - n for q, n in zip(quota, load)])
    if all(len(pieces) == 1 for _, _, pieces in plan):
        return homes.unionByName(_laid(homeless, plan, max(counts.values())))
    small = F.col("n") < max(counts)        # these make way
    stay = cut(homes.where(~small))
    loose = cut(homeless.unionByName(homes.where(small).select("link", "part", F.col("n").alias("all"))))
    load, _ = _load(stay, shards)
    counts = {r["all"]: r["count"] for r in loose.groupBy("all").count().collect()}
    return stay.unionByName(_laid(loose, lay_out(counts, [q - n for q, n in zip(quota, load)]), max(counts.values())))


def settle(state: DataFrame, quota: list[int]) -> tuple[DataFrame, DataFrame]:
    """``state(link, part, shard, n)`` -> homes(link, part, shard, n), each part
    whole and within the quotas, and the parts without one (link, part, all)."""
    parts = cut(state.groupBy("link", "part").agg(F.sum("n").alias("all")))
    wishes = cut(state.join(parts, ["link", "part"]))
    buckets = bucket_count(parts.count(), BUCKET * len(quota))
    limit = _of_shard(quota, "shard")
    near = F.struct("n", F.xxhash64("link", "part", "shard"), "shard")
    homes = wishes.limit(0)
    while True:
        open_ = wishes.join(homes.select("link", "part"), ["link", "part"], "left_anti")
        asked = cut(open_.groupBy("link", "part").agg(F.max(near).alias("to"), F.max("all").alias("all"))
                    .select("link", "part", F.col("to.shard").alias("shard"), F.col("to.n").alias("n"), "all"))
        if asked.isEmpty():
            return homes.select("link", "part", "shard", F.col("all").alias("n")), \
                parts.join(homes.select("link", "part"), ["link", "part"], "left_anti").select("link", "part", "all")
        pool = homes.select(asked.columns).unionByName(asked).withColumnRenamed("n", "there").withColumnRenamed("all", "n")
        judged = cut(_granted(pool, "shard", 63 - F.floor(F.log2(F.col("there").cast("double"))), limit, buckets)
                     .select("link", "part", "shard", F.col("there").alias("n"), F.col("n").alias("all"), (F.col("granted") == F.col("n")).alias("taken")))
        homes = judged.where("taken").drop("taken")
        wishes = cut(wishes.join(judged.where("not taken").select("link", "part", "shard"), ["link", "part", "shard"], "left_anti"))


def labelled(rows: DataFrame, total: int, shards: int) -> DataFrame:
    """The first labels: (link, part, shard, n) of the keys with two or more documents."""
    most = max(1, total // shards)
    start = rows.groupBy("link", F.pmod(F.xxhash64("doc_id", "link"), F.lit(shards)).cast("int").alias("shard")) \
        .agg(F.count("*").alias("n"))
    of_key = Window.partitionBy("link")
    start = start.withColumn("all", F.sum("n").over(of_key)).where(F.col("all") > 1) \
        .withColumn("before", F.sum("n").over(of_key.orderBy("shard")) - F.col("n"))
    part = F.sequence(F.floor(F.col("before") / most), F.floor((F.col("before") + F.col("n") - 1) / most))
    return start.withColumn("part", F.explode(part)).select(
        "link", "part", "shard",
        (F.least(F.col("before") + F.col("n"), (F.col("part") + 1) * most)
         - F.greatest(F.col("before"), F.col("part") * most)).alias("n"))


def propagate(rows: DataFrame, total: int, shards: int = SHARDS) -> DataFrame:
    """``rows(doc_id, link)`` -> (link, shard, n): how many documents of each key
    with two or more of them have a place in which shard, within the quotas."""
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    homes, homeless = settle(cut(labelled(rows, total, shards)), quota)
    return cut(_together(homes, cut(homeless), quota).groupBy("link", "shard").agg(F.sum("n").alias("n")))


def assign(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``rows(doc_id, link, ...)`` with columns ``shard`` and ``slot`` added. The
    rows are read several times, so they should be a written or checkpointed table."""
    total = rows.count()
    places = propagate(rows, total, shards)
    load, _ = _load(places, shards)
    missing = [total // shards + (s < total % shards) - load[s] for s in range(shards)]

    upto = F.sum("n").over(Window.partitionBy("link").orderBy("shard"))
    # a table of its own, so that the join below is one of two shuffles and Spark
    # can split the rows of a frequent key
    keys = cut(places.withColumn("upto", upto).groupBy("link").agg(
        F.sort_array(F.collect_list(F.struct("upto", "shard"))).alias("places"))
        .join(rows.groupBy("link").agg(F.count("*").alias("all")).where(F.col("all") > 1), "link"))
    tie = F.xxhash64("doc_id", "link")
    held = rows.join(keys, "link", "left")
    alone = held.where("places is null").withColumn("shard", F.lit(None).cast("int")).drop("places", "all")
    order = [c for c in rows.columns if c not in ("doc_id", "link")]
    linked = _bucketed_rank(held.where("places is not null"), ["link"],
                            F.pmod(tie, F.ceil(F.col("all") / BUCKET)), ["doc_id", *order], "rank")
    placed = cut(linked.withColumn("shard", F.get(F.filter("places", lambda p: p["upto"] > F.col("rank")), F.lit(0))["shard"])
                 .drop("places", "all", "rank").unionByName(alone))

    free = _bucketed_rank(placed.where("shard is null").withColumn("all", F.lit(0)), ["all"],
                          F.pmod(tie, F.lit(bucket_count(total, BUCKET))), ["doc_id", "link", *order], "rank")
    filled = F.array(*[F.lit(sum(missing[:s + 1])).cast("bigint") for s in range(shards)])
    free = free.withColumn("shard", F.size(F.filter(filled, lambda v: v <= F.col("rank"))).cast("int")).drop("all", "rank")
    whole = cut(placed.where("shard is not null").unionByName(free.select(placed.columns)))
    return _bucketed_rank(whole, ["shard"], F.pmod(tie, F.lit(bucket_count(total, BUCKET * shards))),
                          ["doc_id", "link", *order], "slot")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = cut(table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 16).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"),
        F.unhex(F.md5(text)).alias("link")))
    return assign(rows).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                               F.lit(None).cast("int").alias("grown_shard"))
