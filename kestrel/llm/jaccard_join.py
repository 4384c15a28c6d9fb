"""N-gram Jaccard join by MinHash banding (operator 5).

Texts are compared as sets of 5-word shingles; two are linked if the Jaccard
similarity of the sets is 0.8 or more.

1. Each text gets a 128-bit digest of its shingle set, and MinHash band hashes.
   Rows and bands follow from the target recall at the threshold
   (:func:`choose_bands`). Texts with equal sets form one node with a number of
   copies, so copies never multiply.
2. Band hashes are shuffled; in each shared bucket every node is tied to the
   bucket's smallest node (a star, never all pairs). Components of these ties
   are the candidate groups.
3. Each group is cut by hash into blocks of bounded size. Each pair of blocks is
   one small task on the full shingle sets: exact intersections of all its pairs.
   It returns one row per linked node (how many documents it is linked to, and
   the smallest node it is connected to), never a row per pair.
4. The verified ties form the classes.

Nothing is capped: a larger group has more block pairs, of the same size.

Defined results: a text without words (null, empty, punctuation) has no links
and is a class of its own. A text of fewer than five words is one shingle.
Repeated rows are copies: linked to each other like any equal texts. The class
id is the smallest document id of the class; null ids count last. An empty
table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kestrel.llm import words
from kestrel.llm.common import cut, fresh, table
from kestrel.llm.components import components

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.999        # of pairs exactly at the threshold; more similar pairs do better
MOST_HASHES = 144
BLOCK_NODES = 1024
BLOCK_SHINGLES = 1 << 21
_RARE = 16            # columns with fewer sets are paired directly


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the longest bands that reach the recall within ``most`` hashes."""
    for rows in range(32, 0, -1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold ** rows))
        if bands * rows <= most:
            return bands, rows
    raise ValueError("no banding reaches this recall")


def _seeds(n: int) -> np.ndarray:
    return words.mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _signatures(sets: list[np.ndarray], bands: int, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digest halves and band hashes of non-empty shingle sets."""
    flat = np.concatenate(sets)
    at = np.cumsum([0, *(len(s) for s in sets[:-1])])
    low = np.add.reduceat(words.mix(flat ^ np.uint64(0x5851F42D4C957F2D)), at)
    high = np.add.reduceat(words.mix(flat + np.uint64(0x14057B7EF767814F)), at)
    held, room = np.zeros((bands, len(sets)), dtype=np.uint64), np.empty_like(flat)
    for k, seed in enumerate(_seeds(bands * rows)):
        np.multiply(flat, seed, out=room)
        held[k // rows] += words.mix(np.minimum.reduceat(room, at)) * words._STEP[k % rows + 1]
    held += np.arange(1, bands + 1, dtype=np.uint64)[:, None]
    return words.mix(low), words.mix(high), words.mix(held.ravel()).reshape(held.shape).T


def text_key(text: str | Column) -> Column:
    return F.xxhash64(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def signatures(docs: DataFrame, id_col: str, text_col: str, shingle: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, text_key, node, tag, n, bands) per row; node is null without words."""
    given = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col).cast("string")).alias("text_key"),
                        F.col(text_col).cast("string").alias("text"))
    kind = given.schema["doc_id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, at = batch.column(2).to_pylist(), 0
            for a, b, hashes, per in words.word_hashes(texts):
                stop = np.cumsum(per).tolist()
                sets = [np.unique(words.shingle_hashes(hashes[x - y:x], shingle)) for x, y in zip(stop, per.tolist())]
                full = [k for k, s in enumerate(sets) if len(s)]
                node, tag = np.zeros(len(sets), dtype=np.uint64), np.zeros(len(sets), dtype=np.uint64)
                band = np.zeros((len(full), bands), dtype=np.uint64)
                if full:
                    node[full], tag[full], band = _signatures([sets[k] for k in full], bands, rows)
                n = np.array([len(s) for s in sets], dtype=np.int64)
                offsets = np.concatenate([[0], np.cumsum((n > 0) * bands)]).astype(np.int32)
                none = n == 0
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a),
                     pa.array(node.view(np.int64), mask=none), pa.array(tag.view(np.int64), mask=none), pa.array(n),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(band).ravel().view(np.int64)))],
                    names=["doc_id", "text_key", "node", "tag", "n", "bands"])

    return given.mapInArrow(sign, f"doc_id {kind}, text_key bigint, node bigint, tag bigint, n bigint, "
                                  f"bands array<bigint>")


def overlaps(sets: list[np.ndarray], split: int) -> np.ndarray:
    """Exact sizes of the intersections of sets[:split] with sets[split:] (of all
    sets with each other where split is 0), as a matrix."""
    n, total = len(sets), len(sets) - split
    first, second = (slice(0, split), slice(split, n)) if split else (slice(0, n), slice(0, n))
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    _, col, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(col, kind="stable")
    col, row = col[order], row[order]
    often = count[col]
    inter = np.zeros((split or n, total), dtype=np.float32)
    few = (often > 1) & (often < _RARE)
    c, r = col[few], row[few]
    for d in range(1, _RARE - 1):
        if len(c) <= d:
            break
        same = c[:-d] == c[d:]
        if not same.any():
            break
        a, b = r[:-d][same], r[d:][same]   # a < b: rows ascend within a column
        if split:
            across = (a < split) & (b >= split)
            a, b = a[across], b[across] - split
        inter += np.bincount(a * total + b, minlength=inter.size).reshape(inter.shape)
        if not split:
            inter += np.bincount(b * total + a, minlength=inter.size).reshape(inter.shape)
    many = often >= _RARE
    c, r = col[many], row[many]
    if len(c):
        c = np.cumsum(np.diff(c, prepend=c[0]) != 0)
        wide = max(256, (1 << 22) // n)
        for at in range(0, int(c[-1]) + 1, wide):
            lo, hi = np.searchsorted(c, [at, at + wide])
            dense = np.zeros((n, wide), dtype=np.float32)
            dense[r[lo:hi], c[lo:hi] - at] = 1
            inter += dense[first] @ dense[second].T
    return inter


def linked(sets: list[np.ndarray], split: int, threshold: float) -> np.ndarray:
    """Symmetric matrix over all sets: pairs across the split that reach the threshold."""
    n = len(sets)
    size = np.array([len(s) for s in sets], dtype=np.float64)
    inter = overlaps(sets, split).astype(np.float64)
    a, b = (size[:split], size[split:]) if split else (size, size)
    # compared in whole numbers' terms, with room for the rounding of the product only
    near = inter >= threshold * (a[:, None] + b[None, :] - inter) - 1e-9
    out = np.zeros((n, n), dtype=bool)
    if split:
        out[:split, split:] = near
        out[split:, :split] = near.T
    else:
        out = near
        np.fill_diagonal(out, False)
    return out


def _verify(threshold: float):
    def one(nodes: np.ndarray, blocks: np.ndarray, copies: np.ndarray, sets: list[np.ndarray], across: bool):
        _, first = np.unique(nodes, return_index=True)   # a node met twice counts once
        first = first[np.argsort(blocks[first], kind="stable")]
        nodes, blocks, copies, sets = nodes[first], blocks[first], copies[first], [sets[k] for k in first]
        split = int(np.searchsorted(blocks, blocks[-1])) if across else 0
        if len(nodes) < 2 or (across and split == 0):
            return None
        near = linked(sets, split, threshold)
        links = near @ copies
        leader, last = nodes.copy(), None
        while last is None or (leader != last).any():
            last = leader.copy()
            for k in np.flatnonzero(near.any(axis=1)):
                leader[k] = min(leader[k], leader[near[k]].min())
        keep = links > 0
        return nodes[keep], leader[keep], links[keep]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (root, lo, hi): one group after another."""
        held: list[tuple] = []
        key = None

        def close():
            if held:
                out = one(np.array([h[0] for h in held]), np.array([h[1] for h in held]),
                          np.array([h[2] for h in held]), [np.frombuffer(h[3], dtype=np.uint64) for h in held],
                          key[1] != key[2])
                if out is not None and len(out[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["node", "leader", "links"])

        for batch in batches:
            for root, lo, hi, node, block, copies, shingles in zip(*(c.to_pylist() for c in batch.columns)):
                if (root, lo, hi) != key:
                    yield from close()
                    held, key = [], (root, lo, hi)
                held.append((node, block, copies, shingles))
        yield from close()

    return verify


def _shingle_bytes(shingle: int, kind: str):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.tobytes() for s in words.shingle_sets(batch.column(batch.num_columns - 1).to_pylist(), shingle)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sets, pa.binary())],
                                             names=[*batch.schema.names[:-1], "shingles"])
    return make


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
            threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """(signed rows, nodes): the rows' signatures, and per distinct shingle set
    (node, tag) its class id, number of links, and the class's first row."""
    bands, rows = choose_bands(threshold, recall)
    signed = cut(signatures(docs, id_col, text_col, shingle, bands, rows))
    nodes = cut(signed.where("node is not null").groupBy("node", "tag").agg(
        F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"), F.min("n").alias("n"),
        F.coalesce(F.min_by("text_key", "doc_id"), F.min("text_key")).alias("text_key"), F.first("bands").alias("bands")))

    band = nodes.select("node", F.explode("bands").alias("band"))
    shared = band.groupBy("band").agg(F.min("node").alias("leader"), F.max("node").alias("other")) \
        .where("leader <> other").select("band", "leader")
    ties = band.join(shared, "band").select(F.col("node").alias("a"), F.col("leader").alias("b"))
    group = components(ties)

    member = group.join(nodes.select("node", "copies", "first_doc", "text_key", "n"), "node")
    size = member.groupBy("root").agg(F.ceil(F.greatest(
        F.count("*") / F.lit(BLOCK_NODES), F.sum("n") / F.lit(BLOCK_SHINGLES))).cast("int").alias("blocks"))
    member = member.join(size, "root").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    given = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    texts = given.withColumn("_key", text_key("_text"))
    found = texts.join(member, (F.col("_key") == F.col("text_key")) & F.col("_id").eqNullSafe(F.col("first_doc"))) \
        .select("root", "blocks", "block", "node", "copies", "_text")
    sets = found.mapInArrow(_shingle_bytes(shingle, ""), "root bigint, blocks int, block int, node bigint, "
                                                         "copies bigint, shingles binary")
    paired = sets.withColumn("mate", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "root", F.least("block", "mate").alias("lo"), F.greatest("block", "mate").alias("hi"),
        "node", "block", "copies", "shingles")
    checked = cut(paired.repartition("root", "lo", "hi").sortWithinPartitions("root", "lo", "hi", "block", "node")
                  .mapInArrow(_verify(threshold), "node bigint, leader bigint, links bigint"))

    root = components(checked.select(F.col("node").alias("a"), F.col("leader").alias("b")))
    links = checked.groupBy("node").agg(F.sum("links").alias("links"))
    rooted = nodes.select("node", "tag", "copies", "first_doc", "text_key") \
        .join(root, "node", "left").join(links, "node", "left") \
        .withColumn("root", F.coalesce("root", "node")) \
        .withColumn("n_links", F.coalesce("links", F.lit(0)) + F.col("copies") - 1)
    first = rooted.groupBy("root").agg(
        F.min("first_doc").alias("class_id"),
        F.coalesce(F.min_by("text_key", "first_doc"), F.min("text_key")).alias("class_key"))
    return signed, rooted.join(first, "root").select("node", "tag", "class_id", "class_key", "n_links")


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per document: doc_id, class_id, n_links (documents at or above the threshold)."""
    signed, found = classes(docs, id_col, text_col, **how)
    return signed.select("doc_id", "node", "tag").join(found, ["node", "tag"], "left").select(
        "doc_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))


def first_of_each_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The documents without near duplicates: of each class the row with the
    smallest id stays (of rows with the same id and text, that whose other columns
    have the smallest hash), with all its columns."""
    signed, found = classes(docs, id_col, text_col, **how)
    kept = found.select(F.col("class_id").alias("doc_id"), F.col("class_key").alias("text_key")).distinct() \
        .unionByName(signed.where("node is null").select("doc_id", "text_key").distinct())
    a, b, r = fresh(docs, "id"), fresh(docs, "key"), fresh(docs, "row")
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    keyed = docs.withColumn(a, name(id_col)).withColumn(b, text_key(F.col(text_col).cast("string")))
    chosen = keyed.join(kept.select(name("doc_id").alias(a), F.col("text_key").alias(b)), [a, b])
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    first = F.xxhash64(F.to_json(F.struct(*others))) if others else F.lit(0)
    return chosen.withColumn(r, F.row_number().over(Window.partitionBy(a, b).orderBy(first))) \
        .where(F.col(r) == 1).select(*docs.columns)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))
