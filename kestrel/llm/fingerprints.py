"""Document fingerprints by a threshold-scaled sketch (operator 7).

A sketch keeps every hash of a 5-word shingle below a fixed fraction
(1 / ``SCALE``) of the hash range, so its size follows the text's. Sketches of
one scale merge by union (:func:`merged`), and the share of the smaller sketch
that lies in the larger one estimates containment, however unequal the texts.
The fraction is 1/2: a text of k shingles keeps k/2 of them on average and none with
probability 2^-k, and a likeness c of such a text has a standard error of about
sqrt(2 c (1 - c) / k), which README states by length.

A fingerprint is ``shingles:digest:hashes``: the number of shingles, a 64-bit
digest of all of them, and the kept hashes in ascending order, 16 hex digits
each. Likeness is 1 where the digests are equal, 0 where otherwise one of the
sketches is empty, else the containment of the smaller sketch.

:func:`fingerprint_edits` compares each document with an edited copy and with
its successor by id. Documents are dealt by id into ranges, each with the first
document of the next range at its end, so a task reads a range in order and
needs two texts at a time; whole texts are shuffled once.

Defined results: a null text is an empty one (no shingles); fewer than five
words are one shingle. Null ids come first; rows with the same id follow each
other in order of a hash of their text, then of the text. A table of one row is
its own successor; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm import words
from kestrel.llm.common import bucket_count, table

SHINGLE = 5
SCALE = 2
RANGE_ROWS = 1000
MOST_RANGES = 1 << 16


class Sketch:
    __slots__ = ("shingles", "digest", "kept")

    def __init__(self, hashes: np.ndarray, scale: int):
        self.shingles = len(hashes)
        self.digest = int(words.mix(np.add.reduce(words.mix(hashes), keepdims=True, dtype=np.uint64))[0])
        self.kept = np.unique(hashes[hashes <= np.uint64((1 << 64) // scale - 1)])

    def __str__(self) -> str:
        return f"{self.shingles}:{self.digest:016x}:{self.kept.astype('>u8').tobytes().hex()}"

    def likeness(self, other: Sketch) -> float:
        if (self.shingles, self.digest) == (other.shingles, other.digest):
            return 1.0
        least = min(len(self.kept), len(other.kept))
        if not least:
            return 0.0
        return len(np.intersect1d(self.kept, other.kept, assume_unique=True)) / least


def sketches_of(texts: list[str | None], shingle: int = SHINGLE, scale: int = SCALE) -> list[Sketch]:
    out = []
    for _, _, hashes, per in words.word_hashes(texts):
        stop = np.cumsum(per).tolist()
        out += [Sketch(words.shingle_hashes(hashes[b - n:b], shingle), scale) for b, n in zip(stop, per.tolist())]
    return out


def sketch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
           scale: int = SCALE) -> DataFrame:
    """(doc_id, shingles, fingerprint, hashes array<bigint>) per row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = sketches_of(batch.column(1).to_pylist(), shingle, scale)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([s.shingles for s in found], pa.int64()), pa.array([str(s) for s in found]),
                 pa.array([s.kept.view(np.int64) for s in found], pa.list_(pa.int64()))],
                names=["doc_id", "shingles", "fingerprint", "hashes"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(make, f"doc_id {kind}, shingles bigint, fingerprint string, hashes array<bigint>")


def merged(sketches: DataFrame, by: str) -> DataFrame:
    """The sketch of all texts of each ``by``, one row per hash (a union needs no more)."""
    return sketches.select(by, F.explode("hashes").alias("hash")).distinct()


def _in_ranges(docs: DataFrame, id_col: str, text_col: str, range_rows: int) -> DataFrame:
    """(range, ahead, doc_id, text): each row in its id range, and the first row of
    a range once more, ``ahead``, at the end of the range before."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    n = min(MOST_RANGES, bucket_count(rows.count(), range_rows))
    cuts = rows.select(F.col("doc_id").cast("double").alias("d")).where("d is not null") \
        .stat.approxQuantile("d", [k / n for k in range(1, n)], min(0.1, 0.25 / n)) if n > 1 else []
    edges = [-float("inf"), *sorted(set(cuts)), float("inf")]
    placed = rows.withColumn("_d", F.coalesce(F.col("doc_id").cast("double"), F.lit(-1.7e308)))
    if len(edges) > 2:
        placed = Bucketizer(splits=edges, inputCol="_d", outputCol="_range").transform(placed)
    else:
        placed = placed.withColumn("_range", F.lit(0.0))
    placed = placed.withColumn("range", F.col("_range").cast("int")).withColumn("order", F.struct(
        F.col("doc_id").isNotNull().alias("known"), "doc_id", F.xxhash64("text").alias("hash")))
    # at most MOST_RANGES rows
    firsts = sorted(((r["range"], r["first"]) for r in placed.groupBy("range").agg(F.min("order").alias("first")).collect()),
                    key=lambda x: x[0])
    spark = docs.sparkSession
    before = spark.createDataFrame(
        [(here, first["doc_id"], first["hash"], firsts[k - 1][0]) for k, (here, first) in enumerate(firsts)],
        f"range int, first_id {rows.schema['doc_id'].dataType.simpleString()}, first_hash bigint, before int")
    with_edge = placed.join(F.broadcast(before), "range")
    is_first = F.col("order.doc_id").eqNullSafe(F.col("first_id")) & (F.col("order.hash") == F.col("first_hash"))
    here = F.struct(F.col("range").alias("range"), F.lit(False).alias("ahead"))
    ahead = F.struct(F.col("before").alias("range"), F.lit(True).alias("ahead"))
    return with_edge.withColumn("at", F.explode(F.when(is_first, F.array(here, ahead)).otherwise(F.array(here)))) \
        .select("at.range", "at.ahead", F.col("order.known").alias("known"), F.col("order.hash").alias("hash"), "doc_id", "text")


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                      scale: int = SCALE, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Per row: its fingerprint, that of the text whose second half is replaced by
    the start of the next document's, and the likeness to the latter and to the
    next document."""
    dealt = _in_ranges(docs, id_col, text_col, range_rows)
    order = ["range", "ahead", "known", "doc_id", "hash", "text"]
    dealt = dealt.repartition("range").sortWithinPartitions(*order).select("range", "ahead", "doc_id", "text")
    kind = dealt.schema["doc_id"].dataType

    def rows_of(ids: list, texts: list[str]) -> list[tuple]:
        """Rows for all but the last of some consecutive documents."""
        edited = [t[:len(t) - len(t) // 2] + after[:len(t) // 2] for t, after in zip(texts, texts[1:])]
        made = sketches_of([*texts, *edited], shingle, scale)
        own, other = made[:len(texts)], made[len(texts):]
        return [(ids[k], len(texts[k]), hashlib.sha256(edited[k].encode()).hexdigest(), str(own[k]), str(other[k]),
                 own[k].likeness(other[k]), own[k].likeness(own[k + 1])) for k in range(len(edited))]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, done, ids, texts, size = None, False, [], [], 0
        types = None

        def flush():
            nonlocal ids, texts, size
            rows = rows_of(ids, texts) if len(ids) > 1 else []
            ids, texts = ids[-1:], texts[-1:]
            size = 0
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), [types, pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()])],
                    names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        for batch in batches:
            types = batch.column(2).type
            for where, ahead, doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                if where != at:
                    at, done, ids, texts, size = where, False, [], [], 0
                if done:
                    continue   # the range has its successor already
                ids.append(doc)
                texts.append(text or "")
                size += len(texts[-1])
                done = ahead
                if ahead or size >= words.GROUP:
                    yield from flush()

    name = kind.simpleString()
    return dealt.mapInArrow(compare, f"doc_id {name}, n_chars bigint, edited_sha256 string, fingerprint string, "
                                     f"edited_fingerprint string, near_edited double, near_next double")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))
