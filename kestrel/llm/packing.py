"""Packing token sequences by minimum bin slack (operator 10).

Each document becomes its token ids and an end id. Its whole windows of
``capacity`` ids are sequences of their own; the rest (below ``capacity``) is a
piece to be packed. Pieces are dealt by hash into buckets of about ``BUCKET``
pieces. Within a bucket a window opens with the longest piece left, and a
subset-sum over the multiset of the remaining lengths (a bitset, one shift per
piece considered) finds the filling closest to capacity; the counts come from
tracing the newly set bits back. A sequence is padded to ``capacity`` unless
its length is a power of two.

Only counts, lengths and checksums leave the tasks that tokenise; a bucket
holds a bounded number of small rows, whatever a document's length or source.

Defined results: a null or empty text is the end id alone. Rows with the same
id are packed independently, as often as they occur; a null id stays null. An
empty table gives no rows. The order of equal pieces is by id, start and
checksum, so results do not depend on the order of the input.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm.common import bucket_count, table
from kestrel.llm.encode import Encoder

CAPACITY = 4096
END_ID = 2
BUCKET = 20_000
PIECES = "doc_id {id}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of a document: start, length, checksum of its ids."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer)
        for batch in batches:
            names, out = batch.column(0), []
            for k, text in enumerate(batch.column(1).to_pylist()):
                ids = np.append(encoder.ids(text or ""), end_id).astype("<u4")
                for start in range(0, len(ids), capacity):
                    part = ids[start:start + capacity]
                    out.append((k, start, len(part), zlib.crc32(part.tobytes()), len(ids)))
            row, *rest = np.array(out, dtype=np.int64).reshape(-1, 5).T
            yield pa.RecordBatch.from_arrays([names.take(pa.array(row)), *map(pa.array, rest)],
                                             names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return rows.mapInArrow(cut_up, PIECES.format(id=kind.simpleString()))


def fill_windows(lengths: list[int], capacity: int) -> list[list[int]]:
    """Pack pieces (given by length, ascending) into windows; returns the
    positions in ``lengths`` of each window's pieces."""
    held: dict[int, list[int]] = {}
    for at, n in enumerate(lengths):
        held.setdefault(n, []).append(at)
    for places in held.values():
        places.reverse()
    left = sorted(held)   # distinct lengths with pieces left, ascending

    def take(n: int) -> int:
        at = held[n].pop()
        if not held[n]:
            left.pop(bisect_left(left, n))
        return at

    windows = []
    while left:
        longest = left[-1]
        window, room = [take(longest)], capacity - longest
        reach, full, steps = 1, (1 << (room + 1)) - 1, []
        for k in range(bisect_right(left, room) - 1, -1, -1):
            n = left[k]
            for _ in range(min(len(held[n]), room // n)):
                new = (reach << n) & full & ~reach
                if not new:
                    break
                steps.append((n, new))
                reach |= new
            if reach >> room & 1:
                break
        total = reach.bit_length() - 1
        for n, new in reversed(steps):
            if new >> total & 1:
                window.append(take(n))
                total -= n
        windows.append(window)
    return windows


def pack(pieces: DataFrame, capacity: int = CAPACITY, bucket: int = BUCKET, rows: int | None = None) -> DataFrame:
    """Give each piece a ``sequence_id`` and its ``offset`` there. ``rows``: the
    number of documents, where it is known."""
    n = bucket_count(pieces.count() if rows is None else rows, bucket)
    key = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(n))
    dealt = pieces.withColumn("_bucket", key).repartition(min(n, 20_000), "_bucket") \
        .sortWithinPartitions("_bucket", "length", "doc_id", "start", "ids_crc32")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches of a partition in order of bucket and length: a bucket's short
        pieces come first and are held; its whole windows are passed on at once."""
        at, held, sequence = None, [], 0

        def emit(rows: pa.RecordBatch, ids: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(ids), pa.array(offsets)],
                                              names=[*rows.schema.names[:-1], "sequence_id", "offset"])

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal held, sequence
            if held:
                rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                lengths = rows.column(2).to_numpy()
                ids, offsets = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
                for window in fill_windows(lengths.tolist(), capacity):
                    offset = 0
                    for place in window:
                        ids[place], offsets[place] = (at << 32) + sequence, offset
                        offset += int(lengths[place])
                    sequence += 1
                yield emit(rows, ids, offsets)
            held = []

        for batch in batches:
            key, length = batch.column(5).to_numpy(), batch.column(2).to_numpy()
            edges = np.flatnonzero(np.diff(key * 2 + (length >= capacity))) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(key)]):
                if a == b:
                    continue
                if key[a] != at:
                    yield from close()
                    at, sequence = int(key[a]), 0
                part = batch.slice(a, b - a)
                if length[a] < capacity:
                    held.append(part)
                else:
                    yield from close()
                    yield emit(part, (at << 32) + sequence + np.arange(b - a), np.zeros(b - a, dtype=np.int64))
                    sequence += b - a
        yield from close()

    kind = pieces.schema["doc_id"].dataType.simpleString()
    return dealt.mapInArrow(number, PIECES.format(id=kind) + ", sequence_id bigint, offset bigint")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary())


def pack_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Tokenise and pack a table of documents."""
    return pack(token_pieces(docs, tokenizer), rows=docs.count())
