"""Benchmark decontamination by spaced-seed hashing (operator 4).

Fixed masks keep some word positions of a window and ignore the others. The
masked windows of the benchmark items and of the documents are hashed and
joined; a hit fixes one alignment of item and document, on which the words are
then compared one by one. The overlap is the longest aligned stretch in which
at least ``SIMILARITY`` of the words are equal (so it may hold substituted
words), without unequal ends; it counts from ``LEAST_WORDS`` words.

The masks hit every such overlap: each window of 10 to 19 words with at most a
fifth of them unequal, wherever those are, has a place where one of the masks
looks at equal words only (an enumeration proves it), and a longer overlap falls
into such windows of which one at least has that share. Items of 5 to 9
words are hashed whole, once for each ignored position, which is all that 80 %
leaves to them.

Repeated words: where a text and an item share so many seeds that their products
exceed ``HEAVY`` times their lengths, the hits are not listed; every alignment of
the two is looked at, longest first, in slices, until none left can be better. So
work per text and item grows with the product of their lengths at most, memory
with their sum.

The benchmark is the stated query set. It is read in blocks of a bounded number
of characters, and each block is sent to all tasks (a checked size) and joined
there against all documents, whole. So documents are never shuffled, and a
passage that a third of them holds costs its hits only.

Defined results: null or empty texts and items overlap with nothing. An item
of at most ``LEAST_WORDS`` words is found as a whole, with unequal ends, too, at 80 %
equal; one with fewer than ``LEAST_ITEM`` words only in a text that consists of
just these words (it would be in every text otherwise). Rows of either table that repeat
are reported as often as they occur. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm import words
from kestrel.llm.common import bucket_count, small_batches, table

MASKS = ("111011", "11001011", "10100111")
LEAST_WORDS = 10
LEAST_ITEM = 5
SIMILARITY = 0.8
BLOCK_CHARS = 1 << 24   # characters of the benchmark sent to the tasks at once
HEAVY = 4               # seed products beyond this many times the lengths are not listed
SLICE = 1 << 20         # seed pairs listed at once
_SLOT_BITS = 22         # of the largest table of seeds; small ones have smaller tables


class Overlap(NamedTuple):
    row: int        # of the texts given
    item: int       # of the items given
    doc_start: int  # in words
    item_start: int
    n_words: int
    n_equal: int


def _seed_hashes(hashes: np.ndarray, mask: str) -> np.ndarray:
    span = len(mask)
    if len(hashes) < span:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(len(hashes) - span + 1, np.uint64(span), dtype=np.uint64)
    for k, bit in enumerate(mask):
        if bit == "1":
            out += hashes[k:len(hashes) - span + 1 + k] * words._STEP[k + 1]
    return out


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (count[0] of them), then those of first[1], ..."""
    return np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())


class Seeds:
    """The masked windows of some items: per (seed, item) its positions."""

    def __init__(self, mask: str, all_words: np.ndarray, at: np.ndarray, item: np.ndarray):
        self.mask = mask
        seed = _seed_hashes(all_words, mask)[at]
        order = np.lexsort((at, item, seed))
        seed, item, self.at = seed[order], item[order], at[order]
        new = np.ones(len(seed), dtype=bool)
        new[1:] = (seed[1:] != seed[:-1]) | (item[1:] != item[:-1])
        self.first = np.flatnonzero(new)
        self.count = np.diff(np.append(self.first, len(seed)))
        self.seed, self.item = seed[self.first], item[self.first]
        bits = min(_SLOT_BITS, max(10, len(self.seed).bit_length() + 5))    # at most one slot in 32 is taken
        self.shift = np.uint64(64 - bits)
        self.slot = np.zeros(1 << bits, dtype=bool)
        self.slot[(words.mix(self.seed) >> self.shift).astype(np.int64)] = True

    def hits(self, hashes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(position in ``hashes``, index of a (seed, item)) in slices."""
        for low in range(0, len(hashes), 1 << 18):
            own = _seed_hashes(hashes[low:low + (1 << 18) + len(self.mask) - 1], self.mask)
            maybe = np.flatnonzero(self.slot[(words.mix(own) >> self.shift).astype(np.int64)])
            a = np.searchsorted(self.seed, own[maybe], side="left")
            n = np.searchsorted(self.seed, own[maybe], side="right") - a
            upto = np.cumsum(n)
            edges = np.searchsorted(upto, np.arange(SLICE, upto[-1], SLICE)) if len(upto) else []
            edges = np.unique(np.concatenate([[0], edges, [len(n)]]).astype(np.int64))
            for s in map(slice, edges[:-1].tolist(), edges[1:].tolist()):
                yield np.repeat(maybe[s] + low, n[s]), _ranges(a[s], n[s])


def longest_similar(equal: np.ndarray, share: float) -> tuple[int, int]:
    """The longest stretch [a, b) of which at least ``share`` is True, without
    unequal ends (of equally long ones, the first)."""
    gain = np.concatenate([[0], np.cumsum(np.where(equal, round(1000 * (1 - share)), -round(1000 * share)))])
    # an end b goes with the first start a that is equal and has no greater gain
    lowest = np.minimum.accumulate(np.where(equal, gain[:-1], 1 << 60))
    start = np.searchsorted(-lowest, -gain[1:], side="left")
    stretch = np.where(equal, np.arange(1, len(gain)) - start, 0)
    b = int(np.argmax(stretch))
    return (int(start[b]), b + 1) if stretch[b] > 0 else (0, 0)


class Finder:
    """Overlaps of texts with a block of benchmark items."""

    def __init__(self, items: list[str], masks=MASKS, least=LEAST_WORDS, share=SIMILARITY, heavy=HEAVY):
        self.least, self.share, self.heavy = least, share, heavy
        parts = [(h, c) for _, _, h, c in words.word_hashes(items)]
        self.words = np.concatenate([h for h, _ in parts]) if parts else np.zeros(0, dtype=np.uint64)
        self.size = np.concatenate([c for _, c in parts]) if parts else np.zeros(0, dtype=np.int64)
        self.stop = np.cumsum(self.size)
        self.start = self.stop - self.size
        wanted = [(mask, self.size >= least) for mask in masks]
        for n in range(LEAST_ITEM, least):
            wanted += [("1" * k + "0" + "1" * (n - 1 - k), self.size == n) for k in range(n)]
        self.seeds = []
        for mask, which in wanted:
            item = np.flatnonzero(which)
            places = self.size[item] - len(mask) + 1
            if places.sum():
                self.seeds.append(Seeds(mask, self.words, _ranges(self.start[item], places), np.repeat(item, places)))
        self.tiny: dict[bytes, list[int]] = {}
        for k in np.flatnonzero((self.size > 0) & (self.size < LEAST_ITEM)).tolist():
            self.tiny.setdefault(self.words[self.start[k]:self.stop[k]].tobytes(), []).append(k)

    def _alignments(self, hashes: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """Distinct (row, item, shift) of hits, and (row, item) with too many of them."""
        end = np.cumsum(per)
        found, many = [np.zeros((0, 3), dtype=np.int64)], set()
        for seeds in self.seeds:
            for doc, entry in seeds.hits(hashes):
                row, item = np.searchsorted(end, doc, side="right"), seeds.item[entry]
                pair, at = np.unique(row * len(self.size) + item, return_inverse=True)
                r, i = pair // len(self.size), pair % len(self.size)
                heavy = np.bincount(at, seeds.count[entry]) > self.heavy * (per[r] + self.size[i])
                many.update(zip(r[heavy].tolist(), i[heavy].tolist()))
                light = ~heavy[at]
                doc, entry, row, item = doc[light], entry[light], row[light], item[light]
                n = seeds.count[entry]
                shift = np.repeat(doc, n) - seeds.at[_ranges(seeds.first[entry], n)]
                found.append(self._distinct(np.stack([np.repeat(row, n), np.repeat(item, n), shift], axis=1)))
        return self._distinct(np.concatenate(found)), sorted(many)

    @staticmethod
    def _distinct(rows: np.ndarray) -> np.ndarray:
        rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
        new = np.ones(len(rows), dtype=bool)
        new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
        return rows[new]

    def _overlap(self, equal: np.ndarray, n: int) -> tuple[int, int] | None:
        """The stretch of an alignment that counts, for an item of ``n`` words."""
        if len(equal) < min(self.least, n):
            return None
        if n <= self.least:
            return (0, n) if equal.sum() >= self.share * n - 1e-9 else None
        lo, hi = (0, len(equal)) if equal.all() else longest_similar(equal, self.share)
        return (lo, hi) if hi - lo >= self.least else None

    def _every_alignment(self, text: np.ndarray, i: int) -> tuple[int, int, int, int] | None:
        """The best (doc_start, item_start, words, equal) of all alignments: those
        with the longest common window first, so that the rest can be left out."""
        item, n = self.words[self.start[i]:self.stop[i]], int(self.size[i])
        least = min(self.least, n)
        shift = np.arange(least - n, len(text) - least + 1)
        window = np.minimum(n, len(text) - shift) - np.maximum(0, -shift)
        order = np.lexsort((shift, -window))
        best, step = None, max(1, (1 << 21) // n)
        for k in range(0, len(order), step):
            part = order[k:k + step]
            if best is not None and (best[2] > window[part[0]] or best[2] == best[3] == window[part[0]]):
                break
            place = shift[part][:, None] + np.arange(n)[None, :]
            equal = (text[np.clip(place, 0, len(text) - 1)] == item) & (place >= 0) & (place < len(text))
            enough = equal.sum(axis=1) >= self.share * least - 1e-9
            for x in np.flatnonzero(enough).tolist():
                s = int(shift[part[x]])
                a, b = max(0, -s), min(n, len(text) - s)
                if best is not None and (best[2] > b - a or best[2] == best[3] == b - a):
                    break
                got = self._overlap(equal[x, a:b], n)
                if got:
                    lo, hi = a + got[0], a + got[1]
                    new = (lo + s, lo, hi - lo, int(equal[x, lo:hi].sum()))
                    if best is None or (-new[2], -new[3], new[0]) < (-best[2], -best[3], best[0]):
                        best = new
        return best

    def find(self, texts: list[str | None]) -> Iterator[Overlap]:
        """For each text and item the longest overlap."""
        for first, _, hashes, per in words.word_hashes(texts):
            end = np.cumsum(per)
            begin = end - per
            if self.tiny:
                for r in np.flatnonzero((per > 0) & (per < LEAST_ITEM)).tolist():
                    for i in self.tiny.get(hashes[begin[r]:end[r]].tobytes(), []):
                        yield Overlap(first + r, i, 0, 0, int(per[r]), int(per[r]))
            if not len(hashes) or not self.seeds:
                continue
            aligned, many = self._alignments(hashes, per)
            best: dict[tuple[int, int], Overlap] = {}
            for r, i in many:
                got = self._every_alignment(hashes[begin[r]:end[r]], i)
                if got:
                    best[(r, i)] = Overlap(first + r, i, *got)
            done = set(many)
            for r, i, shift in aligned.tolist():
                if (r, i) in done:
                    continue
                a = max(int(self.start[i]), int(begin[r]) - shift)
                b = min(int(self.stop[i]), int(end[r]) - shift)
                if b <= a:
                    continue
                equal = self.words[a:b] == hashes[a + shift:b + shift]
                stretch = self._overlap(equal, int(self.size[i]))
                if stretch is None:
                    continue
                lo, hi = stretch
                got = Overlap(first + r, i, a + lo + shift - int(begin[r]), a + lo - int(self.start[i]),
                              hi - lo, int(equal[lo:hi].sum()))
                held = best.get((r, i))
                if held is None or (-got.n_words, -got.n_equal, got.doc_start) < (-held.n_words, -held.n_equal, held.doc_start):
                    best[(r, i)] = got
            yield from best.values()


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list]:
    """The benchmark's rows in blocks of about BLOCK_CHARS characters."""
    items = benchmark.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    size = items.agg(F.sum(F.length("text"))).head()[0] or 0
    n = bucket_count(size, BLOCK_CHARS)
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("text", "item_id"), F.lit(n)) == k).orderBy("item_id", "text").collect()
        if rows:
            yield rows


def _finder(shared):
    made: list[Finder] = []

    def get() -> Finder:
        if not made:
            made.append(Finder(shared.value))
        return made[0]
    return get


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and item that overlap: where, how long, how similar."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    field = benchmark.select(F.col(item_col).alias("item_id")).schema["item_id"]
    schema = f"doc_id {kind}, item_id {field.dataType.simpleString()}, doc_start bigint, item_start bigint, " \
             f"n_words bigint, n_equal bigint, similarity double"
    out = None
    for block in _blocks(benchmark, item_col, item_text):
        names = [r["item_id"] for r in block]
        get = _finder(spark.sparkContext.broadcast([r["text"] for r in block]))

        def search(batches: Iterator[pa.RecordBatch], get=get, names=names) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = list(get().find(batch.column(1).to_pylist()))
                if found:
                    row, item, *rest = np.array(found, dtype=np.int64).T
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(row)), pa.array([names[k] for k in item]),
                         *map(pa.array, rest), pa.array(rest[3] / rest[2])],
                        names=["doc_id", "item_id", "doc_start", "item_start", "n_words", "n_equal", "similarity"])

        part = rows.mapInArrow(search, schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def without_benchmark(docs: DataFrame, benchmark: DataFrame, text_col: str = "text",
                      item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents that overlap with no item, with all their columns."""
    spark = docs.sparkSession
    small_batches(spark)
    for block in _blocks(benchmark, item_col, item_text):
        get = _finder(spark.sparkContext.broadcast([r["text"] for r in block]))

        @F.pandas_udf("boolean")
        def clean(texts: pd.Series) -> pd.Series:
            out = np.ones(len(texts), dtype=bool)
            out[[x.row for x in get().find([t if isinstance(t, str) else None for t in texts])]] = False
            return pd.Series(out)

        docs = docs.where(clean(F.col(text_col).cast("string")))
    return docs


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
