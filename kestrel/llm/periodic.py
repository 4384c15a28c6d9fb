"""Periodic runs of words, found with a difference cover (operator 12).

A run is a stretch of words with smallest period q, at least ``MIN_PERIODS``
periods and ``MIN_LENGTH`` words long, that no neighbouring word extends.

1. The words of a group of texts become numbers in one array, each text closed by
   a number of its own, so that nothing compares equal across texts.
2. Only the suffixes that start at positions of a difference cover modulo
   ``PERIOD`` are sorted: first by their leading ``PERIOD`` words, then by doubling
   steps, which lead from sample to sample; only ties are sorted again. The ranks
   of each step give the common prefixes of neighbours, a sparse table their
   minima over a range.
3. LCE(i, j): some shift below ``PERIOD`` makes both positions samples. Up to there
   the words are compared; beyond, the answer is one range minimum.
4. Harmonic grid: a run of period q holds at least ``g = max(MIN_LENGTH, MIN_PERIODS q) - q``
   positions that agree with the word q further on, so it holds one of every g-th.
   Of a run's grid points the first one is extended forwards by one LCE and
   backwards by a search over LCEs (it starts less than g words before).
   Of several periods of one stretch the least is kept.

Texts are handled in groups of about ``GROUP_WORDS`` words (a longer text is a
group of its own) and ``GRID_POINTS`` grid points, so the working memory does not
depend on the batch. Nothing is shuffled, and the work is n log n in the words of a text, however repetitive.

Defined results: a null or empty text has no words and no runs; its collapsed
text is empty. Repeated rows are answered alike; an empty table gives no rows.
Words are separated by the six ASCII white-space characters only.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm.common import small_batches, table
from kestrel.llm.mixing import WORD

MIN_LENGTH = 24
MIN_PERIODS = 3
GROUP_WORDS = 1 << 18
GRID_POINTS = 1 << 18       # grid points looked at in one step (some 20 MB of arrays)
PERIOD = 31
# fixed values: a perfect difference set modulo 31 (every remainder is one difference)
COVER = np.array([1, 5, 11, 24, 25, 27])
_SHIFT = np.zeros(PERIOD, dtype=np.int64)       # remainder d -> h with h and h + d in the cover
for _h in COVER.tolist():
    for _k in COVER.tolist():
        _SHIFT[(_k - _h) % PERIOD] = _h
_INDEX = np.full(PERIOD, -1, dtype=np.int64)
_INDEX[COVER] = np.arange(len(COVER))


class Extensions:
    """Longest common extensions inside the texts of one array of word numbers.
    ``text`` numbers the texts; ``code`` ends with PERIOD closing numbers."""

    def __init__(self, code: np.ndarray, text: np.ndarray):
        self.code = code
        m = (len(code) // PERIOD - 1) * len(COVER)       # samples whose first words lie in the array
        s = np.arange(m)
        at = (s // len(COVER)) * PERIOD + COVER[s % len(COVER)]
        bits = max(1, int(code.max()).bit_length())
        per = max(1, 62 // bits)
        owner = text[at].astype(np.int64)
        order = np.argsort(owner, kind="stable")
        rank = np.zeros(m, dtype=np.int64)
        tied = self._split(order, rank, np.arange(m), owner, first=True)
        for low in range(0, PERIOD, per):
            if not len(tied):
                break
            who = order[tied]
            key = np.zeros(len(who), dtype=np.int64)
            for k in range(low, min(low + per, PERIOD)):
                key = (key << bits) | code[at[who] + k]
            tied = self._sort_ties(order, rank, tied, key)
        steps, step = [rank.copy()], len(COVER)
        while len(tied):
            who = order[tied]
            tied = self._sort_ties(order, rank, tied, steps[-1][who + step])
            steps.append(rank.copy())
            step *= 2
        self.rank = rank
        # common prefixes of neighbours in one text: step by step downwards, then word by word
        a, b = order[:-1].copy(), order[1:].copy()
        here = np.flatnonzero(owner[a] == owner[b])
        a, b = a[here], b[here]
        far = np.zeros(len(here), dtype=np.int64)
        for k in range(len(steps) - 1, -1, -1):
            same = steps[k][a] == steps[k][b]
            move = same * (len(COVER) << k)
            a, b = a + move, b + move
            far += same * (PERIOD << k)
        pa_, pb = at[np.minimum(a, m - 1)], at[np.minimum(b, m - 1)]
        far += self._compare(pa_, pb, np.full(len(here), PERIOD))
        least = np.zeros(m, dtype=np.int32)
        least[here + 1] = far
        self.least = [least]                # least[k][x]: minimum over x .. x + 2^k - 1
        longest = int(np.bincount(owner).max()) if m else 0
        for k in range(max(0, longest.bit_length() - 1)):
            half, low = 1 << k, self.least[-1]
            row = low.copy()
            np.minimum(low[:-half], low[half:], out=row[:-half])
            self.least.append(row)

    @staticmethod
    def _split(order, rank, tied, key, first=False):
        """Give the sorted ``tied`` places ranks by group; return the places still tied."""
        new = np.ones(len(tied), dtype=bool)
        if first:
            who = order[tied]
            new[1:] = key[who[1:]] != key[who[:-1]]
        else:
            new[1:] = (key[1:] != key[:-1]).any(axis=1)
        rank[order[tied]] = np.maximum.accumulate(np.where(new, tied, 0))
        single = new.copy()
        single[:-1] &= new[1:]
        return tied[~single]

    def _sort_ties(self, order, rank, tied, key):
        who = order[tied]
        group = rank[who]
        by = np.lexsort((key, group))
        order[tied] = who[by]
        return self._split(order, rank, tied, np.stack([group[by], key[by]], axis=1))

    def _compare(self, i, j, upto):
        """Equal words from i and j on, at most ``upto``."""
        out = np.zeros(len(i), dtype=np.int64)
        live = np.flatnonzero(upto > 0)
        for t in range(PERIOD):
            live = live[upto[live] > t]
            live = live[self.code[i[live] + t] == self.code[j[live] + t]]
            if not len(live):
                break
            out[live] = t + 1
        return out

    def lce(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Equal words from positions i and j of the same text on (i < j)."""
        shift = (_SHIFT[(j - i) % PERIOD] - i) % PERIOD
        out = self._compare(i, j, shift)
        on = np.flatnonzero(out == shift)
        a, b = i[on] + shift[on], j[on] + shift[on]
        ra = self.rank[(a // PERIOD) * len(COVER) + _INDEX[a % PERIOD]]
        rb = self.rank[(b // PERIOD) * len(COVER) + _INDEX[b % PERIOD]]
        low, high = np.minimum(ra, rb) + 1, np.maximum(ra, rb)
        k = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        for level in np.unique(k).tolist():
            of = np.flatnonzero(k == level)
            row = self.least[level]
            out[on[of]] += np.minimum(row[low[of]], row[high[of] - (1 << level) + 1])
        return out


def find_runs(code: np.ndarray, text: np.ndarray, begin: np.ndarray, length: np.ndarray,
              min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS) -> np.ndarray:
    """Rows (text, start, length, period) by text, start, period. ``begin`` and
    ``length`` give the place of each text in ``code``; before and behind it there
    are numbers that occur nowhere else."""
    who = np.flatnonzero(length >= min_length)
    most = length[who] // min_periods
    # (text, q) pairs, cut so that a slice has about GRID_POINTS grid points
    owner = np.repeat(who, most)
    q = np.arange(len(owner)) - np.repeat(np.cumsum(most) - most, most) + 1
    grid = np.maximum(min_length, min_periods * q) - q
    count = -(-(length[owner] - q) // grid)
    found, ext = [], None
    total = np.cumsum(count)
    edges = np.searchsorted(total, np.arange(GRID_POINTS, total[-1], GRID_POINTS)) if len(total) else []
    edges = np.unique(np.concatenate([[0], edges, [len(total)]]).astype(np.int64))
    for s in map(slice, edges[:-1].tolist(), edges[1:].tolist()):
        pair = np.repeat(np.arange(s.start, s.stop), count[s])
        i = begin[owner[pair]] + (np.arange(len(pair)) - np.repeat(np.cumsum(count[s]) - count[s], count[s])) * grid[pair]
        p = q[pair]
        hit = np.flatnonzero(code[i] == code[i + p])
        # a run has half a grid step, eight words at least, on one side of the point
        i, p, pair = i[hit], p[hit], pair[hit]
        ahead, behind = np.ones(len(i), dtype=bool), np.ones(len(i), dtype=bool)
        reach = max(0, min(3, (min_length - min_length // min_periods) // 2 - 1))
        for t in range(1, reach + 1):
            ahead &= code[i + t] == code[np.minimum(i + p + t, len(code) - 1)]
            behind &= code[i - t] == code[i + p - t]
        hit = np.flatnonzero(ahead | behind)
        if not len(hit):
            continue
        i, p, pair = i[hit], p[hit], pair[hit]
        ext = ext or Extensions(code, text)
        far = ext.lce(i, i + p)
        fresh = np.ones(len(i), dtype=bool)
        fresh[1:] = (pair[1:] != pair[:-1]) | (i[:-1] + far[:-1] < i[1:])
        i, p, pair, far = i[fresh], p[fresh], pair[fresh], far[fresh]
        # the first position x from which all words up to i agree lies in (i - grid, i]
        lo, hi = np.maximum(i - grid[pair], begin[owner[pair]]), i.copy()
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) // 2
            ok = ext.lce(mid, mid + p[open_]) >= i[open_] - mid
            hi[open_[ok]] = mid[ok]
            lo[open_[~ok]] = mid[~ok] + 1
        size = i + far + p - hi
        ok = np.flatnonzero(size >= np.maximum(min_length, min_periods * p))
        found.append(np.stack([owner[pair[ok]], hi[ok] - begin[owner[pair[ok]]], size[ok], p[ok]], axis=1))
    if not found:
        return np.zeros((0, 4), dtype=np.int64)
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    least = np.ones(len(rows), dtype=bool)      # one stretch: its smallest period
    least[1:] = (rows[1:, :3] != rows[:-1, :3]).any(axis=1)
    rows = rows[least]
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def runs_of(texts: list[list[bytes]], min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS) -> list[list[tuple]]:
    """For each list of words its runs (start, length, period)."""
    numbers: dict[bytes, int] = defaultdict(count().__next__)      # no reference to itself: it goes with the group
    length = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    begin = np.cumsum(length + 1) - length - 1 + PERIOD
    size = int(length.sum()) + len(texts) + PERIOD
    size += -size % PERIOD + 2 * PERIOD
    code = np.zeros(size, dtype=np.int64)
    own = np.full(size, len(texts), dtype=np.int32)
    fill = np.ones(size, dtype=bool)
    for k, (words, b) in enumerate(zip(texts, begin.tolist())):
        code[b:b + len(words)] = np.fromiter(map(numbers.__getitem__, words), dtype=np.int64, count=len(words))
        own[b:b + len(words) + 1] = k
        fill[b:b + len(words)] = False
    code[fill] = len(numbers) + np.arange(int(fill.sum()))
    out: list[list[tuple]] = [[] for _ in texts]
    for k, *run in find_runs(code, own, begin, length, min_length, min_periods).tolist():
        out[k].append(tuple(run))
    return out


def collapsed(words: list[bytes], runs: list[tuple]) -> bytes:
    """The words that lie in no run, or in each such run's first period, joined by spaces."""
    if runs:
        edge = np.zeros(len(words) + 1, dtype=np.int64)
        for start, length, period in runs:
            edge[start + period] += 1
            edge[start + length] -= 1
        words = compress(words, (np.cumsum(edge[:-1]) == 0).tolist())
    return b" ".join(words)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
                  min_periods: int = MIN_PERIODS) -> DataFrame:
    """One row per document: doc_id, n_words, runs (array of start, length, period
    by start, then period), collapsed (the text with every run cut to one period)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    small_batches(docs.sparkSession)
    shape = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, first, size = [], 0, 0
            last = batch.num_rows - 1
            for k in range(batch.num_rows):
                held.append((batch.column(1)[k].as_py() or b"").split())
                size += len(held[-1])
                if size >= GROUP_WORDS or k == last:
                    found = runs_of(held, min_length, min_periods)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(first, len(held)), pa.array(list(map(len, held)), pa.int64()),
                         pa.array([[dict(zip(("start", "length", "period"), r)) for r in runs] for runs in found], shape),
                         pa.array([collapsed(w, r) for w, r in zip(held, found)], pa.binary()).cast(pa.string())],
                        names=["doc_id", "n_words", "runs", "collapsed"])
                    held, first, size = [], k + 1, 0

    return rows.mapInArrow(search, f"doc_id {kind}, n_words bigint, "
                                   "runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def with_planted_period(docs: DataFrame) -> DataFrame:
    """The contract's texts: in one document of ten, by the CRC-32 of its id, the
    words from one on repeat with a period."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    rows = docs.select("doc_id", "text", F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))).alias("_w"),
                       g.alias("_g"))
    rows = rows.withColumn("_n", F.size("_w"))
    w, n = F.col("_w"), F.col("_n")
    a = F.col("_g") % n
    p = F.lit(1) + F.floor((n - a) / (F.lit(3) + F.col("_g") % 8))
    rows = rows.withColumn("_a", F.when(n > 0, a).cast("int")).withColumn("_p", F.when(n > 0, p).cast("int"))
    cycle = F.slice(w, F.col("_a") + 1, F.col("_p"))
    times = F.ceil((n - F.col("_a")) / F.col("_p")).cast("int")
    edited = F.array_join(F.slice(F.concat(F.slice(w, F.lit(1), F.col("_a")), F.flatten(F.array_repeat(cycle, times))), F.lit(1), n), " ")
    return rows.select("doc_id", F.when(n > 0, edited).otherwise(F.col("text")).alias("text"))


def _greatest_exponent(runs: Column) -> Column:
    """The first run of greatest length / period, compared as whole numbers."""
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    return F.aggregate(runs, none, lambda best, r: F.when(
        best.isNull() | (r.length * best.period > best.length * r.period), r).otherwise(best))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_planted_period(table(spark, sf_dir, "documents")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n")))
    best = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), _greatest_exponent(F.col("runs")).alias("b"),
                        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return best.select("doc_id", "n_runs", "b.start", "b.length", "b.period",
                       F.floor(F.lit(1000) * F.col("b.length") / F.col("b.period")).cast("long").alias("exponent_milli"),
                       "runs_sha256", "collapsed_sha256")
