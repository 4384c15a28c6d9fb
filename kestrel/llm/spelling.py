"""Spelling variants by asymmetric q-chunks (operator 13).

Two words are near if one inserted, deleted or replaced code point turns one into
the other. Of a pair, the shorter word (of equally long ones, the smaller)
contributes its two disjoint chunks, the halves; the other one all positional
grams of the halves' lengths. One edit touches one half only, so the other half
is a gram of the other word, at its own place or one further on (counted both
ways: within shift one). Chunks and grams are joined on a hash of length, half
and letters, so a collision or a chance hit only costs the check that follows.

1. Occurrences are counted per task (a bounded table, emitted when full) before
   they are shuffled, so a frequent word costs one row per task.
2. Grams that more than ``HOT_ROWS`` words share are dealt over several salts, and
   the chunks of such a key are sent to each; candidates stream through the check.
3. A word's form is its near word of largest count if that is at least
   ``RATIO`` times its own. Counts at least double along forms, so there are no cycles
   and few steps; roots are found by pointer doubling.

Defined results: null or empty texts have no words. A null id counts as an empty
text in front of the colon. Ties of counts go to the smaller word in code-point order.
Repeated rows count as often as they occur. Words of any length are compared whole.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm.common import cut, table

LEAST_LETTERS = 5
LEAST_COUNT = 3
RATIO = 2
HOT_ROWS = 1_000
HELD_WORDS = 1 << 18
# one byte per code point up to U+00FF: letters stay (A-Z in lower case), the rest are spaces
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = LEAST_LETTERS,
                least_count: int = LEAST_COUNT, alter: Callable[[int, bytes], bytes] | None = None) -> DataFrame:
    """(word, n): the words of all texts. ``alter(seed, word)`` may change a word of
    a document (``seed``: the CRC-32 of ``<doc_id>:``; one byte per code point)."""
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}

        def emptied() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()),
                                               pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return made

        for batch in batches:
            for k in range(batch.num_rows):
                text = batch.column(1)[k].as_py()
                if not text:
                    continue
                seed = zlib.crc32(f"{batch.column(0)[k].as_py() or ''}:".encode())
                found = Counter(text.encode("latin-1", "replace").translate(_LETTERS).split())
                for word, n in found.items():
                    if len(word) < least_letters:
                        continue
                    if alter is not None:
                        word = alter(seed, word)
                        if len(word) < least_letters:
                            continue
                    held[word] = held.get(word, 0) + n
                if len(held) >= HELD_WORDS:
                    yield emptied()
        yield emptied()

    counted = rows.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= least_count)


def _key(length: Column, half: int, letters: Column) -> Column:
    return F.xxhash64(length, F.lit(half), letters)


def _part(word: Column, start: Column, size: Column) -> Column:
    return F.substr(word, start + 1, size)


def chunks(words: DataFrame) -> DataFrame:
    """(key, short, n_short): the two halves of every word."""
    w, size = F.col("word"), F.length("word")
    half = F.floor(size / 2).cast("int")
    keys = F.array(_key(size, 1, _part(w, F.lit(0), half)), _key(size, 2, _part(w, half, size - half)))
    return words.select(F.explode(keys).alias("key"), w.alias("short"), F.col("n").alias("n_short"))


def grams(words: DataFrame, least_letters: int) -> DataFrame:
    """(key, long, n_long): every positional gram that lies within shift one of a
    half of a word as long as this one, or one code point shorter."""
    w, size = F.col("word"), F.length("word")
    keys = []
    for less in (0, 1):
        of = size - less                    # the length of the word that gives the chunks
        half = F.floor(of / 2).cast("int")
        for k, start, length in ((1, F.lit(0), half), (2, half, of - half)):
            for shift in (-1, 0, 1):
                at = start + shift
                fits = (of >= least_letters) & (at >= 0) & (at + length <= size)
                keys.append(F.when(fits, _key(of, k, _part(w, at, length))))
    return words.select(F.explode(F.array_distinct(F.array_compact(F.array(*keys)))).alias("key"), w.alias("long"), F.col("n").alias("n_long"))


def near_pairs(words: DataFrame, least_letters: int = LEAST_LETTERS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``words(word, n)`` -> each pair of near words once: short, n_short, long, n_long."""
    c, g = chunks(words), grams(words, least_letters)
    hot = cut(g.groupBy("key").count().where(F.col("count") > hot_rows)
              .select("key", F.ceil(F.col("count") / hot_rows).cast("int").alias("salts")))
    on = ["key"]
    if not hot.isEmpty():
        # at most one hot key per ``hot_rows`` grams
        salts = F.coalesce("salts", F.lit(1))
        g = g.join(hot, "key", "left").withColumn("salt", F.pmod(F.xxhash64("long"), salts).cast("int")).drop("salts")
        c = c.join(hot, "key", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
        on = ["key", "salt"]
    longer = F.length("long") > F.length("short")
    pairs = c.join(g, on).where((longer | (F.col("short") < F.col("long"))) & (F.levenshtein("short", "long", 1) == 1))
    return pairs.select("short", "n_short", "long", "n_long").distinct()


def variants(words: DataFrame, least_letters: int = LEAST_LETTERS, ratio: int = RATIO) -> DataFrame:
    """``words(word, n)``, distinct -> word, n, n_near, form, form_n, root."""
    words = cut(words)
    pairs = cut(near_pairs(words, least_letters))
    both = pairs.select(F.col("short").alias("word"), F.col("n_short").alias("n"), F.col("long").alias("other"), F.col("n_long").alias("m")) \
        .unionByName(pairs.select(F.col("long").alias("word"), F.col("n_long").alias("n"), F.col("short").alias("other"),
                                  F.col("n_short").alias("m")))
    best = both.groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("b"))
    enough = -F.col("b.m") >= ratio * F.col("n")
    near = cut(best.select("word", "n_near", F.when(enough, F.col("b.other")).alias("form"), F.when(enough, -F.col("b.m")).alias("form_n")))
    to = cut(near.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        step = to.join(to.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left")
        if step.where("next is not null").isEmpty():
            break
        to = cut(step.select("word", F.coalesce("next", "root").alias("root")))
    return words.join(near, "word", "left").join(to, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def without_letter(seed: int, word: bytes) -> bytes:
    """The contract's edit: about one word of 97 loses a code point, by the CRC-32 of ``<doc_id>:<word>``."""
    h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), seed)
    if h % 97:
        return word
    k = h % len(word)
    return word[:k] + word[k + 1:]


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(word_counts(table(spark, sf_dir, "documents"), alter=without_letter))
