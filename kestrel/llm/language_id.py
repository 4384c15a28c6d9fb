"""Language identification by rank-order n-gram profiles (operator 1).

A profile lists the ``PROFILE_SIZE`` most frequent 1- to 3-grams of letters, in
order (ties: by n-gram). The profile of a language comes from all training
texts. A document's own list is compared with each profile by the out-of-place
distance: the sum over its n-grams of the difference between the two ranks,
``PROFILE_SIZE`` for an n-gram that the profile lacks. The nearest language
wins (ties: the smaller name); score = 1 - distance / greatest distance.

Text is lower-cased, and every run of non-letters counts as one space (also at
both ends). Texts of any length are counted whole: a long one in chunks, each of
which takes up the last ``ORDERS`` - 1 codes of the one before, so that no n-gram is
lost or made up at a cut.

Defined results: a null text, or one without a letter, gives ``und`` and score
0. With no training rows (empty table, or all texts or languages null) each
text gives ``und`` and 0. Repeated rows count as often as they occur. A text
none of whose n-grams is in any profile gets the first language name, score 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kestrel.llm.common import table

ORDERS = 3
PROFILE_SIZE = 400
MAX_LANGUAGES = 2000   # profiles travel to the tasks: PROFILE_SIZE x languages rows at most
CHUNK = 1 << 19
UNDETERMINED = "und"
_BITS = np.int64(21)   # a code point has at most 21 bits, so three fit in 63
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        flags = np.zeros(0x110000, dtype=bool)
        flags[[c for c in range(0x110000) if chr(c).isalpha()]] = True
        _LETTER.append(flags)
    return _LETTER[0]


def _codes(text: str) -> Iterator[np.ndarray]:
    """Lower-cased letters with single spaces between, before and after, in chunks
    of at most about CHUNK codes (none for a text without a letter)."""
    low, begun, after_letter = text.lower(), False, False
    for at in range(0, len(low), CHUNK):
        code = np.frombuffer(low[at:at + CHUNK].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        letter = _letters()[code]
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        keep[0] |= after_letter
        out = np.where(letter, code, 32)[keep].astype(np.int64)
        after_letter = bool(letter[-1])
        ends = [] if at + CHUNK < len(low) or not after_letter else [32]    # a text that ends in a letter
        if len(out):
            yield np.concatenate([[] if begun else [32], out, ends]).astype(np.int64)
            begun = True
        elif ends:
            yield np.array(ends, dtype=np.int64)


def _grams(code: np.ndarray, known: int = 0) -> np.ndarray:
    """The n-grams of the codes that end behind the first ``known`` ones, n = 1 to
    ORDERS, each packed into 63 bits."""
    fresh = code[known:]
    parts, gram = [fresh[fresh != 32]], code
    for n in range(2, ORDERS + 1):
        gram = (gram[:-1] << _BITS) | code[n - 1:]
        parts.append(gram[max(0, known - n + 1):])
    return np.concatenate(parts)


def _gram_chunks(text: str) -> Iterator[np.ndarray]:
    """All n-grams of a whole text, in bounded pieces."""
    tail = np.zeros(0, dtype=np.int64)
    for code in _codes(text):
        both = np.concatenate([tail, code])
        yield _grams(both, len(tail))
        tail = both[-(ORDERS - 1):]


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct packed n-grams of a whole text and how often each occurs."""
    keys, counts = [], []
    for grams in _gram_chunks(text):
        k, c = np.unique(grams, return_counts=True)
        keys, counts = _merged(keys + [k], counts + [c]) if keys else ([k], [c])
    none = np.zeros(0, dtype=np.int64)
    return (keys[0], counts[0]) if keys else (none, none)


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    k, at = np.unique(np.concatenate(keys), return_inverse=True)
    return [k], [np.bincount(at, weights=np.concatenate(counts), minlength=len(k)).astype(np.int64)]


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: one count per (language, n-gram)."""
    totals: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        by_lang: dict[str, list[str]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            by_lang.setdefault(lang, []).append(text)
        for lang, texts in by_lang.items():
            held, size = [], 0
            keys, counts = ([totals[lang][0]], [totals[lang][1]]) if lang in totals else ([], [])
            for k, text in enumerate(texts):
                if len(text) > CHUNK:
                    a, b = gram_counts(text)
                    keys.append(a), counts.append(b)
                else:
                    for grams in _gram_chunks(text):
                        held.append(grams)
                        size += len(grams)
                if size > 4 * CHUNK or (held and k == len(texts) - 1):
                    a, b = np.unique(np.concatenate(held), return_counts=True)
                    keys.append(a), counts.append(b)
                    held, size = [], 0
            if keys:
                keys, counts = _merged(keys, counts)
                totals[lang] = keys[0], counts[0]
    for lang, (keys, counts) in totals.items():
        for at in range(0, len(keys), 1 << 16):
            part = keys[at:at + (1 << 16)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(part), pa.string()), pa.array(part), pa.array(counts[at:at + (1 << 16)])],
                names=["lang", "gram", "n"])


def learn_profiles(rows: DataFrame, lang_col: str = "lang", text_col: str = "text") -> dict[str, np.ndarray]:
    """Language -> its n-grams, most frequent first, counted over all ``rows``
    with a language and a text. Only the profiles reach the driver
    (PROFILE_SIZE rows a language; over MAX_LANGUAGES languages is an error)."""
    known = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")) \
        .where("lang is not null and text is not null")
    counts = known.mapInArrow(_count_batches, "lang string, gram bigint, n bigint") \
        .groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # the first cut is per (language, part of the n-grams), so no task ranks a whole language
    part = F.pmod(F.xxhash64("gram"), F.lit(64))
    order = [F.desc("n"), F.asc("gram")]
    first = counts.withColumn("part", part) \
        .withColumn("r", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))) \
        .where(F.col("r") <= PROFILE_SIZE).drop("r", "part")
    ranked = first.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(*order))) \
        .where(F.col("r") <= PROFILE_SIZE)
    top = ranked.limit(PROFILE_SIZE * MAX_LANGUAGES + 1).collect()
    if len(top) > PROFILE_SIZE * MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    found: dict[str, list[tuple[int, int]]] = {}
    for row in top:
        found.setdefault(row["lang"], []).append((row["r"], row["gram"]))
    return {lang: np.array([g for _, g in sorted(found[lang])], dtype=np.int64) for lang in sorted(found)}


class _Ranker:
    """Out-of-place distances to all profiles at once."""

    def __init__(self, profiles: dict[str, np.ndarray]):
        self.names = list(profiles)
        self.grams = np.unique(np.concatenate(list(profiles.values())))
        self.rank = np.full((len(self.grams), len(self.names)), -1, dtype=np.int64)
        for j, grams in enumerate(profiles.values()):
            self.rank[np.searchsorted(self.grams, grams), j] = np.arange(len(grams))

    def classify(self, text: str) -> tuple[str, float]:
        keys, counts = gram_counts(text)
        if len(keys) == 0:
            return UNDETERMINED, 0.0
        own = keys[np.lexsort((keys, -counts))[:PROFILE_SIZE]]
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        there = np.where((self.grams[at] == own)[:, None], self.rank[at], -1)
        place = np.arange(len(own))[:, None]
        distance = np.where(there < 0, PROFILE_SIZE, np.abs(there - place)).sum(axis=0)
        best = int(np.argmin(distance))
        return self.names[best], 1.0 - float(distance[best]) / (PROFILE_SIZE * len(own))


def classifier(profiles: dict[str, np.ndarray]):
    """A column function text -> struct(lang_pred, score)."""
    if not profiles:
        return lambda text: F.struct(F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    made: list[_Ranker] = []

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        if not made:
            made.append(_Ranker(profiles))
        rows = [made[0].classify(t) if isinstance(t, str) else (UNDETERMINED, 0.0) for t in texts]
        return pd.DataFrame(rows, columns=["lang_pred", "score"])

    return lambda text: predict(F.col(text).cast("string") if isinstance(text, str) else text)


def held_out(doc_id: str) -> Column:
    """True for the fold that is never learned from (a null id is not in it)."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, lang_pred, score."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = rows.select("doc_id", held_out("doc_id").alias("held_out"), classifier(profiles)("text").alias("p"))
    return out.select("doc_id", "held_out", "p.lang_pred", "p.score")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, learn_profiles(docs.where(~held_out("doc_id"))))
