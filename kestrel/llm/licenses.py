"""Licence scans (operator 8): TF-IDF cosine of headers and licence files to
templates, then inheritance from the nearest licensed directory above.

A term is one of ``TERMS`` hash buckets of words, so the document frequencies of
the whole corpus are a vector of fixed size, the only statistic that is sent to
the tasks. Every line of every file is compared with every statement of
:data:`TEMPLATES`, and a licence file also as a whole. Besides, every file is
searched for passages: the full licence texts, their beginnings and the usual
source headers (``license_texts``), SPDX lines and the statements again, across
lines and inside of them. A passage of n words is compared with the run of n words
(all, of a shorter file) that shares most weight with it; a statement's or SPDX
line's run has to hold the words that name the licence. A file's licence is
that of the nearest template or passage, if the cosine is at least ``LEAST``.
(Ties: the earlier template, the earlier line.)

A licence file (its name begins with LICENSE, LICENCE, COPYING or NOTICE)
licenses its directory; of several the one with the highest cosine, then the
smaller path. A file without a licence of its own takes that of the nearest
directory above it that has one. Only distinct directories are joined with their
ancestors, so a directory with a third of all files costs one row there.

Defined results: a null or empty text has no licence of its own; a null path has
the empty directory. Repeated rows are judged alike. Without any licence nothing
is inherited: license, basis, score and directory are null. An empty table
gives no rows.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm import words
from kestrel.llm.common import cut, table

TERMS = 1 << 17
LEAST = 0.7
# a title or the first words of a licence, below copyright lines or not
LICENSE_START = (r"(?i)\A\s*(?:(?:the\s+)?(?:(?:mit|isc|apache|(?:gnu\s+)?(?:lesser\s+|affero\s+)?general\s+public|mozilla\s+public"
                 r"|bsd\s+[23]-clause)\s+licen[sc]e\b[^\n]*|[23]-clause\s+bsd\s+licen[sc]e\b[^\n]*)\s+(?:version\b|copyright\b|permission\b"
                 r"|redistribution\b)|(?:copyright\b[^\n]*\n\s*)*(?:permission is hereby granted, free of charge|permission to use, copy, modify"
                 r"|redistribution and use in source and binary forms|this is free and unencumbered software))")
LICENSE_FILE = r"(?i)^(licen[sc]e|copying|notice)"

# fixed values: SPDX identifiers and the customary statements that name the licence
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License. See LICENSE in the project root for license information."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except '
                   "in compliance with the License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Licensed under the 3-Clause BSD License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


# the words that a run of words must hold to be one of the statements above
NAMING = ("mit license", "mit license", "apache license 2", "apache license 2", "gnu general public 2", "gnu general public 3",
          "lesser general public 3", "affero general public 3", "3 clause bsd", "mozilla public 2", "cc by 4", "cc by sa 4",
          "cc by nc 4", "public domain cc0", "unencumbered public domain")
SPDX = ("MIT", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0",
        "ISC", "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0")
HEAD_WORDS = 100   # the beginning of a longer licence text is a passage of its own
TEXTS = os.path.join(os.path.dirname(os.path.abspath(__file__)), "license_texts")


def passages() -> list[tuple[str, str, str]]:
    """(licence, text, words it must hold). The statements come first, so that a
    passage and a template of the same number are the same. Read on the driver."""
    out = [(name, text, must) for (name, text), must in zip(TEMPLATES, NAMING, strict=True)]
    out += [(name, f"SPDX-License-Identifier: {name}", f"spdx {name}") for name in SPDX]
    for file in sorted(os.listdir(TEXTS)):
        with open(os.path.join(TEXTS, file), encoding="utf-8") as f:
            text = f.read()
        name = file.removesuffix(".txt").removesuffix(".header")
        out.append((name, text, ""))
        if len(text.split()) > 3 * HEAD_WORDS:
            out.append((name, " ".join(text.split()[:HEAD_WORDS]), ""))
    return out


def _terms(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - (TERMS - 1).bit_length())).astype(np.int64)


def document_frequencies(files: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """How many of all texts hold each term (TERMS numbers), and how many texts there are."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(TERMS, dtype=np.int64)
        for batch in batches:
            for _, _, hashes, per in words.word_hashes(batch.column(0).to_pylist()):
                row = np.repeat(np.arange(len(per)), per)
                held += np.bincount(np.unique(row * TERMS + _terms(hashes)) % TERMS, minlength=TERMS)
        term = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(term.astype(np.int32)), pa.array(held[term])], names=["term", "n"])

    text = files.select(F.col(text_col).cast("string").alias("text"))
    out = np.zeros(TERMS, dtype=np.int64)
    for term, n in text.mapInArrow(count, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[term] = n   # at most TERMS rows
    return out, files.count()


class Matcher:
    """Cosines of lines with the template statements."""

    def __init__(self, frequency: np.ndarray, total: int, templates=TEMPLATES, least: float = LEAST):
        self.least, self.names = least, [name for name, _ in templates]
        self.idf = np.log((1 + total) / (1 + frequency)) + 1
        self.templates = np.zeros((TERMS, len(templates)), dtype=np.float64)
        for k, (_, statement) in enumerate(templates):
            for _, _, hashes, _ in words.word_hashes([statement]):
                term, n = np.unique(_terms(hashes), return_counts=True)
                weight = n * self.idf[term]
                self.templates[term, k] = weight / np.sqrt((weight ** 2).sum())
        self.used = self.templates.any(axis=1)

    def scores(self, lines: list[str]) -> Iterator[tuple[int, int, float]]:
        """(line, template, cosine) of the nearest template of lines that reach the least cosine."""
        for first, _, hashes, per in words.word_hashes(lines):
            term = _terms(hashes)
            hit = np.flatnonzero(self.used[term])
            if not len(hit):
                continue
            row = np.repeat(np.arange(len(per)), per)
            some = np.unique(row[hit])
            stop = np.cumsum(per)
            # the norm is at least that of terms that occur once: a cheap bound first
            square = np.concatenate([[0.0], np.cumsum(self.idf[term] ** 2)])
            bound = np.sqrt(square[stop[some]] - square[stop[some] - per[some]])
            dot = np.zeros((len(per), len(self.names)))
            np.add.at(dot, row[hit], self.idf[term[hit], None] * self.templates[term[hit]])
            for k in some[dot[some].max(axis=1) >= self.least * bound - 1e-9].tolist():
                own, n = np.unique(term[stop[k] - per[k]:stop[k]], return_counts=True)
                cosine = np.round(dot[k] / np.sqrt(((n * self.idf[own]) ** 2).sum()), 6)
                best = int(np.argmax(cosine))
                if cosine[best] >= self.least:
                    yield first + k, best, float(cosine[best])


def _term_list(text: str) -> np.ndarray:
    return _terms(np.concatenate([np.zeros(0, dtype=np.uint64), *(h for _, _, h, _ in words.word_hashes([text]))]))


class Passages:
    """Cosines of runs of words with passages of the same number of words."""

    def __init__(self, idf: np.ndarray, found: list[tuple[str, str, str]], least: float = LEAST):
        self.idf, self.least, self.names = idf, least, [name for name, _, _ in found]
        terms = [_term_list(text) for _, text, _ in found]
        self.length = [len(t) for t in terms]
        self.must = [np.unique(_term_list(must)) for _, _, must in found]
        used = np.unique(np.concatenate(terms))
        self.column = np.full(TERMS, -1, dtype=np.int64)
        self.column[used] = np.arange(len(used))
        self.weight = np.zeros((len(found), len(used)))
        for k, own in enumerate(terms):
            term, n = np.unique(own, return_counts=True)
            weight = n * idf[term]
            self.weight[k, self.column[term]] = weight / np.sqrt((weight ** 2).sum())
        self.square = np.ascontiguousarray((self.weight ** 2).T)

    def _cosine(self, k: int, own: np.ndarray) -> float:
        n = min(self.length[k], len(own))
        column = self.column[own]
        gain = np.concatenate([[0.0], np.cumsum(np.where(column >= 0, self.weight[k][column] * self.idf[own], 0.0))])
        shared = gain[n:] - gain[:-n]
        for term in self.must[k]:
            held = np.concatenate([[0], np.cumsum(own == term)])
            shared[held[n:] == held[:-n]] = -1.0
        at = int(np.argmax(shared))
        if shared[at] <= 0:
            return 0.0
        term, n = np.unique(own[at:at + n], return_counts=True)
        column = self.column[term]
        dot = (n * self.idf[term] * np.where(column >= 0, self.weight[k][column], 0.0)).sum()
        return round(float(dot / np.sqrt(((n * self.idf[term]) ** 2).sum())), 6)

    def find(self, texts: list[str | None]) -> Iterator[tuple[int, int, float]]:
        """(text, passage, cosine) of the nearest passage of texts that reach the least cosine."""
        for first, _, hashes, per in words.word_hashes(texts):
            term = _terms(hashes)
            column = self.column[term]
            hit = np.flatnonzero(column >= 0)
            if not len(hit):
                continue
            held = np.unique(np.repeat(np.arange(len(per)), per)[hit] * self.square.shape[0] + column[hit])
            row, column = np.divmod(held, self.square.shape[0])
            start = np.flatnonzero(np.diff(row, prepend=-1))
            # no run can come nearer than the part of the passage whose terms the text has
            near = np.add.reduceat(self.square[column], start, axis=0) >= self.least ** 2 - 1e-6
            stop = np.cumsum(per)
            for j in np.flatnonzero(near.any(axis=1)).tolist():
                r = int(row[start[j]])
                own = term[stop[r] - per[r]:stop[r]]
                cosine, minus = max((self._cosine(k, own), -k) for k in np.flatnonzero(near[j]).tolist())
                if cosine >= self.least:
                    yield first + r, -minus, cosine


def own_licenses(files: DataFrame, id_col: str, path: Column, text_col: str = "text") -> DataFrame:
    """(doc_id, path, directory, is_license_file, license, score, line) per file."""
    frequency, total = document_frequencies(files, text_col)
    rows = files.select(F.col(id_col).alias("doc_id"), path.cast("string").alias("path"),
                        F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("directory", F.regexp_extract(F.coalesce("path", F.lit("")), r"^(.*)/[^/]*$", 1)) \
        .withColumn("is_license_file", F.coalesce(F.regexp_extract("path", r"([^/]*)$", 1).rlike(LICENSE_FILE), F.lit(False)))
    shared = files.sparkSession.sparkContext.broadcast((frequency, total, passages()))
    kind = rows.schema["doc_id"].dataType.simpleString()
    rows = rows.select("doc_id", "path", "directory", "is_license_file", "text")
    made: list[Matcher | Passages] = []

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(Matcher(*shared.value[:2]))
            made.append(Passages(made[0].idf, shared.value[2]))
        for batch in batches:
            parts, owner, line_no, texts = [], [], [], []
            best: dict[int, tuple[float, int, int]] = {}

            def judge():
                for part, template, cosine in made[0].scores(parts):
                    found = (cosine, -template, -line_no[part])
                    best[owner[part]] = max(best.get(owner[part], found), found)
                for row, passage, cosine in made[1].find([text for _, text in texts]):
                    found = (cosine, -passage, 0)
                    best[texts[row][0]] = max(best.get(texts[row][0], found), found)
                parts.clear(), owner.clear(), line_no.clear(), texts.clear()

            size = 0
            for k, (text, whole) in enumerate(zip(batch.column(4).to_pylist(), batch.column(3).to_pylist())):
                lines = text.split("\n") if text else []
                texts.append((k, text))
                for n, line in enumerate([text, *lines] if whole and lines else lines):
                    parts.append(line)
                    owner.append(k)
                    line_no.append(n)
                size += len(text or "")
                if size > 8 * words.GROUP:
                    judge()
                    size = 0
            judge()
            got = [best.get(k) for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array([None if g is None else made[1].names[-g[1]] for g in got], pa.string()),
                 pa.array([None if g is None else g[0] for g in got], pa.float64())],
                names=["doc_id", "path", "directory", "is_license_file", "license", "score"])

    return rows.mapInArrow(scan, f"doc_id {kind}, path string, directory string, is_license_file boolean, "
                                 f"license string, score double")


def inherit(own: DataFrame) -> DataFrame:
    """Give files without a licence that of the nearest licensed directory above."""
    licensed = own.where("is_license_file and license is not null").groupBy(F.col("directory").alias("above")).agg(
        F.min(F.struct((-F.col("score")).alias("minus"), "path", "license")).alias("first")) \
        .select("above", "first.license", (-F.col("first.minus")).alias("score"))
    step = F.split("directory", "/")
    above = own.where("license is null").select("directory").distinct() \
        .withColumn("depth", F.explode(F.sequence(F.size(step), F.lit(0), F.lit(-1)))) \
        .withColumn("above", F.array_join(F.slice(step, 1, F.col("depth")), "/"))
    nearest = above.join(licensed, "above").groupBy("directory").agg(
        F.max_by(F.struct("above", "license", "score"), "depth").alias("given"))
    out = own.join(nearest, "directory", "left")
    own_basis = F.when(F.col("is_license_file"), "license file").otherwise("header")
    mine = F.col("license").isNotNull()
    return out.select(
        "doc_id", "path", F.coalesce("license", "given.license").alias("license"),
        F.when(mine, own_basis).when(F.col("given").isNotNull(), "inherited").alias("basis"),
        F.coalesce("score", "given.score").alias("score"),
        F.when(~mine, F.col("given.above")).alias("inherited_from"))


def tree_path(doc_id: str = "doc_id", source: str = "source", text: str = "text") -> Column:
    """The documents have no paths: they are laid out by source and number, 64 to a
    directory, 64 directories to the next. One that states the licence of the work
    as a whole ("this work is licensed ...") or begins like a licence text takes
    the name of a licence file."""
    number = F.coalesce(F.col(doc_id).cast("bigint"), F.lit(0))
    name = F.when(F.col(text).rlike(r"(?i)\bthis work is licensed\b") | F.col(text).rlike(LICENSE_START), F.lit("LICENSE-")).otherwise(F.lit("doc-"))
    return F.concat(F.coalesce(F.col(source), F.lit("")), F.lit("/"), F.floor(number / 4096).cast("string"), F.lit("/"),
                    F.floor(number / 64).cast("string"), F.lit("/"), name, F.coalesce(F.col(doc_id).cast("string"), F.lit("")))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inherit(cut(own_licenses(table(spark, sf_dir, "documents"), "doc_id", tree_path())))
