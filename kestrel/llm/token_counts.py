"""Token counts under a unigram vocabulary, by dynamic programming on a trie
(operator 9).

A text's pre-tokens are its white-space separated runs, each with a leading
``▁``. The pre-tokens that a task has not met before are inserted in a trie, and
the best unigram score of every prefix is computed once, for all pre-tokens that
share it, one trie level at a time: the best segmentation of a node's prefix is
that of an ancestor plus the piece between. Its score and number of tokens are
stored where a pre-token ends and looked up for every further occurrence, so a
document costs one lookup per run. Nothing is shuffled; the store is bounded
(``REMEMBERED``) and begun anew when it is full, which changes no result.

Runs of any length go into the trie; in text without white space they share
prefixes like others. On a level with fewer than ``FEW`` nodes the rest of each
branch is a chain: it is walked character by character from the scores of its last
ancestors, since a step of a whole level would cost more than its nodes.

A character that no piece covers costs one token per byte (byte fallback) and
``UNKNOWN`` below the least score. Of equally good segmentations that with the
longest last piece is taken.

Scores: the vocabulary file lists its pieces by rank but has no probabilities,
so a piece of rank r scores -log(r + 1) (Zipf's law), unless others are given.

Defined results: a null or empty text, or white space alone, has no tokens and
score 0. Repeated rows are counted alike. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm import words
from kestrel.llm.common import table

REMEMBERED = 1 << 20
TRIE_CODES = 1 << 21    # code points of the pre-tokens inserted in one trie
FEW = 24                # nodes of a level
UNKNOWN = 10.0
SPACE = "▁"
_SLOT_BITS = 20


def pieces(path: str) -> dict[str, float]:
    """Piece -> score, without control and byte pieces."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [model.id_to_piece(k) for k in range(model.get_piece_size())
             if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k))]
    return {p: -math.log(r + 1) for r, p in enumerate(plain, start=1)}


def vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _bytes_of(code: np.ndarray) -> np.ndarray:
    return 1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)


class Counter:
    """Best score and token count of pre-tokens."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.unknown = min(scores.values(), default=0.0) - UNKNOWN
        self.up, self.down = words._powers(self.longest + 2)
        names = list(scores)
        code = [(_codes(p).astype(np.uint64) + np.uint64(1)) for p in names]
        hashes = np.array([(c * self.up[:len(c)]).sum(dtype=np.uint64) for c in code], dtype=np.uint64)
        order = np.argsort(hashes)
        self.hash, self.score = hashes[order], np.array([scores[p] for p in names])[order]
        self.slot = np.zeros(1 << _SLOT_BITS, dtype=bool)
        self.slot[(words.mix(self.hash) >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)] = True
        self.place: dict[str, int] = {}
        self.count: list[np.ndarray] = []
        self.best: list[np.ndarray] = []

    def one(self, run: str) -> tuple[int, float]:
        """The best segmentation of a single run, character by character."""
        return self._walk(SPACE + run, 0, [(0.0, 0)])

    def _walk(self, text: str, done: int, best: list[tuple[float, int]]) -> tuple[int, float]:
        """The rest of a run from its character ``done`` on: ``best`` holds (score,
        tokens) of the prefixes before, up to ``longest`` of them, in order."""
        start = len(best) - 1
        for end in range(done + 1, len(text) + 1):
            c = text[end - 1]
            top = None
            for n in range(min(self.longest, end), 0, -1):
                s = self.scores.get(text[end - n:end])
                extra = 1
                if s is None:
                    if n > 1:
                        continue
                    s, extra = self.unknown, int(_bytes_of(_codes(c))[0])
                before, tokens = best[start + end - done - n]
                if top is None or before + s > top[0]:
                    top = (before + s, tokens + extra)
            best.append(top)
        return best[-1][1], best[-1][0]

    def _trie(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Counts and scores of distinct runs, level by level."""
        texts = [SPACE + r for r in runs]
        length = np.array([len(t) for t in texts])
        code = _codes("".join(texts))
        first = np.cumsum(length) - length
        parent = [np.zeros(1, dtype=np.int64)]
        value, score, tokens = [np.zeros(1, dtype=np.uint64)], [np.zeros(1)], [np.zeros(1, dtype=np.int64)]
        at = np.zeros(len(runs), dtype=np.int64)      # of each run: its node on this level
        out_count, out_score = np.zeros(len(runs), dtype=np.int64), np.zeros(len(runs))
        active = np.arange(len(runs))
        for depth in range(1, int(length.max()) + 1):
            if len(active) < FEW or depth >= len(self.up):
                break
            char = code[first[active] + depth - 1].astype(np.int64)
            node, place = np.unique((at[active] << 21) | char, return_inverse=True)
            above, char = node >> 21, node & 0x1FFFFF
            own = value[-1][above] + (char + 1).astype(np.uint64) * self.up[depth - 1]
            top, least = np.full(len(node), -np.inf), np.zeros(len(node), dtype=np.int64)
            anc = above
            for n in range(1, min(self.longest, depth) + 1):
                # the piece is the last n characters: between the ancestor n levels up and the node
                piece = (own - value[depth - n][anc]) * self.down[depth - n]
                maybe = np.flatnonzero(self.slot[(words.mix(piece) >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)])
                found = np.minimum(np.searchsorted(self.hash, piece[maybe]), len(self.hash) - 1)
                hit = self.hash[found] == piece[maybe]
                maybe, found = maybe[hit], found[hit]
                if n == 1:
                    top[:] = score[depth - 1][anc] + self.unknown
                    least[:] = tokens[depth - 1][anc] + _bytes_of(char)
                    top[maybe] = -np.inf
                got = score[depth - n][anc[maybe]] + self.score[found]
                better = got >= top[maybe]
                maybe = maybe[better]
                top[maybe], least[maybe] = got[better], tokens[depth - n][anc[maybe]] + 1
                if n < depth:
                    anc = parent[depth - n][anc]
            parent.append(above), value.append(own), score.append(top), tokens.append(least)
            at[active] = place
            ends = active[length[active] == depth]
            out_count[ends], out_score[ends] = least[at[ends]], top[at[ends]]
            active = active[length[active] > depth]
        reached = len(score) - 1
        for r in active.tolist():
            best, node = [], int(at[r])
            for depth in range(reached, max(-1, reached - self.longest), -1):
                best.append((float(score[depth][node]), int(tokens[depth][node])))
                node = int(parent[depth][node]) if depth else 0
            out_count[r], out_score[r] = self._walk(texts[r], reached, best[::-1])
        return out_count, out_score

    def learn(self, runs: set[str]) -> None:
        if len(self.place) + len(runs) > REMEMBERED:
            self.place, self.count, self.best = {}, [], []
        part, size = [], 0
        for run in sorted(runs):
            part.append(run)
            size += len(run) + 1
            if size >= TRIE_CODES:
                self._keep(part, *self._trie(part))
                part, size = [], 0
        if part:
            self._keep(part, *self._trie(part))

    def _keep(self, runs, count, best) -> None:
        start = len(self.place)
        self.place.update(zip(runs, range(start, start + len(runs))))
        self.count.append(count)
        self.best.append(best)

    def totals(self, texts: list[str | None]) -> list[tuple[int, int, float]]:
        """(pre-tokens, tokens, score) of each text."""
        runs = [(t or "").split() for t in texts]
        new = set().union(*runs) - self.place.keys()
        if new:
            if len(self.place) + len(new) > REMEMBERED:
                new = set().union(*runs)
                self.place, self.count, self.best = {}, [], []
            self.learn(new)
            self.count, self.best = [np.concatenate(self.count)], [np.concatenate(self.best)]
        out = []
        for r in runs:
            at = np.fromiter(map(self.place.__getitem__, r), dtype=np.int64, count=len(r))
            out.append((len(r), int(self.count[0][at].sum()), float(self.best[0][at].sum())) if len(r) else (0, 0, 0.0))
        return out


_MADE: dict[str, Counter] = {}


def token_counts(docs: DataFrame, model: str, scores: dict[str, float] | None = None, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_pretokens, n_tokens, score."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    own: list[Counter] = []

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if scores is not None:
            if not own:
                own.append(Counter(scores))
            counter = own[0]
        else:
            counter = _MADE.get(model) or _MADE.setdefault(model, Counter(pieces(model)))
        for batch in batches:
            texts, out, held, size = batch.column(1).to_pylist(), [], [], 0
            for text in texts:
                held.append(text)
                size += len(text or "")
                if size >= 8 * words.GROUP:
                    out += counter.totals(held)
                    held, size = [], 0
            out += counter.totals(held) if held else []
            pre, n, score = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(pre, pa.int64()), pa.array(n, pa.int64()),
                 pa.array(np.round(np.array(score, dtype=np.float64), 6))], names=["doc_id", "n_pretokens", "n_tokens", "score"])

    return rows.mapInArrow(count, f"doc_id {kind}, n_pretokens bigint, n_tokens bigint, score double")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), vocabulary())
