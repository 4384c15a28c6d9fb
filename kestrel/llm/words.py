"""Word and shingle hashing on whole texts, vectorised over code points.

A word is a maximal run of code points for which ``str.isalnum`` holds, in
lower case. Texts are hashed in groups of about ``GROUP`` code points, so the
working memory does not depend on the size of a batch; a longer text is cut
between words and its pieces are hashed one after another.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

GROUP = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_STEP = np.array([pow(0xD6E8FEB86659FD93, k, 1 << 64) for k in range(64)], dtype=np.uint64)
_TABLES: dict[str, np.ndarray] = {}


def _is_word() -> np.ndarray:
    if "word" not in _TABLES:
        table = np.zeros(0x110000, dtype=bool)
        table[[c for c in range(0x110000) if chr(c).isalnum()]] = True
        _TABLES["word"] = table
    return _TABLES["word"]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n."""
    if "up" not in _TABLES or len(_TABLES["up"]) < n:
        size = max(n, 2 * GROUP)
        for name, b in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            row = np.full(size, np.uint64(b), dtype=np.uint64)
            row[0] = 1
            _TABLES[name] = np.multiply.accumulate(row)
    return _TABLES["up"], _TABLES["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _pieces(text: str) -> Iterator[str]:
    """The text in pieces of at most about GROUP code points, cut at white space
    (or, in a run without any, where GROUP is reached)."""
    at = 0
    while len(text) - at > GROUP:
        cut = max(text.rfind(" ", at + 1, at + GROUP), text.rfind("\n", at + 1, at + GROUP))
        cut = at + GROUP if cut < 0 else cut
        yield text[at:cut]
        at = cut
    yield text[at:] if at else text


def _hash_group(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    lowered = [p.lower() for p in pieces]
    code = np.frombuffer("\n".join([*lowered, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ends = np.cumsum(np.fromiter((len(p) + 1 for p in lowered), dtype=np.int64, count=len(lowered)))
    word = _is_word()[code]
    edge = np.flatnonzero(np.diff(word.view(np.int8), prepend=np.int8(0)))
    first, last = edge[0::2], edge[1::2]
    up, down = _powers(len(code) + 1)
    total = np.zeros(len(code) + 1, dtype=np.uint64)
    np.cumsum((code.astype(np.uint64) + np.uint64(1)) * up[: len(code)], out=total[1:])
    hashes = mix((total[last] - total[first]) * down[first])
    per = np.diff(np.searchsorted(first, ends), prepend=0)
    return hashes, per


def word_hashes(texts: Sequence[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (from, to, hashes, counts): the word hashes of texts[from:to], one
    after another, and the number of words of each. None counts as empty."""
    start, group, size = 0, [], 0

    def flush(upto: int):
        hashes, per = _hash_group(group)
        return start, upto, hashes, per

    for k, text in enumerate(texts):
        text = text or ""
        if len(text) > GROUP:
            if group:
                yield flush(k)
            parts = [_hash_group([p])[0] for p in _pieces(text)]
            whole = np.concatenate(parts)
            yield k, k + 1, whole, np.array([len(whole)])
            start, group, size = k + 1, [], 0
            continue
        group.append(text)
        size += len(text) + 1
        if size >= GROUP:
            yield flush(k + 1)
            start, group, size = k + 1, [], 0
    if group:
        yield flush(start + len(group))


def shingle_hashes(hashes: np.ndarray, n: int = 5) -> np.ndarray:
    """Hashes of all runs of ``n`` words of one text in order; a text of fewer
    words is one shingle, a text without words has none."""
    m = len(hashes)
    if m == 0:
        return np.zeros(0, dtype=np.uint64)
    k = min(m, n)
    out = np.full(m - k + 1, np.uint64(k), dtype=np.uint64)
    for i in range(k):
        out += hashes[i: m - k + 1 + i] * _STEP[i + 1]
    return mix(out)


def shingle_sets(texts: Sequence[str | None], n: int = 5) -> Iterator[np.ndarray]:
    """For each text, its distinct shingle hashes in ascending order."""
    for _, _, hashes, per in word_hashes(texts):
        stop = np.cumsum(per)
        for a, b in zip((stop - per).tolist(), stop.tolist()):
            yield np.unique(shingle_hashes(hashes[a:b], n))
