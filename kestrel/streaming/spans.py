"""The windows of quota spans, counted in Python workers (which import nothing but
this module, so that they stay small)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Counts (key and window) that a worker unfolds at once.
SPAN_CELLS = 1 << 17


def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts per window of rows (begin, requests, p, s): begin of the window, key, count."""
    for b in batches:
        if not len(b):
            continue
        begin, p, s = (b.column(c).to_numpy(zero_copy_only=False) for c in ("begin", "p", "s"))
        held = b.column("requests")
        row = np.repeat(np.arange(len(b)), held.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        keys, at = held.flatten().flatten()
        keys = keys.dictionary_encode(null_encoding="encode")
        code, off = keys.indices.to_numpy(zero_copy_only=False).astype(np.int64), at.to_numpy(zero_copy_only=False) - begin[row]
        order = np.lexsort((code, row))
        row, code, off = row[order], code[order], off[order]
        p, s = p[row], s[row]
        n = -(-p // s)                            # the windows of a span
        low, high = np.maximum((off - p) // s + 1, 0), np.minimum(off // s, n - 1)      # those that hold the request
        first = np.ones(len(row), dtype=bool)
        first[1:] = (row[1:] != row[:-1]) | (code[1:] != code[:-1])
        group, starts = np.cumsum(first) - 1, np.flatnonzero(first)
        most = int(n.max(initial=1))
        step = max(1, SPAN_CELLS // most)
        for g in range(0, len(starts), step):     # groups g to h: one row of counts each
            h = min(g + step, len(starts))
            one = slice(starts[g], starts[h] if h < len(starts) else len(row))
            in_it = low[one] <= high[one]
            at_row = (group[one][in_it] - g) * (most + 1)
            cells = (h - g) * (most + 1)
            change = np.bincount(at_row + low[one][in_it], minlength=cells) - np.bincount(at_row + high[one][in_it] + 1, minlength=cells)
            counts = np.cumsum(change)
            cell = np.flatnonzero(counts)
            of = starts[g:h][cell // (most + 1)]
            yield pa.RecordBatch.from_arrays([
                pa.array(begin[row[of]] + cell % (most + 1) * s[of]), keys.dictionary.take(pa.array(code[of])), pa.array(p[of]),
                pa.array(counts[cell])], names=["_begin", "_key", "_p", "_n"])
