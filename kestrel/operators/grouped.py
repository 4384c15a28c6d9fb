"""Sorted grouped map: many small groups per task without a per-group
Arrow round trip.

``applyInPandas`` ships every group separately between the JVM and Python;
with thousands of small groups that overhead dominates. Here the frame is
hash-partitioned on the group keys and sorted within partitions (one
shuffle, the same one ``groupBy`` would do), then ``mapInPandas`` walks each
partition's Arrow batches and hands ``fn`` a batch of *complete* groups with
their row ranges. A group cut by a batch boundary is carried over to the next
batch, so memory is bounded by batch size plus the largest group, never by
the partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Bounds = list[tuple[int, int]]


def _complete_groups(batches: Iterator[pd.DataFrame], keys: Sequence[str]) -> Iterator[tuple[pd.DataFrame, Bounds]]:
    carry: pd.DataFrame | None = None
    for b in batches:
        if carry is not None and len(carry):
            b = pd.concat([carry, b], ignore_index=True)
        if not len(b):
            continue
        change = np.zeros(len(b), dtype=bool)
        change[0] = True
        for k in keys:
            v = b[k].to_numpy()
            change[1:] |= v[1:] != v[:-1]
        starts = change.nonzero()[0].tolist()
        last = starts[-1]
        if last > 0:
            done = b.iloc[:last].reset_index(drop=True)
            yield done, list(zip(starts[:-1], starts[1:]))
        carry = b.iloc[last:].reset_index(drop=True)
    if carry is not None and len(carry):
        yield carry, [(0, len(carry))]


def sorted_group_map(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                     fn: Callable[[pd.DataFrame, Bounds], pd.DataFrame], schema: str) -> DataFrame:
    """``fn(batch, bounds)`` gets rows sorted by (keys, order) and the
    [start, end) range of each complete group in the batch."""
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch, bounds in _complete_groups(it, keys):
            yield fn(batch, bounds)
    from kestrel.session import ship_package
    ship_package(df.sparkSession)
    part = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    return part.mapInPandas(run, schema)
