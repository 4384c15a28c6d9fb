"""Running sums over an order, by ranges of it.

A window over a whole key (or over everything) is one task's work. Here the rows
are range-partitioned by (key, order) into ranges of about ``RANGE_ROWS`` rows; each
range sums up, the sums of the earlier ranges of a key (one row per range) are its
offset, and the running sum inside a range is a window over that range alone. So a
key with a third of all rows is many ranges, and ranges follow the number of rows,
not the values.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrel.session import cut_lineage

RANGE_ROWS = 20_000


def in_ranges(df: DataFrame, by: Sequence[str], order: Sequence[Column], range_rows: int | None = None) -> DataFrame:
    """``df`` with ``_range``, ascending with (by, order). Rows that tie may fall in
    two ranges, so ``order`` should tell rows apart. Checkpointed, so that every
    use sees the same ranges."""
    df = cut_lineage(df)
    n = max(1, math.ceil(df.count() / (range_rows or RANGE_ROWS)))
    return cut_lineage(df.repartitionByRange(n, *[F.col(b) for b in by], *order).withColumn("_range", F.spark_partition_id()))


def running_sums(df: DataFrame, by: Sequence[str], order: Sequence[Column], cols: Sequence[str], inclusive: bool = True,
                 range_rows: int | None = None) -> DataFrame:
    """``df`` with ``_cum_<col>`` for each of ``cols``: its sum over the rows of the
    same ``by`` up to (or, if not ``inclusive``, before) the row."""
    r = in_ranges(df, by, order, range_rows)
    sums = r.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_t_{c}") for c in cols])
    earlier = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    earlier = earlier.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    keys = [F.col(b).alias(f"_k_{b}") for b in by]
    sums = sums.select(*keys, F.col("_range").alias("_at"), *[F.coalesce(F.sum(f"_t_{c}").over(earlier), F.lit(0)).alias(f"_o_{c}") for c in cols])
    same = F.col("_range") == F.col("_at")
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_k_{b}"))
    within = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    out = r.join(sums, same)
    return out.select(*df.columns, *[(F.col(f"_o_{c}") + F.coalesce(F.sum(c).over(within), F.lit(0))).alias(f"_cum_{c}") for c in cols])
