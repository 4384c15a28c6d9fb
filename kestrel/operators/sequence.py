"""Per-entity sequence work that stays balanced when one entity is hot.

Rolling windows, streaks and running counts are defined over an entity's
rows in (day, tiebreak) order. A plain ``Window.partitionBy(entity)`` sends
all rows of an entity to one task; with 20 teams that is 1/20 of the data per
task (or a third, for a hot team). Instead the work is split into *chunks*:
(entity, day, range of ids), the ranges ``CHUNK_IDS`` ids wide, so an entity
with any number of rows on one day is several chunks (:func:`id_range`):

1. a window partitioned by the chunk numbers the rows of each chunk and
   collects the previous ``k`` rows inside the chunk (bounded arrays);
2. each chunk is reduced to one row: its size and its last ``k`` rows;
3. the chunk table (entities x active days x ranges -- bounded by the calendar
   and the ids, not by the rows) is scanned per entity to get, for each chunk, the running
   count and the last ``k`` rows *before* it (the carry-in);
4. the carry-in is joined back to the rows by chunk.

The same chunk table answers as-of questions ("state at the end of the last
day before D") without touching the row-level data again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def last_k(arr: Column, k: int) -> Column:
    """The last ``k`` elements of an array (all of them when shorter)."""
    return F.slice(arr, F.greatest(F.size(arr) - F.lit(k - 1), F.lit(1)), F.lit(k))


def empty_like(arr: Column) -> Column:
    return F.filter(arr, lambda _: F.lit(False))


CHUNK_IDS = 1 << 20     # ids of one chunk
PART = "_part"


def id_range(rows: DataFrame, first: str) -> Column:
    """The range of ids that a row's chunk covers, ascending with the first column
    of the order: of a number every ``CHUNK_IDS`` of them, of a text (hexadecimal
    hash ids) its first two characters."""
    if isinstance(rows.schema[first].dataType, (T.IntegralType, T.DecimalType, T.FractionalType)):
        return F.floor(F.col(first) / F.lit(CHUNK_IDS)).cast("long")
    return F.substring(F.col(first).cast("string"), 1, 2)


def within_chunk(rows: DataFrame, keys: Sequence[str], chunk: str, order: Sequence[str],
                 hist_cols: Sequence[str], k: int, with_prev: bool = True) -> DataFrame:
    """Adds ``_part`` (the chunk's range of ids), ``_rn`` (1-based row number in
    chunk), ``_n`` (chunk size; a second window, left out of plans that do not read it),
    ``_in_tail`` (among the chunk's last ``k`` rows) and, with ``with_prev``, ``_inprev``
    (up to ``k`` previous rows of the chunk, oldest first)."""
    part = [*keys, chunk, PART]
    rows = rows.withColumn(PART, id_range(rows, order[0]))
    w = Window.partitionBy(*part).orderBy(*order)
    out = (rows
           .withColumn("_rn", F.row_number().over(w))
           .withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*part)))
           .withColumn("_in_tail", F.lead(F.lit(True), k).over(w).isNull()))
    if with_prev:
        entry = F.struct(*[F.col(c) for c in (chunk, *order, *hist_cols)])
        out = out.withColumn("_inprev", F.sort_array(F.collect_list(entry).over(w.rowsBetween(-k, -1))))
    return out


def chunk_table(rows1: DataFrame, keys: Sequence[str], chunk: str, order: Sequence[str],
                hist_cols: Sequence[str], k: int, last_cols: Sequence[str] = ()) -> DataFrame:
    """One row per chunk: ``_n`` (its size), ``_tail`` (last ``k`` rows, ``k`` as for
    :func:`within_chunk`) and the values of ``last_cols`` on the chunk's last row."""
    entry = F.struct(*[F.col(c) for c in (chunk, *order, *hist_cols)])
    aggs = [F.max("_rn").cast("long").alias("_n"), F.sort_array(F.collect_list(entry)).alias("_tail")]
    aggs += [F.max_by(F.col(c), F.col("_rn")).alias(c) for c in last_cols]
    # Rows are already clustered by chunk: this aggregate adds no shuffle.
    return rows1.filter("_in_tail").groupBy(*keys, chunk, PART).agg(*aggs)


def chunk_carry(chunks: DataFrame, keys: Sequence[str], chunk: str, k: int) -> DataFrame:
    """Adds the running count and history before (``_carry_n``,
    ``_carry_hist``) and up to the end of (``_cum``, ``_end_hist``) each chunk,
    and ``_day_end`` for the last chunk of a day."""
    wc = Window.partitionBy(*keys).orderBy(chunk, PART)
    # each chunk holds >= 1 row, so the last k rows lie within the last k chunks
    end_hist = last_k(F.sort_array(F.flatten(F.collect_list("_tail").over(wc.rowsBetween(-(k - 1), 0)))), k)
    out = (chunks
           .withColumn("_cum", F.sum("_n").over(wc.rowsBetween(Window.unboundedPreceding, 0)))
           .withColumn("_end_hist", end_hist)
           .withColumn("_day_end", ~F.lead(chunk).over(wc).eqNullSafe(F.col(chunk)) | F.lead(PART).over(wc).isNull()))
    return (out
            .withColumn("_carry_n", F.coalesce(F.lag("_cum").over(wc), F.lit(0)))
            .withColumn("_carry_hist", F.coalesce(F.lag("_end_hist").over(wc), empty_like(F.col("_end_hist")))))


def attach_carry(rows1: DataFrame, carry: DataFrame, keys: Sequence[str], chunk: str, k: int,
                 carry_cols: Sequence[str] = ()) -> DataFrame:
    """Row-level ``_hist`` (last ``k`` rows strictly before the row, oldest
    first) and ``_seq`` (1-based position of the row in its entity)."""
    c = carry.select(*keys, chunk, PART, "_carry_n", "_carry_hist", *carry_cols)
    j = rows1.join(c, [*keys, chunk, PART], "inner")
    return (j.withColumn("_hist", last_k(F.concat(F.col("_carry_hist"), F.col("_inprev")), k))
             .withColumn("_seq", F.col("_carry_n") + F.col("_rn")))


def with_history(rows: DataFrame, keys: Sequence[str], chunk: str, order: Sequence[str],
                 hist_cols: Sequence[str], k: int) -> DataFrame:
    """Rows plus ``_hist``/``_seq``/``_rn`` (see module docstring)."""
    rows1 = within_chunk(rows, keys, chunk, order, hist_cols, k)
    carry = chunk_carry(chunk_table(rows1, keys, chunk, order, hist_cols, k), keys, chunk, k)
    return attach_carry(rows1, carry, keys, chunk, k)


def end_states(rows: DataFrame, keys: Sequence[str], chunk: str, order: Sequence[str],
               hist_cols: Sequence[str], k: int, last_cols: Sequence[str] = ()) -> DataFrame:
    """One row per (entity, day) with ``_end_hist`` (the last ``k`` rows up
    to and including the day's last row), ``_cum`` (rows so far) and the
    day's last-row ``last_cols``: the state any later day sees, computed
    without joining back to the rows."""
    rows1 = within_chunk(rows, keys, chunk, order, hist_cols, k, with_prev=False)
    return chunk_carry(chunk_table(rows1, keys, chunk, order, hist_cols, k, last_cols), keys, chunk, k).where("_day_end").drop(PART)


def tail_sum(arr: Column, field: str, n: int) -> Column:
    """Sum of ``field`` over the last ``n`` elements of ``arr`` (fewer when
    the array is shorter), unrolled into ``n`` element reads so it stays in
    whole-stage codegen (array lambdas do not)."""
    size = F.size(arr)
    terms = [F.coalesce(F.get(arr, size - F.lit(j))[field].cast("long"), F.lit(0).cast("long"))
             for j in range(1, n + 1)]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def head_sum(arr: Column, field: str, n: int) -> Column:
    """Sum of ``field`` over the first ``n`` elements of ``arr``."""
    terms = [F.coalesce(F.get(arr, F.lit(j))[field].cast("long"), F.lit(0).cast("long")) for j in range(n)]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def hist_sum(hist: Column, field: str, max_len: int) -> Column:
    """Sum of ``field`` over a history array of at most ``max_len`` items."""
    return tail_sum(hist, field, max_len)


def asof_tables(states: Sequence[tuple[DataFrame, str, Sequence[str], bool]], keys: Sequence[str], spine: DataFrame,
                spine_day: str) -> DataFrame:
    """As-of lookups in several state tables at once: for each distinct (keys,
    spine_day) of ``spine``, from each (table, day column, columns, strict) its
    last row before the day (or, not strict, up to it).

    Days and states are stacked and read in order per key: one shuffle, no join.
    Everything is reduced to (entity, day) first, so the window's input is
    bounded by entities x days, never by the fact table."""
    def stacked(df: DataFrame, day: str, place: int, own: int | None) -> DataFrame:
        cols = []
        for k, (t, _, names, _) in enumerate(states):
            kind = t.select(F.struct(*names)).schema[0].dataType
            cols.append((F.struct(*names) if k == own else F.lit(None).cast(kind)).alias(f"_s{k}"))
        return df.select(*keys, F.col(day).alias("_d"), F.lit(place).alias("_place"), *cols)

    # of one day: what a strict lookup must not see comes after the query, the rest before it
    both = stacked(spine.select(*keys, spine_day).distinct(), spine_day, 1, None)
    for k, (t, day, _, strict) in enumerate(states):
        both = both.unionByName(stacked(t, day, 2 if strict else 0, k))
    w = Window.partitionBy(*keys).orderBy("_d", "_place").rowsBetween(Window.unboundedPreceding, 0)
    looked = both.select(*keys, "_d", "_place", *[F.last(f"_s{k}", ignorenulls=True).over(w).alias(f"_s{k}")
                                                  for k in range(len(states))]).filter("_place = 1")
    return looked.select(*keys, F.col("_d").alias(spine_day),
                         *[F.col(f"_s{k}.{c}").alias(c) for k, (_, _, names, _) in enumerate(states) for c in names])


def asof_before(states: DataFrame, keys: Sequence[str], day: str, spine: DataFrame,
                spine_day: str, state_cols: Sequence[str]) -> DataFrame:
    """Strict as-of lookup: for each distinct (keys, spine_day) of ``spine``,
    the ``state_cols`` of the last ``states`` row with ``day < spine_day``.

    ``states`` holds at most one row per (keys, day). Both sides are reduced
    to (entity, day) before the per-entity window, so the window input is
    bounded by entities x days, never by the fact table.
    """
    return asof_tables([(states, day, state_cols, True)], keys, spine, spine_day)


def asof_upto(states: DataFrame, keys: Sequence[str], day: str, spine: DataFrame,
              spine_day: str, state_cols: Sequence[str]) -> DataFrame:
    """As :func:`asof_before` but including a state dated on the spine day."""
    return asof_tables([(states, day, state_cols, False)], keys, spine, spine_day)
