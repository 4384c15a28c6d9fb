"""Mixing sources to target weights by Pareto order sampling (operator 11).

1. Targets. The sources share a budget by weight; no target may exceed ``most``
   times its source's size, and what is cut off there is shared again. The result
   is one water level: sources are ordered by the level at which they are full,
   and the level is that of the first one that stays below its own.
2. Expected copies. Within a source a document is expected ``min(most, c * favour)``
   times, with ``c`` such that the expected words are the target. Favours are
   grades (few values), so ``c`` comes from one row per source and grade, by the
   same water level.
3. The whole part of the expected copies is certain. The rest, p, is the inclusion
   probability of one more copy: documents are ranked by u/(1-u) divided by
   p/(1-p), u a uniform hash of the id, and those of smallest rank are taken until
   the source's remaining words are used up. So inclusion is unequal, and the size
   of the sample, in words, is fixed: the document in which the words run out
   gives its first words only, the one document of its source that does.

A text is read once; what is shuffled is a few numbers per document. Running sums
are taken inside ranges of the rank order, a range holding ``RANGE_ROWS`` rows
whatever the source's share of all rows; one row per range and source is summed
over the ranges. Reruns agree, since u depends on the id only.

Defined results: a null text has size 0; documents of size 0 are never taken. A
null source is a source, the last one. Null ids share one u; rows that tie are
ordered by size, and wholly equal rows are interchangeable. Null or non-positive
favours count as 1. An empty table gives no rows; if all sizes are 0, all targets are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kestrel.llm.common import bucket_count, cut, running_offsets, table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
RANGE_ROWS = 20_000
SMALL_ROWS = 200_000    # a table of so few narrow rows may be sent to all tasks
_EXACT = 1e-12


def n_words(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def _sent(df: DataFrame) -> DataFrame:
    """``df``, sent to all tasks if its checked size allows."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``sizes(source, source_size)``, one row per source -> also ``weight`` and
    ``target``. Weights repeat in order of the sources, null last. (The windows
    hold one row per source.)"""
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    full = F.lit(float(most)) * F.col("source_size")
    s = sizes.select("source", "source_size", weight.alias("weight")).withColumn("_at", full / F.col("weight"))
    order = Window.orderBy("_at", F.asc_nulls_last("source"))
    earlier, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("source_size").over(earlier), F.lit(0))
    s = s.withColumn("_level", (F.lit(float(share)) * F.sum("source_size").over(everything) - F.lit(float(most)) * before)
                     / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0))))
    s = s.withColumn("_no", F.row_number().over(order))
    s = s.withColumn("_water", F.min(F.when(F.col("_level") <= F.col("_at"), F.struct("_no", "_level"))).over(everything))
    return s.select("source", "source_size", "weight",
                    F.when(F.col("_no") < F.col("_water._no"), full)
                    .otherwise(F.least(F.coalesce(F.col("_water._level") * F.col("weight"), full), full)).alias("target"))


def _expected(grades: DataFrame, most: float) -> DataFrame:
    """``grades(source_no, favour, words, target)`` -> also ``expected`` copies of
    a document of that grade, and ``rest``, the source's words beyond whole copies."""
    by = Window.partitionBy("source_no")
    order = by.orderBy(F.desc("favour"))
    before = F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum(F.col("favour") * F.col("words")).over(order.rowsBetween(0, Window.unboundedFollowing))
    g = grades.withColumn("_c", (F.col("target") - F.lit(most) * before) / F.nullif(left, F.lit(0.0)))
    g = g.withColumn("_water", F.max(F.when(F.col("_c") * F.col("favour") <= most, F.struct("favour", "_c"))).over(by))
    e = F.when(F.col("favour") <= F.col("_water.favour"), F.col("_water._c") * F.col("favour")).otherwise(F.lit(most))
    g = g.withColumn("expected", F.greatest(e, F.lit(0.0))).withColumn("whole", F.floor(F.col("expected") + F.lit(_EXACT)))
    return g.withColumn("rest", F.col("target") - F.sum(F.col("whole") * F.col("words")).over(by)).drop("_c", "_water")


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on ``key`` and ``seed`` only."""
    text = F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit("")))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", size: Column | None = None,
        favour: Column | None = None, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST,
        seed: int = 11) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, expected
    (copies), whole (certain copies), extra (first words of one more copy, all of
    them but at the cut), taken (words). ``favour`` grades documents by how much
    more often they are wanted than others of their source."""
    grade = F.lit(1.0) if favour is None else favour.cast("double")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                       (n_words(F.col(text_col).cast("string")) if size is None else size).alias("size"), grade.alias("favour"))
    rows = cut(rows.withColumn("favour", F.when(F.col("favour") > 0, F.col("favour")).otherwise(F.lit(1.0)))
               .withColumn("row", F.monotonically_increasing_id()))
    words = cut(rows.groupBy("source", "favour").agg(F.sum("size").alias("words")))
    aims = targets(words.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    aims = cut(aims.withColumn("source_no", F.row_number().over(Window.orderBy(F.asc_nulls_last("source")))))
    same = F.col("source").eqNullSafe(F.col("_source"))
    grades = words.join(aims.withColumnRenamed("source", "_source"), same).select("_source", "favour", "words", "source_size", "target", "source_no")
    grades = _sent(_expected(grades, float(most)).withColumnRenamed("favour", "_favour"))

    r = rows.join(grades, same & (F.col("favour") == F.col("_favour"))) \
        .select("doc_id", "source", "size", "source_size", "target", "expected", "whole", "rest", "source_no", "row")
    p, u = F.col("expected") - F.col("whole"), uniform(F.col("doc_id"), seed)
    drawn = (p > _EXACT) & (F.col("size") > 0)
    r = r.withColumn("rank", F.when(drawn, u / (F.lit(1.0) - u) * ((F.lit(1.0) - p) / p)))
    order = ["source_no", "rank", "size", "row"]
    n = bucket_count(rows.count(), RANGE_ROWS)
    r = cut(r.repartitionByRange(n, *order).withColumn("range", F.spark_partition_id()))

    wanted = F.when(F.col("rank").isNotNull(), F.col("size")).otherwise(F.lit(0))
    before = _sent(running_offsets(r, ["source_no"], "range", wanted, "before"))
    within = Window.partitionBy("source_no", "range").orderBy("rank", "size", "row").rowsBetween(Window.unboundedPreceding, 0)
    r = r.join(before, ["source_no", "range"]).withColumn("upto", F.col("before") + F.sum(wanted).over(within))
    free = F.floor(F.col("rest") + F.lit(1e-6)) - F.col("upto") + F.col("size")     # words left for this document
    extra = F.when(F.col("rank").isNotNull(), F.greatest(F.lit(0), F.least(free, F.col("size")))).otherwise(F.lit(0)).cast("long")
    return r.select("doc_id", "source", "size", "source_size", "target", "expected", F.col("whole").cast("int").alias("whole"),
                    extra.alias("extra"), (F.col("whole") * F.col("size") + extra).cast("long").alias("taken"))


def digits(size: Column) -> Column:
    """The grade of the registered query: the number of decimal digits of the size,
    so a document of 1,000 words is wanted twice as often per word as one of 50."""
    return F.length(size.cast("string"))


def op11_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", n_words("text").alias("size"))
    mixed = mix(docs, size=F.col("size"), favour=digits(F.col("size")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")
