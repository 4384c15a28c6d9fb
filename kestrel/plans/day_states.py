"""Stored day states: what live features need of the past, kept up day by day.

Form, strength and the records of pairs, venues and tosses are functions of per-day
summaries (the chunk tables of :mod:`kestrel.operators.sequence` and daily counts). A
day's summary depends on that day's matches and lines only, so a store takes in the
days of a load as one batch and is never recomputed from the match and ball logs:

    append(store, matches, stats)   the whole days of a load -> one folder per table
    states(store)                   the lookups of :func:`kestrel.plans.features.build_features`

Scoring then reads the summaries (entities x active days), whatever the size of the
logs. A day that is loaded again (late results) replaces its summaries: of each day
the rows of its latest batch count. A batch is written under its number with
overwrite and counts once its list of days, written last, is complete; a repeated
append with the same number gives the same store.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.operators import form as fm
from kestrel.operators import matchups as mu
from kestrel.operators import players as pl
from kestrel.operators import strength as stg
from kestrel.operators import upsert as up
from kestrel.plans.features import States

_TABLES = ("form", "roles", "pairs", "venues", "tosses")


def _path(store: str, table: str) -> str:
    return f"{store.rstrip('/')}/{table}"


def append(store: str, matches: DataFrame, stats: DataFrame, batch: int | None = None) -> int:
    """Take in all days that ``matches`` has; both frames must hold these days whole.
    Returns the number of the batch."""
    spark = matches.sparkSession
    done = up.versions(spark, _path(store, "days"))
    batch = (done[-1] + 1 if done else 0) if batch is None else batch
    made = {"form": fm.form_chunks(matches), "roles": pl.role_chunks(stats, matches), "pairs": mu.pair_days(matches),
            "venues": mu.venue_days(matches), "tosses": mu.toss_days(matches)}
    for table in _TABLES:
        up.write_version(made[table].withColumn("_batch", F.lit(batch)), _path(store, table), batch)
    days = matches.select("match_date").distinct().withColumn("_batch", F.lit(batch))
    up.write_version(days, _path(store, "days"), batch)
    return batch


def _read(spark: SparkSession, store: str, table: str, batches: list[int]) -> DataFrame:
    return spark.read.parquet(*[up.version_path(_path(store, table), b) for b in batches])


def summaries(spark: SparkSession, store: str) -> dict[str, DataFrame]:
    """The stored tables, each day from its latest batch."""
    batches = up.versions(spark, _path(store, "days"))
    if not batches:
        raise ValueError(f"{store}: no days stored")
    days = _read(spark, store, "days", batches).groupBy("match_date").agg(F.max("_batch").alias("_batch"))   # a calendar
    found = {}
    for table in _TABLES:
        rows = _read(spark, store, table, batches)
        same = [F.col("match_date").eqNullSafe(F.col("_day")), F.col("_batch") == F.col("_latest")]
        latest = days.select(F.col("match_date").alias("_day"), F.col("_batch").alias("_latest"))
        found[table] = rows.join(latest, same[0] & same[1], "left_semi").drop("_batch")
    return found


def states(spark: SparkSession, store: str) -> States:
    s = summaries(spark, store)
    return States(fm.form_states(chunks=s["form"]), stg.strength_states(chunks=s["roles"]), mu.pair_states(days=s["pairs"]),
                  mu.venue_stats(days=s["venues"]), mu.toss_impact(days=s["tosses"]))
