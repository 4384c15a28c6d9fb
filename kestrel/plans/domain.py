"""Domain tables derived from the test tables, as lazy DataFrames.

matches      <- orders (projection)
deliveries   <- lineitem join matches
player_stats <- A1 + A2 scorecards of deliveries, validated (V2), typed
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kestrel.operators import quality, scorecards
from kestrel.sources import fixtures as fx


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.matches(spark, sf_dir)


def deliveries(spark: SparkSession, sf_dir: str, m: DataFrame | None = None) -> DataFrame:
    return fx.deliveries(spark, sf_dir, m)


def player_stats(spark: SparkSession, sf_dir: str, m: DataFrame | None = None,
                 bowling_team: str = "batting") -> DataFrame:
    """Valid stat lines in table types (rejected lines go to :func:`stat_rejects`)."""
    m = matches(spark, sf_dir) if m is None else m
    raw = scorecards.player_stats(deliveries(spark, sf_dir, m), bowling_team, m)
    valid, _ = quality.split_valid(quality.validate_player_stats(raw), "scorecard",
                                   [*scorecards.STAT_COLUMNS, "match_date"])
    return scorecards.typed_stats(valid)


def stat_checks(spark: SparkSession, sf_dir: str, m: DataFrame | None = None) -> DataFrame:
    m = matches(spark, sf_dir) if m is None else m
    raw = scorecards.player_stats(deliveries(spark, sf_dir, m), "batting", m)
    return quality.validate_player_stats(raw)
