"""Pair and context statistics: head-to-head (C6, C7/A7/J7), venue record
(C8/A3) and toss impact (C9/A4).

Pairs are keyed by a canonical (lo, hi) = (least, greatest) team name, so
an unordered pair is one equi-join key instead of an OR of two orders and no
all-pairs loop is needed (J10 becomes a group-by).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kestrel.functions.numeric import ratio_round, round_half_even
from kestrel.operators import sequence as seq
from kestrel.operators.form import completed, team_rows

# Defaults for a pair that never met, an unknown venue record
# and an unknown toss record.
H2H_DEFAULT_TOTAL = 0
H2H_DEFAULT_RATE = 0.5
VENUE_DEFAULT_RATE = 0.5
TOSS_DEFAULT_ADVANTAGE = 0.0


def _lo_hi(a: str = "team1", b: str = "team2"):
    return F.least(a, b), F.greatest(a, b)


def h2h_stats(matches: DataFrame) -> DataFrame:
    """Every pair that met with a result: total, wins of each side and
    win rates (3 dp). Orientation: team_a = lexically smaller name (Q13)."""
    lo, hi = _lo_hi()
    g = completed(matches).groupBy(lo.alias("team_a"), hi.alias("team_b")).agg(
        F.count(F.lit(1)).alias("total_matches"),
        F.count_if(F.col("winner") == lo).alias("team_a_wins"),
        F.count_if(F.col("winner") == hi).alias("team_b_wins"))
    return g.select("team_a", "team_b", "total_matches", "team_a_wins", "team_b_wins",
                    ratio_round("team_a_wins", "total_matches", 3).alias("team_a_win_rate"),
                    ratio_round("team_b_wins", "total_matches", 3).alias("team_b_win_rate"))


def pair_days(matches: DataFrame) -> DataFrame:
    """(lo, hi, match_date, n, lo_w, hi_w): each pair's results on each day they met."""
    lo, hi = _lo_hi()
    return completed(matches).groupBy(lo.alias("lo"), hi.alias("hi"), "match_date").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("winner") == lo).alias("lo_w"),
        F.count_if(F.col("winner") == hi).alias("hi_w"))


def pair_states(matches: DataFrame | None = None, days: DataFrame | None = None) -> DataFrame:
    """Cumulative results of each pair at the end of each day they met:
    (lo, hi, match_date, cum_total, cum_lo_wins, cum_hi_wins). Size: pairs x
    days, independent of the number of matches per day. From the matches, or from
    stored days."""
    daily = pair_days(matches) if days is None else days
    w = Window.partitionBy("lo", "hi").orderBy("match_date").rowsBetween(Window.unboundedPreceding, 0)
    return daily.select("lo", "hi", "match_date",
                        F.sum("n").over(w).alias("cum_total"),
                        F.sum("lo_w").over(w).alias("cum_lo_wins"),
                        F.sum("hi_w").over(w).alias("cum_hi_wins"))


def h2h_asof(matches: DataFrame, spine: DataFrame) -> DataFrame:
    """For each spine match (match_id, match_date, team1, team2) the
    pair's record from matches strictly before its date: h2h_total,
    team1_h2h_win_rate = round(a/total, 3), team2 = round(1 - a/total, 3);
    0 / 0.5 / 0.5 for a first meeting."""
    lo, hi = _lo_hi()
    sp = spine.select("match_id", "match_date", "team1", "team2", lo.alias("lo"), hi.alias("hi"))
    looked = seq.asof_before(pair_states(matches), ["lo", "hi"], "match_date", sp, "match_date",
                             ["cum_total", "cum_lo_wins", "cum_hi_wins"])
    j = sp.join(looked, ["lo", "hi", "match_date"], "left")
    total = F.coalesce(F.col("cum_total"), F.lit(0).cast("long"))
    a_w = F.when(F.col("team1") == F.col("lo"), F.col("cum_lo_wins")).otherwise(F.col("cum_hi_wins"))
    share = a_w / F.col("cum_total")
    return j.select(
        "match_id", "match_date", "team1", "team2", total.alias("h2h_total"),
        F.when(total > 0, round_half_even(share, 3)).otherwise(F.lit(H2H_DEFAULT_RATE)).alias("team1_h2h_win_rate"),
        F.when(total > 0, round_half_even(F.lit(1.0) - share, 3)).otherwise(F.lit(H2H_DEFAULT_RATE))
         .alias("team2_h2h_win_rate"))


def venue_days(matches: DataFrame) -> DataFrame:
    """(team, venue, match_date, n, w): results on each day."""
    r = team_rows(completed(matches)).filter(F.col("venue").isNotNull())
    return r.groupBy("team", "venue", "match_date").agg(F.count(F.lit(1)).alias("n"), F.sum("won").cast("long").alias("w"))


def venue_stats(matches: DataFrame | None = None, days: DataFrame | None = None) -> DataFrame:
    """Per (team, venue): matches_at_venue, wins_at_venue, win rate. From
    the matches, or from stored days."""
    if days is None:
        r = team_rows(completed(matches)).filter(F.col("venue").isNotNull())
        g = r.groupBy("team", "venue").agg(F.count(F.lit(1)).alias("matches_at_venue"),
                                           F.sum("won").cast("long").alias("wins_at_venue"))
    else:
        g = days.groupBy("team", "venue").agg(F.sum("n").alias("matches_at_venue"), F.sum("w").alias("wins_at_venue"))
    return g.withColumn("venue_win_rate", ratio_round("wins_at_venue", "matches_at_venue", 3))


def _toss_counts(matches: DataFrame, by: list[str]) -> DataFrame:
    known = completed(matches).filter(F.col("toss_winner").isNotNull() & (F.col("toss_winner") != ""))
    r = team_rows(known)
    return r.groupBy(*by).agg(
        F.count_if(F.col("won_toss") == 1).alias("_tw_n"),
        F.count_if((F.col("won_toss") == 1) & (F.col("won") == 1)).alias("_tw_w"),
        F.count_if(F.col("won_toss") == 0).alias("_tl_n"),
        F.count_if((F.col("won_toss") == 0) & (F.col("won") == 1)).alias("_tl_w"))


def toss_days(matches: DataFrame) -> DataFrame:
    """(team, match_date and the four counts of the toss record)."""
    return _toss_counts(matches, ["team", "match_date"])


def toss_impact(matches: DataFrame | None = None, days: DataFrame | None = None) -> DataFrame:
    """Per team, win rate when winning / losing the toss (3 dp, 0
    when the team has no such match) and the advantage (difference, 3 dp).
    One conditional aggregate instead of two groupings and an outer join. From the
    matches, or from stored days."""
    g = _toss_counts(matches, ["team"]) if days is None else \
        days.groupBy("team").agg(*[F.sum(c).alias(c) for c in ("_tw_n", "_tw_w", "_tl_n", "_tl_w")])
    rate = lambda w, n: F.when(F.col(n) > 0, ratio_round(w, n, 3)).otherwise(F.lit(0.0))
    g = g.select("team", rate("_tw_w", "_tw_n").alias("toss_win_rate"),
                 rate("_tl_w", "_tl_n").alias("toss_loss_rate"))
    return g.withColumn("toss_advantage", round_half_even(F.col("toss_win_rate") - F.col("toss_loss_rate"), 3))
