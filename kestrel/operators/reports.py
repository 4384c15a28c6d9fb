"""Report queries over matches and player_stats (C12-C15, C19 parts,
A9/A10/A12/A13, L1-L3, P3-P5, P9).

Point-lookup forms (one match, one pair of teams) are plain filters on a
literal; the set-wise forms compute the same report for every match / every
pair at once, which is what a batch job runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrel.functions.numeric import cents, half_up_ratio, ratio_round
from kestrel.operators.form import is_decided
from kestrel.operators.upsert import latest_snapshot

# Fixed values of the reports.
TOP_PLAYERS = 8
MIN_APPEARANCES = 2
RECENT_MATCHES = 10
TOP_RUN_TOTALS = 5
LATEST_ROWS = 3
H2H_DEFAULT_PCT = 50.0


def latest_lines(stats: DataFrame) -> DataFrame:
    """Q8: stat lines appended at every poll (they carry ``_batch``) count once,
    as of the latest poll; tables without polls are taken as they are."""
    if "_batch" not in stats.columns:
        return stats
    return latest_snapshot(stats, ["match_id", "player_name", "team", "role"], ["_batch"])


def batting_rows(stats: DataFrame, min_balls: int = 0) -> DataFrame:
    """Batting lines with balls_faced > min_balls."""
    return latest_lines(stats).filter((F.col("role") == "batting") & (F.col("balls_faced") > min_balls))


def bowling_rows(stats: DataFrame) -> DataFrame:
    """Bowling lines with overs_bowled > 0."""
    return latest_lines(stats).filter((F.col("role") == "bowling") & (F.col("overs_bowled") > 0))


def with_match(stats: DataFrame, matches: DataFrame) -> DataFrame:
    """J1 as an existence check: stat lines whose match is in ``matches``."""
    return stats.join(matches.select("match_id"), "match_id", "left_semi")


# ---- C12 match cards ------------------------------------------------------

BAT_CARD_COLS = ["player_name", "team", "runs", "balls_faced", "fours", "sixes", "strike_rate"]
BOWL_CARD_COLS = ["player_name", "team", "wickets", "overs_bowled", "economy"]


def _as_double(cols):
    return [F.col(c).cast("double").alias(c) if c in ("strike_rate", "overs_bowled", "economy") else F.col(c)
            for c in cols]


def batting_cards(stats: DataFrame) -> DataFrame:
    """C12/L2 for every match: card lines with ``card_order`` (runs desc)."""
    w = Window.partitionBy("match_id").orderBy(F.desc("runs"), "player_name", "team")
    return batting_rows(stats).select("match_id", *_as_double(BAT_CARD_COLS),
                                      F.row_number().over(w).cast("long").alias("card_order"))


def bowling_cards(stats: DataFrame) -> DataFrame:
    """C12/L2 for every match: wickets desc, economy asc."""
    w = Window.partitionBy("match_id").orderBy(F.desc("wickets"), F.asc("economy"), "player_name", "team")
    return bowling_rows(stats).select("match_id", *_as_double(BOWL_CARD_COLS),
                                      F.row_number().over(w).cast("long").alias("card_order"))


def match_batting_card(stats: DataFrame, match_id) -> DataFrame:
    """P9 point lookup (parameter bound as a literal, never spliced into SQL)."""
    return (batting_rows(stats).filter(F.col("match_id") == F.lit(match_id))
            .select(*BAT_CARD_COLS).orderBy(F.desc("runs"), "player_name", "team"))


def match_bowling_card(stats: DataFrame, match_id) -> DataFrame:
    return (bowling_rows(stats).filter(F.col("match_id") == F.lit(match_id))
            .select(*BOWL_CARD_COLS).orderBy(F.desc("wickets"), F.asc("economy"), "player_name", "team"))


def innings_cards(innings: DataFrame) -> DataFrame:
    """C12 for every match: its innings lines, in order of their name."""
    w = Window.partitionBy("match_id").orderBy("inning_name")
    return innings.select("match_id", "inning_name", "runs", "wickets", F.col("overs").cast("double").alias("overs"),
                          F.row_number().over(w).cast("long").alias("card_order"))


# ---- C13 / L1 recent matches ---------------------------------------------

RECENT_COLS = ["match_id", "name", "status", "team1", "team2", "winner", "venue", "match_date", "toss_winner"]


def recent_matches(matches: DataFrame, n: int = RECENT_MATCHES) -> DataFrame:
    """L1: latest ``n`` matches by date (match_id breaks ties); a top-k, so
    Spark plans TakeOrderedAndProject (per-partition top-k, then merge)."""
    return matches.select(*RECENT_COLS).orderBy(F.desc("match_date"), F.desc("match_id")).limit(n)


# ---- A9 / A10 player aggregates and C14 top-k per pair -----------------------

def batter_summary(stats: DataFrame, matches: DataFrame, min_balls: int = 3,
                   min_innings: int = MIN_APPEARANCES) -> DataFrame:
    """Per (player, team): avg_runs, avg_sr (1 dp, half away from zero),
    total fours/sixes, innings; HAVING innings >= min_innings. ``_key`` is
    the unrounded average used for ordering."""
    b = with_match(batting_rows(stats, min_balls), matches)
    g = b.groupBy("player_name", "team").agg(
        F.sum("runs").alias("_runs"), F.sum(cents("strike_rate")).alias("_sr_c"),
        F.sum("fours").cast("long").alias("total_fours"), F.sum("sixes").cast("long").alias("total_sixes"),
        F.count(F.lit(1)).alias("innings"))
    g = g.filter(F.col("innings") >= min_innings)
    return g.select("player_name", "team",
                    half_up_ratio("_runs", "innings", 1).alias("avg_runs"),
                    half_up_ratio("_sr_c", "innings * 100", 1).alias("avg_sr"),
                    "total_fours", "total_sixes", "innings",
                    (F.col("_runs") / F.col("innings")).alias("_key"))


def bowler_summary(stats: DataFrame, matches: DataFrame, min_matches: int = MIN_APPEARANCES) -> DataFrame:
    """A10: avg_wickets (1 dp), avg_economy (2 dp), total_wickets, matches."""
    b = with_match(bowling_rows(stats), matches)
    g = b.groupBy("player_name", "team").agg(
        F.sum("wickets").alias("_w"), F.sum(cents("economy")).alias("_eco_c"),
        F.count(F.lit(1)).alias("matches"))
    g = g.filter(F.col("matches") >= min_matches)
    return g.select("player_name", "team",
                    half_up_ratio("_w", "matches", 1).alias("avg_wickets"),
                    half_up_ratio("_eco_c", "matches * 100", 2).alias("avg_economy"),
                    F.col("_w").cast("long").alias("total_wickets"), "matches",
                    (F.col("_w") / F.col("matches")).alias("_key"),
                    (F.col("_eco_c") / F.col("matches")).alias("_key2"))


def top_per_pair(summary: DataFrame, pairs: DataFrame, order: list[Column],
                 k: int = TOP_PLAYERS) -> DataFrame:
    """C14 set-wise: the top ``k`` players of team1 or team2 for every pair.

    Exact two-step top-k: the top k of a pair lie within the top k of each of
    its two teams, so rank within team first (bounded by roster size), then
    within each pair over at most 2k candidates.
    """
    ordering = [*order, F.asc("player_name"), F.asc("team")]
    per_team = summary.withColumn("_r", F.row_number().over(Window.partitionBy("team").orderBy(*ordering)))
    cand = per_team.filter(F.col("_r") <= k).drop("_r")
    sides = pairs.select("team1", "team2", F.explode(F.array("team1", "team2")).alias("team")).distinct()
    j = sides.join(cand, "team", "inner")
    w = Window.partitionBy("team1", "team2").orderBy(*ordering)
    return (j.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)
             .drop("_key", "_key2"))


def team_pairs(matches: DataFrame) -> DataFrame:
    """Ordered (team1, team2) pairs that appear in the match table."""
    return matches.select("team1", "team2").distinct()


def top_batters_per_pair(stats, matches, min_balls: int = 3, k: int = TOP_PLAYERS) -> DataFrame:
    return top_per_pair(batter_summary(stats, matches, min_balls), team_pairs(matches),
                        [F.desc("_key")], k)


def top_bowlers_per_pair(stats, matches, k: int = TOP_PLAYERS) -> DataFrame:
    return top_per_pair(bowler_summary(stats, matches), team_pairs(matches),
                        [F.desc("_key"), F.asc("_key2")], k)


# ---- C15 head-to-head summary -------------------------------------------------

def pair_results(matches: DataFrame) -> DataFrame:
    """Decided matches per unordered pair (lo < hi): total, lo_wins, hi_wins."""
    d = matches.filter(is_decided(F.col("winner")))
    lo, hi = F.least("team1", "team2"), F.greatest("team1", "team2")
    return d.groupBy(lo.alias("lo"), hi.alias("hi")).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("winner") == lo).alias("lo_wins"),
        F.count_if(F.col("winner") == hi).alias("hi_wins"))


def h2h_summary(matches: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """C15/A8 for each ordered pair: total, wins of each side and win
    percentages (1 dp); 50.0 each when they never met with a result."""
    pairs = team_pairs(matches) if pairs is None else pairs
    pr = pair_results(matches)
    p = pairs.withColumn("lo", F.least("team1", "team2")).withColumn("hi", F.greatest("team1", "team2"))
    j = p.join(pr, ["lo", "hi"], "left")
    t1_is_lo = F.col("team1") == F.col("lo")
    total = F.coalesce(F.col("total"), F.lit(0))
    w1 = F.coalesce(F.when(t1_is_lo, F.col("lo_wins")).otherwise(F.col("hi_wins")), F.lit(0))
    w2 = F.coalesce(F.when(t1_is_lo, F.col("hi_wins")).otherwise(F.col("lo_wins")), F.lit(0))
    j = j.select("team1", "team2", total.alias("total"), w1.alias("team1_wins"), w2.alias("team2_wins"))
    pct = lambda w: F.when(F.col("total") > 0, ratio_round(F.col(w) * 100, F.col("total"), 1)) \
        .otherwise(F.lit(H2H_DEFAULT_PCT))
    return j.select("team1", "team2", "total", "team1_wins", "team2_wins",
                    pct("team1_wins").alias("team1_wr"), pct("team2_wins").alias("team2_wr"))


# ---- C19 warehouse report parts ------------------------------------------------

def top_run_totals(stats: DataFrame, k: int = TOP_RUN_TOTALS) -> DataFrame:
    """SUM(runs) of batting lines by (player, team), top k."""
    return (latest_lines(stats).filter(F.col("role") == "batting").groupBy("player_name", "team")
            .agg(F.sum("runs").cast("long").alias("total_runs"))
            .orderBy(F.desc("total_runs"), "player_name", "team").limit(k))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One (table_name, row_count) row per table, one job for all."""
    parts = [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
             for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def latest_rows(df: DataFrame, ts_col: str, cols: list[str], k: int = 3, tiebreak: list[str] | None = None):
    """L1 on a fetch/log timestamp (latest matches, recent errors)."""
    return df.select(*cols, ts_col).orderBy(F.desc(ts_col), *(tiebreak or [])).limit(k)


# ---- F22 inputs: top scorers, best bowler and the prediction of each match -------

def post_match_rows(scored: DataFrame, decided: DataFrame, stats: DataFrame,
                    win_margin: str = "N/A", score: Column | None = None) -> DataFrame:
    """One row per decided match with the post-match prompt fields: each
    side's top scorer (runs desc, name), the best bowler (wickets desc,
    economy asc, name, team) and the prediction from ``score`` (default the
    deterministic 0.5 + win_rate_diff / 2)."""
    from kestrel.ml.scoring import heuristic_score
    bat = batting_rows(stats)
    wb = Window.partitionBy("match_id", "team").orderBy(F.desc("runs"), "player_name")
    top = bat.withColumn("_r", F.row_number().over(wb)).filter(F.col("_r") == 1) \
             .select("match_id", "team", "player_name", "runs")
    bowl = bowling_rows(stats)
    ww = Window.partitionBy("match_id").orderBy(F.desc("wickets"), F.asc("economy"), "player_name", "team")
    best = bowl.withColumn("_r", F.row_number().over(ww)).filter(F.col("_r") == 1).select(
        "match_id", F.col("player_name").alias("best_bowler"), F.col("wickets").alias("best_bowler_wickets"),
        F.col("economy").cast("double").alias("best_bowler_economy"))
    p = heuristic_score() if score is None else score
    s = scored.select("match_id", "team1", "team2", p.alias("_p"))
    d = decided.select("match_id", "winner")
    out = s.join(d, "match_id", "inner")
    for n in ("1", "2"):
        t = top.select("match_id", F.col("team").alias(f"team{n}"),
                       F.col("player_name").alias(f"team{n}_top_scorer"),
                       F.col("runs").alias(f"team{n}_top_scorer_runs"))
        out = out.join(t, ["match_id", f"team{n}"], "left")
    out = out.join(best, "match_id", "left")
    return out.select(
        "*", F.lit(win_margin).alias("win_margin"),
        F.when(F.col("_p") >= 0.5, F.col("team1")).otherwise(F.col("team2")).alias("predicted_winner"),
        (F.greatest(F.col("_p"), F.lit(1.0) - F.col("_p")) * F.lit(100.0)).alias("predicted_prob"))


# ---- P10 display names, U3 entities, L5 head/tail, L6 latest innings ----------------

# The card column headers shown to users.
BAT_DISPLAY = {"player_name": "Player", "team": "Team", "runs": "R", "balls_faced": "B", "fours": "4s",
               "sixes": "6s", "strike_rate": "SR"}
BOWL_DISPLAY = {"player_name": "Player", "team": "Team", "wickets": "W", "overs_bowled": "Ov", "economy": "Eco"}


def display_card(card: DataFrame, role: str) -> DataFrame:
    """P10: the card's columns under their display names."""
    names = BAT_DISPLAY if role == "batting" else BOWL_DISPLAY
    keep = [c for c in card.columns if c not in names]
    return card.select(*keep, *[F.col(k).alias(v) for k, v in names.items()])


def distinct_teams(matches: DataFrame) -> DataFrame:
    """Entities appearing as team1 or team2 (one scan, explode, distinct)."""
    return matches.select(F.explode(F.array("team1", "team2")).alias("team")).filter(F.col("team").isNotNull()) \
                  .distinct()


def head_tail(table: DataFrame, value: str, k: int = 5) -> DataFrame:
    """The k largest and k smallest rows of a small model-summary table,
    tagged ``top`` / ``bottom``."""
    top = table.orderBy(F.desc(value), "feature").limit(k).withColumn("end", F.lit("top"))
    bottom = table.orderBy(F.asc(value), "feature").limit(k).withColumn("end", F.lit("bottom"))
    return top.unionByName(bottom)


def warehouse_report(tables: dict[str, DataFrame], k: int = TOP_RUN_TOTALS, latest: int = LATEST_ROWS) -> DataFrame:
    """C19 as one long frame of (section, item, value) rows: the table counts
    (A13), the latest matches (L1), the top run totals (A12) and the most recent
    errors, which go by source and reason where they were logged together."""
    none = F.lit(None).cast("bigint")
    counts = table_counts(tables).select(F.lit("row_count").alias("section"), F.col("table_name").alias("item"),
                                         F.col("row_count").alias("value"))
    recent = latest_rows(tables["matches"], "match_date", ["match_id", "name", "status"], latest, [F.desc("match_id")]) \
        .select(F.lit("latest_match").alias("section"),
                F.concat_ws(" | ", "name", "status", F.col("match_date").cast("string")).alias("item"), "match_id")
    top = top_run_totals(tables["player_stats"], k).select(
        F.lit("top_runs").alias("section"), F.concat("player_name", F.lit(" ("), "team", F.lit(")")).alias("item"), "total_runs")
    errors = latest_rows(tables["data_errors"], "logged_at", ["source", "error_message"], latest, ["source", "error_message"]) \
        .select(F.lit("recent_error").alias("section"), F.concat_ws(": ", "source", "error_message").alias("item"), none)
    out = counts
    for part in (recent, top, errors):
        out = out.union(part)
    return out
