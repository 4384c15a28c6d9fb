"""Per-match stat lines from a ball log (A1 batting, A2 bowling) and the
``player_stats`` table built from them (U2 union of both roles).

The grouping keys are (match, player, batting side): the aggregate is
partial on the map side and the shuffle is spread over matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.functions.numeric import round_half_even

STAT_COLUMNS = ["match_id", "player_name", "team", "role", "runs", "balls_faced", "fours",
                "sixes", "strike_rate", "wickets", "overs_bowled", "economy"]


def _carried(deliveries: DataFrame) -> list:
    """Match-level columns carried through the card aggregates when the ball
    log already has them (``match_date``: functionally dependent on the
    match, so grouping by it changes nothing but saves a later join)."""
    return [F.col("match_date")] if "match_date" in deliveries.columns else []


def detect_batter_col(columns) -> str:
    """The ball log names the striker ``batter`` (newer) or ``batsman``."""
    for c in ("batter", "batsman"):
        if c in columns:
            return c
    raise KeyError("Cannot find batsman/batter column in deliveries")


def detect_dismissal_col(columns) -> str | None:
    """S3: first present of ``player_dismissed`` / ``dismissal_kind``."""
    for c in ("player_dismissed", "dismissal_kind"):
        if c in columns:
            return c
    return None


def batting_card(deliveries: DataFrame) -> DataFrame:
    """A1: (match, batter, batting side) -> runs, balls_faced, fours, sixes,
    strike_rate = round(runs / balls * 100, 2)."""
    bat = detect_batter_col(deliveries.columns)
    d = deliveries.filter(F.col("match_id").isNotNull() & F.col(bat).isNotNull()
                          & F.col("batting_team").isNotNull())
    g = d.groupBy("match_id", F.col(bat).alias("player_name"), F.col("batting_team").alias("team"),
                  *_carried(deliveries)).agg(
        F.coalesce(F.sum("batsman_runs"), F.lit(0)).cast("int").alias("runs"),
        F.count("ball").cast("int").alias("balls_faced"),
        F.count_if(F.col("batsman_runs") == 4).cast("int").alias("fours"),
        F.count_if(F.col("batsman_runs") == 6).cast("int").alias("sixes"))
    sr = round_half_even(F.try_divide(F.col("runs"), F.col("balls_faced")) * F.lit(100.0), 2)
    return g.withColumn("strike_rate", sr)


def bowling_card(deliveries: DataFrame, bowling_team: str = "batting",
                 matches: DataFrame | None = None) -> DataFrame:
    """A2: (match, bowler, batting side) -> balls, runs_given, wickets,
    overs = round(balls / 6, 1), economy = round(runs / (overs or 1), 2).

    ``bowling_team="batting"`` keeps the reference's labelling of a bowler with
    the side that batted (Q6); ``"fielding"`` labels the bowler's own side and
    needs ``matches`` for the opponent lookup.
    """
    dis = detect_dismissal_col(deliveries.columns)
    d = deliveries.filter(F.col("match_id").isNotNull() & F.col("bowler").isNotNull()
                          & F.col("batting_team").isNotNull())
    wickets = F.count(dis) if dis else F.lit(0)
    g = d.groupBy("match_id", F.col("bowler").alias("player_name"), F.col("batting_team").alias("team"),
                  *_carried(deliveries)).agg(
        F.count("ball").cast("int").alias("balls_bowled"),
        F.coalesce(F.sum("total_runs"), F.lit(0)).cast("int").alias("runs_given"),
        wickets.cast("int").alias("wickets"))
    overs = round_half_even(F.col("balls_bowled") / F.lit(6.0), 1)
    g = g.withColumn("overs_bowled", overs)
    div = F.when(F.col("overs_bowled") == 0, F.lit(1.0)).otherwise(F.col("overs_bowled"))
    g = g.withColumn("economy", round_half_even(F.col("runs_given") / div, 2))
    if bowling_team == "fielding":
        if matches is None:
            raise ValueError("bowling_team='fielding' needs matches")
        m = matches.select("match_id", "team1", "team2")
        g = (g.join(m, "match_id", "inner")
              .withColumn("team", F.when(F.col("team") == F.col("team1"), F.col("team2")).otherwise(F.col("team1")))
              .drop("team1", "team2"))
    return g


def player_stats(deliveries: DataFrame, bowling_team: str = "batting",
                 matches: DataFrame | None = None) -> DataFrame:
    """Batting lines then bowling lines in the ``player_stats`` layout
    (the other role's numbers are zero), typed as the stat table."""
    extra = ["match_date"] if "match_date" in deliveries.columns else []
    bat = batting_card(deliveries).select(
        "match_id", *extra, "player_name", "team", F.lit("batting").alias("role"),
        "runs", "balls_faced", "fours", "sixes", "strike_rate",
        F.lit(0).alias("wickets"), F.lit(0.0).alias("overs_bowled"), F.lit(0.0).alias("economy"))
    bowl = bowling_card(deliveries, bowling_team, matches).select(
        "match_id", *extra, "player_name", "team", F.lit("bowling").alias("role"),
        F.lit(0).alias("runs"), F.lit(0).alias("balls_faced"), F.lit(0).alias("fours"),
        F.lit(0).alias("sixes"), F.lit(0.0).alias("strike_rate"),
        "wickets", "overs_bowled", "economy")
    return bat.unionByName(bowl)


TABLE_TYPES = {"runs": "int", "balls_faced": "int", "fours": "int", "sixes": "int", "strike_rate": "decimal(6,2)",
               "wickets": "int", "overs_bowled": "decimal(5,1)", "economy": "decimal(5,2)"}
# From these sizes on, a number rounds to more digits than its column has.
DECIMAL_LIMITS = {"strike_rate": 9999.995, "overs_bowled": 9999.95, "economy": 999.995}


def _too_large(c: str) -> Column:
    x = F.col(c).cast("double")
    return F.coalesce(~F.isnan(x) & (F.abs(x) >= F.lit(DECIMAL_LIMITS[c])), F.lit(False))


def overflow_reason() -> Column:
    """K4 after V2: which accepted numbers the table's types cannot hold (NULL if
    they hold all). NaN, which the validator accepts (Q26), is stored as NULL."""
    return F.nullif(F.concat_ws("; ", *[
        F.when(_too_large(c), F.concat(F.lit(f"Out of range for the table: {c} "), F.col(c).cast("string")))
        for c in DECIMAL_LIMITS]), F.lit(""))


def typed_stats(stats: DataFrame) -> DataFrame:
    """Cast a stat frame to the table types (decimal(6,2)/(5,1)/(5,2)). Rows that
    do not fit are left out here; :func:`overflow_reason` names them for the rejects."""
    for c in DECIMAL_LIMITS:
        stats = stats.where(~_too_large(c))
    kinds = dict(stats.dtypes)
    return stats.select(
        "match_id", *(["match_date"] if "match_date" in stats.columns else []), "player_name", "team", "role",
        *[F.col(c) if kinds[c] == kind else F.col(c).try_cast(kind).alias(c) for c, kind in TABLE_TYPES.items()])


def innings_lines(deliveries: DataFrame) -> DataFrame:
    """Innings table of the ball log: runs, wickets and overs (6 balls) per match and side."""
    n = F.count(F.lit(1))
    return deliveries.groupBy("match_id", F.concat("batting_team", F.lit(" innings")).alias("inning_name")).agg(
        F.sum("total_runs").cast("int").alias("runs"), F.count("player_dismissed").cast("int").alias("wickets"),
        (F.floor(n / 6) + (n % 6) / 10).cast("decimal(5,1)").alias("overs"))
