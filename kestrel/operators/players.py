"""Player form: rolling batting / bowling features (C3, C4, W4-W6, W8),
features as of a date (C5) and the spotlight aggregates (A11, W7, C16).

Sequence work per player uses the chunked scan of
:mod:`kestrel.operators.sequence` (a player can hold a large share of all
stat lines). Decimal inputs are summed as exact hundredths; each output is
one division and one rounding.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrel.functions.numeric import cents, cents_ratio_round, ratio_round, round_half_even
from kestrel.operators import sequence as seq
from kestrel.session import cut_lineage

# Rolling window, trend look-back (3 recent vs 3 older rows)
# and the spotlight defaults.
ROLL = 5
TREND_SPAN = 3
HIST = 2 * TREND_SPAN
SPOTLIGHT_TOP = 3
SPOTLIGHT_MIN_APPEARANCES = 3
SPOTLIGHT_MIN_BALLS = 3
SPOTLIGHT_RECENT = 6

ORDER = ["match_id", "team"]          # tiebreak after match_date inside a player


def dated(stats: DataFrame, matches: DataFrame) -> DataFrame:
    """Stat lines with their match date (inner join on match_id). Stat
    lines derived from the ball log already carry the date (they passed
    through the same join), and then no second join is needed."""
    if "match_date" in stats.columns:
        return stats
    return stats.join(matches.select("match_id", "match_date"), "match_id", "inner")


def batting_lines(stats: DataFrame, matches: DataFrame, min_balls: int = 0) -> DataFrame:
    b = stats.filter((F.col("role") == "batting") & (F.col("balls_faced") > min_balls))
    return dated(b, matches).select("player_name", "team", "match_id", "match_date", "runs", "balls_faced",
                                    "fours", "sixes", cents("strike_rate").alias("sr_c"))


def bowling_lines(stats: DataFrame, matches: DataFrame) -> DataFrame:
    b = stats.filter((F.col("role") == "bowling") & (F.col("overs_bowled") > 0))
    return dated(b, matches).select("player_name", "team", "match_id", "match_date", "wickets",
                                    cents("economy").alias("eco_c"))


def _rolling(field: str, cur: Column, cents_in: bool, hist: Column | None = None) -> Column:
    h = F.col("_hist") if hist is None else hist
    total = seq.tail_sum(h, field, ROLL - 1) + cur.cast("long")
    n = F.least(F.size(h), F.lit(ROLL - 1)) + 1
    return cents_ratio_round(total, n, 2) if cents_in else ratio_round(total, n, 2)


def trend(field: str, hist: Column | None = None, position: Column | None = None) -> Column:
    """Mean of the 3 rows before the current one minus the mean of the up
    to 3 rows before those, divisor max(1, min(3, i-3)); 0.0 for i < 3
    (i = 0-based position). Input in hundredths; exact numerator."""
    i = (F.col("_seq") if position is None else position) - 1
    hist = F.col("_hist") if hist is None else hist
    recent = seq.tail_sum(hist, field, TREND_SPAN)
    older = seq.tail_sum(hist, field, HIST) - recent          # hist holds at most 6 rows
    d = F.greatest(F.lit(1), F.least(F.lit(TREND_SPAN), i - TREND_SPAN)).cast("long")
    num = recent * d - F.lit(TREND_SPAN) * older
    return F.when(i < TREND_SPAN, F.lit(0.0)).otherwise(cents_ratio_round(num, F.lit(TREND_SPAN) * d, 2))


def _day_end(lines: DataFrame, fields: list[str], last_cols: list[str]) -> DataFrame:
    """Per (player, day): state after the day's last line. ``_end_hist``
    holds that line and the 6 before it."""
    st = seq.end_states(lines, ["player_name"], "match_date", ORDER, fields, HIST + 1, last_cols)
    end = F.col("_end_hist")
    return st.withColumn("_cur", F.element_at(end, -1)) \
             .withColumn("_prev", F.slice(end, 1, F.size(end) - 1))


def batting_day_states(stats: DataFrame, matches: DataFrame) -> DataFrame:
    """Batting form at the end of each (player, day) with batting lines."""
    st = _day_end(batting_lines(stats, matches), ["runs", "sr_c"], ["team", "fours", "sixes", "balls_faced"])
    prev = F.col("_prev")
    return st.select(
        "player_name", "match_date", "team",
        _rolling("runs", F.col("_cur.runs"), False, prev).alias("rolling_avg_runs"),
        _rolling("sr_c", F.col("_cur.sr_c"), True, prev).alias("rolling_avg_sr"),
        trend("sr_c", prev, F.col("_cum")).alias("sr_trend"),
        round_half_even((F.col("fours") + F.col("sixes")) / F.col("balls_faced"), 3).alias("boundary_rate"),
        F.col("_cum").cast("long").alias("innings_played"))


def bowling_day_states(stats: DataFrame, matches: DataFrame) -> DataFrame:
    """Bowling form at the end of each (player, day) with bowling lines."""
    st = _day_end(bowling_lines(stats, matches), ["wickets", "eco_c"], ["team"])
    prev = F.col("_prev")
    return st.select(
        "player_name", "match_date", "team",
        _rolling("wickets", F.col("_cur.wickets"), False, prev).alias("rolling_avg_wickets"),
        _rolling("eco_c", F.col("_cur.eco_c"), True, prev).alias("rolling_avg_economy"),
        trend("eco_c", prev, F.col("_cum")).alias("economy_trend"),
        F.col("_cum").cast("long").alias("matches_bowled"))


_ROLE_KEYS = ["player_name", "role"]


def role_chunks(stats: DataFrame, matches: DataFrame) -> DataFrame:
    """One row per (player, role, day, range of ids) with what :func:`role_day_states`
    needs of it. A day's rows depend on that day's lines only."""
    batting = F.col("role") == "batting"
    lines = stats.filter((batting & (F.col("balls_faced") > 0)) | ((F.col("role") == "bowling") & (F.col("overs_bowled") > 0)))
    value = F.when(batting, F.col("runs").cast("long") * 100).otherwise(cents("economy"))
    lines = dated(lines, matches).select("player_name", "role", "team", "match_id", "match_date", value.alias("v"))
    rows1 = seq.within_chunk(lines, _ROLE_KEYS, "match_date", ORDER, ["v"], ROLL, with_prev=False)
    return seq.chunk_table(rows1, _ROLE_KEYS, "match_date", ORDER, ["v"], ROLL, ["team"])


def role_day_states(chunks: DataFrame) -> DataFrame:
    """What team strength needs of both roles, in one pass: per (player, role,
    day) the team of the day's last line and the rolling mean after it (batting:
    runs; bowling: economy), in hundredths."""
    st = seq.chunk_carry(chunks, _ROLE_KEYS, "match_date", ROLL).where("_day_end")
    end = F.col("_end_hist")
    mean = cents_ratio_round(seq.tail_sum(end, "v", ROLL), F.size(end), 2)
    return st.select("player_name", "role", "match_date", "team", F.rint(mean * 100).cast("long").alias("v"))


def batting_feature_rows(stats: DataFrame, matches: DataFrame) -> DataFrame:
    """W4/W6/W8/W3 per batting line: rolling_avg_runs, rolling_avg_sr (5
    innings, 2 dp), sr_trend, boundary_rate (3 dp), innings_played."""
    h = seq.with_history(batting_lines(stats, matches), ["player_name"], "match_date", ORDER,
                         ["runs", "sr_c"], HIST)
    return h.select(
        "player_name", "team", "match_id", "match_date",
        _rolling("runs", F.col("runs"), False).alias("rolling_avg_runs"),
        _rolling("sr_c", F.col("sr_c"), True).alias("rolling_avg_sr"),
        trend("sr_c").alias("sr_trend"),
        round_half_even((F.col("fours") + F.col("sixes")) / F.col("balls_faced"), 3).alias("boundary_rate"),
        F.col("_seq").cast("long").alias("innings_played"))


def bowling_feature_rows(stats: DataFrame, matches: DataFrame) -> DataFrame:
    """W5/W6/W3 per bowling line: rolling_avg_wickets, rolling_avg_economy,
    economy_trend, matches_bowled."""
    h = seq.with_history(bowling_lines(stats, matches), ["player_name"], "match_date", ORDER,
                         ["wickets", "eco_c"], HIST)
    return h.select(
        "player_name", "team", "match_id", "match_date",
        _rolling("wickets", F.col("wickets"), False).alias("rolling_avg_wickets"),
        _rolling("eco_c", F.col("eco_c"), True).alias("rolling_avg_economy"),
        trend("eco_c").alias("economy_trend"),
        F.col("_seq").cast("long").alias("matches_bowled"))


BAT_FEATURES = ["team", "rolling_avg_runs", "rolling_avg_sr", "sr_trend", "boundary_rate", "innings_played"]
BOWL_FEATURES = ["team", "rolling_avg_wickets", "rolling_avg_economy", "economy_trend", "matches_bowled"]


def latest_per_player(day_states: DataFrame, cols: list[str]) -> DataFrame:
    """The state after the player's last day (one row per player
    and day in, one row per player out; partial aggregate)."""
    last = F.max_by(F.struct(*cols), F.col("match_date"))
    return day_states.groupBy("player_name").agg(last.alias("_l")).select("player_name", "_l.*")


def batting_features(stats: DataFrame, matches: DataFrame) -> DataFrame:
    """Latest batting form per player."""
    return latest_per_player(batting_day_states(stats, matches), BAT_FEATURES)


def bowling_features(stats: DataFrame, matches: DataFrame) -> DataFrame:
    """C4: latest bowling form per player."""
    return latest_per_player(bowling_day_states(stats, matches), BOWL_FEATURES)


def player_features_asof(stats: DataFrame, matches: DataFrame, as_of) -> DataFrame:
    """Combined form from lines dated strictly before ``as_of`` (a
    date literal or a scalar Column): batting and bowling snapshots full-outer
    joined on (player, team), missing numbers 0. States are causal, so the
    last day state before the date is the as-of state."""
    cut = F.col("match_date") < (as_of if isinstance(as_of, Column) else F.lit(as_of).cast("date"))
    bat = latest_per_player(batting_day_states(stats, matches).filter(cut),
                            ["team", "rolling_avg_runs", "rolling_avg_sr", "sr_trend"])
    bowl = latest_per_player(bowling_day_states(stats, matches).filter(cut),
                             ["team", "rolling_avg_wickets", "rolling_avg_economy", "economy_trend"])
    j = bat.join(bowl, ["player_name", "team"], "full")
    nums = ["rolling_avg_runs", "rolling_avg_sr", "sr_trend",
            "rolling_avg_wickets", "rolling_avg_economy", "economy_trend"]
    return j.fillna(0.0, subset=nums).select("player_name", "team", *nums)


# ---- spotlight (A11, W7, C16) ---------------------------------------------------

def _lit_or_col(v, typ: str | None = None) -> Column:
    c = v if isinstance(v, Column) else F.lit(v)
    return c.cast(typ) if typ else c


def _recent_lines(lines: DataFrame, players: DataFrame, field: str, k: int = SPOTLIGHT_RECENT) -> DataFrame:
    """W7 input: the latest ``k`` lines (any team) of each selected player as
    an array oldest-first, via per-day tails so a player with a long history
    is never sorted in one task."""
    sel = lines.join(players.select("player_name").distinct(), "player_name", "left_semi")
    rows1 = seq.within_chunk(sel, ["player_name"], "match_date", ORDER, [field], k)
    chunks = seq.chunk_table(rows1, ["player_name"], "match_date", ORDER, [field], k)
    w = Window.partitionBy("player_name").orderBy(F.desc("match_date"), F.desc(seq.PART))
    last_days = chunks.withColumn("_dr", F.row_number().over(w)).filter(F.col("_dr") <= k)
    return last_days.groupBy("player_name").agg(
        seq.last_k(F.sort_array(F.flatten(F.collect_list("_tail"))), k).alias("recent"))


def _trend_from_recent(field: str, digits: int = 1) -> Column:
    """Latest-first values v; < 4 values -> 0; mean(v[:3]) - mean(v[3:])."""
    rec = F.col("recent")                      # oldest first, at most 6
    n = F.size(rec)
    first3 = seq.tail_sum(rec, field, 3)       # the latest three
    rest = seq.tail_sum(rec, field, SPOTLIGHT_RECENT) - first3
    rest_n = F.greatest(n - 3, F.lit(1)).cast("long")
    num = first3 * rest_n - F.lit(3) * rest
    return F.when(n < 4, F.lit(0.0)).otherwise(cents_ratio_round(num, F.lit(3) * rest_n, digits))


def spotlight(stats: DataFrame, matches: DataFrame, team1, team2, as_of,
              top_n: int = SPOTLIGHT_TOP, min_balls: int = SPOTLIGHT_MIN_BALLS,
              min_apps: int = SPOTLIGHT_MIN_APPEARANCES) -> DataFrame:
    """C16 (A11 + W7 + L3 + U2): top ``top_n`` batters of either team by
    average runs, then top bowlers by average wickets (economy ascending),
    from lines strictly before ``as_of``; (player, team) needs ``min_apps``
    lines. Fixed 8-field record, other role's fields 0, ``ord`` = listing
    order. ``team1``/``team2``/``as_of`` are literals or scalar Columns."""
    t1, t2 = _lit_or_col(team1, "string"), _lit_or_col(team2, "string")
    d = _lit_or_col(as_of, "date")
    keep = F.col("team").isin(t1, t2) & (F.col("match_date") < d)
    bat_all = batting_lines(stats, matches, min_balls).filter(F.col("match_date") < d)
    bowl_all = bowling_lines(stats, matches).filter(F.col("match_date") < d)

    def top(lines: DataFrame, f1: str, f2: str, second: bool) -> DataFrame:
        g = lines.filter(keep).groupBy("player_name", "team").agg(
            F.count(F.lit(1)).alias("_n"), F.sum(f1).cast("long").alias("_s1"),
            F.sum(f2).cast("long").alias("_s2"))
        g = g.filter(F.col("_n") >= min_apps)
        order = [F.desc(F.col("_s1") / F.col("_n"))]
        if second:
            order.append(F.asc(F.col("_s2") / F.col("_n")))
        w = Window.orderBy(*order, "player_name", "team")
        # small: only the two teams' qualifying players reach this top-k
        return g.withColumn("rk", F.row_number().over(w).cast("long")).filter(F.col("rk") <= top_n)

    tb = top(bat_all, "runs", "sr_c", False)
    tb = tb.join(_recent_lines(bat_all, tb, "sr_c"), "player_name", "left")
    tw = top(bowl_all, "wickets", "eco_c", True)
    tw = tw.join(_recent_lines(bowl_all, tw, "eco_c"), "player_name", "left")
    b = tb.select(F.col("player_name").alias("name"), "team",
                  ratio_round("_s1", "_n", 1).alias("rolling_avg_runs"),
                  cents_ratio_round("_s2", "_n", 1).alias("rolling_avg_sr"),
                  _trend_from_recent("sr_c").alias("sr_trend"),
                  F.lit(0.0).alias("rolling_avg_wickets"), F.lit(0.0).alias("rolling_avg_economy"),
                  F.lit(0.0).alias("economy_trend"), F.col("rk").alias("ord"), F.lit("batting").alias("role"))
    w = tw.select(F.col("player_name").alias("name"), "team",
                  F.lit(0.0).alias("rolling_avg_runs"), F.lit(0.0).alias("rolling_avg_sr"),
                  F.lit(0.0).alias("sr_trend"),
                  ratio_round("_s1", "_n", 1).alias("rolling_avg_wickets"),
                  cents_ratio_round("_s2", "_n", 1).alias("rolling_avg_economy"),
                  _trend_from_recent("eco_c").alias("economy_trend"),
                  (F.col("rk") + F.lit(top_n)).alias("ord"), F.lit("bowling").alias("role"))
    return b.unionByName(w)


# ---- spotlight of every fixture (C16 set-wise) -------------------------------------

LEVELS = 17             # dyadic ranges of up to 2^16 days
_ALWAYS = (1 << (LEVELS - 1)) - 1


def _levels(begin: Column, end: Column) -> Column:
    """The levels whose ranges are no longer than the span [begin, end)."""
    return F.sequence(F.lit(0), F.least(F.length(F.bin(end - begin)) - 1, F.lit(LEVELS - 1)))


def _ranges_of(begin: Column, end: Column) -> Column:
    """[begin, end) of days as at most two dyadic ranges (level, number) per level."""
    def at(level: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1), level)
        a, b = F.call_function("shiftright", begin + size - 1, level), F.call_function("shiftright", end, level)
        return F.array(*[F.when((a < b) & (odd % 2 != 0), F.struct(level.alias("level"), node.alias("node"))) for odd, node in ((a, a), (b, b - 1))])
    return F.array_compact(F.flatten(F.transform(_levels(begin, end), at)))


def _top_asof(lines: DataFrame, sides: DataFrame, f1: str, f2: str, second: bool, top_n: int, min_apps: int) -> DataFrame:
    """For each (team, match_date) of ``sides`` its ``top_n`` players by totals of
    the lines dated before: (team, match_date, player_name, _n, _s1, _s2).

    A player's totals for a team hold from the day after a line until the next
    one. That span is cut into dyadic ranges of days, the best players of each
    (team, range) are kept, and a day looks up the ranges that contain it: one per
    level. So neither a players x dates grid nor a range join is needed."""
    daily = lines.groupBy("team", "player_name", "match_date").agg(
        F.count(F.lit(1)).alias("n"), F.sum(f1).cast("long").alias("s1"), F.sum(f2).cast("long").alias("s2"))
    own = Window.partitionBy("team", "player_name").orderBy("match_date")
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    st = daily.select("team", "player_name", *[F.sum(c).over(upto).alias(f"_{c}") for c in ("n", "s1", "s2")],
                      (F.unix_date("match_date") + 1).alias("_from"),
                      F.coalesce(F.unix_date(F.lead("match_date").over(own)) + 1, F.lit(_ALWAYS)).alias("_to"))
    st = st.where(F.col("_n") >= min_apps).withColumn("_r", F.explode(_ranges_of(F.col("_from"), F.col("_to"))))
    order = [F.desc(F.col("_s1") / F.col("_n")), *([F.asc(F.col("_s2") / F.col("_n"))] if second else []), F.asc("player_name")]
    best = Window.partitionBy("team", "level", "node").orderBy(*order)
    kept = st.select("team", "_r.level", "_r.node", "player_name", "_n", "_s1", "_s2") \
        .withColumn("_k", F.row_number().over(best)).where(F.col("_k") <= top_n).drop("_k")
    days = sides.select("team", "match_date").distinct().withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))))
    days = days.withColumn("node", F.floor(F.unix_date("match_date") / F.pow(F.lit(2), F.col("level"))).cast("int"))
    found = days.join(kept, ["team", "level", "node"])
    per_day = Window.partitionBy("team", "match_date").orderBy(*order)
    return found.withColumn("_k", F.row_number().over(per_day)).where(F.col("_k") <= top_n).drop("_k", "level", "node")


def spotlight_of_fixtures(stats: DataFrame, matches: DataFrame, fixtures: DataFrame, top_n: int = SPOTLIGHT_TOP,
                          min_balls: int = SPOTLIGHT_MIN_BALLS, min_apps: int = SPOTLIGHT_MIN_APPEARANCES) -> DataFrame:
    """C16 (as :func:`spotlight`) for every fixture (match_id, match_date, team1,
    team2): its records, with ``match_id``. The best of a fixture are among the best
    of its two teams; the trend reads the player's last lines before the day."""
    sides = fixtures.select("match_id", "match_date", F.explode(F.array_distinct(F.array("team1", "team2"))).alias("team"))

    def role(lines: DataFrame, f1: str, f2: str, second: bool) -> DataFrame:
        # read for the totals and for the last lines
        lines = cut_lineage(lines.select("player_name", "team", "match_id", "match_date", f1, f2))
        top = _top_asof(lines, sides, f1, f2, second, top_n, min_apps)
        order = [F.desc(F.col("_s1") / F.col("_n")), *([F.asc(F.col("_s2") / F.col("_n"))] if second else [])]
        w = Window.partitionBy("match_id").orderBy(*order, "player_name", "team")
        picked = cut_lineage(sides.join(top, ["team", "match_date"]).withColumn("rk", F.row_number().over(w).cast("long"))
                             .where(F.col("rk") <= top_n))
        tails = seq.end_states(lines, ["player_name"], "match_date", ORDER, [f2], SPOTLIGHT_RECENT) \
            .withColumnRenamed("_end_hist", "recent")
        recent = seq.asof_before(tails, ["player_name"], "match_date", picked, "match_date", ["recent"])
        return picked.join(recent, ["player_name", "match_date"], "left")

    zero, c = F.lit(0.0), F.col
    b = role(batting_lines(stats, matches, min_balls), "runs", "sr_c", False).select(
        "match_id", c("player_name").alias("name"), "team", ratio_round("_s1", "_n", 1).alias("rolling_avg_runs"),
        cents_ratio_round("_s2", "_n", 1).alias("rolling_avg_sr"), _trend_from_recent("sr_c").alias("sr_trend"),
        zero.alias("rolling_avg_wickets"), zero.alias("rolling_avg_economy"), zero.alias("economy_trend"),
        c("rk").alias("ord"), F.lit("batting").alias("role"))
    w = role(bowling_lines(stats, matches), "wickets", "eco_c", True).select(
        "match_id", c("player_name").alias("name"), "team", zero.alias("rolling_avg_runs"), zero.alias("rolling_avg_sr"),
        zero.alias("sr_trend"), ratio_round("_s1", "_n", 1).alias("rolling_avg_wickets"),
        cents_ratio_round("_s2", "_n", 1).alias("rolling_avg_economy"), _trend_from_recent("eco_c").alias("economy_trend"),
        (c("rk") + F.lit(top_n)).alias("ord"), F.lit("bowling").alias("role"))
    return b.unionByName(w)
