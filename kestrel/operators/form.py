"""Team form: rolling win rate, signed streak and matches played.

U1 team_rows, W1/W2/W3 team_form_rows, C1 team_form, C2 team_form_asof.
All sequence work goes through :mod:`kestrel.operators.sequence`, so no task
ever holds a whole team's history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrel.functions.numeric import ratio_round, to_int_flag
from kestrel.operators import sequence as seq

# Rolling window length and the defaults used when a team has
# no history before the date.
FORM_WINDOW = 5
DEFAULT_WIN_RATE = 0.5
DEFAULT_STREAK = 0


def is_decided(winner: Column) -> Column:
    """A finished match with a result (winner not null and not '')."""
    return winner.isNotNull() & (winner != F.lit(""))


def completed(matches: DataFrame) -> DataFrame:
    return matches.filter(is_decided(F.col("winner")))


def team_rows(matches: DataFrame) -> DataFrame:
    """One row per (match, side) with ``won`` and ``won_toss`` flags.

    One scan and an ``explode`` of a two-element array (no union of two scans).
    """
    def side(team: str, other: str) -> Column:
        return F.struct(F.col(team).alias("team"), F.col(other).alias("opponent"),
                        to_int_flag(F.col(team) == F.col("winner")).alias("won"),
                        to_int_flag(F.col(team) == F.col("toss_winner")).alias("won_toss"))
    cols = [c for c in ("match_id", "match_date", "venue", "winner", "toss_winner") if c in matches.columns]
    m = matches if "toss_winner" in matches.columns else matches.withColumn("toss_winner", F.lit(None).cast("string"))
    if "toss_winner" not in cols:
        cols.append("toss_winner")
    return (m.select(*cols, F.explode(F.array(side("team1", "team2"), side("team2", "team1"))).alias("_s"))
             .select(*cols, "_s.*"))


_KEYS, _CHUNK, _ORDER = ["team"], "match_date", ["match_id"]


def _numbered(rows: DataFrame) -> DataFrame:
    """rows(team, match_date, match_id, won) with their place and run in the chunk."""
    k = FORM_WINDOW
    keys, chunk, order = _KEYS, _CHUNK, _ORDER
    rows1 = seq.within_chunk(rows, keys, chunk, order, ["won"], k)
    w = Window.partitionBy(*keys, chunk, seq.PART).orderBy(*order)
    rows1 = rows1.withColumn(
        "_chg", F.when(F.lag("won").over(w).isNull() | (F.lag("won").over(w) != F.col("won")), F.col("_rn")))
    return rows1.withColumn(
        "_run_start", F.max("_chg").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_chg")


def _chunks(rows1: DataFrame) -> DataFrame:
    return seq.chunk_table(rows1, _KEYS, _CHUNK, _ORDER, ["won"], FORM_WINDOW, last_cols=["won", "_run_start"])


def form_chunks(matches: DataFrame) -> DataFrame:
    """One row per (team, day, range of ids): what :func:`form_states` needs of it.
    A day's rows depend on that day's matches only."""
    return _chunks(_numbered(_base_rows(matches)))


def _carried(chunks: DataFrame) -> DataFrame:
    """The chunk table with running counts, history and streak."""
    k, keys, chunk = FORM_WINDOW, _KEYS, _CHUNK
    # Streak across chunks: a chunk extends the previous streak only when all of
    # its rows share the previous chunk's last result (gaps and islands).
    wc = Window.partitionBy(*keys).orderBy(chunk, seq.PART)
    chunks = (chunks
              .withColumn("_tail_len", F.col("_n") - F.col("_run_start") + 1)
              .withColumn("_brk", F.when((F.col("_run_start") == 1) & (F.lag("won").over(wc) == F.col("won")), 0)
                          .otherwise(1))
              .withColumn("_grp", F.sum("_brk").over(wc.rowsBetween(Window.unboundedPreceding, 0))))
    wg = Window.partitionBy(*keys, "_grp").orderBy(chunk, seq.PART).rowsBetween(Window.unboundedPreceding, 0)
    chunks = chunks.withColumn("_mag", F.sum("_tail_len").over(wg))
    chunks = chunks.withColumn("_end_streak", F.when(F.col("won") == 1, F.col("_mag")).otherwise(-F.col("_mag")))
    carry = seq.chunk_carry(chunks, keys, chunk, k)
    return carry.withColumn("_carry_streak", F.coalesce(F.lag("_end_streak").over(wc), F.lit(0)))


def _base_rows(matches: DataFrame) -> DataFrame:
    return team_rows(completed(matches)).select("team", "match_date", "match_id", "won")


def team_form_rows(matches: DataFrame) -> DataFrame:
    """W1 rolling win rate (5 incl. current, 3 dp), W2 signed streak, W3
    matches played -- one row per (team, completed match)."""
    rows1 = _numbered(_base_rows(matches))
    carry = _carried(_chunks(rows1))
    r = seq.attach_carry(rows1, carry, ["team"], "match_date", FORM_WINDOW, carry_cols=["_carry_streak"])
    wins = seq.tail_sum(F.col("_hist"), "won", FORM_WINDOW - 1) + F.col("won")
    n = F.least(F.size("_hist"), F.lit(FORM_WINDOW - 1)) + 1
    sign = F.when(F.col("won") == 1, 1).otherwise(-1)
    inner = (F.col("_rn") - F.col("_run_start") + 1) * sign
    streak = F.when((F.col("_run_start") == 1) & (F.col("_carry_streak") * sign > 0),
                    inner + F.col("_carry_streak")).otherwise(inner)
    return r.select("team", "match_id", "match_date", "won",
                    ratio_round(wins, n, 3).alias("rolling_win_rate"),
                    streak.cast("int").alias("streak"),
                    F.col("_seq").cast("long").alias("matches_played"))


def form_states(matches: DataFrame | None = None, chunks: DataFrame | None = None) -> DataFrame:
    """Form at the end of each (team, day) with matches: the state every later
    day sees. Size: teams x active days. From the matches, or from stored chunks."""
    carry = _carried(form_chunks(matches) if chunks is None else chunks)
    end = F.col("_end_hist")
    return carry.where("_day_end").select(
        "team", "match_date",
        ratio_round(seq.hist_sum(end, "won", FORM_WINDOW), F.size(end), 3).alias("rolling_win_rate"),
        F.col("_end_streak").cast("int").alias("streak"),
        F.col("_cum").cast("long").alias("matches_played"))


def team_form(matches: DataFrame) -> DataFrame:
    """Latest form snapshot per team."""
    st = form_states(matches)
    latest = F.max_by(F.struct("rolling_win_rate", "streak", "matches_played"), F.col("match_date"))
    return st.groupBy("team").agg(latest.alias("_l")).select("team", "_l.*")


def team_form_asof(matches: DataFrame, spine: DataFrame) -> DataFrame:
    """For each (spine match, side) the team's form from matches dated
    strictly before the spine date; defaults 0.5 / 0 / 0 with no history.

    ``spine`` needs match_id, match_date, team1, team2.
    """
    sides = spine.select("match_id", "match_date",
                         F.explode(F.array(F.col("team1"), F.col("team2"))).alias("team"))
    looked = seq.asof_before(form_states(matches), ["team"], "match_date", sides, "match_date",
                             ["rolling_win_rate", "streak", "matches_played"])
    j = sides.join(looked, ["team", "match_date"], "left")
    return j.select("match_id", "match_date", "team",
                    F.coalesce("rolling_win_rate", F.lit(DEFAULT_WIN_RATE)).alias("rolling_win_rate"),
                    F.coalesce("streak", F.lit(DEFAULT_STREAK)).alias("streak"),
                    F.coalesce("matches_played", F.lit(0).cast("long")).alias("matches_played"))
