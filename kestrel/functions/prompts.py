"""Text prompts built set-wise from feature rows (F20 pre-match, F21 live,
F22 post-match, F23 spotlight).

A template is text with ``{name}`` slots. :func:`render` turns it into
one ``concat`` of literals and Column expressions (JVM side; no Python
UDF). Number formats are part of the result: ``x*100`` with 0
decimals is the half-even integer of the double ``x*100``; plain floats print
as Spark/DuckDB shortest text (``62.3``, ``50.0``).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- templates: our own wording; callers may pass others with the same slots ----

PRE_MATCH_TEMPLATE = """Preview a cricket match in three sentences. Everything you may say is in this sheet.

fixture: {team1} v {team2}
ground: {venue}
chance of winning, percent: {team1} {team1_win_prob}, {team2} {team2_win_prob}
games won of the last five, percent: {team1} {team1_win_rate_pct} ({streak1_str}), {team2} {team2_win_rate_pct} ({streak2_str})
meetings won by {team1}, percent: {team1_h2h_pct} of {h2h_total}
games won on this ground, percent: {team1} {team1_venue_pct}, {team2} {team2_venue_pct}
toss went to: {toss_winner}

Cover how both sides come into the game, then their meetings and the ground, then who is likely to win and by the chance given. Sober wording, no greeting."""

LIVE_TEMPLATE = """Describe the state of a running cricket match in one sentence of thirty words or fewer, from this sheet alone.

fixture: {team1} v {team2}
batting: {batting_team}, {runs} for {wickets} after {overs} overs
chance of winning, percent: {team1} {team1_win_prob}, {team2} {team2_win_prob}
{run_rate_str}

Name the score of the batting side and how the chances stand. Lively wording, true to the numbers."""

RUN_RATE_TEMPLATE = "runs an over: {required_rate} needed, {current_rate} so far"

POST_MATCH_TEMPLATE = """Report a finished cricket match in three sentences. Everything you may say is in this sheet.

fixture: {team1} v {team2}
winner: {winner}, margin {win_margin}
most runs for {team1}: {team1_top_scorer}, {team1_top_scorer_runs}
most runs for {team2}: {team2_top_scorer}, {team2_top_scorer_runs}
best bowling: {best_bowler}, {best_bowler_wickets} wickets, {best_bowler_economy} runs an over
forecast: {prediction_str}

Cover the win and the batting behind it, then the bowling, then how the forecast did."""

PREDICTION_RIGHT = "right, {winner} was given {predicted_prob} percent"
PREDICTION_UPSET = "wrong, {predicted_winner} was given {predicted_prob} percent and lost"

SPOTLIGHT_TEMPLATE = """Choose one batter and one bowler to follow in {match}, and give a sentence of reasons for each. Use these figures of the last five games only.

{players_str}"""

NO_SPOTLIGHT = "There are no player figures for this match yet."
SPOTLIGHT_BAT_LINE = "{name}, {team}: {rolling_avg_runs} runs a game at strike rate {rolling_avg_sr} (change {sr_sign}{sr_trend})"
SPOTLIGHT_BOWL_LINE = ("{name}, {team}: {rolling_avg_wickets} wickets a game at economy {rolling_avg_economy} "
                       "(change {eco_sign}{economy_trend})")

_SLOT = re.compile(r"\{([a-z0-9_]+)\}")


def _pieces(template: str):
    pos = 0
    for m in _SLOT.finditer(template):
        yield "text", template[pos:m.start()]
        yield "slot", m.group(1)
        pos = m.end()
    yield "text", template[pos:]


def render(template: str, values: dict[str, Column]) -> Column:
    """Template -> one concat expression; every slot must be provided and is
    coalesced to '' (concat with NULL would blank the whole text)."""
    parts = []
    for kind, v in _pieces(template):
        if kind == "text":
            if v:
                parts.append(F.lit(v))
        else:
            parts.append(F.coalesce(values[v].cast("string"), F.lit("")))
    return F.concat(*parts)



def pct0(x) -> Column:
    """``{x*100:.0f}``: half-even integer of the double x*100."""
    c = F.col(x) if isinstance(x, str) else x
    return F.rint(c * F.lit(100.0)).cast("long").cast("string")



def fixed2(x) -> Column:
    """``{x:.2f}`` with half-even on the double (Python formatting)."""
    c = F.col(x) if isinstance(x, str) else x
    return F.when(c.isNotNull(), F.format_string("%.2f", F.rint(c * F.lit(100.0)) / F.lit(100.0)))


def streak_text(streak: Column) -> Column:
    from kestrel.functions.text import streak_phrase
    return streak_phrase(streak)



def pre_match_prompts(rows: DataFrame, template: str = PRE_MATCH_TEMPLATE) -> DataFrame:
    """F20 for every row with team1, team2, venue, toss_winner,
    team1_win_prob, team2_win_prob (percent), team1/2_win_rate,
    team1/2_streak, team1_h2h_win_rate, h2h_total, team1/2_venue_win_rate."""
    c = F.col
    vals = {
        "team1": c("team1"), "team2": c("team2"), "venue": c("venue"),
        "team1_win_prob": c("team1_win_prob"), "team2_win_prob": c("team2_win_prob"),
        "team1_win_rate_pct": pct0("team1_win_rate"), "team2_win_rate_pct": pct0("team2_win_rate"),
        "streak1_str": streak_text(c("team1_streak")), "streak2_str": streak_text(c("team2_streak")),
        "team1_h2h_pct": pct0("team1_h2h_win_rate"), "h2h_total": c("h2h_total"),
        "team1_venue_pct": pct0("team1_venue_win_rate"), "team2_venue_pct": pct0("team2_venue_win_rate"),
        "toss_winner": c("toss_winner"),
    }
    return rows.select("match_id", render(template, vals).alias("prompt"))


def live_prompts(rows: DataFrame, template: str = LIVE_TEMPLATE) -> DataFrame:
    """run-rate line only when both rates are set and non-zero."""
    c = F.col
    both = F.coalesce((c("required_rate") != 0) & (c("current_rate") != 0), F.lit(False))
    rr = F.when(both, render(RUN_RATE_TEMPLATE, {"required_rate": fixed2("required_rate"),
                                                 "current_rate": fixed2("current_rate")})).otherwise(F.lit(""))
    vals = {k: c(k) for k in ("team1", "team2", "batting_team", "runs", "wickets", "overs",
                              "team1_win_prob", "team2_win_prob")}
    vals["run_rate_str"] = rr
    return rows.select("match_id", render(template, vals).alias("prompt"))


def post_match_prompts(rows: DataFrame, template: str = POST_MATCH_TEMPLATE) -> DataFrame:
    """verdict line says "right" when the predicted winner
    is the winner, else "wrong"; confidence printed with 0 decimals."""
    c = F.col
    prob0 = F.rint(c("predicted_prob")).cast("long").cast("string")
    verdict = F.when(c("predicted_winner") == c("winner"),
                     render(PREDICTION_RIGHT, {"winner": c("winner"), "predicted_prob": prob0})) \
        .otherwise(render(PREDICTION_UPSET, {"predicted_winner": c("predicted_winner"), "predicted_prob": prob0}))
    vals = {k: c(k) for k in ("team1", "team2", "winner", "win_margin", "team1_top_scorer", "team1_top_scorer_runs",
                              "team2_top_scorer", "team2_top_scorer_runs", "best_bowler", "best_bowler_wickets")}
    vals["best_bowler_economy"] = fixed2("best_bowler_economy")
    vals["prediction_str"] = verdict
    return rows.select("match_id", render(template, vals).alias("prompt"))


def _spotlight_line() -> Column:
    """One player's line: batter form when rolling_avg_runs > 0, else bowler form.
    A batter record's bowling fields are integer zeros and print as 0."""
    c = F.col
    is_bat = c("role") == "batting"
    zero = F.lit("0")
    sign = lambda x: F.when(c(x) > 0, F.lit("+")).otherwise(F.lit(""))
    bat_line = render(SPOTLIGHT_BAT_LINE, {
        "name": c("name"), "team": c("team"), "rolling_avg_runs": c("rolling_avg_runs"),
        "rolling_avg_sr": c("rolling_avg_sr"), "sr_sign": sign("sr_trend"), "sr_trend": c("sr_trend")})
    bowl_line = render(SPOTLIGHT_BOWL_LINE, {
        "name": c("name"), "team": c("team"),
        "rolling_avg_wickets": F.when(is_bat, zero).otherwise(c("rolling_avg_wickets").cast("string")),
        "rolling_avg_economy": F.when(is_bat, zero).otherwise(c("rolling_avg_economy").cast("string")),
        "eco_sign": F.when(is_bat, F.lit("")).otherwise(sign("economy_trend")),
        "economy_trend": F.when(is_bat, zero).otherwise(c("economy_trend").cast("string"))})
    return F.when(c("rolling_avg_runs") > 0, bat_line).otherwise(bowl_line)


def _spotlight_text(lines: Column, match: Column) -> Column:
    players = F.array_join(F.transform(lines, lambda x: x["line"]), "\n")
    return F.when(F.size(lines) > 0, render(SPOTLIGHT_TEMPLATE, {"match": match, "players_str": players})).otherwise(F.lit(NO_SPOTLIGHT))


def spotlight_prompt(records: DataFrame, match_name: Column | str) -> DataFrame:
    """F23 from a spotlight record set (name, team, the six numbers, ord,
    role); lines in ``ord`` order joined by newlines."""
    lines = records.select(F.struct(F.col("ord"), _spotlight_line().alias("line")).alias("_l")) \
        .agg(F.sort_array(F.collect_list("_l")).alias("_ls"))
    m = F.lit(match_name) if isinstance(match_name, str) else match_name
    return lines.select(_spotlight_text(F.col("_ls"), m).alias("prompt"))


def spotlight_prompts(records: DataFrame, fixtures: DataFrame, match_name: Column) -> DataFrame:
    """F23 for every fixture: ``records`` carry the ``match_id`` (at most six each);
    ``match_name`` is an expression over ``fixtures``."""
    lines = records.select("match_id", F.struct(F.col("ord"), _spotlight_line().alias("line")).alias("_l")) \
        .groupBy("match_id").agg(F.sort_array(F.collect_list("_l")).alias("_ls"))
    named = fixtures.select("match_id", match_name.alias("_m")).join(lines, "match_id", "left")
    return named.select("match_id", _spotlight_text(F.col("_ls"), F.col("_m")).alias("prompt"))
