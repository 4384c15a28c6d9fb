"""C10 feature matrix (flagship) and C11 live features.

One row per spine match with the 20 model features: form (J6), head-to-head
(J7), venue and toss records (J8), team strength (J9), differences (F11) and
flags (F12), plus the target for C10.

Plan shape: every feature family is first reduced to a lookup table keyed by
(entity, day) or (entity, venue) -- its size is bounded by entities x
calendar days, not by the number of matches -- and the spine is joined to
five of them: one per team with form, strength and toss record as of the day,
one per team with the venue record, one with the pair's record. Where AQE
measures a table as small the join becomes a broadcast hash join; otherwise the
spine is shuffled by its keys.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kestrel.functions.numeric import ratio_round, round_half_even, to_int_flag
from kestrel.operators import form as fm
from kestrel.operators import matchups as mu
from kestrel.operators import sequence as seq
from kestrel.operators import strength as stg

# The model's feature list, in order, and its target.
FEATURE_COLS = [
    "team1_win_rate", "team2_win_rate", "win_rate_diff", "team1_streak", "team2_streak",
    "team1_h2h_win_rate", "team2_h2h_win_rate", "h2h_total",
    "team1_venue_win_rate", "team2_venue_win_rate", "venue_advantage_diff",
    "toss_won_by_team1", "team1_toss_advantage", "team2_toss_advantage",
    "team1_bat_avg", "team2_bat_avg", "bat_avg_diff",
    "team1_bowl_eco", "team2_bowl_eco", "bowl_eco_diff",
]
TARGET_COL = "team1_won"
ID_COLS = ["match_id", "match_date", "team1", "team2"]
UNFINISHED_EXCLUDED = ["completed", "Completed", "Result"]


def _side_lookup(spine: DataFrame, table: DataFrame, on: dict[str, str], cols: dict[str, str]) -> DataFrame:
    """Left-join ``table`` renaming its key columns to spine columns (``on``:
    table col -> spine col) and value columns (``cols``: table -> output)."""
    t = table.select(*[F.col(k).alias(v) for k, v in on.items()],
                     *[F.col(k).alias(v) for k, v in cols.items()])
    return spine.join(t, list(on.values()), "left")


class States(NamedTuple):
    """What the lookups read: end-of-day form and strength of the teams, records of
    pairs, venues and tosses."""
    form: DataFrame
    strength: DataFrame
    pairs: DataFrame
    venues: DataFrame
    tosses: DataFrame


def states_of(matches: DataFrame, stats: DataFrame) -> States:
    return States(fm.form_states(matches), stg.strength_states(stats, matches), mu.pair_states(matches),
                  mu.venue_stats(matches), mu.toss_impact(matches))


def build_features(matches: DataFrame | None, stats: DataFrame | None, spine: DataFrame,
                   history: str = "all", with_target: bool = True, keep: tuple[str, ...] = (),
                   states: States | None = None) -> DataFrame:
    """Features for every row of ``spine`` (match_id, match_date, team1,
    team2, venue, toss_winner[, winner]). ``states`` (see
    :mod:`kestrel.plans.day_states`) stand for the matches and stat lines.

    ``history="all"`` computes venue/toss records over all decided matches
    as the reference does (Q5); ``"before"`` uses only matches strictly before
    the spine date (leakage-free A5).
    """
    sp = spine.select("match_id", "match_date", "team1", "team2",
                      F.coalesce(F.nullif(F.col("venue"), F.lit("")), F.lit("Unknown")).alias("venue")
                      if history == "live" else F.col("venue"),
                      "toss_winner", *(["winner"] if with_target else []),
                      *[F.col(k).alias(f"_keep_{k}") for k in keep])
    sides = sp.select(F.explode(F.array("team1", "team2")).alias("team"), "match_date")

    # J6 form and J9 strength as of the day, for every team and day at once
    st = states_of(matches, stats) if states is None else states
    team_t = seq.asof_tables([(st.form, "match_date", ["rolling_win_rate", "streak"], True),
                              (st.strength, "eff_day", stg.STATE, False)],
                             ["team"], sides, "match_date")
    team_t = team_t.select("team", "match_date", "rolling_win_rate", "streak", *stg.strength_columns())
    # J7 head-to-head as of the day
    lo, hi = F.least("team1", "team2"), F.greatest("team1", "team2")
    sp = sp.withColumn("_lo", lo).withColumn("_hi", hi)
    pair_q = sp.select(F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), "match_date")
    h2h_t = seq.asof_before(st.pairs, ["lo", "hi"], "match_date", pair_q, "match_date",
                            ["cum_total", "cum_lo_wins", "cum_hi_wins"])
    if history == "before":
        venue_t, toss_t = _venue_toss_before(matches, sp)
        team_t = team_t.join(toss_t, ["team", "match_date"], "left")
        venue_key = ["team", "venue", "match_date"]
    else:
        venue_t, toss_t = st.venues, st.tosses.select("team", "toss_advantage")
        team_t = team_t.join(toss_t, "team", "left")
        venue_key = ["team", "venue"]

    out = sp
    for n in ("1", "2"):
        out = _side_lookup(out, team_t, {"team": f"team{n}", "match_date": "match_date"},
                           {"rolling_win_rate": f"team{n}_win_rate", "streak": f"team{n}_streak",
                            "bat_avg": f"team{n}_bat_avg", "bowl_eco": f"team{n}_bowl_eco",
                            "toss_advantage": f"team{n}_toss_advantage"})
        out = _side_lookup(out, venue_t, {k: f"team{n}" if k == "team" else k for k in venue_key},
                           {"venue_win_rate": f"team{n}_venue_win_rate"})
    out = _side_lookup(out, h2h_t, {"lo": "_lo", "hi": "_hi", "match_date": "match_date"},
                       {"cum_total": "_h_total", "cum_lo_wins": "_h_lo", "cum_hi_wins": "_h_hi"})

    c = F.col
    total = F.coalesce(c("_h_total"), F.lit(0).cast("long"))
    share = F.when(c("team1") == c("_lo"), c("_h_lo")).otherwise(c("_h_hi")) / c("_h_total")
    d = mu.H2H_DEFAULT_RATE
    t1wr = F.coalesce(c("team1_win_rate"), F.lit(fm.DEFAULT_WIN_RATE))
    t2wr = F.coalesce(c("team2_win_rate"), F.lit(fm.DEFAULT_WIN_RATE))
    v1 = F.coalesce(c("team1_venue_win_rate"), F.lit(mu.VENUE_DEFAULT_RATE))
    v2 = F.coalesce(c("team2_venue_win_rate"), F.lit(mu.VENUE_DEFAULT_RATE))
    b1 = F.coalesce(c("team1_bat_avg"), F.lit(0.0))
    b2 = F.coalesce(c("team2_bat_avg"), F.lit(0.0))
    e1 = F.coalesce(c("team1_bowl_eco"), F.lit(0.0))
    e2 = F.coalesce(c("team2_bowl_eco"), F.lit(0.0))
    feats = {
        "team1_win_rate": t1wr,
        "team2_win_rate": t2wr,
        "win_rate_diff": round_half_even(t1wr - t2wr, 3),
        "team1_streak": F.coalesce(c("team1_streak"), F.lit(fm.DEFAULT_STREAK)),
        "team2_streak": F.coalesce(c("team2_streak"), F.lit(fm.DEFAULT_STREAK)),
        "team1_h2h_win_rate": F.when(total > 0, round_half_even(share, 3)).otherwise(F.lit(d)),
        "team2_h2h_win_rate": F.when(total > 0, round_half_even(F.lit(1.0) - share, 3)).otherwise(F.lit(d)),
        "h2h_total": total,
        "team1_venue_win_rate": v1,
        "team2_venue_win_rate": v2,
        "venue_advantage_diff": round_half_even(v1 - v2, 3),
        "toss_won_by_team1": to_int_flag(c("toss_winner") == c("team1")),
        "team1_toss_advantage": F.coalesce(c("team1_toss_advantage"), F.lit(mu.TOSS_DEFAULT_ADVANTAGE)),
        "team2_toss_advantage": F.coalesce(c("team2_toss_advantage"), F.lit(mu.TOSS_DEFAULT_ADVANTAGE)),
        "team1_bat_avg": b1,
        "team2_bat_avg": b2,
        "bat_avg_diff": round_half_even(b1 - b2, 2),
        "team1_bowl_eco": e1,
        "team2_bowl_eco": e2,
        "bowl_eco_diff": round_half_even(e1 - e2, 2),
    }
    cols = [c("match_id"), F.date_format("match_date", "yyyy-MM-dd").alias("match_date"), c("team1"), c("team2")]
    cols += [v.alias(k) for k, v in feats.items()]
    if with_target:
        cols.append(to_int_flag(c("winner") == c("team1")).alias(TARGET_COL))
    cols += [c(f"_keep_{k}").alias(k) for k in keep]
    return out.select(*cols)


def _venue_toss_before(matches: DataFrame, sp: DataFrame):
    """A5: venue and toss records from decided matches strictly before each
    spine day, via per-(key, day) cumulative counts and the strict as-of."""
    r = fm.team_rows(fm.completed(matches))
    wv = Window.partitionBy("team", "venue").orderBy("match_date").rowsBetween(Window.unboundedPreceding, 0)
    vd = (r.filter(F.col("venue").isNotNull()).groupBy("team", "venue", "match_date")
          .agg(F.count(F.lit(1)).alias("n"), F.sum("won").alias("w"))
          .select("team", "venue", "match_date", F.sum("n").over(wv).alias("n"), F.sum("w").over(wv).alias("w")))
    vq = sp.select(F.explode(F.array("team1", "team2")).alias("team"), "venue", "match_date")
    venue_t = seq.asof_before(vd, ["team", "venue"], "match_date", vq, "match_date", ["n", "w"]) \
        .select("team", "venue", "match_date", ratio_round("w", "n", 3).alias("venue_win_rate"))
    known = r.filter(F.col("toss_winner").isNotNull() & (F.col("toss_winner") != ""))
    wt = Window.partitionBy("team").orderBy("match_date").rowsBetween(Window.unboundedPreceding, 0)
    td = (known.groupBy("team", "match_date").agg(
        F.count_if(F.col("won_toss") == 1).alias("twn"), F.count_if((F.col("won_toss") == 1) & (F.col("won") == 1)).alias("tww"),
        F.count_if(F.col("won_toss") == 0).alias("tln"), F.count_if((F.col("won_toss") == 0) & (F.col("won") == 1)).alias("tlw"))
          .select("team", "match_date", *[F.sum(x).over(wt).alias(x) for x in ("twn", "tww", "tln", "tlw")]))
    tq = sp.select(F.explode(F.array("team1", "team2")).alias("team"), "match_date")
    t = seq.asof_before(td, ["team"], "match_date", tq, "match_date", ["twn", "tww", "tln", "tlw"])
    rate = lambda w, n: F.when(F.col(n) > 0, ratio_round(w, n, 3)).otherwise(F.lit(0.0))
    seen = F.coalesce(F.col("twn"), F.lit(0)) + F.coalesce(F.col("tln"), F.lit(0)) > 0
    toss_t = t.select("team", "match_date", F.when(
        seen, round_half_even(rate("tww", "twn") - rate("tlw", "tln"), 3)).alias("toss_advantage"))
    return venue_t, toss_t


def feature_matrix(matches: DataFrame, stats: DataFrame, history: str = "all") -> DataFrame:
    """One row per decided match (4 ids + 20 features + team1_won)."""
    return build_features(matches, stats, fm.completed(matches), history=history, with_target=True)


def unfinished(matches: DataFrame) -> DataFrame:
    """Status not in the finished labels (a NULL status drops, as in SQL)."""
    return matches.filter(~F.col("status").isin(*UNFINISHED_EXCLUDED))


def live_features(matches: DataFrame | None, stats: DataFrame | None, spine: DataFrame | None = None,
                  keep: tuple[str, ...] = (), states: States | None = None) -> DataFrame:
    """C11: the same 20 features for matches still to be scored (no target).
    Venue defaults to "Unknown", toss winner to "" (F15)."""
    sp = unfinished(matches) if spine is None else spine
    sp = sp.withColumn("toss_winner", F.coalesce(F.col("toss_winner"), F.lit("")))
    if "venue" in keep:
        sp = sp.withColumn("venue", F.coalesce(F.nullif(F.col("venue"), F.lit("")), F.lit("Unknown")))
    return build_features(matches, stats, sp, history="live", with_target=False, keep=keep, states=states)
