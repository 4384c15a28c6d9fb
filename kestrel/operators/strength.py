"""Team strength as of a date -- the mean of each player's latest
rolling batting average and the mean of positive latest rolling economies
over the players whose latest line before the date is for that team.

Rule (per date D): every player contributes one row per distinct team among
{team of latest batting line before D, team of latest bowling line before
D}; a row carries the batting average if it is the batting team (0
otherwise, so pure bowlers dilute the mean, Q11) and the economy if it is the
bowling team. bat = mean(bat over rows), eco = mean(eco over rows with
eco > 0); 0.0 when there is nothing.

Plan: a player's state only changes on days with a line. Each state holds
for D in (day, next_day]; it becomes +contribution at day+1 and
-contribution at next_day+1. Summing the deltas per (team, day) and running
a cumulative sum per team gives every team's totals on every day -- an
interval "sweep", so no (player x date) grid is ever built and no range join
is needed. Sums are in exact hundredths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrel.functions.numeric import cents_ratio_round
from kestrel.operators import players as pl
from kestrel.operators import sequence as seq


def strength_deltas(day_states: DataFrame) -> DataFrame:
    """(team, eff_day, d_n, d_bat, d_eco, d_eco_n) contributions of the states
    (player_name, role, match_date, team, v)."""
    def of(role: str, team: str, value: str):
        return F.max(F.when(F.col("role") == role, F.struct(F.col("team").alias(team), F.col("v").alias(value))))
    ev = day_states.groupBy("player_name", "match_date").agg(
        of("batting", "bt", "bat_c").alias("_b"), of("bowling", "wt", "eco_c").alias("_w"))
    wp = Window.partitionBy("player_name").orderBy("match_date")
    upto = wp.rowsBetween(Window.unboundedPreceding, 0)
    bat_st = F.last("_b", ignorenulls=True).over(upto)
    bowl_st = F.last("_w", ignorenulls=True).over(upto)
    st = ev.select("player_name", "match_date", bat_st.alias("b"), bowl_st.alias("w"),
                   F.lead("match_date").over(wp).alias("next_day"))
    teams = F.array_distinct(F.filter(F.array(F.col("b.bt"), F.col("w.wt")), lambda t: t.isNotNull()))
    st = st.select("*", F.explode(teams).alias("team"))
    is_bat = F.coalesce(F.col("team") == F.col("b.bt"), F.lit(False))
    is_eco = F.coalesce((F.col("team") == F.col("w.wt")) & (F.col("w.eco_c") > 0), F.lit(False))
    contrib = st.select(
        "team", "match_date", "next_day",
        F.lit(1).cast("long").alias("n"),
        F.when(is_bat, F.col("b.bat_c")).otherwise(F.lit(0)).cast("long").alias("bat"),
        F.when(is_eco, F.col("w.eco_c")).otherwise(F.lit(0)).cast("long").alias("eco"),
        F.when(is_eco, F.lit(1)).otherwise(F.lit(0)).cast("long").alias("eco_n"))
    ends = F.array(
        F.struct(F.date_add("match_date", 1).alias("eff_day"), F.lit(1).alias("sgn")),
        F.struct(F.date_add("next_day", 1).alias("eff_day"), F.lit(-1).alias("sgn")))
    d = contrib.select("*", F.explode(ends).alias("_e")).filter(F.col("_e.eff_day").isNotNull())
    sg = F.col("_e.sgn")
    return d.groupBy("team", F.col("_e.eff_day").alias("eff_day")).agg(
        F.sum(F.col("n") * sg).alias("d_n"), F.sum(F.col("bat") * sg).alias("d_bat"),
        F.sum(F.col("eco") * sg).alias("d_eco"), F.sum(F.col("eco_n") * sg).alias("d_eco_n"))


def strength_states(stats: DataFrame | None = None, matches: DataFrame | None = None, chunks: DataFrame | None = None) -> DataFrame:
    """(team, eff_day, n, bat, eco, eco_n): totals valid from eff_day on. From the
    stat lines, or from stored chunks."""
    deltas = strength_deltas(pl.role_day_states(pl.role_chunks(stats, matches) if chunks is None else chunks))
    w = Window.partitionBy("team").orderBy("eff_day").rowsBetween(Window.unboundedPreceding, 0)
    return deltas.select("team", "eff_day",
                         F.sum("d_n").over(w).alias("n"), F.sum("d_bat").over(w).alias("bat"),
                         F.sum("d_eco").over(w).alias("eco"), F.sum("d_eco_n").over(w).alias("eco_n"))


def team_strength_asof(stats: DataFrame, matches: DataFrame, sides: DataFrame) -> DataFrame:
    """For each distinct (team, match_date) of ``sides``: bat_avg, bowl_eco."""
    looked = seq.asof_upto(strength_states(stats, matches), ["team"], "eff_day", sides, "match_date", STATE)
    return looked.select("team", "match_date", *strength_columns())


STATE = ["n", "bat", "eco", "eco_n"]


def strength_columns() -> list[Column]:
    """bat_avg and bowl_eco from the totals of :data:`STATE`."""
    return [F.when(F.col("n") > 0, cents_ratio_round("bat", "n", 2)).otherwise(F.lit(0.0)).alias("bat_avg"),
            F.when(F.col("eco_n") > 0, cents_ratio_round("eco", "eco_n", 2)).otherwise(F.lit(0.0)).alias("bowl_eco")]
