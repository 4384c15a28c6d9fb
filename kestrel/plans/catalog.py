"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

the whole test tables (through the domain projections) and returns a
DataFrame. Queries return lazy plans, except that the model queries fit
their small parameters (a row count, medians, scaler statistics, class
weights) and checkpoint the feature matrix to the shared folder first; the
feed queries run their stream to completion and return the written table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.functions import prompts as pr
from kestrel.functions import text as tx
from kestrel.ml import metrics as mt
from kestrel.ml import prep
from kestrel.ml import scoring
from kestrel.ml import train as mtrain
from kestrel.operators import form, quality, reports, scorecards
from kestrel.operators import matchups as mu
from kestrel.operators import players as pl
from kestrel.operators import requests as rq
from kestrel.operators import strength as stg
from kestrel.operators import upsert as up
from kestrel.plans import domain as dm
from kestrel.plans import features as feat
from kestrel.plans import ingest as ing
from kestrel.session import ensure_compiled, ensure_partitions, ship_package
from kestrel.sources import fixtures as fxs
from kestrel.streaming import feed as feedmod

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
FLAGSHIP = "C10_feature_matrix"


def register(name: str):
    """Register a query. The test tables hold wall-clock timestamps without
    zone; the session zone is pinned to UTC so conversions never shift them."""
    def deco(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            if spark.conf.get("spark.sql.session.timeZone", "UTC") != "UTC":
                spark.conf.set("spark.sql.session.timeZone", "UTC")
            ship_package(spark)
            ensure_compiled(spark)
            ensure_partitions(spark, fxs.input_parts(spark, sf_dir, "orders", "lineitem", "events"))
            return fn(spark, sf_dir)
        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[name] = run
        return fn
    return deco


# ---- team form ----------------------------------------------------------------

@register("W1_W2_W3_team_form_rows")
def q_form_rows(spark, sf_dir):
    return form.team_form_rows(dm.matches(spark, sf_dir))


@register("C1_team_form")
def q_team_form(spark, sf_dir):
    return form.team_form(dm.matches(spark, sf_dir))


@register("C2_team_form_asof")
def q_team_form_asof(spark, sf_dir):
    m = dm.matches(spark, sf_dir)
    return form.team_form_asof(m, form.completed(m))


@register("U1_team_rows")
def q_team_rows(spark, sf_dir):
    return form.team_rows(form.completed(dm.matches(spark, sf_dir))).select(
        "match_id", "match_date", "venue", "team", "opponent", "won", "won_toss")


# ---- scorecards and validation --------------------------------------------------

@register("A1_batting_scorecard")
def q_batting_card(spark, sf_dir):
    return scorecards.batting_card(dm.deliveries(spark, sf_dir)).drop("match_date")


@register("A2_bowling_scorecard")
def q_bowling_card(spark, sf_dir):
    return scorecards.bowling_card(dm.deliveries(spark, sf_dir)).drop("match_date")


@register("A2_bowling_scorecard_fielding_side")
def q_bowling_card_fielding(spark, sf_dir):
    m = dm.matches(spark, sf_dir)
    return scorecards.bowling_card(dm.deliveries(spark, sf_dir, m), "fielding", m).drop("match_date")


@register("V1_V3_match_validation_tally")
def q_match_tally(spark, sf_dir):
    return quality.load_tally(quality.validate_matches(dm.matches(spark, sf_dir)))


@register("V1_match_validation")
def q_match_validation(spark, sf_dir):
    return quality.validate_matches(dm.matches(spark, sf_dir)).select("match_id", "is_valid", "error_message")


@register("V2_V3_stat_validation_tally")
def q_stat_tally(spark, sf_dir):
    return quality.load_tally(dm.stat_checks(spark, sf_dir))


# ---- reports --------------------------------------------------------------------

@register("C12_batting_cards")
def q_batting_cards(spark, sf_dir):
    return reports.batting_cards(dm.player_stats(spark, sf_dir))


@register("C12_bowling_cards")
def q_bowling_cards(spark, sf_dir):
    return reports.bowling_cards(dm.player_stats(spark, sf_dir))


@register("C13_recent_matches")
def q_recent(spark, sf_dir):
    return reports.recent_matches(dm.matches(spark, sf_dir))


@register("A9_batter_summary")
def q_batter_summary(spark, sf_dir):
    m = dm.matches(spark, sf_dir)
    return reports.batter_summary(dm.player_stats(spark, sf_dir, m), m, min_balls=0).drop("_key")


@register("A10_bowler_summary")
def q_bowler_summary(spark, sf_dir):
    m = dm.matches(spark, sf_dir)
    return reports.bowler_summary(dm.player_stats(spark, sf_dir, m), m).drop("_key", "_key2")


@register("C14_top_batters_per_pair")
def q_top_batters(spark, sf_dir):
    m = dm.matches(spark, sf_dir)
    return reports.top_batters_per_pair(dm.player_stats(spark, sf_dir, m), m, min_balls=0)


@register("C14_top_bowlers_per_pair")
def q_top_bowlers(spark, sf_dir):
    m = dm.matches(spark, sf_dir)
    return reports.top_bowlers_per_pair(dm.player_stats(spark, sf_dir, m), m)


@register("C15_h2h_summary")
def q_h2h_summary(spark, sf_dir):
    return reports.h2h_summary(dm.matches(spark, sf_dir))


@register("A12_top_run_totals")
def q_top_runs(spark, sf_dir):
    return reports.top_run_totals(dm.player_stats(spark, sf_dir))


def _warehouse(spark, sf_dir):
    """The four tables of the store: matches, innings, player_stats, data_errors."""
    m = dm.matches(spark, sf_dir)
    d = dm.deliveries(spark, sf_dir, m)
    checks = quality.validate_player_stats(scorecards.player_stats(d, "batting", m))
    ok, stat_rej = quality.split_valid(checks, "scorecard", scorecards.STAT_COLUMNS)
    _, match_rej = quality.split_valid(quality.validate_matches(m), "matches")
    return {"matches": m, "innings": scorecards.innings_lines(d), "player_stats": scorecards.typed_stats(ok),
            "data_errors": stat_rej.unionByName(match_rej)}


@register("A13_table_counts")
def q_table_counts(spark, sf_dir):
    return reports.table_counts(_warehouse(spark, sf_dir))


@register("C12_innings_cards")
def q_innings_cards(spark, sf_dir):
    return reports.innings_cards(scorecards.innings_lines(dm.deliveries(spark, sf_dir)))


# ---- matchups -------------------------------------------------------------------



@register("C6_h2h_stats")
def q_h2h(spark, sf_dir):
    return mu.h2h_stats(dm.matches(spark, sf_dir))


@register("C7_h2h_asof")
def q_h2h_asof(spark, sf_dir):
    m = dm.matches(spark, sf_dir)
    return mu.h2h_asof(m, form.completed(m))


@register("C8_venue_stats")
def q_venue(spark, sf_dir):
    return mu.venue_stats(dm.matches(spark, sf_dir))


@register("C9_toss_impact")
def q_toss(spark, sf_dir):
    return mu.toss_impact(dm.matches(spark, sf_dir))


# ---- players --------------------------------------------------------------------

@register("W4_W6_W8_batting_feature_rows")
def q_bat_rows(spark, sf_dir):
    m = dm.matches(spark, sf_dir)
    return pl.batting_feature_rows(dm.player_stats(spark, sf_dir, m), m)


@register("W5_W6_bowling_feature_rows")
def q_bowl_rows(spark, sf_dir):
    m = dm.matches(spark, sf_dir)
    return pl.bowling_feature_rows(dm.player_stats(spark, sf_dir, m), m)


@register("C3_batting_features")
def q_bat_feat(spark, sf_dir):
    m = dm.matches(spark, sf_dir)
    return pl.batting_features(dm.player_stats(spark, sf_dir, m), m)


@register("C4_bowling_features")
def q_bowl_feat(spark, sf_dir):
    m = dm.matches(spark, sf_dir)
    return pl.bowling_features(dm.player_stats(spark, sf_dir, m), m)


@register("C5_player_features_asof")
def q_player_asof(spark, sf_dir):
    """As of the latest match day in the data (a scalar subquery)."""
    m = dm.matches(spark, sf_dir)
    return pl.player_features_asof(dm.player_stats(spark, sf_dir, m), m, m.select(F.max("match_date")).scalar())


@register("J9_team_strength_asof")
def q_strength(spark, sf_dir):
    m = dm.matches(spark, sf_dir)
    sides = form.completed(m).select(F.explode(F.array("team1", "team2")).alias("team"), "match_date")
    return stg.team_strength_asof(dm.player_stats(spark, sf_dir, m), m, sides)


@register("C16_spotlight_next_fixture")
def q_spotlight(spark, sf_dir):
    """Spotlight for the next fixture of any teams: every unfinished one."""
    m = dm.matches(spark, sf_dir)
    return pl.spotlight_of_fixtures(dm.player_stats(spark, sf_dir, m), m, feat.unfinished(m), min_balls=0)


def _longer_lines(stats):
    """Batting lines with up to six balls more, by match: in the test ball log nearly
    every batter faces one ball a match, so the reports' threshold would drop all."""
    more = F.when(F.col("role") == "batting", F.col("match_id") % 7).otherwise(0)
    return stats.withColumn("balls_faced", (F.col("balls_faced") + more).cast("int"))


@register("C16_spotlight_min_balls")
def q_spotlight_min_balls(spark, sf_dir):
    m = dm.matches(spark, sf_dir)
    return pl.spotlight_of_fixtures(_longer_lines(dm.player_stats(spark, sf_dir, m)), m, feat.unfinished(m))


@register("A9_batter_summary_min_balls")
def q_batter_summary_min_balls(spark, sf_dir):
    m = dm.matches(spark, sf_dir)
    return reports.batter_summary(_longer_lines(dm.player_stats(spark, sf_dir, m)), m).drop("_key")


@register("C14_top_batters_min_balls")
def q_top_batters_min_balls(spark, sf_dir):
    m = dm.matches(spark, sf_dir)
    return reports.top_batters_per_pair(_longer_lines(dm.player_stats(spark, sf_dir, m)), m)


@register("P4_batting_lines_min_balls")
def q_min_balls(spark, sf_dir):
    m = dm.matches(spark, sf_dir)
    return pl.batting_lines(_longer_lines(dm.player_stats(spark, sf_dir, m)), m, pl.SPOTLIGHT_MIN_BALLS) \
        .select("match_id", "player_name", "team", "runs", "balls_faced")


# ---- feature matrix ---------------------------------------------------------------

@register("C10_feature_matrix")
def q_feature_matrix(spark, sf_dir):
    m = dm.matches(spark, sf_dir)
    return feat.feature_matrix(m, dm.player_stats(spark, sf_dir, m))


@register("C10_feature_matrix_leakage_free")
def q_feature_matrix_before(spark, sf_dir):
    m = dm.matches(spark, sf_dir)
    return feat.feature_matrix(m, dm.player_stats(spark, sf_dir, m), history="before")


@register("C11_live_features_from_day_states")
def q_live_from_states(spark, sf_dir):
    """C11 from a store that took in the history in three loads, the second of which
    brings the days of one year again."""
    from kestrel.plans import day_states
    m = dm.matches(spark, sf_dir)
    st = dm.player_stats(spark, sf_dir, m)
    store = feedmod.scratch_dirs(spark, "day-states")["table_path"]
    year = F.year("match_date")
    for days in (year <= 1995, (year >= 1995) & (year < 1997), F.coalesce(year >= 1997, F.lit(True))):
        # a line has its match's day, so each load makes the lines of its own days only
        day_states.append(store, m.where(days), st.where(days))
    return feat.live_features(None, None, feat.unfinished(m), states=day_states.states(spark, store))


@register("C11_live_features")
def q_live(spark, sf_dir):
    m = dm.matches(spark, sf_dir)
    return feat.live_features(m, dm.player_stats(spark, sf_dir, m))



# ---- scalar functions and prompts ---------------------------------------------------



@register("F1_match_hash_id")
def q_hash_id(spark, sf_dir):
    m = dm.matches(spark, sf_dir)
    return m.select("match_id", tx.match_hash_id(F.date_format("match_date", "yyyy-MM-dd"), "team1", "team2",
                                                 "venue").alias("hash_id"))


@register("F2_request_cache_key")
def q_cache_key(spark, sf_dir):
    e = fxs.read_table(spark, sf_dir, "events")
    return e.select("event_id", tx.cache_key("user_id", "event_type").alias("cache_key"))


@register("F4_F6_F7_F15_F24_match_labels")
def q_match_labels(spark, sf_dir):
    m = dm.matches(spark, sf_dir)
    return m.select("match_id", tx.versus_name("team1", "team2").alias("versus"),
                    tx.status_bucket("status").alias("status_bucket"),
                    tx.insight_kind("status", "winner").alias("insight_kind"),
                    tx.or_default("venue", "Unknown").alias("venue_or_unknown"),
                    tx.result_line("winner", "toss_winner", "status").alias("result_line"))


@register("F5_F8_event_dates")
def q_event_dates(spark, sf_dir):
    e = fxs.read_table(spark, sf_dir, "events")
    pre = tx.date_prefix(F.col("ts").cast("string"))
    return e.select("event_id", pre.alias("date_text"), tx.lenient_date(pre).alias("event_date"))


@register("F16_F17_win_prob_bands")
def q_prob_bands(spark, sf_dir):
    m = dm.matches(spark, sf_dir)
    f = scoring.with_win_probs(feat.live_features(m, dm.player_stats(spark, sf_dir, m)))
    return f.select("match_id", "team1_win_prob", "team2_win_prob",
                    tx.gauge_band("team1_win_prob").alias("gauge_band"),
                    tx.percent_delta("team1_win_prob").alias("delta_vs_even"))


@register("F19_team_streak_phrases")
def q_streak_phrases(spark, sf_dir):
    f = form.team_form(dm.matches(spark, sf_dir))
    return f.select("team", "streak", tx.streak_phrase("streak").alias("streak_phrase"))


def _chart_fields(st, m, **how):
    axes = ["radar_runs", "radar_sr", "radar_fours", "radar_sixes", "radar_innings"]
    b = reports.batter_summary(st, m, **how).withColumn(
        "_r", tx.radar_axes("avg_runs", "avg_sr", "total_fours", "total_sixes", "innings"))
    b = b.select("player_name", "team", F.lit("batting").alias("role"),
                 *[F.col("_r")[i].alias(a) for i, a in enumerate(axes)], F.lit(None).cast("string").alias("quadrant"))
    w = reports.bowler_summary(st, m).select(
        "player_name", "team", F.lit("bowling").alias("role"), *[F.lit(None).cast("double").alias(a) for a in axes],
        tx.bowler_quadrant("avg_wickets", "avg_economy").alias("quadrant"))
    return b.unionByName(w)


@register("F18_F25_player_chart_fields")
def q_chart_fields(spark, sf_dir):
    m = dm.matches(spark, sf_dir)
    return _chart_fields(dm.player_stats(spark, sf_dir, m), m, min_balls=0)


@register("F18_F25_player_chart_fields_min_balls")
def q_chart_fields_min_balls(spark, sf_dir):
    m = dm.matches(spark, sf_dir)
    return _chart_fields(_longer_lines(dm.player_stats(spark, sf_dir, m)), m)


@register("F20_pre_match_prompts")
def q_pre_prompts(spark, sf_dir):
    m = dm.matches(spark, sf_dir)
    f = feat.live_features(m, dm.player_stats(spark, sf_dir, m), keep=("venue", "toss_winner"))
    return pr.pre_match_prompts(scoring.with_win_probs(f))


@register("F22_post_match_prompts")
def q_post_prompts(spark, sf_dir):
    m = dm.matches(spark, sf_dir)
    st = dm.player_stats(spark, sf_dir, m)
    f = feat.feature_matrix(m, st).select("match_id", "team1", "team2", "win_rate_diff")
    return pr.post_match_prompts(reports.post_match_rows(f, form.completed(m), st))


def _spot_prompts(stats, m, **how):
    fixtures = feat.unfinished(m)
    return pr.spotlight_prompts(pl.spotlight_of_fixtures(stats, m, fixtures, **how), fixtures, tx.versus_name(F.col("team1"), F.col("team2")))


@register("F23_spotlight_prompt")
def q_spot_prompt(spark, sf_dir):
    """F23 for every unfinished fixture."""
    m = dm.matches(spark, sf_dir)
    return _spot_prompts(dm.player_stats(spark, sf_dir, m), m, min_balls=0)


@register("F23_spotlight_prompt_min_balls")
def q_spot_prompt_min_balls(spark, sf_dir):
    m = dm.matches(spark, sf_dir)
    return _spot_prompts(_longer_lines(dm.player_stats(spark, sf_dir, m)), m)


# ---- request log, upserts and the feed stream ------------------------------------------



def _events(spark, sf_dir):
    return fxs.read_table(spark, sf_dir, "events")


@register("T5_ttl_cache_hits")
def q_ttl(spark, sf_dir):
    return rq.ttl_cache_hits(_events(spark, sf_dir))


@register("A21_cache_stats")
def q_cache_stats(spark, sf_dir):
    return rq.cache_stats(rq.ttl_cache_hits(_events(spark, sf_dir)))


@register("W10_request_quota")
def q_quota(spark, sf_dir):
    return rq.requests_in_window(_events(spark, sf_dir))


@register("K1_upsert_events_by_user")
def q_upsert_events(spark, sf_dir):
    e = _events(spark, sf_dir).select(
        "user_id", F.col("event_type").alias("first_event_type"), F.col("props").alias("first_props"),
        F.col("event_type").alias("last_event_type"), F.col("value").alias("last_value"), "ts", "event_id")
    how = (["user_id"], ["first_event_type", "first_props"], ["last_event_type", "last_value"], ["ts", "event_id"])
    middle = F.lit("2024-01-15").cast("timestamp")
    path = feedmod.scratch_dirs(spark, "users")["table_path"]
    up.replace_table(up.upsert(None, e.where(F.col("ts") < middle), *how), path)
    # the rest of the log, and once more what the table already holds, into the stored table
    return up.upsert(up.read_current(spark, path), e, *how)


@register("K7_latest_event_per_user")
def q_latest_event(spark, sf_dir):
    return up.latest_snapshot(_events(spark, sf_dir), ["user_id"], ["ts", "event_id"])


@register("S4_F14_event_props_json")
def q_props(spark, sf_dir):
    e = _events(spark, sf_dir)
    return e.select("event_id", F.from_json("props", "k int").getField("k").alias("k"))


def _match_feed(spark, sf_dir):
    """Three captured polls of the scoreboard run through the feed: the first two
    arrive together (repeated keys within a batch), the third later."""
    from kestrel.sources import feed_json
    dirs = feedmod.scratch_dirs(spark, "match-feed")
    polls = f"{dirs['table_path']}-payloads"
    m = dm.matches(spark, sf_dir)
    for batch in ((0, 1), (2,)):
        for poll in batch:
            fxs.scoreboard_payloads(m, poll).write.mode("append").json(polls)
        stream = spark.readStream.schema(feed_json.SCOREBOARD_SCHEMA).json(polls)
        feedmod.feed_matches(feed_json.scoreboard_matches(stream), dirs).awaitTermination()
    return dirs


@register("C18_T1_T2_T3_match_feed_stream")
def q_feed(spark, sf_dir):
    """The table after the polls (latest status, winner and fetch time)."""
    dirs = _match_feed(spark, sf_dir)
    return feedmod.read_table(spark, dirs["table_path"]).select(
        F.col("match_id").cast("long").alias("match_id"), "name", "venue", F.to_date("match_date").alias("match_date"),
        "team1", "team2", "source", "status", "winner", F.col("fetched_at").cast("string").alias("fetched_at"))


@register("C18_K4_T3_match_feed_rejects")
def q_feed_rejects(spark, sf_dir):
    """The rejects of the same polls: source, reason and the row itself."""
    dirs = _match_feed(spark, sf_dir)
    r = spark.read.parquet(dirs["rejects_path"])
    row = F.from_json("raw_data", "match_id string, name string, match_date string, status string")
    return r.select("source", "error_message", row.alias("row")).select(
        "source", "error_message", F.col("row.match_id").cast("long").alias("match_id"),
        F.col("row.name").alias("name"), F.col("row.match_date").alias("match_date"), F.col("row.status").alias("status"))


def _scorecard_feed(spark, sf_dir):
    from kestrel.sources import feed_json
    dirs = feedmod.scratch_dirs(spark, "scorecard-feed")
    base = dirs["table_path"]
    paths = {"innings_path": f"{base}/innings", "stats_path": f"{base}/stats", "rejects_path": f"{base}/rejects",
             "checkpoint": dirs["checkpoint"]}
    fs, _ = up._fs(spark, base)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    d = dm.deliveries(spark, sf_dir).persist()      # dealt by match once: three aggregates of either poll take it as it lies
    try:
        for poll in (0, 1):
            fxs.scorecard_payloads(d, poll).write.option("compression", "gzip").json(f"{base}/captured/{poll}")
    finally:
        d.unpersist()
    del d
    spark.sparkContext._jvm.System.gc()     # the files of a shuffle go with the driver's last reference to it
    fs.mkdirs(path(f"{base}/payloads"))
    for poll in (0, 1):                     # the polls arrive one after the other
        if not fs.rename(path(f"{base}/captured/{poll}"), path(f"{base}/payloads/{poll}")):
            raise OSError(f"cannot move {base}/captured/{poll}")
        stream = spark.readStream.schema(feed_json.SCORECARD_SCHEMA).json(f"{base}/payloads/*")
        feedmod.start_scorecard_feed(stream, available_now=True, **paths).awaitTermination()
    return paths


@register("S5_K3_K7_scorecard_feed_stats")
def q_scorecard_stats(spark, sf_dir):
    """Stat lines of two polls, appended and reduced to the latest poll per line (Q8)."""
    lines = spark.read.parquet(_scorecard_feed(spark, sf_dir)["stats_path"])
    last = up.latest_snapshot(lines.drop("batch"), ["match_id", "player_name", "team", "role"], ["_batch"])
    return last.select(F.col("match_id").cast("long").alias("match_id"), "player_name", "team", "role", "runs", "balls_faced",
                       "fours", "sixes", "wickets", F.col("_batch").alias("poll"))


@register("S5_K2_T4_scorecard_feed_innings")
def q_scorecard_innings(spark, sf_dir):
    """Innings lines as appended, one per poll."""
    lines = spark.read.parquet(_scorecard_feed(spark, sf_dir)["innings_path"])
    return lines.select(F.col("match_id").cast("long").alias("match_id"), "inning_name", "runs", "wickets",
                        F.col("overs").cast("double").alias("overs"), F.col("_batch").alias("poll"))


@register("L6_F24_latest_innings_text")
def q_latest_innings(spark, sf_dir):
    """The latest innings line of each match and side, as text."""
    lines = spark.read.parquet(_scorecard_feed(spark, sf_dir)["innings_path"]).drop("batch")
    last = up.latest_snapshot(lines, ["match_id", "inning_name"], ["_batch"])
    s = tx.innings_score("runs", "wickets", "overs")
    return last.select(F.col("match_id").cast("long").alias("match_id"), "inning_name", s["score"].alias("score"),
                       s["overs_text"].alias("overs_text"))


@register("K4_scorecard_feed_rejects")
def q_scorecard_rejects(spark, sf_dir):
    """Stat lines that the validator refused: reason and row."""
    r = spark.read.parquet(_scorecard_feed(spark, sf_dir)["rejects_path"] + "/scorecards")
    row = F.from_json("raw_data", "match_id string, player_name string, runs string")
    return r.select("source", "error_message", row["match_id"].cast("long").alias("match_id"),
                    row["player_name"].alias("player_name"))


# ---- batch history load -------------------------------------------------------------



def _ingested(spark, sf_dir):
    m = dm.matches(spark, sf_dir)
    raw_m, raw_d = ing.testdata_raw(m, dm.deliveries(spark, sf_dir, m))
    return ing.ingest_history(raw_m, raw_d)


@register("C17_ingest_matches")
def q_ingest_matches(spark, sf_dir):
    return _ingested(spark, sf_dir)["matches"]


@register("C17_J2_J3_ingest_player_stats")
def q_ingest_stats(spark, sf_dir):
    return _ingested(spark, sf_dir)["player_stats"].withColumns(
        {c: F.col(c).cast("double") for c in ("strike_rate", "overs_bowled", "economy")})


@register("C17_V3_ingest_tally")
def q_ingest_tally(spark, sf_dir):
    r = _ingested(spark, sf_dir)
    mt = quality.load_tally(r["match_checks"]).select(F.lit("matches").alias("table_name"), "*")
    st = quality.load_tally(r["stat_checks"]).select(F.lit("player_stats").alias("table_name"), "*")
    return mt.unionByName(st)


# ---- model data preparation, evaluation and training -----------------------------------



def _matrix(spark, sf_dir):
    """The feature matrix, checkpointed once into the shared folder: model
    preparation and training read it several times (counts, ranks, folds,
    solver iterations) and must not recompute its plan each time."""
    from kestrel.session import cut_lineage
    m = dm.matches(spark, sf_dir)
    return cut_lineage(feat.feature_matrix(m, dm.player_stats(spark, sf_dir, m)))


def _heuristic_test(spark, sf_dir):
    s = prep.time_split(_matrix(spark, sf_dir))
    return s.filter(~F.col("is_train")).withColumn("score", scoring.heuristic_score())


@register("M2_time_split")
def q_split(spark, sf_dir):
    return prep.time_split(_matrix(spark, sf_dir)).select("match_id", "is_train")


@register("M3_scale_stats")
def q_scale(spark, sf_dir):
    return prep.scale_stats(prep.time_split(_matrix(spark, sf_dir)).filter(F.col("is_train")))


@register("M4_class_weights")
def q_weights(spark, sf_dir):
    return prep.class_weights(prep.time_split(_matrix(spark, sf_dir)).filter(F.col("is_train")))


@register("M8_stratified_folds")
def q_folds(spark, sf_dir):
    tr = prep.time_split(_matrix(spark, sf_dir)).filter(F.col("is_train"))
    return prep.stratified_folds(tr).select("match_id", "team1_won", "fold")


@register("P13_feature_medians")
def q_medians(spark, sf_dir):
    return prep.medians(_matrix(spark, sf_dir))


@register("M11_M16_heuristic_metrics")
def q_metrics(spark, sf_dir):
    return mt.binary_metrics(_heuristic_test(spark, sf_dir), "team1_won", model="heuristic")


@register("M12_class_report")
def q_class_report(spark, sf_dir):
    return mt.class_report(_heuristic_test(spark, sf_dir), "team1_won")


@register("M14_roc_points")
def q_roc(spark, sf_dir):
    return mt.roc_points(_heuristic_test(spark, sf_dir), "team1_won")


@register("M15_calibration")
def q_calibration(spark, sf_dir):
    return mt.calibration(_heuristic_test(spark, sf_dir), "team1_won")


@register("A17_target_balance")
def q_balance(spark, sf_dir):
    return prep.target_balance(_matrix(spark, sf_dir))


@register("A18_null_report")
def q_nulls(spark, sf_dir):
    return prep.null_report(_matrix(spark, sf_dir))


@register("A19_feature_correlations")
def q_corr(spark, sf_dir):
    return prep.correlations(_matrix(spark, sf_dir))


@register("A15_A16_matrix_summary")
def q_summary(spark, sf_dir):
    return prep.matrix_summary(_matrix(spark, sf_dir))


@register("V4_V7_matrix_checks")
def q_matrix_checks(spark, sf_dir):
    return quality.matrix_checks(_matrix(spark, sf_dir))


@register("M5_M6_logistic_coefficients")
def q_logistic(spark, sf_dir):
    train, _, stats, weights = mtrain.prepared(_matrix(spark, sf_dir))
    return mtrain.coefficient_table(mtrain.train_logistic(train, stats, weights))


_FITTED: dict = {}


def _models(spark, sf_dir):
    """Both models of the matrix's training rows, fitted once per application
    (several queries report on the same search)."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _FITTED:
        train, test, stats, weights = mtrain.prepared(_matrix(spark, sf_dir))
        _FITTED[key] = (mtrain.train_logistic(train, stats, weights), stats, mtrain.fit_gbt(train, weights), test)
    return _FITTED[key]


def _both_metrics(spark, sf_dir):
    lr, stats, gbt, test = _models(spark, sf_dir)
    a = mt.binary_metrics(mtrain.score_logistic(lr, test, stats), "team1_won", model="logistic")
    b = mt.binary_metrics(mtrain.score_gbt(gbt.model, test), "team1_won", model="gbt")
    return a.unionByName(b)


@register("M5_logistic_certificate")
def q_certificate(spark, sf_dir):
    """The gradient of the penalised log-loss at the fitted coefficients vanishes."""
    train, _, stats, weights = mtrain.prepared(_matrix(spark, sf_dir))
    fitted = mtrain.train_logistic(train, stats, weights)
    return mtrain.logistic_gradient(fitted, train, stats, weights).select("feature", "optimal")


@register("M11_M13_trained_model_metrics")
def q_model_metrics(spark, sf_dir):
    """Logistic baseline vs boosted trees on the time-ordered test split."""
    both = _both_metrics(spark, sf_dir)
    return both.withColumn("better_model", mt.compare_models(both, "logistic", "gbt")
                           .select("better_model").scalar())


@register("M7_grid_search")
def q_search(spark, sf_dir):
    """All 108 points with their mean AUC over the five folds."""
    return _models(spark, sf_dir)[2].search


@register("M7_M10_gbt_importances")
def q_importances(spark, sf_dir):
    return mtrain.importance_table(_models(spark, sf_dir)[2].model)


@register("M9_loss_per_round")
def q_rounds(spark, sf_dir):
    """Log-loss of the 15 % kept back, after every tree of the final fit."""
    return _models(spark, sf_dir)[2].losses


@register("M18_T7_live_win_probabilities")
def q_live_probs(spark, sf_dir):
    lr, stats, gbt, _ = _models(spark, sf_dir)
    better = mt.compare_models(_both_metrics(spark, sf_dir), "logistic", "gbt").head()["better_model"]
    m = dm.matches(spark, sf_dir)
    live = feat.live_features(m, dm.player_stats(spark, sf_dir, m))
    if better == "gbt":   # M13: the boosted model has to be strictly better
        return mtrain.scored_with_rejects(live, lambda r: mtrain.score_gbt(gbt.model, r), "boosted")
    return mtrain.scored_with_rejects(live, lambda r: mtrain.score_logistic(lr, r, stats), "baseline")


@register("T7_scores_and_rejects")
def q_scores_and_rejects(spark, sf_dir):
    """T7 on rows of which some cannot be scored: a blanked feature, no team name."""
    k = F.col("match_id")
    rows = _damaged_matrix(spark, sf_dir).withColumn("team2", F.when(k % 29 == 0, F.lit(" ")).when(k % 31 == 0, F.col("team1")).otherwise(F.col("team2")))
    return mtrain.scored_with_rejects(rows, lambda r: r.withColumn("score", scoring.heuristic_score()), "form")


# ---- display, entities, report parts -------------------------------------------------------


@register("P10_batting_card_display")
def q_display(spark, sf_dir):
    return reports.display_card(reports.batting_cards(dm.player_stats(spark, sf_dir)), "batting")


@register("U3_distinct_teams")
def q_teams(spark, sf_dir):
    return reports.distinct_teams(dm.matches(spark, sf_dir))


@register("M14_trapezoid_auc")
def q_trapezoid(spark, sf_dir):
    return mt.trapezoid_auc(_heuristic_test(spark, sf_dir), "team1_won")


@register("T6_windowed_quota_stream")
def q_windowed_quota(spark, sf_dir):
    """Requests in every 60 s window, one second apart, by a streaming query over
    the events (drained with availableNow); open windows included."""
    dirs = feedmod.scratch_dirs(spark, "quota")
    feedmod.quota_table(fxs.stream_table(spark, sf_dir, "events"), dirs).awaitTermination()
    return feedmod.read_quota(spark, dirs["table_path"]).select("window_end", "user_id", "in_window", "remaining")


@register("T6_exact_quota_stream")
def q_exact_quota(spark, sf_dir):
    """The trailing count of every request, by a streaming query over the events:
    row by row that of W10."""
    dirs = feedmod.scratch_dirs(spark, "exact-quota")
    feedmod.exact_quota_table(fxs.stream_table(spark, sf_dir, "events"), dirs).awaitTermination()
    return feedmod.read_table(spark, dirs["table_path"]).select("event_id", "user_id", "in_window", "remaining")


@register("C19_warehouse_report")
def q_warehouse(spark, sf_dir):
    return reports.warehouse_report(_warehouse(spark, sf_dir))


@register("V1_K4_match_validation_of_damaged_rows")
def q_damaged_matches(spark, sf_dir):
    """V1 on matches with fields blanked by key: no name, no date or a short one, one team twice."""
    m = dm.matches(spark, sf_dir)
    k = F.col("match_id")
    raw = m.select(
        k, F.when(k % 11 == 0, "").otherwise(F.col("name")).alias("name"),
        F.when(k % 7 == 0, F.lit(None)).when(k % 5 == 0, "2024").otherwise(F.col("match_date").cast("string")).alias("match_date"),
        F.when(k % 13 == 0, F.lit(None)).otherwise(F.col("team1")).alias("team1"),
        F.when(k % 13 == 0, F.lit(None)).when(k % 3 == 0, F.col("team1")).otherwise(F.col("team2")).alias("team2"))
    return quality.validate_matches(raw).select("match_id", "is_valid", "error_message")


@register("V2_K4_stat_validation_of_damaged_rows")
def q_damaged_stats(spark, sf_dir):
    """V2 on stat lines damaged by key: NaN, text and numbers out of range never end the job."""
    d = scorecards.player_stats(dm.deliveries(spark, sf_dir))
    k = F.col("match_id")
    raw = d.select(
        "match_id", "player_name", "team", "role",
        F.when(k % 7 == 0, F.lit(float("nan"))).when(k % 11 == 0, 5e9).otherwise(F.col("runs").cast("double")).alias("runs"),
        F.when(k % 13 == 0, "x").otherwise(F.col("balls_faced").cast("string")).alias("balls_faced"),
        F.when(k % 17 == 0, -F.lit(1)).otherwise(F.col("fours")).alias("fours"), "sixes", "strike_rate", "wickets", "overs_bowled",
        F.when(k % 19 == 0, F.lit(5000.0)).otherwise(F.col("economy")).alias("economy"))
    checked = quality.validate_player_stats(raw)
    return checked.select("match_id", "player_name", "team", "role", "is_valid", "error_message",
                          scorecards.overflow_reason().alias("out_of_range"))


@register("F8_mixed_date_texts")
def q_mixed_dates(spark, sf_dir):
    """F8 on the match dates written in eight ways, by key."""
    m = dm.matches(spark, sf_dir)
    d, k = F.col("match_date"), F.col("match_id") % 8
    ways = ["yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy", "M-d-yyyy", "yyyy-MM-dd'T'14:00'Z'", "yyyy-MM-dd 20:00:00", "d MMM yyyy"]
    text = F.lit("no date")
    for n, way in enumerate(ways):
        text = F.when(k == n, F.date_format(d, way)).otherwise(text)
    return m.select("match_id", text.alias("date_text"), tx.lenient_date(text).alias("parsed"))


@register("L5_M6_coefficient_head_tail")
def q_head_tail(spark, sf_dir):
    train, _, stats, weights = mtrain.prepared(_matrix(spark, sf_dir))
    return reports.head_tail(mtrain.coefficient_table(mtrain.train_logistic(train, stats, weights)), "coefficient")


@register("L5_correlation_head_tail")
def q_corr_head_tail(spark, sf_dir):
    """L5 on a summary that SQL can restate: the features' correlations with the target."""
    return reports.head_tail(prep.correlations(_matrix(spark, sf_dir)).drop("abs_rank"), "corr")


# ---- sources and sinks written and read back; applied preparation ---------------------------


def _damaged_matrix(spark, sf_dir):
    """The feature matrix with values blanked by key, so that reports and fills have work."""
    k = F.col("match_id")
    return _matrix(spark, sf_dir).withColumn("team1_win_rate", F.when(k % 17 == 0, F.lit(None)).otherwise(F.col("team1_win_rate"))) \
        .withColumn("bowl_eco_diff", F.when(k % 5 == 0, F.lit(None)).otherwise(F.col("bowl_eco_diff")))


@register("A18_null_report_of_damaged_matrix")
def q_damaged_nulls(spark, sf_dir):
    return prep.null_report(_damaged_matrix(spark, sf_dir), ["team1_win_rate", "team2_win_rate", "bowl_eco_diff"])


@register("P13_median_fill_applied")
def q_filled(spark, sf_dir):
    return prep.median_fill(_damaged_matrix(spark, sf_dir)).select("match_id", "team1_win_rate", "bowl_eco_diff")


@register("M1_M3_scaled_vector")
def q_scaled(spark, sf_dir):
    """The standardised features as one vector (M1), read back by position."""
    from pyspark.ml.functions import vector_to_array
    split = prep.time_split(_matrix(spark, sf_dir))
    stats = prep.scale_stats(split.filter(F.col("is_train")))
    v = vector_to_array(F.col("features"))
    r = prep.assemble(prep.standardise(split, stats))
    return r.select("match_id", F.size(v).alias("n"), *[F.round(v[k], 6).alias(f"z{k}") for k in (0, 7, 19)])


@register("M13_better_of_two_scores")
def q_better(spark, sf_dir):
    """M13 on two deterministic scores: the form difference, and the same reversed."""
    t = _heuristic_test(spark, sf_dir)
    both = mt.binary_metrics(t, "team1_won", model="form").unionByName(
        mt.binary_metrics(t.withColumn("score", F.lit(1.0) - F.col("score")), "team1_won", model="reversed"))
    return mt.compare_models(both, "form", "reversed")


@register("S1_S3_csv_history_typed")
def q_csv(spark, sf_dir):
    """The ball log as CSV with capitalised headers and, in every 97th match, a
    run count that is no number: written, read back, typed."""
    from kestrel.sources import csv
    return csv.read_deliveries_csv(spark, _csv_history(spark, sf_dir)).select(
        "match_id", "ball", "batting_team", "batter", "bowler", "batsman_runs", "total_runs")


def _csv_history(spark, sf_dir):
    folder = feedmod.scratch_dirs(spark, "csv")["table_path"]
    d = dm.deliveries(spark, sf_dir).drop("match_date")
    bad = (F.col("match_id") % 97 == 0) & (F.col("ball") == 1)
    d = d.withColumn("batsman_runs", F.when(bad, "x").otherwise(F.col("batsman_runs").cast("string")))
    d.toDF(*[c.replace("_", " ").title() for c in d.columns]).write.option("header", True).csv(folder)
    return folder


@register("S2_K4_csv_history_rejects")
def q_csv_rejects(spark, sf_dir):
    from kestrel.sources import csv
    r = csv.delivery_rejects(spark, _csv_history(spark, sf_dir))
    return r.select("source", "error_message", F.get_json_object("raw_data", "$.match_id").cast("long").alias("match_id"))


@register("S7_S8_K5_K6_replaced_table")
def q_replaced(spark, sf_dir):
    """A table loaded once (a second load finds it filled), then replaced, and read back."""
    path = feedmod.scratch_dirs(spark, "replaced")["table_path"]
    m = dm.matches(spark, sf_dir).select("match_id", "name", "status")
    first = up.load_once(path, spark, lambda: m)
    again = up.load_once(path, spark, lambda: m)
    up.replace_table(up.read_current(spark, path).withColumn("status", F.upper("status")), path)
    return up.read_current(spark, path).withColumn("first_load", F.lit(first)).withColumn("second_load", F.lit(again))


@register("P9_card_of_one_match")
def q_one_card(spark, sf_dir):
    """The batting and bowling card of one match, found by key."""
    st = dm.player_stats(spark, sf_dir)
    last = dm.matches(spark, sf_dir).where("winner <> ''").agg(F.max("match_id")).head()[0]
    bat = reports.match_batting_card(st, last).select(F.lit("batting").alias("role"), "player_name", "team", F.col("runs").alias("points"))
    bowl = reports.match_bowling_card(st, last).select(F.lit("bowling").alias("role"), "player_name", "team",
                                                       F.col("wickets").alias("points"))
    return bat.unionByName(bowl)


@register("F21_live_prompts")
def q_live_prompts(spark, sf_dir):
    """F21 for the innings in progress: every innings of an unfinished match."""
    m = dm.matches(spark, sf_dir)
    inn = scorecards.innings_lines(dm.deliveries(spark, sf_dir, m))
    rows = feat.unfinished(m).select("match_id", "team1", "team2").join(inn, "match_id")
    odd = F.col("match_id") % 2 == 1
    rows = rows.withColumn("batting_team", F.regexp_replace("inning_name", " innings$", "")) \
        .withColumn("team1_win_prob", F.lit(55.5)).withColumn("team2_win_prob", F.lit(44.5)) \
        .withColumn("required_rate", F.when(odd, F.lit(8.125))).withColumn("current_rate", F.when(odd, F.lit(7.5)))
    return pr.live_prompts(rows)


@register("C20_matrix_quality_report")
def q_quality_report(spark, sf_dir):
    """C20 as one long frame: nulls, target shares and rule violations of the matrix."""
    m = _damaged_matrix(spark, sf_dir)
    nulls = prep.null_report(m, ["team1_win_rate", "team2_win_rate", "bowl_eco_diff"]).select(
        F.lit("nulls").alias("section"), F.col("column").alias("item"), F.col("null_count").cast("double").alias("value"))
    checks = quality.matrix_checks(m).select(F.lit("violations").alias("section"), F.col("rule").alias("item"),
                                             F.col("violations").cast("double").alias("value"))
    size = m.agg(F.count("*").cast("double").alias("value")).select(F.lit("size").alias("section"), F.lit("rows").alias("item"), "value")
    won = m.groupBy("team1_won").agg(F.count("*").cast("double").alias("value")).select(
        F.lit("target").alias("section"), F.col("team1_won").cast("string").alias("item"), "value")
    return size.unionByName(won).unionByName(nulls).unionByName(checks)
