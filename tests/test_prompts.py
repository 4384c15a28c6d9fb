from pyspark.sql import functions as F

from kestrel.functions import prompts, text


def reference_pre_match(r):
    def streak(s):
        return f"{abs(s)} win streak" if s > 0 else f"{abs(s)} loss streak" if s < 0 else "no current streak"
    pc = lambda x: f"{r[x] * 100:.0f}"
    return "\n".join([
        "Preview a cricket match in three sentences. Everything you may say is in this sheet.", "",
        f"fixture: {r['team1']} v {r['team2']}", f"ground: {r['venue']}",
        f"chance of winning, percent: {r['team1']} {r['team1_win_prob']}, {r['team2']} {r['team2_win_prob']}",
        f"games won of the last five, percent: {r['team1']} {pc('team1_win_rate')} ({streak(r['team1_streak'])}), "
        f"{r['team2']} {pc('team2_win_rate')} ({streak(r['team2_streak'])})",
        f"meetings won by {r['team1']}, percent: {pc('team1_h2h_win_rate')} of {r['h2h_total']}",
        f"games won on this ground, percent: {r['team1']} {pc('team1_venue_win_rate')}, "
        f"{r['team2']} {pc('team2_venue_win_rate')}", f"toss went to: {r['toss_winner']}", "",
        "Cover how both sides come into the game, then their meetings and the ground, then who is likely to win "
        "and by the chance given. Sober wording, no greeting."])


def test_pre_match_prompt_matches_python_formatting(spark):
    rows = [dict(match_id=1, team1="A", team2="B", venue="G", team1_win_prob=62.3, team2_win_prob=37.7,
                 team1_win_rate=0.625, team2_win_rate=0.4, team1_streak=3, team2_streak=-2,
                 team1_h2h_win_rate=0.667, h2h_total=6, team1_venue_win_rate=0.5, team2_venue_win_rate=0.125,
                 toss_winner="A"),
            dict(match_id=2, team1="C", team2="D", venue="H", team1_win_prob=50.0, team2_win_prob=50.0,
                 team1_win_rate=0.5, team2_win_rate=0.5, team1_streak=0, team2_streak=1,
                 team1_h2h_win_rate=0.5, h2h_total=0, team1_venue_win_rate=0.5, team2_venue_win_rate=0.5,
                 toss_winner="")]
    df = spark.createDataFrame(rows)
    got = {r["match_id"]: r["prompt"] for r in prompts.pre_match_prompts(df).collect()}
    for r in rows:
        assert got[r["match_id"]] == reference_pre_match(r)


def test_live_prompt_rate_line(spark):
    df = spark.createDataFrame([(1, "A", "B", "A innings", 120, 3, 14.2, 55.5, 44.5, 9.5, 8.4),
                                (2, "A", "B", "A innings", 12, 0, 2.0, 55.5, 44.5, None, 6.0)],
                               "match_id int, team1 string, team2 string, batting_team string, runs int, "
                               "wickets int, overs double, team1_win_prob double, team2_win_prob double, "
                               "required_rate double, current_rate double")
    got = {r["match_id"]: r["prompt"] for r in prompts.live_prompts(df).collect()}
    assert "runs an over: 9.50 needed, 8.40 so far" in got[1]
    assert "runs an over" not in got[2]
    assert "batting: A innings, 120 for 3 after 14.2 overs" in got[1]


def test_spotlight_prompt_lines(spark):
    recs = spark.createDataFrame(
        [("P1", "A", 30.5, 140.0, 2.5, 0.0, 0.0, 0.0, 1, "batting"),
         ("P2", "B", 0.0, 0.0, 0.0, 1.5, 7.2, -0.4, 4, "bowling")],
        "name string, team string, rolling_avg_runs double, rolling_avg_sr double, sr_trend double, "
        "rolling_avg_wickets double, rolling_avg_economy double, economy_trend double, ord int, role string")
    p = prompts.spotlight_prompt(recs, "A vs B").collect()[0]["prompt"]
    assert p.endswith("P1, A: 30.5 runs a game at strike rate 140.0 (change +2.5)\n"
                      "P2, B: 1.5 wickets a game at economy 7.2 (change -0.4)")


def test_a_template_may_be_given(spark):
    row = spark.createDataFrame([(1, "A", "B", "C", 1, 2, 3.0, 4.0, 5.0, 0.0, 1.0)],
                                "match_id int, team1 string, team2 string, batting_team string, runs int, wickets int, "
                                "overs double, team1_win_prob double, team2_win_prob double, required_rate double, "
                                "current_rate double")
    assert prompts.live_prompts(row, "{runs}-{wickets} {team1}").head().prompt == "1-2 A"


def test_labels(spark):
    df = spark.createDataFrame([("In Progress", None, None), (None, "A", "B"), ("Result", "", "A")],
                               "status string, winner string, toss string")
    r = df.select(text.status_bucket("status").alias("b"), text.insight_kind("status", "winner").alias("k"),
                  text.result_line("winner", "toss", "status").alias("l")).collect()
    assert [(x["b"], x["k"], x["l"]) for x in r] == [
        ("live", "live", None), ("scheduled", "post", "A won"), ("finished", "pre", "Toss: A won the toss")]
    s = spark.range(1).select(text.streak_phrase(F.lit(-2)).alias("s"), text.gauge_band(F.lit(40.0)).alias("g"))
    assert s.collect()[0].asDict() == {"s": "2 loss streak", "g": "even"}
