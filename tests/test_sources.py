import json

from kestrel.operators import scorecards
from kestrel.plans import ingest
from kestrel.sources import csv as csvsrc
from kestrel.sources import feed_json


def _write(path, text):
    with open(path, "w") as f:
        f.write(text)
    return path


def test_scoreboard_edge_cases(spark, scratch):
    payload = {"events": [
        {"id": "1", "name": "A v B", "date": "2024-04-01T14:00Z", "status": {"type": {"description": "Result"}},
         "competitions": [{"venue": {"fullName": "Ground"}, "competitors": [
             {"winner": False, "team": {"displayName": "A"}}, {"winner": True, "team": {"displayName": "B"}}]}]},
        {"id": "2", "name": "one side", "date": "2024-04-02", "competitions": [
            {"competitors": [{"team": {"displayName": "C"}}]}]},
        {"id": "3", "name": "no competitions", "date": "2024-04-03", "competitions": []},
    ]}
    p = _write(f"{scratch}/sb.json", json.dumps(payload))
    rows = {r["match_id"]: r for r in feed_json.scoreboard_matches(
        feed_json.read_json(spark, p, feed_json.SCOREBOARD_SCHEMA)).collect()}
    assert (rows["1"]["winner"], rows["1"]["venue"], rows["1"]["match_date"], rows["1"]["status"]) == \
        ("B", "Ground", "2024-04-01", "Result")
    assert (rows["2"]["team1"], rows["2"]["team2"], rows["2"]["winner"], rows["2"]["status"]) == ("C", "", "", "")
    assert (rows["3"]["team1"], rows["3"]["venue"]) == ("", "")


def test_scorecard_rows(spark, scratch):
    card = {"match_id": "9", "gamepackageJSON": {
        "scoring": [{"displayName": "A innings", "runs": "150", "wickets": "4", "overs": "20.0"}],
        "batting": [{"athlete": {"displayName": "P1"}, "team": {"displayName": "A"}, "runs": "40",
                     "ballsFaced": "20", "fours": "4", "sixes": "1", "strikeRate": "200.0"}],
        "bowling": [{"athlete": {"displayName": "P2"}, "team": {"displayName": "B"}, "wickets": "2",
                     "overs": "4", "economy": "7.5"}]}}
    p = _write(f"{scratch}/sc.json", json.dumps(card))
    cards = feed_json.read_json(spark, p, feed_json.SCORECARD_SCHEMA)
    inn = feed_json.scorecard_innings(cards).collect()[0]
    assert (inn["inning_name"], inn["runs"], inn["wickets"], float(inn["overs"])) == ("A innings", 150, 4, 20.0)
    st = {r["player_name"]: r for r in feed_json.scorecard_stats(cards).collect()}
    assert st["P1"]["runs"] == "40" and st["P2"]["economy"] == "7.5"


def test_scorecard_lines_come_from_one_pass(spark, scratch):
    """Missing lists, empty entries and missing numbers; one scan of the payloads for both roles."""
    person = {"athlete": {"displayName": "P1"}, "team": {"displayName": "A"}}
    docs = [{"match_id": "1", "gamepackageJSON": {"scoring": [None, {"displayName": "A innings", "runs": "x"}], "batting": [None, person]}},
            {"match_id": "2", "gamepackageJSON": {"bowling": [{**person, "economy": None}, {"overs": "2"}], "batting": []}},
            {"match_id": "3"}, {"gamepackageJSON": {"batting": [person]}}]
    cards = spark.read.schema(feed_json.SCORECARD_SCHEMA).json(_write(f"{scratch}/sc.json", "\n".join(json.dumps(d) for d in docs)))
    stats = feed_json.scorecard_stats(cards)
    assert stats._jdf.queryExecution().executedPlan().toString().count("FileScan json") == 1
    got = sorted((str(r.match_id), r.role, r.player_name, r.team, r.runs, r.overs_bowled, r.economy) for r in stats.collect())
    assert got == [("1", "batting", "P1", "A", "0", "0.0", "0.0"), ("2", "bowling", "", "", "0", "2", "0.0"),
                   ("2", "bowling", "P1", "A", "0", "0", "0.0"), ("None", "batting", "P1", "A", "0", "0.0", "0.0")]
    assert [(r.match_id, r.seq, r.inning_name, r.runs, r.wickets, float(r.overs)) for r in feed_json.scorecard_innings(cards).collect()] == [
        ("1", 1, "A innings", 0, 0, 0.0)]


def test_csv_variants_and_ingest(spark, scratch):
    mp = _write(f"{scratch}/matches.csv",
                "ID,Date,Team1,Team2,Venue,Toss Winner,Winner\n"
                "1,2024-04-01,A,B,G,A,A\n2,bad-date,A,B,G,B,B\n3,2024-04-03,C,C,G,C,C\n")
    dp = _write(f"{scratch}/balls.csv",
                "match_id,batting_team,batsman,bowler,ball,batsman_runs,total_runs\n"
                "1,A,P1,Q1,1,4,4\n1,A,P1,Q1,2,6,7\n1,A,P2,Q1,3,0,0\n99,A,P9,Q9,1,1,1\n")
    raw_m = csvsrc.read_matches_csv(spark, mp)
    raw_d = csvsrc.read_deliveries_csv(spark, dp)
    assert scorecards.detect_batter_col(raw_d.columns) == "batsman"
    assert scorecards.detect_dismissal_col(raw_d.columns) is None
    out = ingest.ingest_history(raw_m, raw_d)
    ms = out["matches"].collect()
    assert len(ms) == 1 and ms[0]["name"] == "A vs B" and len(ms[0]["match_id"]) == 12
    rej = sorted(r["error_message"] for r in out["rejects"].collect())
    assert rej == ["Invalid date: nan", "team1 and team2 are identical"]
    st = {(r["player_name"], r["role"]): r for r in out["player_stats"].collect()}
    assert st[("P1", "batting")]["runs"] == 10 and float(st[("P1", "batting")]["strike_rate"]) == 500.0
    assert st[("Q1", "bowling")]["wickets"] == 0 and float(st[("Q1", "bowling")]["overs_bowled"]) == 0.5
    assert float(st[("Q1", "bowling")]["economy"]) == 22.0      # 11 runs / 0.5 overs
    assert all(k[0] != "P9" for k in st)                         # unknown raw id dropped (J2)


def test_bowling_card_fielding_side(spark):
    d = spark.createDataFrame([(1, 1, "A", "P1", "Q1", 1, 1, None)],
                              "match_id long, ball int, batting_team string, batter string, bowler string, "
                              "batsman_runs int, total_runs int, player_dismissed string")
    m = spark.createDataFrame([(1, "A", "B")], "match_id long, team1 string, team2 string")
    assert scorecards.bowling_card(d).collect()[0]["team"] == "A"
    assert scorecards.bowling_card(d, "fielding", m).collect()[0]["team"] == "B"
