from helpers import matches_df
from kestrel.operators import quality


def test_reject_match_reasons(spark):
    raw = spark.createDataFrame(
        [(None, "A vs A", "A", "A", "2024-01-01"), ("m2", "x", "A", "B", "2024-1-1"),
         ("m3", "y", "A", "B", None), ("m4", "z", "A", "B", "2024-01-05")],
        "match_id string, name string, team1 string, team2 string, match_date string")
    r = {x["name"]: x for x in quality.validate_matches(raw).collect()}
    assert r["A vs A"]["error_message"] == "Missing field: match_id; team1 and team2 are identical"
    assert r["x"]["error_message"] == "Invalid date: 2024-1-1"
    assert r["y"]["error_message"] == "Missing field: match_date; Invalid date: None"
    assert r["z"]["is_valid"] and r["z"]["error_message"] is None


def test_reject_stat_reasons(spark):
    raw = spark.createDataFrame(
        [("A", "abc", "1", "0", "0", "0", "1.0", "0", "0"), ("B", "10", "2", "0", "0", "0", "501", "0", "0"),
         ("C", "201", "100", "0", "0", "0", "201", "0", "0"), ("D", "5", "4", "-1", "0", "0", "125", "0", "0"),
         ("E", "0", "0", "0", "0", "1", "0", "2", "NaN"), (None, None, None, None, None, None, None, None, None)],
        "player_name string, runs string, balls_faced string, fours string, sixes string, wickets string, "
        "strike_rate string, overs_bowled string, economy string")
    r = {x["player_name"]: x for x in quality.validate_player_stats(raw).collect()}
    assert r["A"]["error_message"] == "Cannot coerce runs: abc"
    assert r["B"]["error_message"] == "Implausible strike_rate: 501.0"
    assert r["C"]["error_message"] == "Implausible runs in T20: 201"
    assert r["D"]["error_message"] == "fours is negative"
    assert r["E"]["is_valid"]                          # NaN economy passes (as in the reference)
    assert r[None]["error_message"] == "Missing player_name" and r[None]["runs"] == 0


def test_split_and_tally(spark):
    m = matches_df(spark, [(1, 0, "A", "B", "A"), (2, 0, "A", "A", "A")])
    checked = quality.validate_matches(m)
    valid, rejects = quality.split_valid(checked, "test")
    assert valid.count() == 1 and rejects.collect()[0]["error_message"] == "team1 and team2 are identical"
    t = quality.load_tally(checked).collect()[0]
    assert (t["success"], t["failed"]) == (1, 1)
