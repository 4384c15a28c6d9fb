from helpers import matches_df, rows_by
from kestrel.operators import matchups, reports


def test_first_meeting_and_h2h_asof(spark):
    m = matches_df(spark, [(1, 0, "A", "B", "A"), (2, 1, "B", "A", "A"), (3, 2, "A", "B", "B"),
                           (4, 2, "A", "C", "A")])
    r = rows_by(matchups.h2h_asof(m, m), "match_id")
    assert (r[1]["h2h_total"], r[1]["team1_h2h_win_rate"], r[1]["team2_h2h_win_rate"]) == (0, 0.5, 0.5)
    assert (r[2]["h2h_total"], r[2]["team1_h2h_win_rate"]) == (1, 0.0)      # B's view of A's first win
    assert (r[3]["h2h_total"], r[3]["team1_h2h_win_rate"], r[3]["team2_h2h_win_rate"]) == (2, 1.0, 0.0)


def test_h2h_rate_half_even(spark):
    rows = [(i + 1, i, "A", "B", "A" if i == 0 else "B") for i in range(16)]
    h = matchups.h2h_stats(matches_df(spark, rows)).collect()[0]
    assert (h["team_a_win_rate"], h["team_b_win_rate"]) == (0.062, 0.938)


def test_toss_impact_and_venue(spark):
    m = matches_df(spark, [(1, 0, "A", "B", "A", "V1", "A"), (2, 1, "A", "B", "B", "V1", "A"),
                           (3, 2, "A", "B", "A", "V2", "B"), (4, 3, "A", "B", "A", "V2", None)])
    t = rows_by(matchups.toss_impact(m), "team")
    assert (t["A"]["toss_win_rate"], t["A"]["toss_loss_rate"], t["A"]["toss_advantage"]) == (0.5, 1.0, -0.5)
    v = rows_by(matchups.venue_stats(m), "team", "venue")
    assert v[("A", "V2")]["venue_win_rate"] == 1.0 and v[("B", "V1")]["venue_win_rate"] == 0.5


def test_h2h_summary_defaults(spark):
    m = matches_df(spark, [(1, 0, "A", "B", None), (2, 1, "C", "D", "C")])
    r = rows_by(reports.h2h_summary(m), "team1", "team2")
    assert (r[("A", "B")]["total"], r[("A", "B")]["team1_wr"]) == (0, 50.0)
    assert r[("C", "D")]["team1_wr"] == 100.0
