from hypothesis import given, settings
from hypothesis import strategies as st

from helpers import bat, bowl, matches_df, rows_by, stats_df
from kestrel.operators import players, strength


def _one_player_matches(spark, n):
    return matches_df(spark, [(i + 1, i, "A", "B", "A") for i in range(n)])


def test_trend_start(spark):
    # strike rates 10..70 -> trend 0,0,0,20,20,25,30 (the 4th row's older mean is 0)
    m = _one_player_matches(spark, 7)
    s = stats_df(spark, [bat(i + 1, "P", "A", 1, 10, 10.0 * (i + 1)) for i in range(7)])
    r = players.batting_feature_rows(s, m).orderBy("match_date").collect()
    assert [x["sr_trend"] for x in r] == [0.0, 0.0, 0.0, 20.0, 20.0, 25.0, 30.0]
    assert [x["innings_played"] for x in r] == list(range(1, 8))
    assert r[-1]["rolling_avg_sr"] == 50.0
    latest = rows_by(players.batting_features(s, m), "player_name")["P"]
    assert latest["sr_trend"] == 30.0 and latest["innings_played"] == 7


def test_boundary_rate_and_rounding(spark):
    m = _one_player_matches(spark, 1)
    s = stats_df(spark, [bat(1, "P", "A", 10, 16, 62.5, fours=1, sixes=0)])
    r = players.batting_feature_rows(s, m).collect()[0]
    assert r["boundary_rate"] == 0.062          # 1/16 rounds half to even


def test_outer_merge_and_team_strength(spark):
    # team A: pure batter X (avg 30), all-rounder Y (bat 10, eco 6.0); bowler Z labelled A (eco 8.0)
    m = matches_df(spark, [(1, 0, "A", "B", "A"), (2, 5, "A", "B", "B")])
    s = stats_df(spark, [bat(1, "X", "A", 30, 20, 150.0), bat(1, "Y", "A", 10, 10, 100.0),
                         bowl(1, "Y", "A", 1, 4.0, 6.0), bowl(1, "Z", "A", 0, 4.0, 8.0)])
    comb = rows_by(players.player_features_asof(s, m, "2024-01-03"), "player_name", "team")
    assert comb[("Z", "A")]["rolling_avg_runs"] == 0.0
    assert comb[("Y", "A")]["rolling_avg_economy"] == 6.0
    sides = m.selectExpr("explode(array(team1, team2)) as team", "match_date")
    got = rows_by(strength.team_strength_asof(s, m, sides), "team", "match_date")
    a = [v for k, v in got.items() if k[0] == "A"]
    before = [v for v in a if v["match_date"].day == 1][0]
    after = [v for v in a if v["match_date"].day == 6][0]
    assert (before["bat_avg"], before["bowl_eco"]) == (0.0, 0.0)
    # rows of A: X(30,0) Y(10,6.0) Z(0,8.0) -> bat (30+10+0)/3, eco (6+8)/2
    assert (after["bat_avg"], after["bowl_eco"]) == (13.33, 7.0)


def brute_strength(lines, dates):
    """Reference rule per date: latest bat / bowl line before D per player,
    rolling averages over that player's lines before D, outer merge on
    (player, team), team means in hundredths."""
    out = {}
    for d in dates:
        rows = {}
        for role, val in (("batting", "runs"), ("bowling", "eco")):
            per = {}
            for ln in sorted(x for x in lines if x[3] == role and x[0] < d):
                per.setdefault(ln[2], []).append(ln)
            for p, seq in per.items():
                last5 = seq[-5:]
                if role == "batting":
                    v = round(sum(x[4] for x in last5) * 100 / len(last5))
                else:
                    v = round(sum(x[5] for x in last5) / len(last5))
                rows.setdefault((p, seq[-1][6]), {})[role] = v
        teams = {}
        for (p, t), v in rows.items():
            teams.setdefault(t, []).append((v.get("batting", 0), v.get("bowling", 0)))
        for t, vals in teams.items():
            b = round(sum(x[0] for x in vals) / len(vals)) / 100
            e = [x[1] for x in vals if x[1] > 0]
            out[(t, d)] = (b, round(sum(e) / len(e)) / 100 if e else 0.0)
    return out


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 8), st.integers(0, 3), st.integers(0, 1), st.integers(0, 2),
                          st.integers(0, 12), st.integers(1, 60)), min_size=1, max_size=25))
def test_strength_matches_brute_force(spark, spec):
    ms, ls, lines = [], [], []
    for i, (d, p, role, t, runs, eco) in enumerate(spec):
        mid = i + 1
        ms.append((mid, d, "T0", "T1", "T0"))
        team = f"T{t}"
        if role == 0:
            ls.append(bat(mid, f"P{p}", team, runs, 4, 25.0 * runs))
        else:
            ls.append(bowl(mid, f"P{p}", team, 1, 2.0, eco / 4))
        # (day, match, player, role, runs, eco in hundredths, team)
        lines.append((d, mid, f"P{p}", "batting" if role == 0 else "bowling", runs, eco * 25, team))
    m, s = matches_df(spark, ms), stats_df(spark, ls)
    sides = m.selectExpr("explode(array('T0', 'T1', 'T2')) as team", "match_date")
    got = {(r["team"], r["match_date"]): (r["bat_avg"], r["bowl_eco"])
           for r in strength.team_strength_asof(s, m, sides).collect()}
    from helpers import day
    dates = sorted({d for d, *_ in spec})
    want = brute_strength([(day(x[0]), *x[1:]) for x in lines], [day(d) for d in dates])
    for (t, d), v in got.items():
        assert v == want.get((t, d), (0.0, 0.0)), (t, d)


def brute_batting(lines):
    """Reference rules per player in (date, match, team) order: rolling mean
    of the last 5 runs / strike rates (2 dp) and the 3-vs-3 trend with its
    max(1, min(3, i-3)) divisor; values in hundredths to mirror exact sums."""
    out = {}
    per = {}
    for ln in sorted(lines):
        per.setdefault(ln[2], []).append(ln)
    for p, seq in per.items():
        for i, (d, mid, _, team, runs, sr_c) in enumerate(seq):
            w = seq[max(0, i - 4):i + 1]
            avg_runs = round(sum(x[4] for x in w) * 100 / len(w)) / 100
            avg_sr = round(sum(x[5] for x in w) / len(w)) / 100
            if i < 3:
                trend = 0.0
            else:
                recent = sum(x[5] for x in seq[i - 3:i])
                older_rows = seq[max(0, i - 6):i - 3]
                dd = max(1, min(3, i - 3))
                trend = round((recent * dd - 3 * sum(x[5] for x in older_rows)) / (3 * dd)) / 100
            out[(p, mid, team)] = (avg_runs, avg_sr, trend, i + 1)
    return out


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 2), st.integers(0, 1), st.integers(0, 30),
                          st.integers(1, 400)), min_size=1, max_size=40))
def test_batting_rows_match_brute_force(spark, spec):
    ms, ls, lines = [], [], []
    for i, (d, p, t, runs, sr4) in enumerate(spec):
        mid = i + 1
        ms.append((mid, d, "T0", "T1", "T0"))
        sr = sr4 / 4                       # two-decimal strike rate
        ls.append(bat(mid, f"P{p}", f"T{t}", runs, 6, sr))
        lines.append((d, mid, f"P{p}", f"T{t}", runs, sr4 * 25))
    m, s = matches_df(spark, ms), stats_df(spark, ls)
    got = {(r["player_name"], r["match_id"], r["team"]):
           (r["rolling_avg_runs"], r["rolling_avg_sr"], r["sr_trend"], r["innings_played"])
           for r in players.batting_feature_rows(s, m).collect()}
    assert got == brute_batting(lines)


def test_spotlight_trend_w7(spark):
    # strike rates oldest -> newest 4, 7, 8, 9 (latest-first 9, 8, 7, 4) -> trend 4.0; without the 4 -> 0.0
    for srs, want in (([4.0, 7.0, 8.0, 9.0], 4.0), ([7.0, 8.0, 9.0], 0.0)):
        n = len(srs)
        m = matches_df(spark, [(i + 1, i, "A", "B", "A") for i in range(n)])
        s = stats_df(spark, [bat(i + 1, "P", "A", 10, 10, sr) for i, sr in enumerate(srs)])
        recs = players.spotlight(s, m, "A", "B", "2024-02-01", min_balls=0).collect()
        assert len(recs) == 1 and recs[0]["sr_trend"] == want and recs[0]["ord"] == 1
        assert recs[0]["rolling_avg_sr"] == round(sum(srs) / n, 1)
