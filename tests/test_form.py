from hypothesis import given, settings
from hypothesis import strategies as st

from helpers import matches_df, rows_by
from kestrel.operators import form


def _team_a_history(spark, results, days):
    rows = []
    for i, (won, d) in enumerate(zip(results, days)):
        rows.append((i + 1, d, "A", f"B{i % 3}", "A" if won else f"B{i % 3}"))
    return matches_df(spark, rows)


def test_streak_flip(spark):
    # 1,1,0,0,0,1 -> 1,2,-1,-2,-3,1 ; two of the matches share a day
    m = _team_a_history(spark, [1, 1, 0, 0, 0, 1], [0, 1, 1, 2, 3, 4])
    r = form.team_form_rows(m).filter("team = 'A'").orderBy("match_date", "match_id").collect()
    assert [x["streak"] for x in r] == [1, 2, -1, -2, -3, 1]
    assert [x["matches_played"] for x in r] == [1, 2, 3, 4, 5, 6]
    assert [x["rolling_win_rate"] for x in r] == [1.0, 1.0, 0.667, 0.5, 0.4, 0.4]


def test_snapshot_and_same_day_asof(spark):
    m = _team_a_history(spark, [1, 0, 1], [0, 5, 5])
    snap = rows_by(form.team_form(m), "team")["A"]
    assert (snap["streak"], snap["matches_played"], snap["rolling_win_rate"]) == (1, 3, 0.667)
    # the two matches on day 5 see only day 0: one win, streak 1
    asof = form.team_form_asof(m, form.completed(m)).filter("team = 'A'").orderBy("match_id").collect()
    assert [(x["rolling_win_rate"], x["streak"], x["matches_played"]) for x in asof] == \
        [(0.5, 0, 0), (1.0, 1, 1), (1.0, 1, 1)]


def test_no_result_and_null_winner_excluded(spark):
    m = matches_df(spark, [(1, 0, "A", "B", ""), (2, 1, "A", "B", None), (3, 2, "A", "B", "A")])
    r = form.team_form_rows(m).filter("team = 'A'").collect()
    assert len(r) == 1 and r[0]["matches_played"] == 1


def brute_rows(rows):
    """Re-statement of the reference rule: per team, in (date, id) order."""
    out = {}
    by_team = {}
    for mid, d, t1, t2, w in rows:
        for t in (t1, t2):
            by_team.setdefault(t, []).append((d, mid, int(w == t)))
    for t, seq in by_team.items():
        seq.sort()
        cur = 0
        for i, (d, mid, won) in enumerate(seq):
            win = [x[2] for x in seq[max(0, i - 4):i + 1]]
            cur = (cur + 1 if cur > 0 else 1) if won else (cur - 1 if cur < 0 else -1)
            rate = round(sum(win) * 1000 / len(win)) / 1000
            out[(t, mid)] = (rate, cur, i + 1)
    return out


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 3), st.integers(0, 3), st.booleans()),
                min_size=1, max_size=40))
def test_form_matches_brute_force(spark, spec):
    rows = []
    for i, (d, a, b, first_wins) in enumerate(spec):
        if a == b:
            b = (b + 1) % 4
        t1, t2 = f"T{a}", f"T{b}"
        rows.append((i + 1, d, t1, t2, t1 if first_wins else t2))
    got = {(r["team"], r["match_id"]): (r["rolling_win_rate"], r["streak"], r["matches_played"])
           for r in form.team_form_rows(matches_df(spark, rows)).collect()}
    assert got == brute_rows(rows)
