"""Spotlight of every fixture, threshold on balls faced, chunks split by id range,
running sums by ranges, exact medians, stored day states."""
import random

import pytest
from pyspark.sql import functions as F

from kestrel.functions import prompts as pr
from kestrel.ml import metrics, prep
from kestrel.operators import form, players, ranges
from kestrel.operators import sequence as seq
from kestrel.operators import strength as stg
from kestrel.plans import day_states
from kestrel.plans import features as feat
from tests.helpers import bat, bowl, day, matches_df, rows_by, stats_df


def season(seed, n=60, teams="ABC", days=9):
    rng = random.Random(seed)
    m, lines = [], []
    for k in range(n):
        a, b = rng.sample(teams, 2)
        done = rng.random() < 0.7
        m.append((k, rng.randrange(days), a, b, rng.choice([a, b]) if done else None, "G" if k % 3 else "H", a if k % 2 else b,
                  "completed" if done else "in progress"))
        if done:
            for p in rng.sample("PQRSTUV", 4):
                lines.append(bat(k, p, rng.choice([a, b]), rng.randrange(80), rng.randrange(1, 9), rng.randrange(50, 200)))
            for p in rng.sample("PQRXYZ", 3):
                lines.append(bowl(k, p, rng.choice([a, b]), rng.randrange(5), 2.0, rng.randrange(3, 12)))
    return m, lines


def plain_spotlight(m, lines, min_balls):
    """For each unfinished match, straight from the definition."""
    when = {r[0]: r[1] for r in m}
    out = {}
    for r in m:
        if r[7] == "completed":
            continue
        for role, f1, f2 in (("batting", 4, 8), ("bowling", 9, 11)):
            own = [x for x in lines if x[3] == role and when[x[0]] < r[1] and (x[5] > min_balls if role == "batting" else x[10] > 0)]
            by = {}
            for x in own:
                if x[2] in (r[2], r[3]):
                    by.setdefault((x[1], x[2]), []).append(x)
            ranked = sorted((k for k, v in by.items() if len(v) >= 3), key=lambda k: (
                -sum(x[f1] for x in by[k]) / len(by[k]), sum(x[f2] for x in by[k]) / len(by[k]) if role == "bowling" else 0, *k))[:3]
            for place, k in enumerate(ranked, start=1):
                last = sorted((x for x in own if x[1] == k[0]), key=lambda x: (when[x[0]], x[0], x[2]), reverse=True)[:6]
                v = [x[f2] for x in last]
                change = sum(v[:3]) / 3 - sum(v[3:]) / len(v[3:]) if len(v) >= 4 else 0.0
                out[r[0], role, place] = (*k, sum(x[f1] for x in by[k]) / len(by[k]), sum(x[f2] for x in by[k]) / len(by[k]), change)
    return out


@pytest.mark.parametrize("min_balls", [0, 3])
def test_spotlight_of_every_fixture(spark, min_balls):
    m, lines = season(3)
    matches, stats = matches_df(spark, m), stats_df(spark, lines)
    got = {}
    for r in players.spotlight_of_fixtures(stats, matches, feat.unfinished(matches), min_balls=min_balls).collect():
        bats = r.role == "batting"
        got[r.match_id, r.role, r.ord - (0 if bats else 3)] = (r.name, r.team, *((r.rolling_avg_runs, r.rolling_avg_sr, r.sr_trend) if bats else
                                                               (r.rolling_avg_wickets, r.rolling_avg_economy, r.economy_trend)))
    want = plain_spotlight(m, lines, min_balls)
    assert len(want) > 40 and set(got) == set(want)
    for k, w in want.items():
        assert got[k][:2] == w[:2] and got[k][2:] == pytest.approx(w[2:], abs=0.0501)


def test_spotlight_of_one_fixture_is_the_point_query(spark):
    m, lines = season(5)
    matches, stats = matches_df(spark, m), stats_df(spark, lines)
    fixtures = feat.unfinished(matches)
    every = players.spotlight_of_fixtures(stats, matches, fixtures, min_balls=0)
    one = max((r for r in m if r[7] != "completed"), key=lambda r: r[1])
    point = players.spotlight(stats, matches, one[2], one[3], day(one[1]), min_balls=0)
    cols = point.columns
    assert sorted(map(tuple, every.where(F.col("match_id") == one[0]).select(*cols).collect())) == sorted(map(tuple, point.collect()))
    prompts = rows_by(pr.spotlight_prompts(every, fixtures, F.concat("team1", F.lit(" vs "), "team2")), "match_id")
    assert prompts[one[0]]["prompt"] == pr.spotlight_prompt(point, f"{one[2]} vs {one[3]}").head()["prompt"]
    first = min((r for r in m if r[7] != "completed"), key=lambda r: r[1])
    assert prompts[first[0]]["prompt"] == pr.NO_SPOTLIGHT or first[1] > 0


def test_dyadic_ranges_make_up_the_span(spark):
    spans = [(a, b) for a in (0, 1, 5, 13, 64, -3) for b in (1, 2, 6, 14, 64, 1000, 65535) if a < b]
    df = spark.createDataFrame(spans, "a int, b int").select("a", "b", players._ranges_of(F.col("a"), F.col("b")).alias("r"))
    for row in df.collect():
        days = sorted(d for r in row.r for d in range(r.node << r.level, (r.node + 1) << r.level))
        assert days == list(range(row.a, row.b)) and len(row.r) <= 2 * players.LEVELS


# ---- chunks split by id range ------------------------------------------------------

def plain_form(m):
    out, held = {}, {}
    for r in sorted((r for r in m if r[7] == "completed"), key=lambda r: (r[1], r[0])):
        for team in (r[2], r[3]):
            won = int(r[4] == team)
            h = held.setdefault(team, [])
            h.append(won)
            run = next((i for i, x in enumerate(reversed(h)) if x != won), len(h))
            out[r[0], team] = (sum(h[-5:]) / len(h[-5:]), run if won else -run, len(h))
    return out


def hot_day(seed):
    """Most matches of one team on one day."""
    rng = random.Random(seed)
    m = [(k, 4 if k % 8 else rng.randrange(9), "A", rng.choice("BC"), rng.choice("ABC"), "G", "A", "completed") for k in range(120)]
    return [(k, d, a, b, w if w in (a, b) else a, *rest) for k, d, a, b, w, *rest in m]


def test_a_hot_day_is_many_chunks_and_changes_nothing(spark, monkeypatch):
    m = hot_day(1)
    matches = matches_df(spark, m)
    monkeypatch.setattr(seq, "CHUNK_IDS", 5)
    rows = form._base_rows(matches)
    sizes = seq.within_chunk(rows, ["team"], "match_date", ["match_id"], ["won"], 4)
    assert sizes.agg(F.max("_n")).head()[0] <= 5 < rows.groupBy("team", "match_date").count().agg(F.max("count")).head()[0]
    got = rows_by(form.team_form_rows(matches), "match_id", "team")
    want = plain_form(m)
    assert set(got) == set(want)
    for k, w in want.items():
        g = got[k]
        assert (round(w[0], 3), w[1], w[2]) == (g["rolling_win_rate"], g["streak"], g["matches_played"])
    ends = rows_by(form.form_states(matches), "team", "match_date")
    by_day = {}
    for r in sorted(m, key=lambda r: (r[1], r[0])):
        for team in (r[2], r[3]):
            by_day[team, day(r[1])] = want[r[0], team]
    assert {k: (e["streak"], e["matches_played"]) for k, e in ends.items()} == {k: w[1:] for k, w in by_day.items()}


def test_player_and_strength_states_of_a_hot_day(spark, monkeypatch):
    rng = random.Random(2)
    m = hot_day(2)
    lines = [x for r in m for p in rng.sample("PQR", 2) for x in (bat(r[0], p, r[2], rng.randrange(60), 5, rng.randrange(90, 160)),
                                                                  bowl(r[0], p, r[3], rng.randrange(4), 2.0, rng.randrange(4, 9)))]
    matches, stats = matches_df(spark, m), stats_df(spark, lines)
    makes = (lambda: players.batting_feature_rows(stats, matches), lambda: players.bowling_features(stats, matches),
             lambda: stg.strength_states(stats, matches), lambda: feat.feature_matrix(matches, stats))
    whole = [sorted(map(str, make().collect())) for make in makes]
    monkeypatch.setattr(seq, "CHUNK_IDS", 7)
    assert [sorted(map(str, make().collect())) for make in makes] == whole


def test_text_ids_are_split_by_prefix(spark, monkeypatch):
    m = hot_day(3)
    named = matches_df(spark, m).withColumn("match_id", F.lpad(F.hex(F.col("match_id")), 4, "0"))
    same = rows_by(form.team_form_rows(named), "match_id", "team")
    want = plain_form(m)
    assert {(int(k, 16), t): g["streak"] for (k, t), g in same.items()} == {k: w[1] for k, w in want.items()}


# ---- running sums and medians ------------------------------------------------------

@pytest.mark.parametrize("inclusive", [True, False])
def test_running_sums_by_ranges(spark, inclusive):
    rng = random.Random(4)
    rows = [("hot" if k % 3 else None if k % 2 else "b", rng.randrange(500), k, rng.randrange(9)) for k in range(400)]
    df = spark.createDataFrame(rows, "g string, o int, k int, v int")
    got = ranges.running_sums(df, ["g"], [F.desc("o"), F.asc("k")], ["v"], inclusive, range_rows=23).collect()
    r = ranges.in_ranges(df, ["g"], [F.desc("o"), F.asc("k")], range_rows=23)
    assert r.select("_range").distinct().count() >= 10 and r.groupBy("_range").count().agg(F.max("count")).head()[0] < 120
    for x in got:
        mine = sorted(((-o, k, v) for g, o, k, v in rows if g == x.g))
        want = sum(v for o, k, v in mine if (o, k) < (-x.o, x.k) or inclusive and (o, k) == (-x.o, x.k))
        assert x._cum_v == want
    assert len(got) == 400


def test_auc_by_group(spark):
    rng = random.Random(6)
    rows = [("a" if k % 4 else "b", rng.randrange(6) / 5, int(rng.random() < 0.4)) for k in range(200)] + [("c", 0.5, 1)]
    got = rows_by(metrics.auc_by(spark.createDataFrame(rows, "g string, score double, y int"), ("g",), "y"), "g")
    for g in "ab":
        pairs = [(p > q) + 0.5 * (p == q) for h, p, y in rows if h == g and y for i, q, z in rows if i == g and not z]
        assert got[g]["auc"] == pytest.approx(sum(pairs) / len(pairs))
    assert got["c"]["auc"] is None


@pytest.mark.parametrize("parts", [2, 3, 1024])
def test_medians_by_counted_ranges(spark, monkeypatch, parts):
    import statistics
    monkeypatch.setattr(prep, "MEDIAN_PARTS", parts)
    rng = random.Random(parts)
    cols = {"even": [rng.gauss(0, 1) for _ in range(100)], "odd": [round(rng.random(), 1) for _ in range(99)] + [None], "same": [2.5] * 100,
            "far": [10.0 ** rng.randrange(-8, 9) * rng.choice([-1, 1]) for _ in range(100)], "none": [None] * 100,
            "one": [None] * 99 + [7.0], "nan": [float("nan")] * 40 + [1.0, 2.0, 3.0] * 20, "near": [1.0, 1.0 + 2 ** -52] * 50}
    df = spark.createDataFrame(list(zip(*cols.values())), ", ".join(f"{c} double" for c in cols))
    got = prep.exact_medians(df, list(cols))
    want = {c: statistics.median([x for x in v if x is not None and x == x]) if any(x is not None and x == x for x in v) else None for c, v in cols.items()}
    assert {c: v for c, v in got.items() if v is None} == {"none": None}
    assert {c: v for c, v in got.items() if v is not None} == pytest.approx({c: v for c, v in want.items() if v is not None})
    filled = prep.median_fill(df.select("odd", "one"), ["odd", "one"]).collect()
    assert all(r.odd is not None and r.one == 7.0 for r in filled)


# ---- stored day states ---------------------------------------------------------------

def test_day_states_take_in_days_and_replace_them(spark, scratch):
    m, lines = season(8, n=80)
    matches, stats = matches_df(spark, m), stats_df(spark, lines)
    of = lambda keep: (matches_df(spark, [r for r in m if keep(r[1])]),
                       stats_df(spark, [x for x in lines if keep(next(r[1] for r in m if r[0] == x[0]))]))
    store = f"{scratch}/states"
    # day 3 first arrives with all its results turned round, then once more as it is
    turned = matches_df(spark, [(*r[:4], r[3] if r[4] == r[2] else r[2], *r[5:]) if r[4] else r for r in m if r[1] <= 3])
    assert day_states.append(store, turned, of(lambda d: d <= 3)[1]) == 0
    day_states.append(store, *of(lambda d: d in (0, 1, 2, 3)))
    day_states.append(store, *of(lambda d: d > 3))
    spine = feat.unfinished(matches)
    want = sorted(map(str, feat.live_features(matches, stats).collect()))
    live = feat.live_features(None, None, spine, states=day_states.states(spark, store))
    assert sorted(map(str, live.collect())) == want
    day_states.append(store, *of(lambda d: d > 3), batch=2)        # the same batch again
    assert sorted(map(str, feat.live_features(None, None, spine, states=day_states.states(spark, store)).collect())) == want
    read = [f for t in day_states.states(spark, store) for f in t.inputFiles()]
    assert read and all(f"{scratch}/states/" in f for f in read)    # the logs are not read
    with pytest.raises(ValueError):
        day_states.states(spark, f"{scratch}/none")
