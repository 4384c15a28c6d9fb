"""The steps that player states share do no more than their rows need."""

import datetime as dt

from pyspark.sql import functions as F

from kestrel.operators import players as pl
from kestrel.operators import quality
from kestrel.operators import sequence as seq
from kestrel.plans import catalog, day_states
from tests.test_sizes import _tables

STATS = "player_name string, runs int, balls_faced int, fours int, sixes int, wickets int, strike_rate double, overs_bowled double, economy double"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_valid_rows_are_told_by_the_rules_without_text(spark):
    nan = float("nan")
    rows = [("P", 1, 1, 0, 0, 0, 100.0, 0.0, 0.0), ("", 1, 1, 0, 0, 0, 100.0, 0.0, 0.0), (None,) * 9, ("P",) + (None,) * 8,
            ("P", 1, -1, 0, 0, 0, 100.0, 0.0, 0.0), ("P", 1, 1, 0, 0, 0, 500.1, 0.0, 0.0), ("P", 201, 1, 0, 0, 0, 500.0, 0.0, 0.0),
            ("P", 200, 1, 0, 0, 0, nan, nan, nan), ("P", 1, 1, 0, 0, 0, 1.0, 1.0, -0.1)]
    checked = quality.validate_player_stats(spark.createDataFrame(rows, STATS))
    found = checked.collect()
    assert [r.is_valid for r in found] == [r.error_message is None for r in found] == [True, False, False, True, False, False, False, True, False]
    texts = spark.createDataFrame([("P", "1", "x"), ("P", "1.5", "2"), ("P", None, "3"), ("P", "-1", "4")], "player_name string, runs string, economy string")
    found = quality.validate_player_stats(texts).collect()
    assert [r.error_message for r in found] == ["Cannot coerce economy: x", "Cannot coerce runs: 1.5", None, "runs is negative"]
    assert [r.is_valid for r in found] == [False, False, True, False]
    assert "concat" not in _plan(quality.split_valid(checked, "s", ["player_name", "runs"])[0])


def test_a_chunk_is_read_in_one_pass(spark):
    rows = spark.createDataFrame([("a", dt.date(2020, 1, 1 + k % 2), k, k * k) for k in range(11)] + [("b", None, 3, 1), ("b", None, 3, 1)],
                                 "p string, d date, id long, v long")
    rows1 = seq.within_chunk(rows, ["p"], "d", ["id"], ["v"], 4, with_prev=False)
    made = seq.chunk_table(rows1, ["p"], "d", ["id"], ["v"], 4, ["v"])
    found = sorted((r.p, str(r.d), r._n, [t.id for t in r._tail], r.v) for r in made.collect())
    assert found == [("a", "2020-01-01", 6, [4, 6, 8, 10], 100), ("a", "2020-01-02", 5, [3, 5, 7, 9], 81), ("b", "None", 2, [3, 3], 1)]
    assert _plan(made).count("Window ") == 1 and dict(made.dtypes)["_n"] == "bigint"


def test_a_span_looks_at_the_levels_it_can_fill(spark):
    spans = [(a, a + n) for a in (-9, 0, 1, 7, 8, 9131) for n in (0, 1, 2, 3, 6, 7, 8, 9, 31, 64)] + [(9131, (1 << 16) - 1), (0, 1 << 16), (5, 2), (None, 9)]
    got = spark.createDataFrame(spans, "a int, b int").select("a", "b", pl._ranges_of(F.col("a"), F.col("b")).alias("r"), pl._levels(F.col("a"), F.col("b")).alias("l")).collect()
    for a, b, r, levels in got:
        days = sorted(d for level, node in r or [] for d in range(node << level, (node + 1) << level))
        assert days == ([] if a is None else list(range(a, b))), (a, b)
        if a is not None and a < b:
            assert len(levels) == min((b - a).bit_length(), pl.LEVELS) and all(sum(x.level == k for x in r) <= 2 for k in levels)


def test_a_load_makes_the_lines_of_its_own_days(spark, scratch, monkeypatch):
    _tables(spark, scratch)
    taken, append = [], day_states.append
    monkeypatch.setattr(day_states, "append", lambda store, matches, stats: (taken.append((matches, stats)), append(store, matches, stats))[1])
    names = ["match_id", "match_date", *catalog.feat.FEATURE_COLS]
    live = catalog.QUERIES["C11_live_features_from_day_states"](spark, scratch).select(*names)
    assert len(taken) == 3 and not any("LeftSemi" in _plan(stats) for _, stats in taken)
    assert [m.count() for m, _ in taken] == [1000, 1000, 0] and [s.isEmpty() for _, s in taken] == [False, False, True]
    assert sorted(map(str, live.collect())) == sorted(map(str, catalog.QUERIES["C11_live_features"](spark, scratch).select(*names).collect())) != []
