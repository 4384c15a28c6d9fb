"""End-to-end job on the smoke data, the leakage property and the matrix
invariants (SURVEY section 5, items 4 and 6)."""

from pyspark.sql import functions as F

from kestrel.operators import quality
from kestrel.operators import upsert as up
from kestrel.plans import domain as dm
from kestrel.plans import features as feat
from kestrel.plans import ingest, pipeline

SF = "/root/testdata/sf0.001"


def test_end_to_end_job(spark, scratch):
    m = dm.matches(spark, SF)
    raw_m, raw_d = ingest.testdata_raw(m, dm.deliveries(spark, SF, m))
    wh = f"{scratch}/wh"
    paths = pipeline.load_history(raw_m, raw_d, wh)
    assert "player_stats" in paths
    # a second load upserts matches but does not append stat lines again (K6)
    assert "player_stats" not in pipeline.load_history(raw_m, raw_d, wh)
    pipeline.build_features(spark, wh)
    grid = {"columns": [1.0], "rate": [0.1], "depth": [3], "trees": [10, 20], "rows": [0.8, 1.0]}   # the stored models are the point here
    res = pipeline.train_models(spark, wh, grid).collect()
    assert {r["model"] for r in res} == {"logistic", "gbt"}
    assert all(0.0 <= r["auc"] <= 1.0 for r in res)
    pipeline.score_live(spark, wh)
    live = up.read_current(spark, f"{wh}/live_predictions")
    n_unfinished = feat.unfinished(up.read_current(spark, f"{wh}/matches")).count()
    assert live.count() == n_unfinished
    bad = live.filter(F.abs(F.col("team1_win_prob") + F.col("team2_win_prob") - 100.0) > 0.11).count()
    assert bad == 0
    assert up.read_current(spark, f"{wh}/models/gbt_search").count() == 4
    # the same scores from stored day states, taken in by halves
    days = up.read_current(spark, f"{wh}/matches").select("match_date").distinct()
    early = F.col("match_date") < F.lit("1998-01-01").cast("date")
    assert [pipeline.update_states(spark, wh, days.where(c)) for c in (early, ~early)] == [0, 1]
    before = live.drop("scored_at")
    pipeline.score_live(spark, wh)
    after = up.read_current(spark, f"{wh}/live_predictions").drop("scored_at")
    assert before.exceptAll(after).count() == after.exceptAll(before).count() == 0


def test_both_models_score_from_the_store(spark, scratch):
    """The stored trees score as the fitted ones, whichever model is better."""
    from kestrel.ml import boost
    m = dm.matches(spark, SF)
    matrix = feat.feature_matrix(m, dm.player_stats(spark, SF, m))
    wh = f"{scratch}/wh"
    up.replace_table(matrix, f"{wh}/feature_matrix")
    pipeline.train_models(spark, wh, {"columns": [1.0], "rate": [0.3], "depth": [2], "trees": [5], "rows": [1.0]})
    stored = boost.Boosted.from_table(up.read_current(spark, f"{wh}/models/gbt_trees"), feat.FEATURE_COLS)
    assert len(stored.trees) == 5 and len(stored.edges) == len(feat.FEATURE_COLS)
    rows = up.read_current(spark, f"{wh}/feature_matrix")
    scores = [r["score"] for r in rows.withColumn("score", stored.score(spark)).collect()]
    assert len(scores) == matrix.count() and all(0 < s < 1 for s in scores) and len(set(scores)) > 3


def test_matrix_invariants(spark):
    m = dm.matches(spark, SF)
    fm = feat.feature_matrix(m, dm.player_stats(spark, SF, m))
    checks = {r["rule"]: r["violations"] for r in quality.matrix_checks(fm).collect()}
    assert checks["v4_team1_win_rate_range"] == 0 and checks["v6_duplicate_match_id"] == 0
    assert checks["v7_target_domain"] == 0 and checks["v7_h2h_complement"] == 0


def test_no_leakage_with_history_before(spark):
    """Changing every match from a cut date on leaves the features of matches
    before the cut unchanged (history="before")."""
    m = dm.matches(spark, SF)
    st = dm.player_stats(spark, SF, m)
    dates = sorted(r["match_date"] for r in m.select("match_date").distinct().collect())
    cut = dates[len(dates) // 2]
    flipped = m.withColumn("winner", F.when((F.col("match_date") >= F.lit(cut)) & F.col("winner").isNotNull()
                                            & (F.col("winner") != ""),
                                            F.when(F.col("winner") == F.col("team1"), F.col("team2"))
                                            .otherwise(F.col("team1"))).otherwise(F.col("winner")))
    cols = feat.FEATURE_COLS
    a = feat.feature_matrix(m, st, history="before").filter(F.col("match_date") < F.lit(str(cut)))
    b = feat.feature_matrix(flipped, st, history="before").filter(F.col("match_date") < F.lit(str(cut)))
    diff = a.select("match_id", *cols).exceptAll(b.select("match_id", *cols)).count()
    assert a.count() > 0 and diff == 0
