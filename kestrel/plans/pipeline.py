"""End-to-end batch job: the application's runs (history load, feature
build, training, scoring) as one Spark job over stored tables.

    load_history   C17: raw matches + balls -> matches / player_stats / data_errors tables
    build_features C10: stored tables -> feature_matrix table (K5, new version)
    train_models   M2-M10: feature_matrix -> saved logistic + boosted-tree models, metrics
    update_states  C11's past: the days of a load -> per-day summaries (optional)
    score_live     C11 + M18: unfinished matches -> win probabilities table; reads the
                   summaries, where there are any, instead of the whole history

Each step reads the previous step's tables, so the large inputs (the ball
log) are scanned once per load, and every later job reads compact columnar
tables. Tables are versioned folders under ``warehouse`` (see
:mod:`kestrel.operators.upsert`); models are saved with ``pyspark.ml``'s own
writer.
"""

from __future__ import annotations

import os

from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.ml import boost
from kestrel.ml import metrics as mt
from kestrel.ml import train as mtrain
from kestrel.operators import upsert as up
from kestrel.plans import day_states
from kestrel.plans import features as feat
from kestrel.plans import ingest


def _t(warehouse: str, name: str) -> str:
    return os.path.join(warehouse, name)


def load_history(raw_matches: DataFrame, raw_deliveries: DataFrame, warehouse: str) -> dict[str, str]:
    """Upsert matches into the current table, append valid stat lines and
    rejects (stat lines are loaded only into an empty table, K6)."""
    spark = raw_matches.sparkSession
    current = up.read_current(spark, _t(warehouse, "matches"))
    out = ingest.ingest_history(raw_matches, raw_deliveries, existing=current)
    paths = {"matches": up.replace_table(out["matches"], _t(warehouse, "matches"))}
    if up.load_once(_t(warehouse, "player_stats"), spark, lambda: out["player_stats"]):
        paths["player_stats"] = _t(warehouse, "player_stats")
    up.append_rows(out["rejects"], _t(warehouse, "data_errors"))
    return paths


def tables(spark: SparkSession, warehouse: str) -> tuple[DataFrame, DataFrame]:
    return up.read_current(spark, _t(warehouse, "matches")), up.read_current(spark, _t(warehouse, "player_stats"))


def build_features(spark: SparkSession, warehouse: str, history: str = "all") -> str:
    """The feature matrix from the stored tables, as a new version."""
    m, st = tables(spark, warehouse)
    return up.replace_table(feat.feature_matrix(m, st, history=history), _t(warehouse, "feature_matrix"))


def train_models(spark: SparkSession, warehouse: str, grid: dict[str, list] = boost.GRID) -> DataFrame:
    """Train both models on the stored matrix, save them with the scaler
    statistics, the search and the losses per round, and return their test metrics."""
    matrix = up.read_current(spark, _t(warehouse, "feature_matrix"))
    train, test, stats, weights = mtrain.prepared(matrix)
    lr = mtrain.train_logistic(train, stats, weights)
    gbt = mtrain.fit_gbt(train, weights, grid)
    models = _t(warehouse, "models")
    lr.write().overwrite().save(f"{models}/logistic")
    for name, table in (("scale_stats", stats), ("gbt_trees", gbt.model.table(spark)), ("gbt_search", gbt.search), ("gbt_losses", gbt.losses)):
        up.replace_table(table, f"{models}/{name}")
    a = mt.binary_metrics(mtrain.score_logistic(lr, test, stats), "team1_won", model="logistic")
    b = mt.binary_metrics(mtrain.score_gbt(gbt.model, test), "team1_won", model="gbt")
    res = a.unionByName(b)
    up.replace_table(res, f"{models}/metrics")
    return res


def update_states(spark: SparkSession, warehouse: str, days: DataFrame | None = None) -> int:
    """Take days of the stored tables (all, or the ``match_date`` of ``days``) into the
    day states that :func:`score_live` reads. A day taken in again is replaced."""
    m, st = tables(spark, warehouse)
    if days is not None:
        m = m.join(days.select("match_date").distinct(), "match_date", "left_semi")
        st = st.join(m.select("match_id"), "match_id", "left_semi")
    return day_states.append(_t(warehouse, "day_states"), m, st)


def score_live(spark: SparkSession, warehouse: str) -> str:
    """Score every unfinished match with the better saved model
    (higher test AUC; the baseline on a tie) and store the probabilities; matches
    that cannot be scored are stored with the reason."""
    m, st = tables(spark, warehouse)
    models = _t(warehouse, "models")
    res = up.read_current(spark, f"{models}/metrics")
    best = mt.compare_models(res, "logistic", "gbt").first()["better_model"]
    if best == "gbt":
        gbt = boost.Boosted.from_table(up.read_current(spark, f"{models}/gbt_trees"), feat.FEATURE_COLS)
        score = lambda rows: mtrain.score_gbt(gbt, rows)
    else:
        lr, stats = LogisticRegressionModel.load(f"{models}/logistic"), up.read_current(spark, f"{models}/scale_stats")
        score = lambda rows: mtrain.score_logistic(lr, rows, stats)
    kept = day_states.states(spark, _t(warehouse, "day_states")) if up.versions(spark, _t(warehouse, "day_states/days")) else None
    live = feat.live_features(m, st, states=kept)
    probs = mtrain.scored_with_rejects(live, score, best).withColumn("scored_at", F.current_timestamp())
    return up.replace_table(probs, _t(warehouse, "live_predictions"))
