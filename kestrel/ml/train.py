"""Model training and scoring (M5 logistic baseline, M6 coefficients and the
certificate of its optimum, M7 boosted trees with a cross-validated grid, M9 final
fit with a loss per round, M10 importances, M18 scoring of unfinished matches, T7
scoring with rejects).

Differences from the reference's learners, by design: the boosted trees are those
of :mod:`kestrel.ml.boost` (histograms of 64 bins); the logistic regression solves
the same L2 objective (C = 1 with class weights) by setting
``regParam = 1 / sum(weights)`` because Spark divides the loss by the weight
sum. The search covers the full 108-point grid.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrel.functions.numeric import round_half_even
from kestrel.functions.text import percent
from kestrel.ml import boost, metrics, prep
from kestrel.plans.features import FEATURE_COLS, TARGET_COL
from kestrel.session import cut_lineage, ship_package

# The reference's solver settings.
LOGISTIC_MAX_ITER = 1000
LOGISTIC_TOL = 1e-4
CERTIFIED = 1e-3    # the gradient, per unit of total weight, that still counts as 0


def prepared(matrix: DataFrame, impute: str = "all"):
    """M2-M4 + P13: (train, test, scale stats, class weights).
    ``impute="all"`` fills with medians of the whole matrix as the reference
    does; ``"train"`` uses train medians only (Q7)."""
    split = prep.time_split(matrix)
    basis = split.filter(F.col("is_train")) if impute == "train" else None
    filled = prep.median_fill(split, basis=basis)
    train, test = filled.filter(F.col("is_train")), filled.filter(~F.col("is_train"))
    return train, test, prep.scale_stats(train), prep.class_weights(train)


def train_logistic(train: DataFrame, stats: DataFrame, weights: DataFrame):
    """M5: class-weighted L2 logistic regression on standardised features."""
    t = prep.assemble(prep.standardise(prep.with_weights(train, weights), stats))
    wsum = t.agg(F.sum("weight")).first()[0]
    lr = LogisticRegression(featuresCol="features", labelCol=TARGET_COL, weightCol="weight",
                            maxIter=LOGISTIC_MAX_ITER, regParam=1.0 / wsum, elasticNetParam=0.0,
                            standardization=False, fitIntercept=True, tol=LOGISTIC_TOL)
    return lr.fit(t)


def coefficient_table(model, cols=FEATURE_COLS) -> DataFrame:
    """M6: (feature, coefficient rounded to 4), largest first."""
    from pyspark.sql import SparkSession
    s = SparkSession.getActiveSession()
    # a 20-row model summary built on the driver
    rows = [(c, float(v)) for c, v in zip(cols, model.coefficients.toArray())]
    df = s.createDataFrame(rows, "feature string, coefficient double")
    return df.select("feature", round_half_even("coefficient", 4).alias("coefficient")) \
             .orderBy(F.desc("coefficient"), "feature")


def score_logistic(model, rows: DataFrame, stats: DataFrame) -> DataFrame:
    """``score`` = P(team1 wins) from the logistic model."""
    t = prep.assemble(prep.standardise(rows, stats))
    return model.transform(t).withColumn("score", vector_to_array("probability")[1]) \
                .drop("features", "rawPrediction", "probability", "prediction")


def logistic_gradient(model, train: DataFrame, stats: DataFrame, weights: DataFrame, cols: Sequence[str] = FEATURE_COLS) -> DataFrame:
    """M5 certificate: (feature, gradient, optimal). The objective is convex, so
    its minimum is where the gradient of ½|b|² + Σ w · log-loss vanishes, one
    aggregate over the training rows: b_j + Σ w (p - y) x_j for a coefficient,
    Σ w (p - y) for the intercept. It is given per unit of total weight."""
    t = prep.standardise(prep.with_weights(train, weights), stats)
    b, b0 = [float(v) for v in model.coefficients.toArray()], float(model.intercept)
    margin = sum((F.col(c) * F.lit(v) for c, v in zip(cols, b)), F.lit(b0))
    t = t.withColumn("_r", F.col("weight") * (F.lit(1.0) / (F.lit(1.0) + F.exp(-margin)) - F.col(TARGET_COL)))
    g = t.agg(F.sum("weight").alias("_n"), F.sum("_r").alias("intercept"), *[(F.sum(F.col("_r") * F.col(c)) + F.lit(v)).alias(c) for c, v in zip(cols, b)])
    names = ["intercept", *cols]
    stack = ", ".join(f"'{c}', `{c}` / _n" for c in names)
    return g.selectExpr(f"stack({len(names)}, {stack}) as (feature, gradient)") \
            .withColumn("optimal", F.abs("gradient") <= CERTIFIED)


# ---- boosted trees ---------------------------------------------------------------------


class Fitted(NamedTuple):
    model: boost.Boosted
    search: DataFrame       # one row per point: its parameters, mean AUC over the folds, rank
    losses: DataFrame       # M9: (trees, log_loss) on the rows kept back from the final fit


def _search(train: DataFrame, edges, grid: dict[str, list], cols: Sequence[str], block_rows: int) -> tuple[DataFrame, boost.Params]:
    """M7: every point on every fold. Points that differ in the number of trees are one run."""
    spark = train.sparkSession
    data = boost.blocks(prep.stratified_folds(train), cols, edges, TARGET_COL, block_rows=block_rows)
    most = max(grid["trees"])
    kinds = boost.points({**grid, "trees": [most]})
    runs = [boost.Run(k * prep.N_FOLDS + fold, p, fold) for k, p in enumerate(kinds) for fold in range(prep.N_FOLDS)]
    found, _ = boost.fit(data, runs, grid["trees"], margins=False)
    if found.where("auc2 is not null").isEmpty():
        rows = found.select("run", "trees", F.explode(F.arrays_zip("label", "margin")).alias("r")).select("run", "trees", "r.label", "r.margin")
        per_fold = metrics.auc_by(rows, ("run", "trees"), "label", "margin")
    else:       # the rows of a fold lay in one task, which has ranked them
        per_fold = metrics.auc_of(found, ("run", "trees"))
    mean = {(r["kind"], r["trees"]): r["auc"] for r in per_fold.groupBy(F.floor(F.col("run") / prep.N_FOLDS).alias("kind"), "trees")
            .agg(F.avg("auc").alias("auc")).collect()}     # one row per point of the grid
    place = {p: k for k, p in enumerate(kinds)}
    every = [(no, *p, mean.get((place[p._replace(trees=most)], p.trees))) for no, p in enumerate(boost.points(grid))]
    best = max(every, key=lambda r: (-1.0 if r[-1] is None else round(r[-1], 12), -r[0]))
    fields = "no int, columns double, rate double, depth int, trees int, rows double, mean_auc double"
    by_auc = Window.orderBy(F.desc_nulls_last(F.round("mean_auc", 12)), "no")
    ranked = spark.createDataFrame(every, fields).withColumn("rank", F.row_number().over(by_auc))
    return ranked, boost.Params(*best[1:-1])


def fit_gbt(train: DataFrame, weights: DataFrame, grid: dict[str, list] = boost.GRID, cols: Sequence[str] = FEATURE_COLS,
            block_rows: int = boost.BLOCK_ROWS) -> Fitted:
    """M7-M9: grid search by stratified 5-fold AUC, then the final fit on the
    first 85 % of the training rows in time order, with the log-loss of the other
    15 % after every tree."""
    spark = train.sparkSession
    ship_package(spark)
    t = cut_lineage(prep.with_weights(train, weights))
    edges = boost.bin_edges(t, cols)
    search, best = _search(t, edges, grid, cols, block_rows)
    last = prep.time_split(t.drop("is_train"), share=prep.FINAL_FIT_SHARE).withColumn("fold", F.when(F.col("is_train"), 0).otherwise(1))
    data = boost.blocks(last, cols, edges, TARGET_COL, block_rows=block_rows)
    found, trees = boost.fit(data, [boost.Run(0, best, 1)], [best.trees], keep_trees=True)
    loss = found.select("held", F.posexplode("loss").alias("trees", "loss")).groupBy("trees").agg(
        (F.sum("loss") / F.nullif(F.sum("held"), F.lit(0))).alias("log_loss"))
    return Fitted(boost.Boosted(cols, edges, trees[0] if trees else [], best), search, loss)


def importance_table(model: boost.Boosted) -> DataFrame:
    """(feature, importance rounded to 4), largest first."""
    from pyspark.sql import SparkSession
    s = SparkSession.getActiveSession()
    return s.createDataFrame(list(model.importances().items()), "feature string, importance double") \
            .select("feature", round_half_even("importance", 4).alias("importance")) \
            .orderBy(F.desc("importance"), "feature")


def score_gbt(model: boost.Boosted, rows: DataFrame) -> DataFrame:
    ship_package(rows.sparkSession)
    return rows.withColumn("score", model.score(rows.sparkSession))


# ---- scoring with rejects --------------------------------------------------------------


def unscorable(cols: Sequence[str] = FEATURE_COLS, teams: Sequence[str] = ("team1", "team2")) -> Column:
    """Why a row cannot be scored (reasons joined by "; "; empty: it can): a
    team without a name, a team against itself, a feature that is null or NaN."""
    blank = [F.when(F.coalesce(F.trim(t), F.lit("")) == "", F.lit(f"Unknown team: {t}")) for t in teams]
    same = F.when(F.col(teams[0]) == F.col(teams[1]), F.lit("Team plays itself"))
    missing = [F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")), F.lit(f"Missing feature: {c}")) for c in cols]
    return F.concat_ws("; ", *blank, same, *missing)


def split_scorable(rows: DataFrame, cols: Sequence[str] = FEATURE_COLS) -> tuple[DataFrame, DataFrame]:
    """(rows that can be scored, rejects with ``error_message``). A match that
    cannot be scored leaves the others alone and is reported."""
    judged = rows.withColumn("error_message", unscorable(cols))
    return judged.where("error_message = ''").drop("error_message"), judged.where("error_message <> ''")


def scored_with_rejects(rows: DataFrame, score, model_name: str, cols: Sequence[str] = FEATURE_COLS) -> DataFrame:
    """One row per match: both probabilities and the model, or the reason
    why there are none. ``score(rows)`` adds the column ``score``."""
    good, bad = split_scorable(rows, cols)
    done = win_probabilities(score(good), model_name).withColumn("error_message", F.lit(None).cast("string"))
    none = F.lit(None).cast("double")
    return done.unionByName(bad.select("match_id", "team1", "team2", none.alias("team1_win_prob"), none.alias("team2_win_prob"),
                                       F.lit(None).cast("string").alias("model_used"), "error_message"))


def win_probabilities(scored: DataFrame, model_name: str) -> DataFrame:
    """Both teams' win probability in percent (1 dp) and the model."""
    return scored.select("match_id", "team1", "team2",
                         percent(F.col("score")).alias("team1_win_prob"),
                         percent(F.lit(1.0) - F.col("score")).alias("team2_win_prob"),
                         F.lit(model_name).alias("model_used"))
