"""Boosted trees (search, final fit, losses per round, importances), the logistic
certificate and scoring with rejects, on tables small enough for a restatement."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kestrel.ml import boost, prep
from kestrel.ml import train as mtrain
from kestrel.plans.features import FEATURE_COLS

COLS = ["a", "b", "c"]
GRID = {"columns": [0.7, 1.0], "rate": [0.1, 0.3], "depth": [2, 3], "trees": [3, 6], "rows": [0.8, 1.0]}


@pytest.fixture(scope="module")
def train(spark):
    rng = np.random.default_rng(1)
    rows = []
    for k in range(400):
        a, b, c = round(float(rng.normal()), 1), float(rng.integers(0, 3)), float(rng.integers(0, 2))
        y = int(rng.random() < 1 / (1 + math.exp(-(1.5 * a * (1 if b else -1) + 0.5 * c))))
        rows.append((k, f"2024-{1 + k // 40:02d}-{1 + k % 28:02d}", a, b, c, y, 1.0 + 0.5 * y))
    return spark.createDataFrame(rows, "match_id long, match_date string, a double, b double, c double, team1_won int, weight double").cache()


def restated(rows, edges, params, holdout):
    """The same booster, node by node over plain rows."""
    n = len(rows)
    x = [[sum(e < r[c] for e in edges[k]) for k, c in enumerate(COLS)] for r in rows]
    key = np.array([r["key"] for r in rows], dtype=np.int64)
    margin = [0.0] * n
    for turn in range(params.trees):
        allowed = boost.tree_columns(params, turn, len(COLS))
        use = boost._uniform(key, turn) < params.rows if params.rows < 1 else [True] * n
        p = [1 / (1 + math.exp(-m)) for m in margin]
        g = [round((p[i] - r["team1_won"]) * r["weight"] * boost._UNIT) / boost._UNIT for i, r in enumerate(rows)]
        h = [round(p[i] * (1 - p[i]) * r["weight"] * boost._UNIT) / boost._UNIT for i, r in enumerate(rows)]

        def value(at):
            return sum(g[i] for i in at) ** 2 / (sum(h[i] for i in at) + 1)

        def grow(everyone, level):
            learn = [i for i in everyone if rows[i]["fold"] != holdout and use[i]]
            best = (1e-6, None)
            if level < params.depth:
                for f in range(len(COLS)):
                    for b in sorted({x[i][f] for i in learn}) if allowed[f] else ():
                        left, right = [i for i in learn if x[i][f] <= b], [i for i in learn if x[i][f] > b]
                        if min(sum(h[i] for i in left), sum(h[i] for i in right)) < 1:
                            continue
                        gain = value(left) + value(right) - value(learn)
                        if gain > best[0] + 1e-9:
                            best = (gain, (f, b))
            if best[1] is None:
                leaf = -params.rate * sum(g[i] for i in learn) / (sum(h[i] for i in learn) + 1)
                for i in everyone:
                    margin[i] += leaf
                return
            f, b = best[1]
            grow([i for i in everyone if x[i][f] <= b], level + 1)
            grow([i for i in everyone if x[i][f] > b], level + 1)

        grow(range(n), 0)
    return margin


def held_out(found, trees):
    return {r.run: dict(zip(range(len(r.margin)), r.margin)) for r in found.where(F.col("trees") == trees).collect()}


@pytest.mark.parametrize("params", [boost.Params(1.0, 0.3, 3, 5, 1.0), boost.Params(0.7, 0.2, 2, 4, 0.8)])
def test_a_run_is_the_restated_booster(spark, train, params):
    t = prep.stratified_folds(train)
    edges = boost.bin_edges(t, COLS)
    data = boost.blocks(t, COLS, edges, "team1_won")
    found, trees = boost.fit(data, [boost.Run(0, params, 2)], [params.trees], keep_trees=True)
    rows = [r.asDict() for r in t.withColumn("key", F.xxhash64("match_id")).collect()]
    want = restated(rows, edges, params, 2)
    model = boost.Boosted(COLS, edges, trees[0], params)
    got = model.probabilities(np.array([[r[c] for c in COLS] for r in rows]))
    assert got == pytest.approx([1 / (1 + math.exp(-m)) for m in want], abs=1e-9)
    own = found.head()
    assert sorted(own.margin) == pytest.approx(sorted(m for m, r in zip(want, rows) if r["fold"] == 2), abs=1e-9)
    assert len(own.loss) == params.trees + 1 and own.loss[0] == pytest.approx(own.held * math.log(2))


def test_many_blocks_give_the_trees_of_one(spark, train, monkeypatch):
    """Sums by shuffles, level by level, with stored margins: the same trees."""
    monkeypatch.setattr(boost, "GROUP_RUNS", 2)
    monkeypatch.setattr(boost, "KEEP_ROUNDS", 2)
    t = prep.stratified_folds(train)
    edges = boost.bin_edges(t, COLS)
    runs = [boost.Run(0, boost.Params(1.0, 0.3, 3, 5, 0.8), 0), boost.Run(1, boost.Params(0.7, 0.1, 2, 3, 1.0), 1),
            boost.Run(2, boost.Params(1.0, 0.2, 2, 5, 1.0), 4)]
    whole = boost.blocks(t, COLS, edges, "team1_won")
    many = boost.blocks(t, COLS, edges, "team1_won", block_rows=90)
    assert whole.count() == 1 and many.count() >= 4
    one, trees = boost.fit(whole, runs, [3, 5], keep_trees=True)
    two, others = boost.fit(many, runs, [3, 5], keep_trees=True)
    for a, b in zip(trees, others):
        assert len(a) == len(b)
        for s, u in zip(a, b):
            assert all(np.array_equal(p, q) for p, q in zip([*s.feature, *s.bin, s.leaf], [*u.feature, *u.bin, u.leaf]))
    flat = lambda df: sorted((r.run, r.trees, round(m, 9)) for r in df.collect() for m in r.margin)
    assert flat(one) == flat(two)


def test_the_search_takes_every_point_on_every_fold(spark, train):
    fitted = mtrain.fit_gbt(train, prep.class_weights(train), GRID, COLS)
    rows = fitted.search.collect()
    assert len(rows) == 32 and {r.trees for r in rows} == {3, 6} and sorted(r["rank"] for r in rows) == list(range(1, 33))
    best = min(rows, key=lambda r: r["rank"])
    assert best.mean_auc == max(r.mean_auc for r in rows) > 0.6
    assert fitted.model.params == boost.Params(best.columns, best.rate, best.depth, best.trees, best.rows)
    # one point again, by hand: its AUC on each fold
    t = prep.stratified_folds(prep.with_weights(train, prep.class_weights(train)))
    data = boost.blocks(t, COLS, fitted.model.edges, "team1_won")
    aucs = []
    for fold in range(prep.N_FOLDS):
        r = boost.fit(data, [boost.Run(0, fitted.model.params, fold)], [best.trees])[0].head()
        pairs = [(p > q) + 0.5 * (p == q) for p, a in zip(r.margin, r.label) if a for q, b in zip(r.margin, r.label) if not b]
        aucs.append(sum(pairs) / len(pairs))
    assert best.mean_auc == pytest.approx(sum(aucs) / len(aucs), abs=1e-9)


def test_points_that_differ_in_trees_share_a_run(spark, train):
    t = prep.stratified_folds(train)
    data = boost.blocks(t, COLS, boost.bin_edges(t, COLS), "team1_won")
    long, _ = boost.fit(data, [boost.Run(0, boost.Params(trees=6), 1)], [3, 6])
    short, _ = boost.fit(data, [boost.Run(0, boost.Params(trees=3), 1)], [3])
    assert held_out(long, 3) == held_out(short, 3) != held_out(long, 6)


def test_loss_per_round_and_importances(spark, train):
    """The staged losses, recomputed in DuckDB from the margins after each tree."""
    import duckdb
    import pandas as pd
    fitted = mtrain.fit_gbt(train, prep.class_weights(train), {k: v[:1] for k, v in GRID.items()}, COLS)
    rows = prep.time_split(train, share=prep.FINAL_FIT_SHARE).where("not is_train").toPandas()
    x = np.stack([np.searchsorted(e, rows[c].to_numpy(), side="left") for e, c in zip(fitted.model.edges, COLS)])
    out = pd.DataFrame([(t, k, float(v)) for t, tree in enumerate(fitted.model.trees, start=1)
                        for k, v in enumerate(tree.leaf[tree.place(x)])], columns=["tree", "k", "v"])  # noqa: F841  read by the statement
    labels = pd.DataFrame({"k": range(len(rows)), "y": rows.team1_won})  # noqa: F841
    want = duckdb.sql("""SELECT r.i AS trees, avg(ln(1 + exp(CASE WHEN y = 1 THEN -m ELSE m END))) AS loss FROM (
        SELECT r.i, l.k, l.y, COALESCE(sum(o.v), 0) AS m FROM range(0, 4) r(i), labels l LEFT JOIN out o ON o.k = l.k AND o.tree <= r.i
        GROUP BY ALL) r GROUP BY 1 ORDER BY 1""").df()
    got = fitted.losses.orderBy("trees").toPandas()
    assert got.trees.tolist() == want.trees.tolist() == [0, 1, 2, 3]
    assert got.log_loss.tolist() == pytest.approx(want.loss.tolist(), abs=1e-9)
    share = fitted.model.importances()
    assert sum(share.values()) == pytest.approx(1.0) and max(share, key=share.get) in ("a", "b")
    again = boost.Boosted.from_table(fitted.model.table(spark), COLS)
    values = rows[COLS].to_numpy()
    assert again.probabilities(values) == pytest.approx(fitted.model.probabilities(values))


def test_one_class_or_few_rows_still_fit(spark):
    t = spark.createDataFrame([(k, "2024-01-01", 0.0, 1.0, 1.0, 1) for k in range(7)],
                              "match_id long, match_date string, a double, b double, c double, team1_won int")
    w = spark.createDataFrame([(0, 1.0), (1, 1.0)], "label int, weight double")
    fitted = mtrain.fit_gbt(t, w, {k: v[:1] for k, v in GRID.items()}, COLS)
    assert fitted.search.head().mean_auc is None and all(v == 0 for v in fitted.model.importances().values())
    assert mtrain.importance_table(fitted.model).count() == 3


def test_the_default_grid_is_the_full_one():
    assert len(boost.points(boost.GRID)) == 108
    assert mtrain.fit_gbt.__defaults__[0] is boost.GRID


def test_rejected_matches_leave_the_others_alone(spark):
    rows = []
    for k in range(6):
        values = [0.5] * len(FEATURE_COLS)
        if k == 1:
            values[0] = None
        if k == 2:
            values[3] = float("nan")
        rows.append((k, [None, "A", "A", " ", "A", "A"][k], "A" if k == 4 else "B", *values))
    schema = "match_id int, team1 string, team2 string, " + ", ".join(f"{c} double" for c in FEATURE_COLS)
    seen = []

    def score(good):
        seen.extend(r.match_id for r in good.collect())
        return good.withColumn("score", F.lit(0.25))
    got = {r.match_id: (r.team1_win_prob, r.error_message) for r in
           mtrain.scored_with_rejects(spark.createDataFrame(rows, schema), score, "m").collect()}
    assert seen == [5] and got == {
        0: (None, "Unknown team: team1"), 1: (None, f"Missing feature: {FEATURE_COLS[0]}"), 2: (None, f"Missing feature: {FEATURE_COLS[3]}"),
        3: (None, "Unknown team: team1"), 4: (None, "Team plays itself"), 5: (25.0, None)}


def test_the_certificate_tells_a_wrong_optimum(spark, train):
    t = train.select("match_id", "match_date", "team1_won", *[F.col(COLS[k % 3]).alias(c) if k < 3 else (F.col("a") * k + F.col("b") + k).alias(c)
                                                             for k, c in enumerate(FEATURE_COLS)])
    stats, weights = prep.scale_stats(t), prep.class_weights(t)
    model = mtrain.train_logistic(t, stats, weights)
    assert all(r.optimal for r in mtrain.logistic_gradient(model, t, stats, weights).collect())
    from types import SimpleNamespace
    off = SimpleNamespace(coefficients=SimpleNamespace(toArray=lambda: model.coefficients.toArray() + 0.1), intercept=model.intercept)
    assert not all(r.optimal for r in mtrain.logistic_gradient(off, t, stats, weights).collect())


def test_the_task_that_holds_a_fold_ranks_it(spark, train):
    from kestrel.ml import metrics
    rng = np.random.default_rng(4)
    for n in (0, 1, 300):
        margin, label = np.round(rng.normal(size=n), 1), rng.integers(0, 2, n).astype(np.uint8)
        less = margin[label == 1][:, None] - margin[label == 0][None, :]
        assert boost.ranked(margin, label) == (int(2 * (less > 0).sum() + (less == 0).sum()), int(label.sum()), int((label == 0).sum()))
    t = prep.stratified_folds(train)
    data = boost.blocks(t, COLS, boost.bin_edges(t, COLS), "team1_won")
    runs = [boost.Run(0, boost.Params(1.0, 0.3, 2, 4, 0.8), 0), boost.Run(1, boost.Params(0.7, 0.1, 2, 4, 1.0), 1)]
    every, _ = boost.fit(data, runs, [2, 4])
    bare, _ = boost.fit(data, runs, [2, 4], margins=False)
    rows = every.select("run", "trees", F.explode(F.arrays_zip("label", "margin")).alias("r")).select("run", "trees", "r.label", "r.margin")
    auc = lambda df: sorted(map(tuple, df.collect()))
    assert auc(metrics.auc_of(bare, ("run", "trees"))) == auc(metrics.auc_by(rows, ("run", "trees"), "label", "margin"))
    held = {r.run: len(r.margin) for r in every.collect()}
    assert all(len(r.margin) == len(r.label) == 0 and r.held == held[r.run] > 70 for r in bare.collect())


def test_sums_of_many_rows_are_those_of_every_feature():
    rng = np.random.default_rng(6)
    n = 40_000
    x = rng.integers(0, boost.BINS, (5, n)).astype(np.uint8)
    block = boost.Block(x, rng.integers(0, 2, n).astype(np.uint8), np.ones(n), rng.integers(0, 5, n).astype(np.uint8), np.arange(n))
    features = np.array([0, 2, 3, 4])
    for share in (0.8, 1.0):
        grower = boost.Grower(block, boost.Run(0, boost.Params(rows=share), 1), rng.normal(size=n))
        for turn in range(2):
            grower.begin(turn)
            sums = grower.sums(0, features)
            grower.split(np.array([2]), np.array([40]))
            below = grower.sums(1, features, sums)
            for got, nodes in ((sums, 1), (below, 2)):
                node = grower.node[grower.rows] if nodes == 2 else np.zeros(len(grower.rows), dtype=int)
                for k, f in enumerate(features):
                    for part, w in zip(got, (grower.g, grower.h)):
                        assert np.array_equal(part[:, k].ravel(), np.bincount(node * boost.BINS + x[f][grower.rows], w, nodes * boost.BINS))
