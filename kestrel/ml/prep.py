"""Training-data preparation (M1 vector, M2 time split, M3 scaling stats,
M4 class weights, M8 stratified folds, P13 median fill, A15-A19 quality
report).

Global orderings (the 80/20 split by date, fold numbers by a hash order)
are computed without a single-task window: rows are grouped into ordered
buckets, bucket sizes give offsets through a small window, and row numbers
are taken within buckets (:func:`global_rank`).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrel.functions.numeric import ratio_round, round_half_even
from kestrel.plans.features import FEATURE_COLS, TARGET_COL

# Training share, folds and the seed of the fold order.
TRAIN_SHARE = 0.8
FINAL_FIT_SHARE = 0.85
N_FOLDS = 5
SEED = 42
IMBALANCE_WARN = 0.1
ROWS_PER_BUCKET = 20_000


def assemble(df: DataFrame, cols: Sequence[str] = FEATURE_COLS, out: str = "features") -> DataFrame:
    """M1: the fixed feature list as one vector column."""
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="keep").transform(df)


def global_rank(df: DataFrame, bucket: Column, order: Sequence[Column], part: Sequence[str] = ()) -> DataFrame:
    """``_rank``: 1-based position of each row in (bucket, order) order within
    ``part``. ``bucket`` must be monotone in the order (e.g. the date, or a
    hash prefix). Work per task is bounded by one bucket."""
    d = df.withColumn("_bk", bucket)
    sizes = d.groupBy(*part, "_bk").agg(F.count(F.lit(1)).alias("_bn"))
    wo = Window.partitionBy(*part).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    offs = sizes.withColumn("_off", F.coalesce(F.sum("_bn").over(wo), F.lit(0)))
    wr = Window.partitionBy(*part, "_bk").orderBy(*order)
    return (d.join(offs.select(*part, "_bk", "_off"), [*part, "_bk"], "inner")
             .withColumn("_rank", F.col("_off") + F.row_number().over(wr))
             .drop("_bk", "_off"))


def time_split(matrix: DataFrame, share: float = TRAIN_SHARE, date_col: str = "match_date",
               tiebreak: str = "match_id") -> DataFrame:
    """M2: ``is_train`` for the first int(share * n) rows by (date, id). The
    day that the cut falls in comes from the rows per day (a calendar's length);
    only that day's ids are ordered. The cut is applied as literals."""
    days = matrix.groupBy(F.col(date_col).alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy("d").collect()
    left = int(sum(r["n"] for r in days) * share)
    for r in days:
        if left < r["n"]:
            break
        left -= r["n"]
    else:
        return matrix.withColumn("is_train", F.lit(True))
    day = F.col(date_col).eqNullSafe(F.lit(r["d"]))
    before = F.col(date_col).isNull() if r["d"] is None else F.coalesce(F.col(date_col) < F.lit(r["d"]), F.lit(True))
    first = F.lit(False)
    if left:
        last = matrix.where(day).select(tiebreak).orderBy(tiebreak).limit(left).agg(F.max(tiebreak)).head()[0]
        first = F.col(tiebreak) <= F.lit(last)
    return matrix.withColumn("is_train", F.when(day, first).otherwise(before if r["d"] is not None else F.lit(False)))


def stratified_folds(df: DataFrame, label: str = TARGET_COL, key: str = "match_id", k: int = N_FOLDS,
                     seed: int = SEED) -> DataFrame:
    """M8: fold = (position within its class in md5(key, seed) order - 1) % k,
    so every fold gets the same share of each class (+-1 row). The hash prefix
    that deals the rows into windows grows with their number."""
    digits = max(3, math.ceil(math.log(max(df.count(), 1) / ROWS_PER_BUCKET + 1, 16)))
    h = F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))
    r = global_rank(df.withColumn("_h", h), F.substring("_h", 1, digits), [F.col("_h")], part=[label])
    return r.withColumn("fold", ((F.col("_rank") - 1) % k).cast("int")).drop("_rank", "_h")


MEDIAN_PARTS = 1024


def exact_medians(df: DataFrame, cols: Sequence[str]) -> dict[str, float | None]:
    """The exact median (mean of the two middle values) of every column, NULL and
    NaN left out; None for a column without values.

    Selection by counted ranges: the range that holds a middle value is cut into
    ``MEDIAN_PARTS`` parts, one aggregate counts the values of each part and keeps
    their extremes, and the part with the middle value is the next range. A pass
    shuffles and collects at most 2 x columns x ``MEDIAN_PARTS`` rows; no task ever
    holds the distinct values."""
    wide = df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(f"c{k}") for k, c in enumerate(cols)])
    first = wide.agg(*[f(F.col(f"c{k}")).alias(f"{n}{k}") for k in range(len(cols)) for n, f in (("n", F.count), ("a", F.min), ("b", F.max))]).head()
    # (column, place of the middle value) -> [values below the range, its least, its greatest value]
    at = {(k, p): [0, first[f"a{k}"], first[f"b{k}"]] for k in range(len(cols)) if first[f"n{k}"]
          for p in {(first[f"n{k}"] - 1) // 2, first[f"n{k}"] // 2}}
    while True:
        wanted = sorted({(k, lo, hi) for (k, _), (_, lo, hi) in at.items() if lo < hi})
        if not wanted:
            break
        inside = [F.when(F.col(f"c{k}").between(lo, hi), F.struct(
            F.lit(i).alias("i"), F.least(F.floor((F.col(f"c{k}") - lo) / (hi - lo) * MEDIAN_PARTS), F.lit(MEDIAN_PARTS - 1)).alias("p"),
            F.col(f"c{k}").alias("v"))) for i, (k, lo, hi) in enumerate(wanted)]
        parts: dict[tuple, list] = {w: [] for w in wanted}
        for r in wide.select(F.explode(F.array_compact(F.array(*inside))).alias("r")).groupBy("r.i", "r.p") \
                .agg(F.count(F.lit(1)).alias("n"), F.min("r.v").alias("a"), F.max("r.v").alias("b")).orderBy("i", "p").collect():
            parts[wanted[r["i"]]].append(r)
        for (k, place), state in at.items():
            below, lo, hi = state
            for r in parts.get((k, lo, hi), []):
                if below + r["n"] > place:
                    state[:] = [below, r["a"], r["b"]]
                    break
                below += r["n"]
    middle = {c: [at[k, p][1] for p in ((first[f"n{k}"] - 1) // 2, first[f"n{k}"] // 2)] if first[f"n{k}"] else None for k, c in enumerate(cols)}
    return {c: None if v is None else v[0] if v[0] == v[1] else 0.5 * v[0] + 0.5 * v[1] for c, v in middle.items()}


def medians(df: DataFrame, cols: Sequence[str] = FEATURE_COLS) -> DataFrame:
    """P13 input: exact median of every feature, as (feature, median) rows."""
    return df.sparkSession.createDataFrame(list(exact_medians(df, cols).items()), "feature string, median double")


def median_fill(df: DataFrame, cols: Sequence[str] = FEATURE_COLS, basis: DataFrame | None = None) -> DataFrame:
    """NULL features -> the column median of ``basis`` (default: the
    frame itself, as the reference does before splitting; pass the train
    rows for the leakage-free variant). The medians are fitted once
    and applied as literals."""
    med = exact_medians(df if basis is None else basis, cols)
    return df.select(*[F.coalesce(F.col(c), F.lit(med[c])).alias(c) if c in cols and med[c] is not None
                       else F.col(c) for c in df.columns])


def scale_stats(train: DataFrame, cols: Sequence[str] = FEATURE_COLS, scale: int = 10000) -> DataFrame:
    """M3: per feature, train mean and population standard deviation (0 ->
    1, as the reference's scaler does). Features carry at most 4 decimals,
    so sums run over exact integers (x * 10^4) and each statistic is one
    division -- identical in any engine and any summation order."""
    aggs = []
    for c in cols:
        v = F.rint(F.col(c).cast("double") * F.lit(float(scale))).cast("decimal(38,0)")
        aggs += [F.sum(v).alias(f"_s_{c}"), F.sum(v * v).alias(f"_q_{c}")]
    a = train.agg(F.count(F.lit(1)).alias("_n"), *aggs)
    rows = []
    for c in cols:
        n = F.col("_n").cast("decimal(38,0)")
        s, q = F.col(f"_s_{c}"), F.col(f"_q_{c}")
        mean = s.cast("double") / (F.col("_n").cast("double") * F.lit(float(scale)))
        var = (n * q - s * s).cast("double") / (F.col("_n").cast("double") * F.col("_n").cast("double")
                                                * F.lit(float(scale) * float(scale)))
        std = F.sqrt(var)
        rows.append(F.struct(F.lit(c).alias("feature"), mean.alias("mean"),
                             F.when(std == 0, F.lit(1.0)).otherwise(std).alias("std")))
    return a.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def standardise(df: DataFrame, stats: DataFrame, cols: Sequence[str] = FEATURE_COLS) -> DataFrame:
    """M3 apply: (x - mean) / std with the fitted train statistics (one
    value pair per feature, held as literals like any fitted scaler)."""
    st = {r["feature"]: (r["mean"], r["std"]) for r in stats.collect()}
    return df.select(*[((F.col(c) - F.lit(st[c][0])) / F.lit(st[c][1])).alias(c) if c in cols else F.col(c)
                       for c in df.columns])


def class_weights(train: DataFrame, label: str = TARGET_COL) -> DataFrame:
    """M4: weight 1.0 for class 0 and round(neg / pos, 3) for class 1."""
    a = train.agg(F.count_if(F.col(label) == 0).alias("neg"), F.count_if(F.col(label) == 1).alias("pos"))
    w1 = round_half_even(F.col("neg") / F.col("pos"), 3)
    return a.select(F.explode(F.array(F.struct(F.lit(0).alias("label"), F.lit(1.0).alias("weight")),
                                      F.struct(F.lit(1).alias("label"), w1.alias("weight")))).alias("r")) \
            .select("r.*")


def with_weights(df: DataFrame, weights: DataFrame, label: str = TARGET_COL, out: str = "weight") -> DataFrame:
    """Per-row weight column from the fitted class weights."""
    w = {int(r["label"]): float(r["weight"]) for r in weights.collect()}
    expr = F.lit(1.0)
    for k, v in w.items():
        expr = F.when(F.col(label) == k, F.lit(v)).otherwise(expr)
    return df.withColumn(out, expr)


# ---- A15-A19 feature quality report (C20) --------------------------------------------

def null_report(matrix: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Columns with NULLs: null_count and null_pct (2 dp)."""
    cols = list(cols or matrix.columns)
    a = matrix.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in cols])
    stack = ", ".join(f"'{c}', `{c}`" for c in cols)
    long = a.selectExpr("_n", f"stack({len(cols)}, {stack}) as (column, null_count)")
    return long.filter(F.col("null_count") > 0).select(
        "column", "null_count", ratio_round(F.col("null_count") * 100, F.col("_n"), 2).alias("null_pct"))


def target_balance(matrix: DataFrame, label: str = TARGET_COL) -> DataFrame:
    """Share of each target value (3 dp) and the imbalance flag."""
    a = matrix.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 1).alias("n1"),
                   F.count_if(F.col(label) == 0).alias("n0"))
    s1, s0 = ratio_round("n1", "n", 3), ratio_round("n0", "n", 3)
    return a.select(s1.alias("share_team1_won"), s0.alias("share_team1_lost"),
                    (F.abs(s1 - s0) > IMBALANCE_WARN).alias("imbalanced"))


def correlations(matrix: DataFrame, cols: Sequence[str] = FEATURE_COLS, label: str = TARGET_COL,
                 scale: int = 10000) -> DataFrame:
    """Pearson correlation of each feature with the target and its rank
    by |r| (NULL for a constant column). Features sit on a 10^-4 grid, so the
    moment sums are exact integers and r is one sqrt and one division:
    (n Sxy - Sx Sy) / sqrt((n Sxx - Sx^2)(n Syy - Sy^2))."""
    y = F.col(label).cast("decimal(38,0)")
    aggs = [F.count(F.lit(1)).cast("decimal(38,0)").alias("_n"), F.sum(y).alias("_sy"), F.sum(y * y).alias("_syy")]
    for c in cols:
        x = F.rint(F.col(c).cast("double") * F.lit(float(scale))).cast("decimal(38,0)")
        aggs += [F.sum(x).alias(f"_sx_{c}"), F.sum(x * x).alias(f"_sxx_{c}"), F.sum(x * y).alias(f"_sxy_{c}")]
    a = matrix.agg(*aggs)
    n, sy, syy = F.col("_n"), F.col("_sy"), F.col("_syy")
    rows = []
    for c in cols:
        sx, sxx, sxy = F.col(f"_sx_{c}"), F.col(f"_sxx_{c}"), F.col(f"_sxy_{c}")
        num = (n * sxy - sx * sy).cast("double")
        den = F.sqrt((n * sxx - sx * sx).cast("double") * (n * syy - sy * sy).cast("double"))
        rows.append(F.struct(F.lit(c).alias("feature"), F.when(den > 0, num / den).alias("corr")))
    long = a.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    w = Window.orderBy(F.desc_nulls_last(F.abs("corr")), "feature")      # 20 rows
    return long.select("feature", round_half_even("corr", 6).alias("corr"),
                       F.row_number().over(w).cast("long").alias("abs_rank"))


def matrix_summary(matrix: DataFrame) -> DataFrame:
    """Rows, distinct match ids, distinct teams, date range."""
    teams = matrix.select(F.explode(F.array("team1", "team2")).alias("t")).agg(F.count_distinct("t"))
    return matrix.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("match_id").alias("distinct_match_ids"),
                      F.min("match_date").alias("first_date"), F.max("match_date").alias("last_date")) \
        .withColumn("teams", teams.scalar())
