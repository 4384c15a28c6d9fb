"""Classifier evaluation as aggregates over a scored frame (M11 metrics,
M12 per-class report, M13 model comparison, M14 ROC points and AUC, M15
calibration, M16 threshold predictions).

Everything reduces to counts: per distinct score (positives, negatives),
then a cumulative window over the distinct scores -- one row per distinct
score, so the ordered window never sees the fact table. Ratios of counts
are one IEEE division each, so any engine gives the same numbers. The AUC
is the rank statistic with average ranks for ties (the exact value the
trapezoid rule gives on the full ROC curve).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.functions.numeric import ratio_round
from kestrel.operators.ranges import running_sums

THRESHOLD = 0.5
CALIBRATION_BINS = 5


def confusion(scored: DataFrame, label: str, score: str = "score", threshold: float = THRESHOLD) -> DataFrame:
    p = F.col(score) >= threshold
    y = F.col(label) == 1
    return scored.agg(F.count_if(~y & ~p).alias("tn"), F.count_if(~y & p).alias("fp"),
                      F.count_if(y & ~p).alias("fn"), F.count_if(y & p).alias("tp"))


def score_counts(scored: DataFrame, label: str, score: str = "score") -> DataFrame:
    """Per distinct score: positives and negatives (small: one row per score)."""
    return scored.groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(label) == 1).alias("p"),
                                                      F.count_if(F.col(label) != 1).alias("q"))


def _safe(num: Column, den: Column, digits: int) -> Column:
    return F.when(den > 0, ratio_round(num, den, digits)).otherwise(F.lit(0.0))


def _prefix(counts: DataFrame, cols: list[str], descending: bool, inclusive: bool, by: tuple[str, ...] = ()) -> DataFrame:
    """Running sums of ``cols`` over the distinct scores (of each ``by``), by ranges
    of the score that hold a bounded number of them however scores crowd."""
    return running_sums(counts, list(by), [F.desc("s") if descending else F.asc("s")], cols, inclusive)


def auc_numerator(counts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """2 * sum over scores of p_s * (negatives below s + q_s / 2)."""
    c = _prefix(counts, ["q"], descending=False, inclusive=False, by=by)
    return c.groupBy(*by).agg(F.sum(F.col("p") * (F.lit(2) * F.col("_cum_q") + F.col("q"))).alias("auc2"),
                              F.sum("p").alias("npos"), F.sum("q").alias("nneg"))


def auc_by(scored: DataFrame, by: tuple[str, ...], label: str, score: str = "score") -> DataFrame:
    """The AUC of each ``by`` (NULL without both classes): (by, auc)."""
    counts = scored.groupBy(*by, F.col(score).alias("s")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) != 1).alias("q"))
    return auc_of(auc_numerator(counts, by), by)


def auc_of(counted: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """(by, auc) of the numbers of :func:`auc_numerator`."""
    pairs = F.lit(2) * F.col("npos") * F.col("nneg")
    return counted.select(*by, F.when(pairs > 0, F.col("auc2") / pairs).alias("auc"))


def binary_metrics(scored: DataFrame, label: str, score: str = "score", model: str = "model",
                   threshold: float = THRESHOLD, digits: int = 3) -> DataFrame:
    """Accuracy, ROC-AUC, precision, recall, F1 (zero_division = 0) and
    the confusion counts, one row."""
    au = auc_numerator(score_counts(scored, label, score)).select(F.struct("auc2", "npos", "nneg")).scalar()
    cm = confusion(scored, label, score, threshold).select(
        "*", au["auc2"].alias("auc2"), au["npos"].alias("npos"), au["nneg"].alias("nneg"))
    c = F.col
    n = c("tn") + c("fp") + c("fn") + c("tp")
    return cm.select(
        F.lit(model).alias("model"),
        _safe(c("tp") + c("tn"), n, digits).alias("accuracy"),
        _safe(c("auc2"), F.lit(2) * c("npos") * c("nneg"), digits).alias("auc"),
        _safe(c("tp"), c("tp") + c("fp"), digits).alias("precision"),
        _safe(c("tp"), c("tp") + c("fn"), digits).alias("recall"),
        _safe(F.lit(2) * c("tp"), F.lit(2) * c("tp") + c("fp") + c("fn"), digits).alias("f1"),
        "tn", "fp", "fn", "tp")


def class_report(scored: DataFrame, label: str, score: str = "score", threshold: float = THRESHOLD,
                 digits: int = 3) -> DataFrame:
    """Precision / recall / F1 / support for each class, then the macro
    and support-weighted averages."""
    cm = confusion(scored, label, score, threshold)
    c = F.col

    def cls(name: str, tp: Column, fp: Column, fn: Column, support: Column) -> Column:
        return F.struct(F.lit(name).alias("label"),
                        _safe(tp, tp + fp, 6).alias("precision"), _safe(tp, tp + fn, 6).alias("recall"),
                        _safe(F.lit(2) * tp, F.lit(2) * tp + fp + fn, 6).alias("f1"), support.alias("support"))
    rows = cm.select(F.explode(F.array(
        cls("0", c("tn"), c("fn"), c("fp"), c("tn") + c("fp")),
        cls("1", c("tp"), c("fp"), c("fn"), c("tp") + c("fn")))).alias("r")).select("r.*")
    avg = rows.agg(*[F.avg(m).alias(f"macro_{m}") for m in ("precision", "recall", "f1")],
                   *[F.sum(F.col(m) * F.col("support")).alias(f"w_{m}") for m in ("precision", "recall", "f1")],
                   F.sum("support").alias("n"))
    rnd = lambda x: F.rint(x * F.lit(10.0 ** digits)) / F.lit(10.0 ** digits) + F.lit(0.0)
    macro = avg.select(F.lit("macro avg").alias("label"), *[rnd(F.col(f"macro_{m}")).alias(m)
                                                             for m in ("precision", "recall", "f1")], "n")
    weighted = avg.select(F.lit("weighted avg").alias("label"),
                          *[rnd(F.col(f"w_{m}") / F.col("n")).alias(m) for m in ("precision", "recall", "f1")], "n")
    per = rows.select("label", *[rnd(F.col(m)).alias(m) for m in ("precision", "recall", "f1")],
                      F.col("support").alias("n"))
    return per.unionByName(macro).unionByName(weighted).withColumnRenamed("n", "support")


def roc_points(scored: DataFrame, label: str, score: str = "score") -> DataFrame:
    """One ROC point per distinct score (threshold = that score,
    descending) plus the origin; fpr/tpr are exact count ratios."""
    counts = score_counts(scored, label, score)
    tot = counts.agg(F.struct(F.sum("p").alias("P"), F.sum("q").alias("N"))).scalar()
    cum = _prefix(counts, ["p", "q"], descending=True, inclusive=True) \
        .select("s", F.col("_cum_p").alias("tp"), F.col("_cum_q").alias("fp"))
    pts = cum.select(F.col("s").cast("double").alias("threshold"), (F.col("fp") / tot["N"]).alias("fpr"),
                     (F.col("tp") / tot["P"]).alias("tpr"))
    origin = counts.agg(F.count(F.lit(1)).alias("_c")).select(
        F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return origin.unionByName(pts)


def trapezoid_auc(scored: DataFrame, label: str, score: str = "score", digits: int = 3) -> DataFrame:
    """Area under the ROC points by the trapezoid rule. Between two points
    the false positives grow by q_s, and the true positives before and after sum
    to 2 * tp - p_s, so the running sums of the points are all it takes (whole
    numbers; no window over all points)."""
    c = _prefix(score_counts(scored, label, score), ["p"], descending=True, inclusive=True)
    area = c.agg(F.sum(F.col("q") * (F.lit(2) * F.col("_cum_p") - F.col("p"))).alias("a"), F.sum("p").alias("p"),
                 F.sum("q").alias("q"))
    return area.select((F.rint(F.col("a") / (F.lit(2) * F.col("p") * F.col("q")) * 10.0 ** digits) / 10.0 ** digits
                        + 0.0).alias("auc"))


def calibration(scored: DataFrame, label: str, score: str = "score", bins: int = CALIBRATION_BINS,
                score_scale: int = 10000) -> DataFrame:
    """Uniform bins; bin = number of inner edges strictly below the score;
    empty bins dropped. Mean score is computed from scores on a 10^-4 grid
    (exact integer sums)."""
    edges = [i / bins for i in range(1, bins)]
    b = sum([(F.col(score) > F.lit(e)).cast("int") for e in edges], F.lit(0))
    sc = F.rint(F.col(score) * F.lit(float(score_scale))).cast("long")
    g = scored.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum(sc).alias("_s"),
                                           F.count_if(F.col(label) == 1).alias("pos"))
    return g.select("bin", "n", (F.col("_s") / (F.col("n") * F.lit(float(score_scale)))).alias("mean_predicted"),
                    (F.col("pos") / F.col("n")).alias("fraction_positive"))


def compare_models(metrics: DataFrame, baseline: str, challenger: str) -> DataFrame:
    """The challenger wins only with a strictly higher AUC."""
    b = metrics.filter(F.col("model") == challenger).select("auc").scalar()
    a = metrics.filter(F.col("model") == baseline).select(F.col("auc").alias("a"))
    return a.select(F.when(b > F.col("a"), F.lit(challenger)).otherwise(F.lit(baseline)).alias("better_model"),
                    F.col("a").alias(f"auc_{baseline}"), b.alias(f"auc_{challenger}"))
