"""Deterministic scorer used where a checkable probability is needed.

``heuristic_score`` = 0.5 + win_rate_diff / 2 is a transparent stand-in for a
trained model's probability: the metric, prompt and report operators are
checked against SQL with it, and a trained model's ``probability`` column
slots into the same operators (see :mod:`kestrel.ml.train`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.functions.text import percent


def heuristic_score(win_rate_diff: str = "win_rate_diff") -> Column:
    return F.lit(0.5) + F.col(win_rate_diff) / F.lit(2.0)


def with_win_probs(features: DataFrame, score: Column | None = None) -> DataFrame:
    """team1/team2 win probability in percent (1 dp, half-even)."""
    s = heuristic_score() if score is None else score
    return (features.withColumn("_p", s)
            .withColumn("team1_win_prob", percent(F.col("_p")))
            .withColumn("team2_win_prob", percent(F.lit(1.0) - F.col("_p")))
            .drop("_p"))
