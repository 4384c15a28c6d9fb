"""Row validation with a reject output (V1, V2, V3, K4) and rule checks on
the feature matrix (V4-V7).

Validation is set-wise: every rule is a column expression producing a reason
or NULL; reasons are joined with "; " in rule order. Rows are split into the
valid output and the reject table, never silently dropped.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

# Fixed values of the validators.
REQUIRED_MATCH_FIELDS = ["match_id", "name", "team1", "team2", "match_date"]
MIN_DATE_TEXT_LEN = 10
STAT_NUMERIC_FIELDS = [("runs", "int"), ("balls_faced", "int"), ("fours", "int"), ("sixes", "int"),
                       ("wickets", "int"), ("strike_rate", "double"), ("overs_bowled", "double"),
                       ("economy", "double")]
MAX_STRIKE_RATE = 500
MAX_RUNS = 200


def _missing(df: DataFrame, c: str) -> Column:
    if c not in df.columns:
        return F.lit(True)
    col = F.col(c)
    if isinstance(df.schema[c].dataType, StringType):
        return col.isNull() | (col == F.lit(""))
    return col.isNull()


def _reasons(parts: Sequence[Column]) -> Column:
    """Non-NULL reasons joined by "; " (NULL when there is none). concat_ws
    skips NULLs and stays inside whole-stage codegen."""
    msg = F.concat_ws("; ", *parts)
    return F.when(msg != F.lit(""), msg)


def validate_matches(raw: DataFrame) -> DataFrame:
    """V1: adds ``error_message`` (NULL when valid) and ``is_valid``.

    Reasons in order: each missing required field, a date whose text is
    shorter than 10 characters (a NULL date prints as "None"), identical teams
    (NULL-safe, as two missing teams compare equal).
    """
    parts = [F.when(_missing(raw, f), F.lit(f"Missing field: {f}")) for f in REQUIRED_MATCH_FIELDS]
    if "match_date" in raw.columns:
        txt = F.coalesce(F.col("match_date").cast("string"), F.lit("None"))
        parts.append(F.when((F.length(txt) > 0) & (F.length(txt) < MIN_DATE_TEXT_LEN),
                            F.concat(F.lit("Invalid date: "), txt)))
    t1 = F.col("team1") if "team1" in raw.columns else F.lit(None).cast("string")
    t2 = F.col("team2") if "team2" in raw.columns else F.lit(None).cast("string")
    parts.append(F.when(t1.eqNullSafe(t2), F.lit("team1 and team2 are identical")))
    msg = _reasons(parts)
    return raw.withColumn("error_message", msg).withColumn("is_valid", F.col("error_message").isNull())


def validate_player_stats(raw: DataFrame) -> DataFrame:
    """V2: coerce the 8 numeric fields (NULL -> 0), flag failed coercions,
    negatives, strike rate > 500 and runs > 200. Coerced values replace the
    raw ones; a failed coercion (text, NaN or an overflow in a whole-number
    field) leaves NULL and only its own reason (Q15), and never fails the job.
    NaN passes the range checks as in the reference (Q26). ``is_valid`` is read off
    the rules, not off the text, so that a plan that keeps the valid rows builds no
    text (and stays small enough to be compiled)."""
    broken = [_missing(raw, "player_name")]      # none of these is ever NULL
    parts = [F.when(broken[0], F.lit("Missing player_name"))]
    coerced_cols = {}
    for f, typ in STAT_NUMERIC_FIELDS:
        src = F.col(f) if f in raw.columns else F.lit(None)
        if f in raw.columns and raw.schema[f].dataType.simpleString() == typ:     # nothing to coerce
            val = F.coalesce(src, F.lit(0).cast(typ))
            negative = val < 0
        else:
            is_num = f in raw.columns and isinstance(raw.schema[f].dataType, NumericType)
            coerced = src.try_cast(typ) if is_num else src.cast("string").try_cast(typ)
            val = F.when(src.isNull(), F.lit(0).cast(typ)).otherwise(coerced)
            uncoerced, negative = src.isNotNull() & coerced.isNull(), val.isNotNull() & (val < 0)
            parts.append(F.when(uncoerced, F.concat(F.lit(f"Cannot coerce {f}: "), src.cast("string"))))
            broken.append(uncoerced)
        parts.append(F.when(negative, F.lit(f"{f} is negative")))
        broken.append(negative)
        coerced_cols[f] = val
    # reasons read the raw values, so they are fixed before the values are replaced
    out = raw.withColumns({"_p0": F.concat_ws("; ", *parts), "_ok": ~reduce(or_, broken)}).withColumns(coerced_cols)
    sr, runs = F.col("strike_rate"), F.col("runs")
    high_sr = sr.isNotNull() & ~F.isnan(sr) & (sr > MAX_STRIKE_RATE)
    high_runs = runs.isNotNull() & (runs > MAX_RUNS)
    parts_sr = F.when(high_sr, F.concat(F.lit("Implausible strike_rate: "), sr.cast("string")))
    parts_runs = F.when(high_runs, F.concat(F.lit("Implausible runs in T20: "), runs.cast("string")))
    out = out.withColumn("error_message", _reasons([F.nullif(F.col("_p0"), F.lit("")), parts_sr, parts_runs]))
    return out.withColumn("is_valid", F.col("_ok") & ~high_sr & ~high_runs).drop("_p0", "_ok")


def split_valid(checked: DataFrame, source: str, data_cols: Sequence[str] | None = None):
    """(valid rows, K4 reject rows). Rejects: source, raw_data (JSON of the
    row), error_message, logged_at."""
    cols = list(data_cols) if data_cols else [c for c in checked.columns if c not in ("error_message", "is_valid")]
    valid = checked.filter(F.col("is_valid")).select(*cols)
    rejects = checked.filter(~F.col("is_valid")).select(
        F.lit(source).alias("source"),
        F.to_json(F.struct(*[F.col(c) for c in cols])).alias("raw_data"),
        F.col("error_message"),
        F.current_timestamp().alias("logged_at"))
    return valid, rejects


def load_tally(checked: DataFrame) -> DataFrame:
    """V3: success / failed counts of a load."""
    return checked.agg(F.count_if(F.col("is_valid")).alias("success"),
                       F.count_if(~F.col("is_valid")).alias("failed"))


# ---- V4-V7: invariants of the feature matrix --------------------------------

def matrix_checks(matrix: DataFrame, streak_bound: int = 10) -> DataFrame:
    """One row per rule: rule name and number of violating rows (0 = pass).

    V4 win rates in [0,1] (NULL fails), V5 team1_streak in
    [-streak_bound, streak_bound], V6 unique match_id, V7 target in {0,1} and
    h2h rates summing to 1.0 at 2 dp.
    """
    def outside(c: str, lo, hi) -> Column:
        return F.count_if(~F.coalesce(F.col(c).between(lo, hi), F.lit(False)))
    h2h_sum = F.rint((F.col("team1_h2h_win_rate") + F.col("team2_h2h_win_rate")) * 100) / 100
    agg = matrix.agg(
        outside("team1_win_rate", 0, 1).alias("v4_team1_win_rate_range"),
        outside("team2_win_rate", 0, 1).alias("v4_team2_win_rate_range"),
        outside("team1_streak", -streak_bound, streak_bound).alias("v5_team1_streak_range"),
        (F.count(F.lit(1)) - F.count_distinct("match_id")).alias("v6_duplicate_match_id"),
        F.count_if(~F.coalesce(F.col("team1_won").isin(0, 1), F.lit(False))).alias("v7_target_domain"),
        F.count_if(~F.coalesce(h2h_sum == 1.0, F.lit(False))).alias("v7_h2h_complement"))
    names = ["v4_team1_win_rate_range", "v4_team2_win_rate_range", "v5_team1_streak_range",
             "v6_duplicate_match_id", "v7_target_domain", "v7_h2h_complement"]
    stack = ", ".join(f"'{n}', cast({n} as bigint)" for n in names)
    return agg.selectExpr(f"stack({len(names)}, {stack}) as (rule, violations)")
