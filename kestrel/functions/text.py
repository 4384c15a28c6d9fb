"""Scalar column functions: ids, keys, labels, buckets and defaults
(F1, F2, F3, F4, F5, F6, F7, F8, F15, F16, F17, F18, F19, F24, F25).

All are built-in Column expressions (JVM side, inside whole-stage codegen).
NULL handling is explicit because ``concat`` with NULL is NULL in Spark (Q23).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the labelling rules.
ID_HEX_CHARS = 12
NULL_TOKEN = "nan"                     # how a missing CSV value prints in the id text
STATUS_LIVE_WORDS = ["progress", "live"]
STATUS_DONE_WORDS = ["final", "result"]
STATUS_DEFAULT = "Scheduled"
GAUGE_BANDS = [(0, 40, "low"), (40, 60, "even"), (60, 100, "high")]
QUADRANT_WICKETS = 1.0
QUADRANT_ECONOMY = 8.0
RADAR_AXES = ["Runs", "Strike Rate", "Fours", "Sixes", "Innings"]
RADAR_SCALE = {"avg_runs": 1.0, "avg_sr": 0.5, "total_fours": 1.0, "total_sixes": 3.0, "innings": 5.0}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalise_header(name: str) -> str:
    """strip, lower-case, spaces to underscores (driver-side rename)."""
    return name.strip().lower().replace(" ", "_")


def match_hash_id(date, team1, team2, venue, null_token: str = NULL_TOKEN) -> Column:
    """first 12 hex chars of md5("date_team1_team2_venue"); a missing
    part prints as ``null_token``."""
    parts = [F.coalesce(_c(x).cast("string"), F.lit(null_token)) for x in (date, team1, team2, venue)]
    return F.substring(F.md5(F.concat_ws("_", *parts)), 1, ID_HEX_CHARS)


def cache_key(*args) -> Column:
    """md5 of the arguments' text joined by '|' (NULL prints 'None')."""
    return F.md5(F.concat_ws("|", *[F.coalesce(_c(a).cast("string"), F.lit("None")) for a in args]))


def versus_name(team1, team2) -> Column:
    """"A vs B"."""
    return F.concat(F.coalesce(_c(team1), F.lit("")), F.lit(" vs "), F.coalesce(_c(team2), F.lit("")))


def date_prefix(text) -> Column:
    """the first 10 characters of a date-time text ('' when missing)."""
    return F.substring(F.coalesce(_c(text), F.lit("")), 1, 10)


def status_bucket(status) -> Column:
    """live / finished / scheduled by case-insensitive substring; NULL or
    '' status counts as "Scheduled"."""
    s = F.lower(F.coalesce(F.nullif(_c(status), F.lit("")), F.lit(STATUS_DEFAULT)))
    live = F.lit(False)
    for w in STATUS_LIVE_WORDS:
        live = live | s.contains(w)
    done = F.lit(False)
    for w in STATUS_DONE_WORDS:
        done = done | s.contains(w)
    return F.when(live, "live").when(done, "finished").otherwise("scheduled")


def insight_kind(status, winner) -> Column:
    """"live" if status mentions progress/live, else "post" when a
    winner is set (non-empty), else "pre"."""
    s = F.lower(F.coalesce(_c(status), F.lit("")))
    live = s.contains("progress") | s.contains("live")
    has_winner = F.coalesce(F.length(_c(winner)) > 0, F.lit(False))
    return F.when(live, "live").when(has_winner, "post").otherwise("pre")


# Year first, else month first; day first only where the first number is no month.
DATE_FORMATS = ("yyyy-M-d", "yyyy/M/d", "M-d-yyyy", "M/d/yyyy", "d-M-yyyy", "d/M/yyyy",
                "d MMM yyyy", "MMM d, yyyy", "d MMMM yyyy", "MMMM d, yyyy")


def lenient_date(text, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """F8: parse a date written in any of ``formats``, with or without a time of
    day after it (``T`` or a space, then ``h:mm``...); unparseable -> NULL."""
    t = F.regexp_replace(F.trim(_c(text).cast("string")), r"[T ]+\d{1,2}:\d{2}.*$", "")
    return F.coalesce(*[F.try_to_date(t, f) for f in formats])


def or_default(col, default: str) -> Column:
    """``x or default`` -- NULL and '' both take the default."""
    return F.coalesce(F.nullif(_c(col), F.lit("")), F.lit(default))


def percent(prob, digits: int = 1) -> Column:
    """F16: probability -> percent rounded half-even to ``digits``."""
    scale = float(10 ** digits)
    return F.rint(_c(prob) * F.lit(100.0) * F.lit(scale)) / F.lit(scale) + F.lit(0.0)


def gauge_band(pct) -> Column:
    """[0,40) low, [40,60) even, [60,100] high (left-closed bands)."""
    p = _c(pct)
    return (F.when((p >= 0) & (p < 40), "low").when((p >= 40) & (p < 60), "even")
            .when((p >= 60) & (p <= 100), "high"))


def radar_axes(avg_runs, avg_sr, total_fours, total_sixes, innings) -> Column:
    """the five radar values on one scale (runs, SR/2, fours, sixes*3,
    innings*5); a missing stat counts 0."""
    vals = zip(RADAR_SCALE.values(), (avg_runs, avg_sr, total_fours, total_sixes, innings))
    return F.array(*[F.coalesce(_c(v).cast("double"), F.lit(0.0)) * F.lit(k) for k, v in vals])


def percent_delta(pct, even: float = 50.0) -> Column:
    """F16: percentage points above/below an even contest (1 dp text)."""
    p = _c(pct)
    return F.when(p.isNotNull(), F.concat(F.format_string("%.1f", F.rint((p - F.lit(even)) * 10) / 10),
                                          F.lit("% vs even")))


def streak_phrase(streak) -> Column:
    """"n win streak" / "n loss streak" / "no current streak"."""
    s = _c(streak)
    n = F.abs(s).cast("string")
    return (F.when(s > 0, F.concat(n, F.lit(" win streak")))
            .when(s < 0, F.concat(n, F.lit(" loss streak")))
            .otherwise(F.lit("no current streak")))


def innings_score(runs, wickets, overs) -> Column:
    """"runs/wickets" and "overs ov"."""
    return F.struct(F.concat(_c(runs).cast("string"), F.lit("/"), _c(wickets).cast("string")).alias("score"),
                    F.concat(_c(overs).cast("string"), F.lit(" ov")).alias("overs_text"))


def result_line(winner, toss_winner, status) -> Column:
    """"<winner> won" when a winner is set, else a toss line when the
    status mentions the toss or a toss winner is known, else NULL."""
    w, t = _c(winner), _c(toss_winner)
    has_w = F.coalesce(F.length(w) > 0, F.lit(False))
    toss = F.lower(F.coalesce(_c(status), F.lit(STATUS_DEFAULT))).contains("toss") | \
        F.coalesce(F.length(t) > 0, F.lit(False))
    return (F.when(has_w, F.concat(w, F.lit(" won")))
            .when(toss, F.concat(F.lit("Toss: "), F.coalesce(t, F.lit("None")), F.lit(" won the toss"))))


def bowler_quadrant(avg_wickets, avg_economy) -> Column:
    """quadrant of a bowler against the guide lines 1.0 wicket / 8.0
    economy."""
    wk, eco = _c(avg_wickets) >= QUADRANT_WICKETS, _c(avg_economy) <= QUADRANT_ECONOMY
    return (F.when(wk & eco, "strike_and_control").when(wk, "strike")
            .when(eco, "control").otherwise("neither"))
