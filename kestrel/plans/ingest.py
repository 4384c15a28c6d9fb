"""C17 history load: raw match rows + raw ball log -> matches, player_stats
and the reject table, set-wise (one job, no per-row inserts).

raw matches --F8 date, F1 hash id, F4 name--> V1 --> K1 upsert (first-seen
name/venue/date/teams, latest status/winner) ; rejects (K4)
raw balls --A1/A2 cards--> J2 raw id -> hash id (last row wins) --> V2 -->
J3 match must exist --> player_stats ; rejects (K4)
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from kestrel.functions.text import NULL_TOKEN, lenient_date, match_hash_id, versus_name
from kestrel.operators import quality, scorecards
from kestrel.operators import upsert as up

MATCH_IMMUTABLE = ["name", "venue", "match_date", "team1", "team2", "toss_winner", "source"]
MATCH_MUTABLE = ["status", "winner"]
LOADED_STATUS = "completed"
ORPHAN_REASON = "Missing match"


def _text(c: str, nan_compat: bool):
    return F.coalesce(F.col(c), F.lit(NULL_TOKEN)) if nan_compat else F.col(c)


def raw_match_rows(raw: DataFrame, source: str = "history", nan_compat: bool = False) -> DataFrame:
    """Match records as the loader builds them. The id hashes the raw date
    text and names with 'nan' for missing parts; an unparseable date becomes
    the text 'nan' (so it fails the length check). ``nan_compat`` also turns
    missing names / winner into 'nan' as the reference's text conversion does
    (Q9); by default they stay NULL."""
    parsed = lenient_date(F.col("date"))
    return raw.select(
        F.col("id"), F.col("_row"),
        match_hash_id(F.col("date"), F.col("team1"), F.col("team2"), F.col("venue")).alias("match_id"),
        versus_name(F.coalesce(F.col("team1"), F.lit(NULL_TOKEN)), F.coalesce(F.col("team2"), F.lit(NULL_TOKEN)))
        .alias("name"),
        F.lit(LOADED_STATUS).alias("status"),
        _text("venue", nan_compat).alias("venue"),
        F.coalesce(F.date_format(parsed, "yyyy-MM-dd"), F.lit(NULL_TOKEN)).alias("match_date"),
        _text("team1", nan_compat).alias("team1"), _text("team2", nan_compat).alias("team2"),
        _text("toss_winner", nan_compat).alias("toss_winner"), _text("winner", nan_compat).alias("winner"),
        F.lit(source).alias("source"))


def ingest_history(raw_matches: DataFrame, raw_deliveries: DataFrame, existing: DataFrame | None = None,
                   source: str = "history", nan_compat: bool = False, bowling_team: str = "batting") -> dict:
    rows = raw_match_rows(raw_matches, source, nan_compat)
    checked = quality.validate_matches(rows)
    data_cols = ["match_id", "name", "status", "venue", "match_date", "team1", "team2", "toss_winner", "winner",
                 "source"]
    _, match_rej = quality.split_valid(checked, source, data_cols)
    incoming = checked.filter(F.col("is_valid")).select(*data_cols, "_row") \
        .withColumn("match_date", F.col("match_date").cast("date"))
    if existing is not None:
        before = "" if isinstance(rows.schema["_row"].dataType, StringType) else -1
        existing = existing.withColumn("_row", F.lit(before).cast(rows.schema["_row"].dataType))
    matches = up.upsert(existing, incoming, ["match_id"], MATCH_IMMUTABLE, MATCH_MUTABLE, ["_row"]).drop("_row")

    # Raw id -> hash id, a later row of the file wins for a repeated raw id
    id_map = rows.groupBy("id").agg(F.max_by("match_id", "_row").alias("hash_id"))
    raw_stats = scorecards.player_stats(raw_deliveries, bowling_team)
    mapped = raw_stats.join(id_map, raw_stats.match_id == id_map.id, "inner") \
        .drop("match_id", "id").withColumnRenamed("hash_id", "match_id")
    stat_checked = quality.validate_player_stats(mapped)
    stat_valid, stat_rej = quality.split_valid(stat_checked, source, scorecards.STAT_COLUMNS)
    # A stat line needs its match in the table
    stat_ok, orphans = up.fk_split(stat_valid, matches, "match_id")
    def refused(lines, reason):
        return lines.select(F.lit(source).alias("source"),
                            F.to_json(F.struct(*[F.col(c) for c in scorecards.STAT_COLUMNS])).alias("raw_data"),
                            reason.alias("error_message"), F.current_timestamp().alias("logged_at")) \
            .where("error_message IS NOT NULL")
    orphan_rej = refused(orphans, F.lit(ORPHAN_REASON)).unionByName(refused(stat_ok, scorecards.overflow_reason()))
    return {
        "matches": matches,
        "player_stats": scorecards.typed_stats(stat_ok),
        "rejects": match_rej.unionByName(stat_rej).unionByName(orphan_rej),
        "match_checks": checked,
        "stat_checks": stat_checked,
    }


def testdata_raw(matches: DataFrame, deliveries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The test tables shaped as the loader's CSV inputs (raw id, date text)."""
    raw_m = matches.select(F.col("match_id").alias("id"), F.date_format("match_date", "yyyy-MM-dd").alias("date"),
                           "team1", "team2", "venue", "toss_winner", F.lit(None).cast("string").alias("toss_decision"),
                           "winner", F.col("match_id").alias("_row"))
    return raw_m, deliveries
