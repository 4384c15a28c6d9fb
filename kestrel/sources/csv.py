"""CSV sources of the history load (S1 matches, S2/S3 deliveries).

Headers are normalised once on the driver (F3) and columns are typed with
``try_cast``, so a bad cell never ends the load; the two ball-log variants (``batter``/``batsman``,
``player_dismissed``/``dismissal_kind``) are detected from the header.
``_row`` keeps the file order (used where the reference lets a later row
win).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.functions.text import normalise_header

MATCH_TEXT_COLUMNS = ["date", "team1", "team2", "venue", "toss_winner", "toss_decision", "winner"]


def read_csv_normalised(spark: SparkSession, path: str) -> DataFrame:
    """Header row, every column as text, normalised names, file order."""
    df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    # files by name, their blocks by position, a block's rows as they are read
    place = F.concat_ws("/", F.col("_metadata.file_path"), F.lpad(F.col("_metadata.file_block_start").cast("string"), 20, "0"),
                        F.lpad(F.monotonically_increasing_id().cast("string"), 20, "0"))
    return df.select(*[F.col(f"`{c}`").alias(normalise_header(c)) for c in df.columns], place.alias("_row"))


def read_matches_csv(spark: SparkSession, path: str) -> DataFrame:
    df = read_csv_normalised(spark, path)
    out = [F.col("id").try_cast("long").alias("id")] if "id" in df.columns else [F.lit(None).cast("long").alias("id")]
    for c in MATCH_TEXT_COLUMNS:
        out.append(F.col(c).cast("string").alias(c) if c in df.columns else F.lit(None).cast("string").alias(c))
    return df.select(*out, "_row")


def read_deliveries_csv(spark: SparkSession, path: str) -> DataFrame:
    """Typed ball log; the striker column keeps its variant name and
    the dismissal column is optional (see the scorecard operators). Lines with a
    cell that is no number are left out; :func:`delivery_rejects` has them."""
    df = read_csv_normalised(spark, path)
    return df.where(_bad_cells(df).isNull()).select(
        *[F.col(c).try_cast(WHOLE_NUMBERS[c]).alias(c) if c in WHOLE_NUMBERS else F.col(c)
          for c in df.columns if c != "_row"])


WHOLE_NUMBERS = {"match_id": "long", "ball": "int", "batsman_runs": "int", "total_runs": "int"}


def _bad_cells(df: DataFrame) -> Column:
    parts = [F.when(F.col(c).isNotNull() & F.col(c).try_cast(kind).isNull(), F.concat(F.lit(f"Cannot coerce {c}: "), F.col(c)))
             for c, kind in WHOLE_NUMBERS.items() if c in df.columns]
    return F.nullif(F.concat_ws("; ", *parts), F.lit(""))


def delivery_rejects(spark: SparkSession, path: str, source: str = "history") -> DataFrame:
    """K4 of the ball log: the lines that could not be typed, with the reason."""
    df = read_csv_normalised(spark, path)
    return df.select(F.lit(source).alias("source"), F.to_json(F.struct(*[c for c in df.columns if c != "_row"])).alias("raw_data"),
                     _bad_cells(df).alias("error_message"), F.current_timestamp().alias("logged_at")) \
        .where("error_message IS NOT NULL")
