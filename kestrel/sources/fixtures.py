"""Projection of the TPC-H-style test tables onto the domain tables.

``matches`` (one row per dated contest between two entities) comes from
``orders``; ``deliveries`` (one row per ball) from ``lineitem`` joined to
``matches``. The same projections are kept as SQL text so the DuckDB oracle
reads exactly the same domain rows.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the projection: 20 teams, 400 players, winner cut on price.
N_TEAMS = 20
N_PLAYERS = 400
WINNER_PRICE_CUT = 250000
EXTRA_DISCOUNT_CUT = 0.08
# Parquet bytes of a table, and balls, that one task takes after a shuffle.
PART_BYTES = 8 << 20
TASK_BALLS = 500_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def table_bytes(spark: SparkSession, sf_dir: str, name: str) -> int:
    """Bytes of a table's files, as the file system that holds them says (0: no such table)."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(os.path.join(sf_dir, f"{name}.parquet"))
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.getContentSummary(path).getLength() if fs.exists(path) else 0


def input_parts(spark: SparkSession, sf_dir: str, *names: str) -> int:
    """Partitions in which a shuffle of these tables keeps a task's share bounded."""
    return -(-sum(table_bytes(spark, sf_dir, n) for n in names) // PART_BYTES)


def _str(c: Column) -> Column:
    return c.cast("string")


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domain ``matches``: match_id, name, status, venue, match_date, team1,
    team2, toss_winner, winner (null = not finished, '' = no result)."""
    return project_matches(read_table(spark, sf_dir, "orders"))


def project_matches(orders: DataFrame) -> DataFrame:
    """The ``matches`` projection of an orders frame (batch or streaming)."""
    o = orders.select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
        "o_orderdate", "o_orderpriority")
    key = F.col("o_orderkey")
    team1 = F.concat(F.lit("T"), _str(F.col("o_custkey") % N_TEAMS))
    team2 = F.concat(F.lit("T"), _str((F.col("o_custkey") % N_TEAMS + 1 + key % 19) % N_TEAMS))
    is_open = F.col("o_orderstatus") == "O"
    return o.select(
        key.alias("match_id"),
        F.concat(team1, F.lit(" vs "), team2).alias("name"),
        F.when(is_open, "in progress").otherwise("completed").alias("status"),
        F.col("o_orderpriority").alias("venue"),
        F.col("o_orderdate").cast("date").alias("match_date"),
        team1.alias("team1"),
        team2.alias("team2"),
        F.when(key % 7 == 0, F.lit(None).cast("string"))
         .when(key % 2 == 0, team1).otherwise(team2).alias("toss_winner"),
        F.when(is_open, F.lit(None).cast("string"))
         .when(key % 50 == 0, F.lit(""))
         .when(F.col("o_totalprice") >= WINNER_PRICE_CUT, team1)
         .otherwise(team2).alias("winner"),
    )


def deliveries(spark: SparkSession, sf_dir: str, match_df: DataFrame | None = None) -> DataFrame:
    """Domain ball log: match_id, ball, batting_team, batter, bowler,
    batsman_runs, total_runs, player_dismissed."""
    m = (match_df if match_df is not None else matches(spark, sf_dir)).select(
        "match_id", "team1", "team2", "match_date")
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_discount", "l_returnflag")
    # one shuffle, of the narrow ball rows: the join and the aggregates per match
    # that follow all find their rows together; where the session's partitions would
    # be too large for a task's sort and hash maps, there are more of them
    # (adaptive execution joins partitions by their bytes, down to one per core, unless
    # their number is given; how many balls a byte holds depends on the files)
    n = max(input_parts(spark, sf_dir, "lineitem"), -(-li.count() // TASK_BALLS))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    more = n > min(parts, spark.sparkContext.defaultParallelism)
    li = li.repartition(max(n, parts), "l_orderkey") if more else li.repartition("l_orderkey")
    j = li.join(m, li.l_orderkey == m.match_id, "inner")
    batter = F.concat(F.lit("P"), _str(F.col("l_partkey") % N_PLAYERS))
    runs = F.col("l_quantity").cast("int") % 7
    return j.select(
        F.col("match_id"),
        F.col("match_date"),
        F.col("l_linenumber").alias("ball"),
        F.when(F.col("l_linenumber") % 2 == 1, F.col("team1")).otherwise(F.col("team2")).alias("batting_team"),
        batter.alias("batter"),
        F.concat(F.lit("P"), _str((F.col("l_suppkey") * 4 + F.col("l_linenumber")) % N_PLAYERS)).alias("bowler"),
        runs.alias("batsman_runs"),
        (runs + F.when(F.col("l_discount") > EXTRA_DISCOUNT_CUT, 1).otherwise(0)).alias("total_runs"),
        F.when(F.col("l_returnflag") == "R", batter).otherwise(F.lit(None).cast("string")).alias("player_dismissed"),
    )


# The same projections as SQL text (runs unchanged on Spark SQL and DuckDB).
MATCHES_SQL = """
select o_orderkey as match_id, concat(team1,' vs ',team2) as name,
 case when o_orderstatus='O' then 'in progress' else 'completed' end as status, venue, match_date, team1, team2,
 case when o_orderkey % 7 = 0 then cast(null as varchar) when o_orderkey % 2 = 0 then team1 else team2 end as toss_winner,
 case when o_orderstatus='O' then cast(null as varchar) when o_orderkey % 50 = 0 then '' when o_totalprice >= 250000 then team1 else team2 end as winner
from (select o_orderkey, o_orderstatus, o_totalprice, o_orderpriority as venue, cast(o_orderdate as date) as match_date,
 concat('T', cast(o_custkey % 20 as varchar)) as team1,
 concat('T', cast((o_custkey % 20 + 1 + o_orderkey % 19) % 20 as varchar)) as team2 from orders) b
"""

DELIVERIES_SQL = """
select l_orderkey as match_id, l_linenumber as ball,
 case when l_linenumber % 2 = 1 then m.team1 else m.team2 end as batting_team,
 concat('P', cast(l_partkey % 400 as varchar)) as batter, concat('P', cast((l_suppkey * 4 + l_linenumber) % 400 as varchar)) as bowler,
 cast(l_quantity as int) % 7 as batsman_runs,
 cast(l_quantity as int) % 7 + case when l_discount > 0.08 then 1 else 0 end as total_runs,
 case when l_returnflag='R' then concat('P', cast(l_partkey % 400 as varchar)) else cast(null as varchar) end as player_dismissed
from lineitem join matches m on m.match_id = l_orderkey
"""


def stream_table(spark: SparkSession, sf_dir: str, name: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """A test table as a streaming file source (the schema comes from the
    batch reader; a file source needs a folder or glob, hence ``[.]``)."""
    schema = read_table(spark, sf_dir, name).schema
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(os.path.join(sf_dir, f"{name}[.]parquet"))


# ---- captured payloads ---------------------------------------------------------------

EVENTS_PER_PAYLOAD = 500
FIRST_POLL = "2024-05-01 10:00:00"


def scoreboard_payloads(matches_df: DataFrame, poll: int) -> DataFrame:
    """The matches as scoreboard documents (fetched_at, events) of one poll.

    Poll 0 announces every match. Poll 1, a minute later, reports those with an
    even id as live, and some events that the validator must reject: without a
    name (every 97th id), with a short date (every 101st). Poll 2 has the outcome
    of all but every tenth match."""
    key = F.col("match_id")
    rows = matches_df if poll == 0 else matches_df.where(
        "match_id % 2 = 0 OR match_id % 97 = 0 OR match_id % 101 = 0") if poll == 1 else matches_df.where("match_id % 10 <> 0")
    bad_name, bad_date = (key % 97 == 0) & F.lit(poll == 1), (key % 101 == 0) & F.lit(poll == 1)
    status = [F.lit("Scheduled"), F.lit("In Progress"), F.initcap("status")][poll]
    winner = F.col("winner") if poll == 2 else F.lit(None).cast("string")

    def side(team: str):
        return F.struct((F.col(team) == F.coalesce(winner, F.lit("?"))).alias("winner"),
                        F.struct(F.col(team).alias("displayName")).alias("team"))
    date = F.date_format("match_date", "yyyy-MM-dd'T'14:00'Z'")
    event = F.struct(
        key.cast("string").alias("id"), F.when(bad_name, "").otherwise(F.col("name")).alias("name"),
        F.when(bad_date, "soon").otherwise(date).alias("date"),
        F.struct(F.struct(status.alias("description")).alias("type")).alias("status"),
        F.array(F.struct(F.struct(F.col("venue").alias("fullName")).alias("venue"),
                         F.array(side("team1"), side("team2")).alias("competitors"))).alias("competitions"))
    at = F.to_timestamp(F.lit(FIRST_POLL)) + F.make_dt_interval(mins=F.lit(poll))
    return rows.select((key / EVENTS_PER_PAYLOAD).cast("long").alias("doc"), key.alias("k"), event.alias("e")) \
        .groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("k", "e"))).alias("es")) \
        .select(at.alias("fetched_at"), F.transform("es", lambda x: x["e"]).alias("events"))


def scorecard_payloads(deliveries_df: DataFrame, poll: int) -> DataFrame:
    """One scorecard document per match and poll. Poll 0 has the lines with half
    their runs, poll 1 the final ones; in poll 1 every 97th match has one more
    batting line whose runs are no number."""
    from kestrel.operators.scorecards import batting_card, bowling_card
    text = lambda c: F.col(c).cast("string")
    person = lambda c, name: F.struct(F.col(c).alias("displayName")).alias(name)
    runs = text("runs") if poll else F.floor(F.col("runs") / 2).cast("string")
    bat = batting_card(deliveries_df).groupBy("match_id").agg(F.sort_array(F.collect_list(F.struct(
        person("player_name", "athlete"), person("team", "team"), runs.alias("runs"), text("balls_faced").alias("ballsFaced"),
        text("fours").alias("fours"), text("sixes").alias("sixes"), text("strike_rate").alias("strikeRate")))).alias("batting"))
    if poll:
        odd = F.struct(F.struct(F.lit("Extra").alias("displayName")).alias("athlete"),
                       F.struct(F.lit("T0").alias("displayName")).alias("team"), F.lit("x").alias("runs"),
                       *[F.lit("0").alias(c) for c in ("ballsFaced", "fours", "sixes", "strikeRate")])
        bat = bat.withColumn("batting", F.when(F.col("match_id") % 97 == 0, F.array_append("batting", odd))
                             .otherwise(F.col("batting")))
    bowl = bowling_card(deliveries_df).groupBy("match_id").agg(F.sort_array(F.collect_list(F.struct(
        person("player_name", "athlete"), person("team", "team"), text("wickets").alias("wickets"),
        text("overs_bowled").alias("overs"), text("economy").alias("economy")))).alias("bowling"))
    total = deliveries_df.groupBy("match_id", "batting_team").agg(
        F.sum("total_runs").alias("r"), F.count("player_dismissed").alias("w"), F.count("*").alias("n"))
    innings = total.groupBy("match_id").agg(F.sort_array(F.collect_list(F.struct(
        F.concat("batting_team", F.lit(" innings")).alias("displayName"), text("r").alias("runs"), text("w").alias("wickets"),
        (F.floor(F.col("n") / 6) + (F.col("n") % 6) / 10).cast("string").alias("overs")))).alias("scoring"))
    return innings.join(bat, "match_id").join(bowl, "match_id").select(
        F.col("match_id").cast("string").alias("match_id"),
        F.struct("scoring", "batting", "bowling").alias("gamepackageJSON"))
