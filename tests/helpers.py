"""Small builders for hand-made domain rows."""

import datetime as dt



MATCH_SCHEMA = ("match_id long, name string, status string, venue string, match_date date, team1 string, "
                "team2 string, toss_winner string, winner string")
STAT_SCHEMA = ("match_id long, player_name string, team string, role string, runs int, balls_faced int, fours int, "
               "sixes int, strike_rate decimal(6,2), wickets int, overs_bowled decimal(5,1), economy decimal(5,2)")


def day(n: int) -> dt.date:
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def matches_df(spark, rows):
    """rows: (match_id, day_no, team1, team2, winner[, venue, toss_winner, status])."""
    out = []
    for r in rows:
        mid, d, t1, t2, w = r[:5]
        venue = r[5] if len(r) > 5 else "V"
        toss = r[6] if len(r) > 6 else None
        status = r[7] if len(r) > 7 else "completed"
        out.append((mid, f"{t1} vs {t2}", status, venue, day(d), t1, t2, toss, w))
    return spark.createDataFrame(out, MATCH_SCHEMA)


def stats_df(spark, rows):
    """rows: (match_id, player, team, role, runs, balls, fours, sixes, sr, wickets, overs, economy)."""
    from decimal import Decimal
    out = [(r[0], r[1], r[2], r[3], r[4], r[5], r[6], r[7], Decimal(str(r[8])), r[9], Decimal(str(r[10])),
            Decimal(str(r[11]))) for r in rows]
    return spark.createDataFrame(out, STAT_SCHEMA)


def bat(mid, player, team, runs, balls, sr, fours=0, sixes=0):
    return (mid, player, team, "batting", runs, balls, fours, sixes, sr, 0, 0.0, 0.0)


def bowl(mid, player, team, wickets, overs, economy):
    return (mid, player, team, "bowling", 0, 0, 0, 0, 0.0, wickets, overs, economy)


def rows_by(df, *keys):
    if len(keys) == 1:
        return {r[keys[0]]: r.asDict() for r in df.collect()}
    return {tuple(r[k] for k in keys): r.asDict() for r in df.collect()}


def col_list(df, c, order):
    return [r[c] for r in df.orderBy(*order).collect()]



