"""Independent DuckDB formulations of every registered query.

Each statement is written the straightforward way (whole-entity windows,
ASOF joins, correlated aggregates) so it checks our chunked Spark plans
rather than restating them. Shared CTEs project TESTDATA onto the domain.
"""

from __future__ import annotations

from kestrel.functions.numeric import sql_cents_ratio_round as CR
from kestrel.functions.numeric import sql_ratio_round as RR
from kestrel.functions.numeric import sql_round as RND
from kestrel.sources.fixtures import DELIVERIES_SQL, MATCHES_SQL

CTE_MATCHES = f"matches AS ({MATCHES_SQL})"
CTE_DELIVERIES = f"deliveries AS ({DELIVERIES_SQL})"
CTE_COMPLETED = "cm AS (SELECT * FROM matches WHERE winner IS NOT NULL AND winner <> '')"
CTE_TEAM_ROWS = """tr AS (
  SELECT match_id, match_date, venue, team1 AS team, team2 AS opponent, winner, toss_winner,
         CASE WHEN team1 = winner THEN 1 ELSE 0 END AS won,
         CASE WHEN team1 = toss_winner THEN 1 ELSE 0 END AS won_toss FROM cm
  UNION ALL
  SELECT match_id, match_date, venue, team2, team1, winner, toss_winner,
         CASE WHEN team2 = winner THEN 1 ELSE 0 END,
         CASE WHEN team2 = toss_winner THEN 1 ELSE 0 END FROM cm)"""

CTE_FORM_ROWS = f"""fr1 AS (
  SELECT team, match_id, match_date, won,
         SUM(won) OVER w5 AS wins5, COUNT(*) OVER w5 AS n5,
         ROW_NUMBER() OVER w AS played,
         CASE WHEN LAG(won) OVER w = won THEN 0 ELSE 1 END AS chg
  FROM tr
  WINDOW w AS (PARTITION BY team ORDER BY match_date, match_id),
         w5 AS (PARTITION BY team ORDER BY match_date, match_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
fr2 AS (SELECT *, SUM(chg) OVER (PARTITION BY team ORDER BY match_date, match_id ROWS UNBOUNDED PRECEDING) AS grp FROM fr1),
form_rows AS (
  SELECT team, match_id, match_date, won,
         {RR('wins5', 'n5', 3)} AS rolling_win_rate,
         CAST(ROW_NUMBER() OVER (PARTITION BY team, grp ORDER BY match_date, match_id)
              * CASE WHEN won = 1 THEN 1 ELSE -1 END AS INTEGER) AS streak,
         CAST(played AS BIGINT) AS matches_played
  FROM fr2)"""

CTE_FORM_ENDS = """form_ends AS (
  SELECT team, match_date, rolling_win_rate, streak, matches_played FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY team, match_date ORDER BY match_id DESC) AS rk FROM form_rows) x
  WHERE rk = 1)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


FORM_BASE = (CTE_MATCHES, CTE_COMPLETED, CTE_TEAM_ROWS, CTE_FORM_ROWS)

ORACLE: dict[str, str] = {}

ORACLE["W1_W2_W3_team_form_rows"] = with_ctes(*FORM_BASE) + """
SELECT team, match_id, match_date, won, rolling_win_rate, streak, matches_played FROM form_rows"""

ORACLE["C1_team_form"] = with_ctes(*FORM_BASE) + """
SELECT team, rolling_win_rate, streak, matches_played FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY team ORDER BY match_date DESC, match_id DESC) AS rk FROM form_rows) x
WHERE rk = 1"""

ORACLE["C2_team_form_asof"] = with_ctes(*FORM_BASE, CTE_FORM_ENDS) + """
SELECT s.match_id, s.match_date, s.team,
       COALESCE(e.rolling_win_rate, 0.5) AS rolling_win_rate,
       COALESCE(e.streak, 0) AS streak,
       COALESCE(e.matches_played, 0) AS matches_played
FROM tr s ASOF LEFT JOIN form_ends e ON s.team = e.team AND e.match_date < s.match_date"""

from kestrel.functions.numeric import sql_half_up_ratio as HU  # noqa: E402

CTE_CARDS = f"""bat AS (
  SELECT match_id, batter AS player_name, batting_team AS team,
         CAST(COALESCE(SUM(batsman_runs), 0) AS INTEGER) AS runs,
         CAST(COUNT(ball) AS INTEGER) AS balls_faced,
         CAST(COUNT(*) FILTER (WHERE batsman_runs = 4) AS INTEGER) AS fours,
         CAST(COUNT(*) FILTER (WHERE batsman_runs = 6) AS INTEGER) AS sixes
  FROM deliveries WHERE match_id IS NOT NULL AND batter IS NOT NULL AND batting_team IS NOT NULL
  GROUP BY match_id, batter, batting_team),
bat_card AS (SELECT *, {RND('CAST(runs AS DOUBLE) / balls_faced * 100.0', 2)} AS strike_rate FROM bat),
bowl AS (
  SELECT match_id, bowler AS player_name, batting_team AS team,
         CAST(COUNT(ball) AS INTEGER) AS balls_bowled,
         CAST(COALESCE(SUM(total_runs), 0) AS INTEGER) AS runs_given,
         CAST(COUNT(player_dismissed) AS INTEGER) AS wickets
  FROM deliveries WHERE match_id IS NOT NULL AND bowler IS NOT NULL AND batting_team IS NOT NULL
  GROUP BY match_id, bowler, batting_team),
bowl1 AS (SELECT *, {RND('CAST(balls_bowled AS DOUBLE) / 6.0', 1)} AS overs_bowled FROM bowl),
bowl_card AS (SELECT *, {RND('runs_given / CASE WHEN overs_bowled = 0 THEN 1.0 ELSE overs_bowled END', 2)} AS economy
              FROM bowl1)"""

CTE_PLAYER_STATS = """player_stats AS (
  SELECT match_id, player_name, team, 'batting' AS role, runs, balls_faced, fours, sixes,
         CAST(strike_rate AS DECIMAL(6,2)) AS strike_rate, 0 AS wickets,
         CAST(0 AS DECIMAL(5,1)) AS overs_bowled, CAST(0 AS DECIMAL(5,2)) AS economy
  FROM bat_card WHERE NOT (strike_rate > 500) AND NOT (runs > 200)
  UNION ALL
  SELECT match_id, player_name, team, 'bowling', 0, 0, 0, 0, CAST(0 AS DECIMAL(6,2)), wickets,
         CAST(overs_bowled AS DECIMAL(5,1)), CAST(economy AS DECIMAL(5,2))
  FROM bowl_card)"""

STATS_BASE = (CTE_MATCHES, CTE_DELIVERIES, CTE_CARDS, CTE_PLAYER_STATS)
_INNINGS = """inn AS (SELECT match_id, batting_team || ' innings' AS inning_name, CAST(SUM(total_runs) AS INTEGER) AS runs,
  COUNT(player_dismissed) AS wickets, COUNT(*) // 6 AS o, COUNT(*) % 6 AS b FROM deliveries GROUP BY 1, 2)"""

ORACLE["U1_team_rows"] = with_ctes(CTE_MATCHES, CTE_COMPLETED, CTE_TEAM_ROWS) + """
SELECT match_id, match_date, venue, team, opponent, won, won_toss FROM tr"""

ORACLE["A1_batting_scorecard"] = with_ctes(CTE_MATCHES, CTE_DELIVERIES, CTE_CARDS) + """
SELECT match_id, player_name, team, runs, balls_faced, fours, sixes, strike_rate FROM bat_card"""

ORACLE["A2_bowling_scorecard"] = with_ctes(CTE_MATCHES, CTE_DELIVERIES, CTE_CARDS) + """
SELECT match_id, player_name, team, balls_bowled, runs_given, wickets, overs_bowled, economy FROM bowl_card"""

ORACLE["A2_bowling_scorecard_fielding_side"] = with_ctes(CTE_MATCHES, CTE_DELIVERIES, CTE_CARDS) + """
SELECT b.match_id, b.player_name, CASE WHEN b.team = m.team1 THEN m.team2 ELSE m.team1 END AS team,
       b.balls_bowled, b.runs_given, b.wickets, b.overs_bowled, b.economy
FROM bowl_card b JOIN matches m ON m.match_id = b.match_id"""

_MATCH_REASONS = """NULLIF(CONCAT_WS('; ',
    CASE WHEN match_id IS NULL THEN 'Missing field: match_id' END,
    CASE WHEN name IS NULL OR name = '' THEN 'Missing field: name' END,
    CASE WHEN team1 IS NULL OR team1 = '' THEN 'Missing field: team1' END,
    CASE WHEN team2 IS NULL OR team2 = '' THEN 'Missing field: team2' END,
    CASE WHEN match_date IS NULL THEN 'Missing field: match_date' END,
    CASE WHEN length(COALESCE(CAST(match_date AS VARCHAR), 'None')) BETWEEN 1 AND 9
         THEN 'Invalid date: ' || COALESCE(CAST(match_date AS VARCHAR), 'None') END,
    CASE WHEN team1 IS NOT DISTINCT FROM team2 THEN 'team1 and team2 are identical' END), '')"""

ORACLE["V1_match_validation"] = with_ctes(CTE_MATCHES) + f"""
SELECT match_id, {_MATCH_REASONS} IS NULL AS is_valid, {_MATCH_REASONS} AS error_message FROM matches"""

ORACLE["V1_V3_match_validation_tally"] = with_ctes(CTE_MATCHES) + f"""
SELECT COUNT(*) FILTER (WHERE {_MATCH_REASONS} IS NULL) AS success,
       COUNT(*) FILTER (WHERE {_MATCH_REASONS} IS NOT NULL) AS failed FROM matches"""

ORACLE["V2_V3_stat_validation_tally"] = with_ctes(CTE_MATCHES, CTE_DELIVERIES, CTE_CARDS) + """
SELECT (SELECT COUNT(*) FILTER (WHERE NOT (strike_rate > 500) AND NOT (runs > 200)) FROM bat_card)
       + (SELECT COUNT(*) FROM bowl_card) AS success,
       (SELECT COUNT(*) FILTER (WHERE strike_rate > 500 OR runs > 200) FROM bat_card) AS failed"""

ORACLE["C12_batting_cards"] = with_ctes(*STATS_BASE) + """
SELECT match_id, player_name, team, runs, balls_faced, fours, sixes, CAST(strike_rate AS DOUBLE) AS strike_rate,
       ROW_NUMBER() OVER (PARTITION BY match_id ORDER BY runs DESC, player_name, team) AS card_order
FROM player_stats WHERE role = 'batting' AND balls_faced > 0"""

ORACLE["C12_bowling_cards"] = with_ctes(*STATS_BASE) + """
SELECT match_id, player_name, team, wickets, CAST(overs_bowled AS DOUBLE) AS overs_bowled,
       CAST(economy AS DOUBLE) AS economy,
       ROW_NUMBER() OVER (PARTITION BY match_id ORDER BY wickets DESC, economy ASC, player_name, team) AS card_order
FROM player_stats WHERE role = 'bowling' AND overs_bowled > 0"""

ORACLE["C13_recent_matches"] = with_ctes(CTE_MATCHES) + """
SELECT match_id, name, status, team1, team2, winner, venue, match_date, toss_winner
FROM matches ORDER BY match_date DESC, match_id DESC LIMIT 10"""

CTE_BATTER_SUMMARY = f"""bsum AS (
  SELECT ps.player_name, ps.team,
         {HU('SUM(ps.runs)', 'COUNT(*)', 1)} AS avg_runs,
         {HU('SUM(CAST(ps.strike_rate * 100 AS BIGINT))', 'COUNT(*) * 100', 1)} AS avg_sr,
         CAST(SUM(ps.fours) AS BIGINT) AS total_fours, CAST(SUM(ps.sixes) AS BIGINT) AS total_sixes,
         COUNT(*) AS innings, SUM(ps.runs) / COUNT(*) AS k
  FROM player_stats ps JOIN matches m ON ps.match_id = m.match_id
  WHERE ps.role = 'batting' AND ps.balls_faced > 0
  GROUP BY ps.player_name, ps.team HAVING COUNT(*) >= 2)"""

CTE_BOWLER_SUMMARY = f"""wsum AS (
  SELECT ps.player_name, ps.team,
         {HU('SUM(ps.wickets)', 'COUNT(*)', 1)} AS avg_wickets,
         {HU('SUM(CAST(ps.economy * 100 AS BIGINT))', 'COUNT(*) * 100', 2)} AS avg_economy,
         CAST(SUM(ps.wickets) AS BIGINT) AS total_wickets, COUNT(*) AS matches,
         SUM(ps.wickets) / COUNT(*) AS k, SUM(CAST(ps.economy * 100 AS BIGINT)) / COUNT(*) AS k2
  FROM player_stats ps JOIN matches m ON ps.match_id = m.match_id
  WHERE ps.role = 'bowling' AND ps.overs_bowled > 0
  GROUP BY ps.player_name, ps.team HAVING COUNT(*) >= 2)"""

ORACLE["A9_batter_summary"] = with_ctes(*STATS_BASE, CTE_BATTER_SUMMARY) + """
SELECT player_name, team, avg_runs, avg_sr, total_fours, total_sixes, innings FROM bsum"""

ORACLE["A10_bowler_summary"] = with_ctes(*STATS_BASE, CTE_BOWLER_SUMMARY) + """
SELECT player_name, team, avg_wickets, avg_economy, total_wickets, matches FROM wsum"""

ORACLE["C14_top_batters_per_pair"] = with_ctes(*STATS_BASE, CTE_BATTER_SUMMARY) + """
SELECT * FROM (
  SELECT p.team1, p.team2, b.player_name, b.team, b.avg_runs, b.avg_sr, b.total_fours, b.total_sixes, b.innings,
         ROW_NUMBER() OVER (PARTITION BY p.team1, p.team2 ORDER BY b.k DESC, b.player_name, b.team) AS rank
  FROM (SELECT DISTINCT team1, team2 FROM matches) p JOIN bsum b ON b.team IN (p.team1, p.team2)) x
WHERE rank <= 8"""

ORACLE["C14_top_bowlers_per_pair"] = with_ctes(*STATS_BASE, CTE_BOWLER_SUMMARY) + """
SELECT * FROM (
  SELECT p.team1, p.team2, b.player_name, b.team, b.avg_wickets, b.avg_economy, b.total_wickets, b.matches,
         ROW_NUMBER() OVER (PARTITION BY p.team1, p.team2 ORDER BY b.k DESC, b.k2 ASC, b.player_name, b.team) AS rank
  FROM (SELECT DISTINCT team1, team2 FROM matches) p JOIN wsum b ON b.team IN (p.team1, p.team2)) x
WHERE rank <= 8"""

ORACLE["C15_h2h_summary"] = with_ctes(CTE_MATCHES, CTE_COMPLETED) + f"""
SELECT team1, team2, total, team1_wins, team2_wins,
       CASE WHEN total > 0 THEN {RR('team1_wins * 100', 'total', 1)} ELSE 50.0 END AS team1_wr,
       CASE WHEN total > 0 THEN {RR('team2_wins * 100', 'total', 1)} ELSE 50.0 END AS team2_wr
FROM (
  SELECT p.team1, p.team2, COUNT(c.match_id) AS total,
         COUNT(*) FILTER (WHERE c.winner = p.team1) AS team1_wins,
         COUNT(*) FILTER (WHERE c.winner = p.team2) AS team2_wins
  FROM (SELECT DISTINCT team1, team2 FROM matches) p
  LEFT JOIN cm c ON (c.team1 = p.team1 AND c.team2 = p.team2) OR (c.team1 = p.team2 AND c.team2 = p.team1)
  GROUP BY p.team1, p.team2) x"""

ORACLE["A12_top_run_totals"] = with_ctes(*STATS_BASE) + """
SELECT player_name, team, CAST(SUM(runs) AS BIGINT) AS total_runs FROM player_stats WHERE role = 'batting'
GROUP BY player_name, team ORDER BY total_runs DESC, player_name, team LIMIT 5"""

_TABLE_COUNTS = f"""
SELECT 'matches' AS table_name, COUNT(*) AS row_count FROM matches
UNION ALL SELECT 'innings', COUNT(*) FROM inn
UNION ALL SELECT 'player_stats', COUNT(*) FROM player_stats
UNION ALL SELECT 'data_errors',
  (SELECT COUNT(*) FROM bat_card WHERE strike_rate > 500 OR runs > 200)
  + (SELECT COUNT(*) FROM matches WHERE {_MATCH_REASONS} IS NOT NULL)"""
ORACLE["A13_table_counts"] = with_ctes(*STATS_BASE, _INNINGS) + _TABLE_COUNTS

ORACLE["C12_innings_cards"] = with_ctes(*STATS_BASE, _INNINGS) + """
SELECT match_id, inning_name, runs, wickets, CAST(o || '.' || b AS DOUBLE) AS overs,
       ROW_NUMBER() OVER (PARTITION BY match_id ORDER BY inning_name) AS card_order FROM inn"""

# ---- matchups --------------------------------------------------------------------

ORACLE["C6_h2h_stats"] = with_ctes(CTE_MATCHES, CTE_COMPLETED) + f"""
SELECT team_a, team_b, total_matches, team_a_wins, team_b_wins,
       {RR('team_a_wins', 'total_matches', 3)} AS team_a_win_rate,
       {RR('team_b_wins', 'total_matches', 3)} AS team_b_win_rate
FROM (SELECT least(team1, team2) AS team_a, greatest(team1, team2) AS team_b, COUNT(*) AS total_matches,
             COUNT(*) FILTER (WHERE winner = least(team1, team2)) AS team_a_wins,
             COUNT(*) FILTER (WHERE winner = greatest(team1, team2)) AS team_b_wins
      FROM cm GROUP BY 1, 2) x"""

CTE_H2H_ASOF = f"""h2h AS (
  SELECT match_id, match_date, team1, team2, h2h_total,
         CASE WHEN h2h_total > 0 THEN {RND('CAST(a_w AS DOUBLE) / h2h_total', 3)} ELSE 0.5 END AS team1_h2h_win_rate,
         CASE WHEN h2h_total > 0 THEN {RND('1.0 - CAST(a_w AS DOUBLE) / h2h_total', 3)} ELSE 0.5 END AS team2_h2h_win_rate
  FROM (SELECT s.match_id, s.match_date, s.team1, s.team2, COUNT(c.match_id) AS h2h_total,
               COUNT(*) FILTER (WHERE c.winner = s.team1) AS a_w
        FROM spine s LEFT JOIN cm c
          ON ((c.team1 = s.team1 AND c.team2 = s.team2) OR (c.team1 = s.team2 AND c.team2 = s.team1))
         AND c.match_date < s.match_date
        GROUP BY s.match_id, s.match_date, s.team1, s.team2) x)"""

ORACLE["C7_h2h_asof"] = with_ctes(CTE_MATCHES, CTE_COMPLETED, "spine AS (SELECT * FROM cm)", CTE_H2H_ASOF) + """
SELECT * FROM h2h"""

CTE_VENUE = f"""vs AS (
  SELECT team, venue, COUNT(*) AS matches_at_venue, CAST(SUM(won) AS BIGINT) AS wins_at_venue,
         {RR('SUM(won)', 'COUNT(*)', 3)} AS venue_win_rate
  FROM tr WHERE venue IS NOT NULL GROUP BY team, venue)"""

CTE_TOSS = f"""ts AS (
  SELECT team, tw AS toss_win_rate, tl AS toss_loss_rate, {RND('tw - tl', 3)} AS toss_advantage FROM (
    SELECT team,
      CASE WHEN COUNT(*) FILTER (WHERE won_toss = 1) > 0
           THEN {RR('COUNT(*) FILTER (WHERE won_toss = 1 AND won = 1)', 'COUNT(*) FILTER (WHERE won_toss = 1)', 3)}
           ELSE 0.0 END AS tw,
      CASE WHEN COUNT(*) FILTER (WHERE won_toss = 0) > 0
           THEN {RR('COUNT(*) FILTER (WHERE won_toss = 0 AND won = 1)', 'COUNT(*) FILTER (WHERE won_toss = 0)', 3)}
           ELSE 0.0 END AS tl
    FROM tr WHERE toss_winner IS NOT NULL AND toss_winner <> '' GROUP BY team) x)"""

ORACLE["C8_venue_stats"] = with_ctes(CTE_MATCHES, CTE_COMPLETED, CTE_TEAM_ROWS, CTE_VENUE) + "SELECT * FROM vs"
ORACLE["C9_toss_impact"] = with_ctes(CTE_MATCHES, CTE_COMPLETED, CTE_TEAM_ROWS, CTE_TOSS) + "SELECT * FROM ts"

# ---- players ----------------------------------------------------------------------

def _feature_rows_cte(name: str, role_filter: str, f1: str, f2: str, f2_expr: str, extra: str) -> str:
    order = "PARTITION BY player_name ORDER BY match_date, match_id, team"
    return f"""{name}_l AS (
  SELECT ps.player_name, ps.team, ps.match_id, m.match_date, ps.{f1} AS {f1}, {f2_expr} AS {f2}{extra}
  FROM player_stats ps JOIN matches m ON ps.match_id = m.match_id WHERE {role_filter}),
{name}_1 AS (
  SELECT *, SUM({f1}) OVER ({order} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS s1,
         SUM({f2}) OVER ({order} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS s2,
         COUNT(*) OVER ({order} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS n5,
         ROW_NUMBER() OVER ({order}) AS seq,
         COALESCE(SUM({f2}) OVER ({order} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0) AS r3,
         COALESCE(SUM({f2}) OVER ({order} ROWS BETWEEN 6 PRECEDING AND 4 PRECEDING), 0) AS o3
  FROM {name}_l),
{name}_2 AS (SELECT *, greatest(1, least(3, seq - 1 - 3)) AS dd FROM {name}_1)"""


CTE_BAT_FEAT = _feature_rows_cte(
    "bf", "ps.role = 'batting' AND ps.balls_faced > 0", "runs", "sr_c",
    "CAST(ps.strike_rate * 100 AS BIGINT)", ", ps.fours, ps.sixes, ps.balls_faced") + f""",
bat_feat AS (
  SELECT player_name, team, match_id, match_date,
         {RR('s1', 'n5', 2)} AS rolling_avg_runs,
         {CR('s2', 'n5', 2)} AS rolling_avg_sr,
         CASE WHEN seq - 1 < 3 THEN 0.0 ELSE {CR('r3 * dd - 3 * o3', '3 * dd', 2)} END AS sr_trend,
         {RND('CAST(fours + sixes AS DOUBLE) / balls_faced', 3)} AS boundary_rate,
         CAST(seq AS BIGINT) AS innings_played
  FROM bf_2)"""

CTE_BOWL_FEAT = _feature_rows_cte(
    "wf", "ps.role = 'bowling' AND ps.overs_bowled > 0", "wickets", "eco_c",
    "CAST(ps.economy * 100 AS BIGINT)", "") + f""",
bowl_feat AS (
  SELECT player_name, team, match_id, match_date,
         {RR('s1', 'n5', 2)} AS rolling_avg_wickets,
         {CR('s2', 'n5', 2)} AS rolling_avg_economy,
         CASE WHEN seq - 1 < 3 THEN 0.0 ELSE {CR('r3 * dd - 3 * o3', '3 * dd', 2)} END AS economy_trend,
         CAST(seq AS BIGINT) AS matches_bowled
  FROM wf_2)"""

PLAYER_BASE = (*STATS_BASE, CTE_BAT_FEAT, CTE_BOWL_FEAT)

ORACLE["W4_W6_W8_batting_feature_rows"] = with_ctes(*PLAYER_BASE) + "SELECT * FROM bat_feat"
ORACLE["W5_W6_bowling_feature_rows"] = with_ctes(*PLAYER_BASE) + "SELECT * FROM bowl_feat"


def _latest(src: str, cols: str, where: str = "TRUE") -> str:
    return f"""SELECT player_name, {cols} FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY player_name ORDER BY match_date DESC, match_id DESC, team DESC) AS rk
  FROM {src} WHERE {where}) x WHERE rk = 1"""


ORACLE["C3_batting_features"] = with_ctes(*PLAYER_BASE) + _latest(
    "bat_feat", "team, rolling_avg_runs, rolling_avg_sr, sr_trend, boundary_rate, innings_played")
ORACLE["C4_bowling_features"] = with_ctes(*PLAYER_BASE) + _latest(
    "bowl_feat", "team, rolling_avg_wickets, rolling_avg_economy, economy_trend, matches_bowled")

_ASOF_D = "match_date < (SELECT max(match_date) FROM matches)"
ORACLE["C5_player_features_asof"] = with_ctes(*PLAYER_BASE) + f"""
SELECT player_name, team,
       COALESCE(b.rolling_avg_runs, 0.0) AS rolling_avg_runs, COALESCE(b.rolling_avg_sr, 0.0) AS rolling_avg_sr,
       COALESCE(b.sr_trend, 0.0) AS sr_trend, COALESCE(w.rolling_avg_wickets, 0.0) AS rolling_avg_wickets,
       COALESCE(w.rolling_avg_economy, 0.0) AS rolling_avg_economy, COALESCE(w.economy_trend, 0.0) AS economy_trend
FROM ({_latest('bat_feat', 'team, rolling_avg_runs, rolling_avg_sr, sr_trend', _ASOF_D)}) b
FULL OUTER JOIN ({_latest('bowl_feat', 'team, rolling_avg_wickets, rolling_avg_economy, economy_trend', _ASOF_D)}) w
USING (player_name, team)"""


def strength_ctes(days_sql: str) -> tuple[str, ...]:
    """Brute force J9: for every (player, day) the latest lines before the day."""
    return (
        f"sdays AS ({days_sql})",
        "spl AS (SELECT DISTINCT player_name FROM player_stats)",
        "sgrid AS (SELECT p.player_name, d.d FROM spl p, sdays d)",
        """bat_last AS (SELECT player_name, match_date, team AS bt, rolling_avg_runs AS bat FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY player_name, match_date ORDER BY match_id DESC, team DESC) AS rk
  FROM bat_feat) x WHERE rk = 1)""",
        """bowl_last AS (SELECT player_name, match_date, team AS wt, rolling_avg_economy AS eco FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY player_name, match_date ORDER BY match_id DESC, team DESC) AS rk
  FROM bowl_feat) x WHERE rk = 1)""",
        """gb AS (SELECT g.player_name, g.d, b.bt, b.bat FROM sgrid g
  ASOF LEFT JOIN bat_last b ON g.player_name = b.player_name AND b.match_date < g.d)""",
        """gw AS (SELECT g.player_name, g.d, w.wt, w.eco FROM sgrid g
  ASOF LEFT JOIN bowl_last w ON g.player_name = w.player_name AND w.match_date < g.d)""",
        """sst AS (SELECT gb.player_name, gb.d, bt, bat, wt, eco FROM gb JOIN gw
  ON gb.player_name = gw.player_name AND gb.d = gw.d)""",
        """srows AS (
  SELECT d, bt AS team, CAST(round(bat * 100) AS BIGINT) AS bat_c,
         CASE WHEN wt = bt THEN CAST(round(eco * 100) AS BIGINT) ELSE 0 END AS eco_c
  FROM sst WHERE bt IS NOT NULL
  UNION ALL
  SELECT d, wt, 0, CAST(round(eco * 100) AS BIGINT) FROM sst WHERE wt IS NOT NULL AND (bt IS NULL OR bt <> wt))""",
        f"""sagg AS (
  SELECT d, team,
         {CR('SUM(bat_c)', 'COUNT(*)', 2)} AS bat_avg,
         CASE WHEN COUNT(*) FILTER (WHERE eco_c > 0) > 0
              THEN {CR('SUM(eco_c) FILTER (WHERE eco_c > 0)', 'COUNT(*) FILTER (WHERE eco_c > 0)', 2)}
              ELSE 0.0 END AS bowl_eco
  FROM srows GROUP BY d, team)""",
    )


ORACLE["J9_team_strength_asof"] = with_ctes(
    *PLAYER_BASE, CTE_COMPLETED, CTE_TEAM_ROWS, *strength_ctes("SELECT DISTINCT match_date AS d FROM cm")) + """
SELECT s.team, s.match_date, COALESCE(a.bat_avg, 0.0) AS bat_avg, COALESCE(a.bowl_eco, 0.0) AS bowl_eco
FROM (SELECT DISTINCT team, match_date FROM tr) s LEFT JOIN sagg a ON a.team = s.team AND a.d = s.match_date"""


# ---- feature matrix ------------------------------------------------------------------

def _features_select(spine_cols: str, venue_join: str, toss_join: str, target: bool, extra: str = "") -> str:
    tgt = ",\n       CASE WHEN s.winner = s.team1 THEN 1 ELSE 0 END AS team1_won" if target else ""
    tgt += extra
    return f"""
SELECT s.match_id, CAST(s.match_date AS VARCHAR) AS match_date, s.team1, s.team2,
       COALESCE(f1.rolling_win_rate, 0.5) AS team1_win_rate, COALESCE(f2.rolling_win_rate, 0.5) AS team2_win_rate,
       {RND('COALESCE(f1.rolling_win_rate, 0.5) - COALESCE(f2.rolling_win_rate, 0.5)', 3)} AS win_rate_diff,
       COALESCE(f1.streak, 0) AS team1_streak, COALESCE(f2.streak, 0) AS team2_streak,
       h.team1_h2h_win_rate, h.team2_h2h_win_rate, h.h2h_total,
       COALESCE(v1, 0.5) AS team1_venue_win_rate, COALESCE(v2, 0.5) AS team2_venue_win_rate,
       {RND('COALESCE(v1, 0.5) - COALESCE(v2, 0.5)', 3)} AS venue_advantage_diff,
       CASE WHEN s.toss_winner = s.team1 THEN 1 ELSE 0 END AS toss_won_by_team1,
       COALESCE(t1, 0.0) AS team1_toss_advantage, COALESCE(t2, 0.0) AS team2_toss_advantage,
       COALESCE(a1.bat_avg, 0.0) AS team1_bat_avg, COALESCE(a2.bat_avg, 0.0) AS team2_bat_avg,
       {RND('COALESCE(a1.bat_avg, 0.0) - COALESCE(a2.bat_avg, 0.0)', 2)} AS bat_avg_diff,
       COALESCE(a1.bowl_eco, 0.0) AS team1_bowl_eco, COALESCE(a2.bowl_eco, 0.0) AS team2_bowl_eco,
       {RND('COALESCE(a1.bowl_eco, 0.0) - COALESCE(a2.bowl_eco, 0.0)', 2)} AS bowl_eco_diff{tgt}
FROM (SELECT {spine_cols} FROM spine) s
ASOF LEFT JOIN form_ends f1 ON f1.team = s.team1 AND f1.match_date < s.match_date
ASOF LEFT JOIN form_ends f2 ON f2.team = s.team2 AND f2.match_date < s.match_date
JOIN h2h h ON h.match_id = s.match_id
LEFT JOIN sagg a1 ON a1.team = s.team1 AND a1.d = s.match_date
LEFT JOIN sagg a2 ON a2.team = s.team2 AND a2.d = s.match_date
{venue_join}
{toss_join}"""


_VENUE_ALL = """LEFT JOIN (SELECT team, venue, venue_win_rate AS v1 FROM vs) vv1 ON vv1.team = s.team1 AND vv1.venue = s.venue
LEFT JOIN (SELECT team, venue, venue_win_rate AS v2 FROM vs) vv2 ON vv2.team = s.team2 AND vv2.venue = s.venue"""
_TOSS_ALL = """LEFT JOIN (SELECT team, toss_advantage AS t1 FROM ts) tt1 ON tt1.team = s.team1
LEFT JOIN (SELECT team, toss_advantage AS t2 FROM ts) tt2 ON tt2.team = s.team2"""

_FM_CTES = (*PLAYER_BASE, CTE_COMPLETED, CTE_TEAM_ROWS, CTE_FORM_ROWS, CTE_FORM_ENDS, CTE_VENUE, CTE_TOSS)

ORACLE["C10_feature_matrix"] = with_ctes(
    *_FM_CTES, "spine AS (SELECT * FROM cm)", CTE_H2H_ASOF,
    *strength_ctes("SELECT DISTINCT match_date AS d FROM spine")) + _features_select(
    "*", _VENUE_ALL, _TOSS_ALL, True)

ORACLE["C11_live_features"] = with_ctes(
    *_FM_CTES,
    """spine AS (SELECT match_id, match_date, team1, team2, COALESCE(NULLIF(venue, ''), 'Unknown') AS venue,
                        COALESCE(toss_winner, '') AS toss_winner
                 FROM matches WHERE status NOT IN ('completed', 'Completed', 'Result'))""",
    CTE_H2H_ASOF, *strength_ctes("SELECT DISTINCT match_date AS d FROM spine")) + _features_select(
    "*", _VENUE_ALL, _TOSS_ALL, False)

# leakage-free variant: venue and toss records from decided matches strictly before the day
_VENUE_BEFORE = f"""LEFT JOIN LATERAL (SELECT CASE WHEN COUNT(*) > 0 THEN {RR('SUM(r.won)', 'COUNT(*)', 3)} END AS v1
  FROM tr r WHERE r.team = s.team1 AND r.venue = s.venue AND r.match_date < s.match_date) vv1 ON TRUE
LEFT JOIN LATERAL (SELECT CASE WHEN COUNT(*) > 0 THEN {RR('SUM(r.won)', 'COUNT(*)', 3)} END AS v2
  FROM tr r WHERE r.team = s.team2 AND r.venue = s.venue AND r.match_date < s.match_date) vv2 ON TRUE"""


def _toss_before(alias: str, team: str) -> str:
    tw = (f"CASE WHEN COUNT(*) FILTER (WHERE r.won_toss = 1) > 0 THEN "
          f"{RR('COUNT(*) FILTER (WHERE r.won_toss = 1 AND r.won = 1)', 'COUNT(*) FILTER (WHERE r.won_toss = 1)', 3)}"
          f" ELSE 0.0 END")
    tl = (f"CASE WHEN COUNT(*) FILTER (WHERE r.won_toss = 0) > 0 THEN "
          f"{RR('COUNT(*) FILTER (WHERE r.won_toss = 0 AND r.won = 1)', 'COUNT(*) FILTER (WHERE r.won_toss = 0)', 3)}"
          f" ELSE 0.0 END")
    return (f"LEFT JOIN LATERAL (SELECT CASE WHEN COUNT(*) > 0 THEN {RND(f'({tw}) - ({tl})', 3)} END AS {alias}"
            f" FROM tr r WHERE r.team = s.{team} AND r.toss_winner IS NOT NULL AND r.toss_winner <> ''"
            f" AND r.match_date < s.match_date) x{alias} ON TRUE")


ORACLE["C10_feature_matrix_leakage_free"] = with_ctes(
    *_FM_CTES, "spine AS (SELECT * FROM cm)", CTE_H2H_ASOF,
    *strength_ctes("SELECT DISTINCT match_date AS d FROM spine")) + _features_select(
    "*", _VENUE_BEFORE, _toss_before("t1", "team1") + "\n" + _toss_before("t2", "team2"), True)

# spotlight for every unfinished fixture, from the definition: all lines before the day
_SPOT_FX = """fx AS (SELECT match_id, team1 AS a, team2 AS b, match_date AS d FROM matches
  WHERE status NOT IN ('completed', 'Completed', 'Result')),
sd AS (SELECT DISTINCT a AS team, d FROM fx UNION SELECT b, d FROM fx)"""


def _spot_role(lines: str, f1: str, f2: str, second: bool, name: str) -> str:
    order2 = ", s2 / n ASC" if second else ""
    return f"""{name}_tot AS (
  SELECT sd.team, sd.d, l.player_name, COUNT(*) AS n, SUM({f1}) AS s1, SUM({f2}) AS s2
  FROM sd JOIN {lines} l ON l.team = sd.team AND l.match_date < sd.d GROUP BY ALL HAVING COUNT(*) >= 3),
{name}_top AS (
  SELECT * FROM (
    SELECT fx.match_id, fx.d, t.player_name, t.team, n, s1, s2,
           ROW_NUMBER() OVER (PARTITION BY fx.match_id ORDER BY s1 / n DESC{order2}, player_name, t.team) AS rk
    FROM fx JOIN {name}_tot t ON t.d = fx.d AND t.team IN (fx.a, fx.b)) x WHERE rk <= 3),
{name}_rec AS (
  SELECT player_name, d, COUNT(*) AS n, SUM({f2}) FILTER (WHERE r <= 3) AS first3,
         COALESCE(SUM({f2}) FILTER (WHERE r > 3), 0) AS rest
  FROM (SELECT l.player_name, p.d, l.{f2}, ROW_NUMBER() OVER (PARTITION BY l.player_name, p.d
          ORDER BY l.match_date DESC, l.match_id DESC, l.team DESC) AS r
        FROM (SELECT DISTINCT player_name, d FROM {name}_top) p JOIN {lines} l ON l.player_name = p.player_name AND l.match_date < p.d) y
  WHERE r <= 6 GROUP BY ALL),
{name}_out AS (
  SELECT t.match_id, t.player_name AS name, t.team, {RR('t.s1', 't.n', 1)} AS avg1, {CR('t.s2', 't.n', 1)} AS avg2,
         CASE WHEN r.n < 4 THEN 0.0 ELSE {CR('r.first3 * (r.n - 3) - 3 * r.rest', '3 * (r.n - 3)', 1)} END AS trend,
         t.rk
  FROM {name}_top t LEFT JOIN {name}_rec r ON r.player_name = t.player_name AND r.d = t.d)"""


_SPOT_CTES = (_SPOT_FX, _spot_role("bf_l", "runs", "sr_c", False, "sb"), _spot_role("wf_l", "wickets", "eco_c", True, "sw"),
              """recs AS (
SELECT match_id, name, team, avg1 AS rolling_avg_runs, avg2 AS rolling_avg_sr, trend AS sr_trend,
       0.0 AS rolling_avg_wickets, 0.0 AS rolling_avg_economy, 0.0 AS economy_trend, rk AS ord,
       'batting' AS role FROM sb_out
UNION ALL
SELECT match_id, name, team, 0.0, 0.0, 0.0, avg1, avg2, trend, rk + 3, 'bowling' FROM sw_out)""")


def _longer(ctes: tuple[str, ...]) -> tuple[str, ...]:
    """The same statement on stat lines with up to six balls more, and only batting
    lines of more than three: the test ball log has one ball per batter and match."""
    lines = CTE_PLAYER_STATS.replace("player_stats AS (", "short_stats AS (", 1) + """,
player_stats AS (SELECT * REPLACE (CASE WHEN role = 'batting' THEN balls_faced + match_id % 7 ELSE balls_faced END AS balls_faced)
                 FROM short_stats)"""
    return tuple(lines if c == CTE_PLAYER_STATS else c.replace("balls_faced > 0", "balls_faced > 3") for c in ctes)


ORACLE["C16_spotlight_next_fixture"] = with_ctes(*PLAYER_BASE, *_SPOT_CTES) + "SELECT * FROM recs"
ORACLE["C16_spotlight_min_balls"] = with_ctes(*_longer(PLAYER_BASE), *_SPOT_CTES) + "SELECT * FROM recs"
ORACLE["A9_batter_summary_min_balls"] = with_ctes(*_longer((*STATS_BASE, CTE_BATTER_SUMMARY))) + """
SELECT player_name, team, avg_runs, avg_sr, total_fours, total_sixes, innings FROM bsum"""
ORACLE["C14_top_batters_min_balls"] = with_ctes(*_longer((*STATS_BASE, CTE_BATTER_SUMMARY))) + """
SELECT * FROM (
  SELECT p.team1, p.team2, b.player_name, b.team, b.avg_runs, b.avg_sr, b.total_fours, b.total_sixes, b.innings,
         ROW_NUMBER() OVER (PARTITION BY p.team1, p.team2 ORDER BY b.k DESC, b.player_name, b.team) AS rank
  FROM (SELECT DISTINCT team1, team2 FROM matches) p JOIN bsum b ON b.team IN (p.team1, p.team2)) x
WHERE rank <= 8"""
ORACLE["P4_batting_lines_min_balls"] = with_ctes(*_longer(STATS_BASE)) + """
SELECT match_id, player_name, team, runs, balls_faced FROM player_stats WHERE role = 'batting' AND balls_faced > 3"""

# ---- scalar functions and prompts ----------------------------------------------------



def _streak_words(s: str) -> str:
    return (f"CASE WHEN {s} > 0 THEN CAST(abs({s}) AS VARCHAR) || ' win streak' "
            f"WHEN {s} < 0 THEN CAST(abs({s}) AS VARCHAR) || ' loss streak' ELSE 'no current streak' END")


def _percent(x: str) -> str:
    return f"CAST(CAST(round_even(({x}) * 100.0, 0) AS BIGINT) AS VARCHAR)"

ORACLE["F1_match_hash_id"] = with_ctes(CTE_MATCHES) + """
SELECT match_id, substr(md5(concat_ws('_', COALESCE(CAST(match_date AS VARCHAR), 'nan'), COALESCE(team1, 'nan'),
       COALESCE(team2, 'nan'), COALESCE(venue, 'nan'))), 1, 12) AS hash_id FROM matches"""

ORACLE["F2_request_cache_key"] = """
SELECT event_id, md5(concat_ws('|', COALESCE(CAST(user_id AS VARCHAR), 'None'), COALESCE(event_type, 'None'))) AS cache_key
FROM events"""

ORACLE["F4_F6_F7_F15_F24_match_labels"] = with_ctes(CTE_MATCHES) + """
SELECT match_id, COALESCE(team1, '') || ' vs ' || COALESCE(team2, '') AS versus,
  CASE WHEN lower(COALESCE(NULLIF(status, ''), 'Scheduled')) LIKE '%progress%'
         OR lower(COALESCE(NULLIF(status, ''), 'Scheduled')) LIKE '%live%' THEN 'live'
       WHEN lower(COALESCE(NULLIF(status, ''), 'Scheduled')) LIKE '%final%'
         OR lower(COALESCE(NULLIF(status, ''), 'Scheduled')) LIKE '%result%' THEN 'finished'
       ELSE 'scheduled' END AS status_bucket,
  CASE WHEN lower(COALESCE(status, '')) LIKE '%progress%' OR lower(COALESCE(status, '')) LIKE '%live%' THEN 'live'
       WHEN length(winner) > 0 THEN 'post' ELSE 'pre' END AS insight_kind,
  COALESCE(NULLIF(venue, ''), 'Unknown') AS venue_or_unknown,
  CASE WHEN length(winner) > 0 THEN winner || ' won'
       WHEN lower(COALESCE(status, 'Scheduled')) LIKE '%toss%' OR length(toss_winner) > 0
         THEN 'Toss: ' || COALESCE(toss_winner, 'None') || ' won the toss' END AS result_line
FROM matches"""

ORACLE["F5_F8_event_dates"] = """
SELECT event_id, substr(COALESCE(CAST(ts AS VARCHAR), ''), 1, 10) AS date_text,
       TRY_CAST(substr(COALESCE(CAST(ts AS VARCHAR), ''), 1, 10) AS DATE) AS event_date FROM events"""

_LIVE_SPINE = """spine AS (SELECT match_id, match_date, team1, team2, COALESCE(NULLIF(venue, ''), 'Unknown') AS venue,
                        COALESCE(toss_winner, '') AS toss_winner
                 FROM matches WHERE status NOT IN ('completed', 'Completed', 'Result'))"""
_LIVE_FEATS = ("feats AS (" + _features_select("*", _VENUE_ALL, _TOSS_ALL, False,
                                              ",\n       s.venue, s.toss_winner") + ")")
_PROBS = f"""probs AS (SELECT *, {RND('(0.5 + win_rate_diff / 2.0) * 100.0', 1)} AS team1_win_prob,
                         {RND('(1.0 - (0.5 + win_rate_diff / 2.0)) * 100.0', 1)} AS team2_win_prob FROM feats)"""
_LIVE_CTES = (*_FM_CTES, _LIVE_SPINE, CTE_H2H_ASOF, *strength_ctes("SELECT DISTINCT match_date AS d FROM spine"),
              _LIVE_FEATS, _PROBS)

ORACLE["F16_F17_win_prob_bands"] = with_ctes(*_LIVE_CTES) + """
SELECT match_id, team1_win_prob, team2_win_prob,
  CASE WHEN team1_win_prob >= 0 AND team1_win_prob < 40 THEN 'low'
       WHEN team1_win_prob >= 40 AND team1_win_prob < 60 THEN 'even'
       WHEN team1_win_prob >= 60 AND team1_win_prob <= 100 THEN 'high' END AS gauge_band,
  printf('%.1f', round_even((team1_win_prob - 50.0) * 10, 0) / 10) || '% vs even' AS delta_vs_even
FROM probs"""

ORACLE["F19_team_streak_phrases"] = with_ctes(*FORM_BASE) + f"""
SELECT team, streak, {_streak_words('streak')} AS streak_phrase FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY team ORDER BY match_date DESC, match_id DESC) AS rk FROM form_rows) x
WHERE rk = 1"""

_CHART_FIELDS = """
SELECT player_name, team, 'batting' AS role, avg_runs * 1.0 AS radar_runs, avg_sr * 0.5 AS radar_sr,
       CAST(total_fours AS DOUBLE) * 1.0 AS radar_fours, CAST(total_sixes AS DOUBLE) * 3.0 AS radar_sixes,
       CAST(innings AS DOUBLE) * 5.0 AS radar_innings, CAST(NULL AS VARCHAR) AS quadrant FROM bsum
UNION ALL
SELECT player_name, team, 'bowling', NULL, NULL, NULL, NULL, NULL,
  CASE WHEN avg_wickets >= 1.0 AND avg_economy <= 8.0 THEN 'strike_and_control'
       WHEN avg_wickets >= 1.0 THEN 'strike' WHEN avg_economy <= 8.0 THEN 'control' ELSE 'neither' END FROM wsum"""
_CHART_CTES = (*STATS_BASE, CTE_BATTER_SUMMARY, CTE_BOWLER_SUMMARY)
ORACLE["F18_F25_player_chart_fields"] = with_ctes(*_CHART_CTES) + _CHART_FIELDS
ORACLE["F18_F25_player_chart_fields_min_balls"] = with_ctes(*_longer(_CHART_CTES)) + _CHART_FIELDS

ORACLE["F20_pre_match_prompts"] = with_ctes(*_LIVE_CTES) + f"""
SELECT match_id, concat_ws(chr(10),
  'Preview a cricket match in three sentences. Everything you may say is in this sheet.', '',
  concat('fixture: ', team1, ' v ', team2), concat('ground: ', venue),
  concat('chance of winning, percent: ', team1, ' ', team1_win_prob, ', ', team2, ' ', team2_win_prob),
  concat('games won of the last five, percent: ', team1, ' ', {_percent('team1_win_rate')}, ' (',
         {_streak_words('team1_streak')}, '), ', team2, ' ', {_percent('team2_win_rate')}, ' (',
         {_streak_words('team2_streak')}, ')'),
  concat('meetings won by ', team1, ', percent: ', {_percent('team1_h2h_win_rate')}, ' of ', h2h_total),
  concat('games won on this ground, percent: ', team1, ' ', {_percent('team1_venue_win_rate')}, ', ', team2, ' ',
         {_percent('team2_venue_win_rate')}),
  concat('toss went to: ', toss_winner), '',
  'Cover how both sides come into the game, then their meetings and the ground, then who is likely to win '
  || 'and by the chance given. Sober wording, no greeting.') AS prompt FROM probs"""

_POST_CTES = (*_FM_CTES, "spine AS (SELECT * FROM cm)", CTE_H2H_ASOF,
              *strength_ctes("SELECT DISTINCT match_date AS d FROM spine"),
              "fm AS (" + _features_select("*", _VENUE_ALL, _TOSS_ALL, True) + ")",
              """tops AS (SELECT match_id, team, player_name, runs FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY match_id, team ORDER BY runs DESC, player_name) AS r
  FROM player_stats WHERE role = 'batting' AND balls_faced > 0) x WHERE r = 1)""",
              """best AS (SELECT match_id, player_name AS best_bowler, wickets AS best_bowler_wickets,
  CAST(economy AS DOUBLE) AS best_bowler_economy FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY match_id ORDER BY wickets DESC, economy ASC, player_name, team) AS r
  FROM player_stats WHERE role = 'bowling' AND overs_bowled > 0) x WHERE r = 1)""",
              """post AS (
  SELECT f.match_id, f.team1, f.team2, c.winner, 'N/A' AS win_margin,
         t1.player_name AS team1_top_scorer, t1.runs AS team1_top_scorer_runs,
         t2.player_name AS team2_top_scorer, t2.runs AS team2_top_scorer_runs,
         b.best_bowler, b.best_bowler_wickets, b.best_bowler_economy,
         CASE WHEN 0.5 + f.win_rate_diff / 2.0 >= 0.5 THEN f.team1 ELSE f.team2 END AS predicted_winner,
         greatest(0.5 + f.win_rate_diff / 2.0, 1.0 - (0.5 + f.win_rate_diff / 2.0)) * 100.0 AS predicted_prob
  FROM fm f JOIN cm c ON c.match_id = f.match_id
  LEFT JOIN tops t1 ON t1.match_id = f.match_id AND t1.team = f.team1
  LEFT JOIN tops t2 ON t2.match_id = f.match_id AND t2.team = f.team2
  LEFT JOIN best b ON b.match_id = f.match_id)""")

ORACLE["F22_post_match_prompts"] = with_ctes(*_POST_CTES) + """
SELECT match_id, concat_ws(chr(10),
  'Report a finished cricket match in three sentences. Everything you may say is in this sheet.', '',
  concat('fixture: ', team1, ' v ', team2), concat('winner: ', winner, ', margin ', win_margin),
  concat('most runs for ', team1, ': ', team1_top_scorer, ', ', team1_top_scorer_runs),
  concat('most runs for ', team2, ': ', team2_top_scorer, ', ', team2_top_scorer_runs),
  concat('best bowling: ', best_bowler, ', ', best_bowler_wickets, ' wickets, ',
         printf('%.2f', round_even(best_bowler_economy * 100.0, 0) / 100.0), ' runs an over'),
  concat('forecast: ', CASE WHEN predicted_winner = winner
    THEN concat('right, ', winner, ' was given ', CAST(round_even(predicted_prob, 0) AS BIGINT), ' percent')
    ELSE concat('wrong, ', predicted_winner, ' was given ', CAST(round_even(predicted_prob, 0) AS BIGINT),
                ' percent and lost') END), '',
  'Cover the win and the batting behind it, then the bowling, then how the forecast did.') AS prompt FROM post"""


def _sign(x: str) -> str:
    return f"CASE WHEN {x} > 0 THEN '+' ELSE '' END"


_BAT_LINE = f"""concat(name, ', ', team, ': ', rolling_avg_runs, ' runs a game at strike rate ', rolling_avg_sr,
  ' (change ', {_sign('sr_trend')}, sr_trend, ')')"""
_BOWL_LINE = f"""CASE WHEN role = 'batting'
  THEN concat(name, ', ', team, ': 0 wickets a game at economy 0 (change 0)')
  ELSE concat(name, ', ', team, ': ', rolling_avg_wickets, ' wickets a game at economy ', rolling_avg_economy,
              ' (change ', {_sign('economy_trend')}, economy_trend, ')') END"""

_SPOT_PROMPTS = f"""lines AS (SELECT match_id, string_agg(CASE WHEN rolling_avg_runs > 0 THEN {_BAT_LINE} ELSE {_BOWL_LINE} END,
                  chr(10) ORDER BY ord) AS players_str FROM recs GROUP BY 1)"""
_SPOT_PROMPT_ROWS = """SELECT fx.match_id, CASE WHEN players_str IS NULL THEN 'There are no player figures for this match yet.' ELSE
  concat('Choose one batter and one bowler to follow in ', a || ' vs ' || b,
         ', and give a sentence of reasons for each. Use these figures of the last five games only.',
         chr(10), chr(10), players_str) END AS prompt FROM fx LEFT JOIN lines ON lines.match_id = fx.match_id"""
ORACLE["F23_spotlight_prompt"] = with_ctes(*PLAYER_BASE, *_SPOT_CTES, _SPOT_PROMPTS) + _SPOT_PROMPT_ROWS
ORACLE["F23_spotlight_prompt_min_balls"] = with_ctes(*_longer(PLAYER_BASE), *_SPOT_CTES, _SPOT_PROMPTS) + _SPOT_PROMPT_ROWS

# ---- request log, upserts, feed ------------------------------------------------------

CTE_TTL = """RECURSIVE ev AS (
  SELECT user_id, event_id, epoch_us(ts) AS t,
         ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
ch AS (
  SELECT user_id, rn, t AS anchor, event_id, false AS cache_hit FROM ev WHERE rn = 1
  UNION ALL
  SELECT e.user_id, e.rn, CASE WHEN e.t - c.anchor > 300000000 THEN e.t ELSE c.anchor END, e.event_id,
         NOT (e.t - c.anchor > 300000000)
  FROM ch c JOIN ev e ON e.user_id = c.user_id AND e.rn = c.rn + 1)"""

ORACLE["T5_ttl_cache_hits"] = "WITH " + CTE_TTL + "\nSELECT event_id, cache_hit FROM ch"

ORACLE["A21_cache_stats"] = "WITH " + CTE_TTL + """
SELECT hits, misses,
       CASE WHEN hits + misses > 0 THEN round_even(CAST(hits AS DOUBLE) * 1000.0 / (hits + misses), 0) / 10.0
            ELSE 0.0 END AS hit_rate
FROM (SELECT COUNT(*) FILTER (WHERE cache_hit) AS hits, COUNT(*) FILTER (WHERE NOT cache_hit) AS misses FROM ch) x"""

ORACLE["W10_request_quota"] = """
SELECT event_id, user_id, in_window, greatest(0, 10 - in_window) AS remaining FROM (
  SELECT event_id, user_id, COUNT(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts)
         RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS in_window FROM events) x"""

ORACLE["K1_upsert_events_by_user"] = """
SELECT user_id, first_event_type, first_props, last_event_type, last_value, ts, event_id FROM (
  SELECT user_id,
         FIRST_VALUE(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS first_event_type,
         FIRST_VALUE(props) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS first_props,
         event_type AS last_event_type, value AS last_value, ts, event_id,
         ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rk
  FROM events) x WHERE rk = 1"""

ORACLE["K7_latest_event_per_user"] = """
SELECT event_id, ts, user_id, event_type, value, props FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rk FROM events) x
WHERE rk = 1"""

ORACLE["S4_F14_event_props_json"] = """
SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events"""

_POLL_AT = """CASE p WHEN 0 THEN '2024-05-01 10:00:00' WHEN 1 THEN '2024-05-01 10:01:00'
  ELSE '2024-05-01 10:02:00' END"""
ORACLE["C18_T1_T2_T3_match_feed_stream"] = with_ctes(CTE_MATCHES) + f"""
SELECT match_id, name, venue, match_date, team1, team2, 'feed' AS source,
       CASE p WHEN 0 THEN 'Scheduled' WHEN 1 THEN 'In Progress'
            ELSE CASE status WHEN 'completed' THEN 'Completed' ELSE 'In Progress' END END AS status,
       CASE p WHEN 2 THEN COALESCE(winner, '') ELSE '' END AS winner, {_POLL_AT} AS fetched_at
FROM (SELECT *, CASE WHEN match_id % 10 <> 0 THEN 2
                     WHEN match_id % 2 = 0 AND match_id % 97 <> 0 AND match_id % 101 <> 0 THEN 1 ELSE 0 END AS p
      FROM matches) x"""

ORACLE["C18_K4_T3_match_feed_rejects"] = with_ctes(CTE_MATCHES) + """
SELECT 'feed' AS source,
       concat_ws('; ', CASE WHEN match_id % 97 = 0 THEN 'Missing field: name' END,
                       CASE WHEN match_id % 101 = 0 THEN 'Invalid date: soon' END) AS error_message,
       match_id, CASE WHEN match_id % 97 = 0 THEN '' ELSE name END AS name,
       CASE WHEN match_id % 101 = 0 THEN 'soon' ELSE CAST(match_date AS VARCHAR) END AS match_date,
       'In Progress' AS status
FROM matches WHERE match_id % 97 = 0 OR match_id % 101 = 0"""

ORACLE["S5_K3_K7_scorecard_feed_stats"] = with_ctes(*STATS_BASE) + """
SELECT match_id, player_name, team, role, runs, balls_faced, fours, sixes, wickets, 1 AS poll FROM player_stats"""

ORACLE["S5_K2_T4_scorecard_feed_innings"] = with_ctes(*STATS_BASE, _INNINGS) + """
SELECT match_id, inning_name, runs, wickets, CAST(o || '.' || b AS DOUBLE) AS overs, p AS poll
FROM inn, (SELECT 0 AS p UNION ALL SELECT 1) x"""

ORACLE["L6_F24_latest_innings_text"] = with_ctes(*STATS_BASE, _INNINGS) + """
SELECT match_id, inning_name, runs || '/' || wickets AS score, o || '.' || b || ' ov' AS overs_text FROM inn"""

ORACLE["K4_scorecard_feed_rejects"] = with_ctes(*STATS_BASE) + """
SELECT 'feed' AS source, 'Implausible strike_rate: ' || CAST(strike_rate AS VARCHAR) AS error_message, match_id, player_name
FROM bat_card, (SELECT 0 UNION ALL SELECT 1) polls WHERE strike_rate > 500
UNION ALL
SELECT DISTINCT 'feed', 'Cannot coerce runs: x', match_id, 'Extra' FROM bat_card WHERE match_id % 97 = 0"""

# ---- batch history load ---------------------------------------------------------------

CTE_INGEST = """ing AS (
  SELECT match_id AS raw_id,
         substr(md5(concat_ws('_', COALESCE(CAST(match_date AS VARCHAR), 'nan'), COALESCE(team1, 'nan'),
                COALESCE(team2, 'nan'), COALESCE(venue, 'nan'))), 1, 12) AS match_id,
         COALESCE(team1, 'nan') || ' vs ' || COALESCE(team2, 'nan') AS name, 'completed' AS status, venue,
         match_date, team1, team2, toss_winner, winner, 'history' AS source
  FROM matches)"""

ORACLE["C17_ingest_matches"] = with_ctes(CTE_MATCHES, CTE_INGEST) + """
SELECT f.match_id, f.name, f.venue, f.match_date, f.team1, f.team2, f.toss_winner, f.source, l.status, l.winner
FROM (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY match_id ORDER BY raw_id) AS r FROM ing) x
      WHERE r = 1) f
JOIN (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY match_id ORDER BY raw_id DESC) AS r FROM ing) y
      WHERE r = 1) l ON l.match_id = f.match_id"""

ORACLE["C17_J2_J3_ingest_player_stats"] = with_ctes(*STATS_BASE, CTE_INGEST) + """
SELECT i.match_id, p.player_name, p.team, p.role, p.runs, p.balls_faced, p.fours, p.sixes,
       CAST(p.strike_rate AS DOUBLE) AS strike_rate, p.wickets, CAST(p.overs_bowled AS DOUBLE) AS overs_bowled,
       CAST(p.economy AS DOUBLE) AS economy
FROM player_stats p JOIN ing i ON i.raw_id = p.match_id"""

ORACLE["C17_V3_ingest_tally"] = with_ctes(CTE_MATCHES, CTE_DELIVERIES, CTE_CARDS) + """
SELECT 'matches' AS table_name, COUNT(*) AS success, CAST(0 AS BIGINT) AS failed FROM matches
UNION ALL
SELECT 'player_stats',
       (SELECT COUNT(*) FILTER (WHERE NOT (strike_rate > 500) AND NOT (runs > 200)) FROM bat_card)
       + (SELECT COUNT(*) FROM bowl_card),
       (SELECT COUNT(*) FILTER (WHERE strike_rate > 500 OR runs > 200) FROM bat_card)"""

# ---- model data preparation and evaluation ----------------------------------------------

from kestrel.plans.features import FEATURE_COLS as _FC  # noqa: E402

_FM_MATRIX = (*_FM_CTES, "spine AS (SELECT * FROM cm)", CTE_H2H_ASOF,
              *strength_ctes("SELECT DISTINCT match_date AS d FROM spine"),
              "fm AS (" + _features_select("*", _VENUE_ALL, _TOSS_ALL, True) + ")",
              """sp AS (SELECT *, ROW_NUMBER() OVER (ORDER BY match_date, match_id)
                     <= floor(CAST(COUNT(*) OVER () AS DOUBLE) * 0.8) AS is_train FROM fm)""",
              "tst AS (SELECT *, 0.5 + win_rate_diff / 2.0 AS score FROM sp WHERE NOT is_train)")

ORACLE["M2_time_split"] = with_ctes(*_FM_MATRIX) + "SELECT match_id, is_train FROM sp"


def _scaled(c: str) -> str:
    return f"CAST(round_even(CAST({c} AS DOUBLE) * 10000.0, 0) AS HUGEINT)"


ORACLE["M3_scale_stats"] = with_ctes(*_FM_MATRIX) + "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS feature, CAST(s AS DOUBLE) / (CAST(n AS DOUBLE) * 10000.0) AS mean,
       CASE WHEN sqrt(CAST(n * q - s * s AS DOUBLE) / (CAST(n AS DOUBLE) * CAST(n AS DOUBLE) * 100000000.0)) = 0
            THEN 1.0 ELSE sqrt(CAST(n * q - s * s AS DOUBLE) / (CAST(n AS DOUBLE) * CAST(n AS DOUBLE) * 100000000.0))
       END AS std
FROM (SELECT COUNT(*) AS n, SUM({_scaled(c)}) AS s, SUM({_scaled(c)} * {_scaled(c)}) AS q FROM sp WHERE is_train) x"""
    for c in _FC)

ORACLE["M4_class_weights"] = with_ctes(*_FM_MATRIX) + f"""
SELECT 0 AS label, 1.0 AS weight
UNION ALL
SELECT 1, {RND('CAST(COUNT(*) FILTER (WHERE team1_won = 0) AS DOUBLE) / COUNT(*) FILTER (WHERE team1_won = 1)', 3)}
FROM sp WHERE is_train"""

ORACLE["M8_stratified_folds"] = with_ctes(*_FM_MATRIX) + """
SELECT match_id, team1_won, CAST((ROW_NUMBER() OVER (PARTITION BY team1_won
         ORDER BY md5(CAST(match_id AS VARCHAR) || '|42')) - 1) % 5 AS INTEGER) AS fold
FROM sp WHERE is_train"""

ORACLE["P13_feature_medians"] = with_ctes(*_FM_MATRIX) + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, quantile_cont(CAST({c} AS DOUBLE), 0.5) AS median FROM fm" for c in _FC)

_CM = """cmx AS (SELECT COUNT(*) FILTER (WHERE team1_won <> 1 AND score < 0.5) AS tn,
                     COUNT(*) FILTER (WHERE team1_won <> 1 AND score >= 0.5) AS fp,
                     COUNT(*) FILTER (WHERE team1_won = 1 AND score < 0.5) AS fn,
                     COUNT(*) FILTER (WHERE team1_won = 1 AND score >= 0.5) AS tp FROM tst)"""
_AUC = """sc AS (SELECT score AS s, COUNT(*) FILTER (WHERE team1_won = 1) AS p,
                    COUNT(*) FILTER (WHERE team1_won <> 1) AS q FROM tst GROUP BY score),
auc AS (SELECT SUM(p * (2 * below + q)) AS auc2, SUM(p) AS npos, SUM(q) AS nneg FROM (
  SELECT *, COALESCE(SUM(q) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
  FROM sc) x)"""


def _safe_sql(num: str, den: str, d: int) -> str:
    return f"CASE WHEN {den} > 0 THEN {RR(num, den, d)} ELSE 0.0 END"


ORACLE["M11_M16_heuristic_metrics"] = with_ctes(*_FM_MATRIX, _CM, _AUC) + f"""
SELECT 'heuristic' AS model, {_safe_sql('tp + tn', 'tn + fp + fn + tp', 3)} AS accuracy,
       {_safe_sql('auc2', '2 * npos * nneg', 3)} AS auc,
       {_safe_sql('tp', 'tp + fp', 3)} AS precision, {_safe_sql('tp', 'tp + fn', 3)} AS recall,
       {_safe_sql('2 * tp', '2 * tp + fp + fn', 3)} AS f1, tn, fp, fn, tp
FROM cmx, auc"""

_R3 = "round_even(({x}) * 1000.0, 0) / 1000.0 + 0.0"
ORACLE["M12_class_report"] = with_ctes(*_FM_MATRIX, _CM, f"""per AS (
  SELECT '0' AS label, {_safe_sql('tn', 'tn + fn', 6)} AS p, {_safe_sql('tn', 'tn + fp', 6)} AS r,
         {_safe_sql('2 * tn', '2 * tn + fn + fp', 6)} AS f, tn + fp AS support FROM cmx
  UNION ALL
  SELECT '1', {_safe_sql('tp', 'tp + fp', 6)}, {_safe_sql('tp', 'tp + fn', 6)},
         {_safe_sql('2 * tp', '2 * tp + fp + fn', 6)}, tp + fn FROM cmx)""") + f"""
SELECT label, {_R3.format(x='p')} AS precision, {_R3.format(x='r')} AS recall, {_R3.format(x='f')} AS f1,
       support FROM per
UNION ALL
SELECT 'macro avg', {_R3.format(x='AVG(p)')}, {_R3.format(x='AVG(r)')}, {_R3.format(x='AVG(f)')},
       CAST(SUM(support) AS BIGINT) FROM per
UNION ALL
SELECT 'weighted avg', {_R3.format(x='SUM(p * support) / SUM(support)')},
       {_R3.format(x='SUM(r * support) / SUM(support)')}, {_R3.format(x='SUM(f * support) / SUM(support)')},
       CAST(SUM(support) AS BIGINT) FROM per"""

ORACLE["M14_roc_points"] = with_ctes(*_FM_MATRIX, _AUC) + """
SELECT CAST(NULL AS DOUBLE) AS threshold, 0.0 AS fpr, 0.0 AS tpr
UNION ALL
SELECT s, fp / (SELECT SUM(q) FROM sc), tp / (SELECT SUM(p) FROM sc) FROM (
  SELECT s, SUM(p) OVER (ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS tp,
         SUM(q) OVER (ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS fp FROM sc) x"""

ORACLE["M15_calibration"] = with_ctes(*_FM_MATRIX) + """
SELECT bin, COUNT(*) AS n, CAST(SUM(CAST(round_even(score * 10000.0, 0) AS BIGINT)) AS DOUBLE) / (COUNT(*) * 10000.0)
       AS mean_predicted, CAST(COUNT(*) FILTER (WHERE team1_won = 1) AS DOUBLE) / COUNT(*) AS fraction_positive
FROM (SELECT *, CAST(score > 0.2 AS INTEGER) + CAST(score > 0.4 AS INTEGER) + CAST(score > 0.6 AS INTEGER)
              + CAST(score > 0.8 AS INTEGER) AS bin FROM tst) x GROUP BY bin"""

ORACLE["A17_target_balance"] = with_ctes(*_FM_MATRIX) + f"""
SELECT s1 AS share_team1_won, s0 AS share_team1_lost, abs(s1 - s0) > 0.1 AS imbalanced FROM (
  SELECT {RR('COUNT(*) FILTER (WHERE team1_won = 1)', 'COUNT(*)', 3)} AS s1,
         {RR('COUNT(*) FILTER (WHERE team1_won = 0)', 'COUNT(*)', 3)} AS s0 FROM fm) x"""

ORACLE["A18_null_report"] = with_ctes(*_FM_MATRIX) + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", COUNT(*) FILTER (WHERE {c} IS NULL) AS null_count, "
    f"{RR(f'COUNT(*) FILTER (WHERE {c} IS NULL) * 100', 'COUNT(*)', 2)} AS null_pct FROM fm "
    f"HAVING COUNT(*) FILTER (WHERE {c} IS NULL) > 0"
    for c in ["match_id", "match_date", "team1", "team2", *_FC, "team1_won"])


def _corr_row(c: str) -> str:
    x = _scaled(c)
    num = f"CAST(n * SUM({x} * team1_won) - SUM({x}) * SUM(CAST(team1_won AS HUGEINT)) AS DOUBLE)"
    den = (f"sqrt(CAST(n * SUM({x} * {x}) - SUM({x}) * SUM({x}) AS DOUBLE) * "
           f"CAST(n * SUM(CAST(team1_won AS HUGEINT) * team1_won) - SUM(CAST(team1_won AS HUGEINT)) * "
           f"SUM(CAST(team1_won AS HUGEINT)) AS DOUBLE))")
    return (f"SELECT '{c}' AS feature, CASE WHEN {den} > 0 THEN {num} / {den} END AS corr "
            f"FROM fm, (SELECT CAST(COUNT(*) AS HUGEINT) AS n FROM fm) nn GROUP BY n")


ORACLE["A19_feature_correlations"] = with_ctes(*_FM_MATRIX, "cr AS (" + "\nUNION ALL\n".join(
    _corr_row(c) for c in _FC) + ")") + f"""
SELECT feature, {RND('corr', 6)} AS corr,
       ROW_NUMBER() OVER (ORDER BY abs(corr) DESC NULLS LAST, feature) AS abs_rank FROM cr"""

ORACLE["A15_A16_matrix_summary"] = with_ctes(*_FM_MATRIX) + """
SELECT COUNT(*) AS "rows", COUNT(DISTINCT match_id) AS distinct_match_ids, min(match_date) AS first_date,
       max(match_date) AS last_date,
       (SELECT COUNT(DISTINCT t) FROM (SELECT team1 AS t FROM fm UNION ALL SELECT team2 FROM fm) u) AS teams
FROM fm"""

ORACLE["V4_V7_matrix_checks"] = with_ctes(*_FM_MATRIX) + """
SELECT rule, violations FROM (
  SELECT 1 AS o, 'v4_team1_win_rate_range' AS rule,
         COUNT(*) FILTER (WHERE NOT COALESCE(team1_win_rate BETWEEN 0 AND 1, false)) AS violations FROM fm
  UNION ALL SELECT 2, 'v4_team2_win_rate_range',
         COUNT(*) FILTER (WHERE NOT COALESCE(team2_win_rate BETWEEN 0 AND 1, false)) FROM fm
  UNION ALL SELECT 3, 'v5_team1_streak_range',
         COUNT(*) FILTER (WHERE NOT COALESCE(team1_streak BETWEEN -10 AND 10, false)) FROM fm
  UNION ALL SELECT 4, 'v6_duplicate_match_id', COUNT(*) - COUNT(DISTINCT match_id) FROM fm
  UNION ALL SELECT 5, 'v7_target_domain', COUNT(*) FILTER (WHERE NOT COALESCE(team1_won IN (0, 1), false)) FROM fm
  UNION ALL SELECT 6, 'v7_h2h_complement', COUNT(*) FILTER (WHERE NOT COALESCE(
         round_even((team1_h2h_win_rate + team2_h2h_win_rate) * 100, 0) / 100 = 1.0, false)) FROM fm) x"""

ORACLE["P10_batting_card_display"] = with_ctes(*STATS_BASE) + """
SELECT match_id, ROW_NUMBER() OVER (PARTITION BY match_id ORDER BY runs DESC, player_name, team) AS card_order,
       player_name AS "Player", team AS "Team", runs AS "R", balls_faced AS "B", fours AS "4s", sixes AS "6s",
       CAST(strike_rate AS DOUBLE) AS "SR"
FROM player_stats WHERE role = 'batting' AND balls_faced > 0"""

ORACLE["U3_distinct_teams"] = with_ctes(CTE_MATCHES) + """
SELECT DISTINCT team FROM (SELECT team1 AS team FROM matches UNION ALL SELECT team2 FROM matches) t
WHERE team IS NOT NULL"""

# sliding 60 s windows every 30 s; append mode emits windows closed by the final watermark (max ts - 2 min)
ORACLE["T6_windowed_quota_stream"] = """
SELECT make_timestamp(end_us) AS window_end, user_id, COUNT(*) AS in_window, greatest(0, 10 - COUNT(*)) AS remaining
FROM (SELECT user_id, (CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) + k) * 1000000 AS end_us
      FROM events, (SELECT UNNEST(range(1, 61)) AS k) kk) w
GROUP BY end_us, user_id"""

ORACLE["M14_trapezoid_auc"] = with_ctes(*_FM_MATRIX, _AUC, """pts AS (
  SELECT 0.0 AS fpr, 0.0 AS tpr
  UNION ALL
  SELECT fp / (SELECT SUM(q) FROM sc), tp / (SELECT SUM(p) FROM sc) FROM (
    SELECT SUM(p) OVER (ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS tp,
           SUM(q) OVER (ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS fp FROM sc) x)""") + """
SELECT round_even(SUM((fpr - f0) * (tpr + t0) / 2) * 1000, 0) / 1000 + 0.0 AS auc FROM (
  SELECT fpr, tpr, LAG(fpr) OVER (ORDER BY fpr, tpr) AS f0, LAG(tpr) OVER (ORDER BY fpr, tpr) AS t0 FROM pts) x"""

ORACLE["C19_warehouse_report"] = with_ctes(*STATS_BASE, _INNINGS) + f"""
SELECT 'row_count' AS section, table_name AS item, row_count AS value FROM ({_TABLE_COUNTS}) c
UNION ALL SELECT * FROM (
  SELECT 'latest_match', name || ' | ' || status || ' | ' || CAST(match_date AS VARCHAR), match_id
  FROM matches ORDER BY match_date DESC, match_id DESC LIMIT 3) l
UNION ALL SELECT * FROM (
  SELECT 'recent_error', 'scorecard: Implausible strike_rate: ' || CAST(strike_rate AS VARCHAR), CAST(NULL AS BIGINT)
  FROM bat_card WHERE strike_rate > 500 AND NOT (runs > 200) ORDER BY 2 LIMIT 3) e
UNION ALL SELECT * FROM (
  SELECT 'top_runs', player_name || ' (' || team || ')', CAST(SUM(runs) AS BIGINT) AS total_runs
  FROM player_stats WHERE role = 'batting'
  GROUP BY player_name, team ORDER BY total_runs DESC, player_name, team LIMIT 5) t"""


ORACLE["V1_K4_match_validation_of_damaged_rows"] = with_ctes(CTE_MATCHES) + """
SELECT match_id, reasons IS NULL AS is_valid, reasons AS error_message FROM (
  SELECT match_id, NULLIF(concat_ws('; ',
    CASE WHEN match_id % 11 = 0 THEN 'Missing field: name' END,
    CASE WHEN match_id % 13 = 0 THEN 'Missing field: team1; Missing field: team2' END,
    CASE WHEN match_id % 7 = 0 THEN 'Missing field: match_date; Invalid date: None'
         WHEN match_id % 5 = 0 THEN 'Invalid date: 2024' END,
    CASE WHEN match_id % 13 = 0 OR match_id % 3 = 0 THEN 'team1 and team2 are identical' END), '') AS reasons
  FROM matches) x"""

ORACLE["V2_K4_stat_validation_of_damaged_rows"] = with_ctes(*STATS_BASE) + """,
lines AS (
  SELECT match_id, player_name, team, 'batting' AS role, CAST(runs AS DOUBLE) AS runs, fours, strike_rate,
         0.0 AS economy FROM bat_card
  UNION ALL
  SELECT match_id, player_name, team, 'bowling', 0, 0, 0.0, economy FROM bowl_card)
SELECT match_id, player_name, team, role, reasons IS NULL AS is_valid, reasons AS error_message,
       CASE WHEN match_id % 19 = 0 THEN 'Out of range for the table: economy 5000.0' END AS out_of_range
FROM (SELECT *, NULLIF(concat_ws('; ',
    CASE WHEN match_id % 7 = 0 THEN 'Cannot coerce runs: NaN' WHEN match_id % 11 = 0 THEN 'Cannot coerce runs: 5.0E9' END,
    CASE WHEN match_id % 13 = 0 THEN 'Cannot coerce balls_faced: x' END,
    CASE WHEN match_id % 17 = 0 THEN 'fours is negative' END,
    CASE WHEN strike_rate > 500 THEN 'Implausible strike_rate: ' || CAST(strike_rate AS VARCHAR) END), '') AS reasons
  FROM lines) x"""

ORACLE["F8_mixed_date_texts"] = with_ctes(CTE_MATCHES) + """
SELECT match_id, CASE match_id % 8 WHEN 0 THEN strftime(match_date, '%Y-%m-%d') WHEN 1 THEN strftime(match_date, '%Y/%m/%d')
    WHEN 2 THEN strftime(match_date, '%m/%d/%Y') WHEN 3 THEN strftime(match_date, '%-m-%-d-%Y')
    WHEN 4 THEN strftime(match_date, '%Y-%m-%d') || 'T14:00Z' WHEN 5 THEN strftime(match_date, '%Y-%m-%d') || ' 20:00:00'
    WHEN 6 THEN strftime(match_date, '%-d %b %Y') ELSE 'no date' END AS date_text,
  CASE WHEN match_id % 8 = 7 THEN NULL ELSE match_date END AS parsed FROM matches"""

# ---- sources and sinks written and read back; applied preparation --------------------------

_DAMAGED = """dmg AS (SELECT * REPLACE (CASE WHEN match_id % 17 = 0 THEN NULL ELSE team1_win_rate END AS team1_win_rate,
                         CASE WHEN match_id % 5 = 0 THEN NULL ELSE bowl_eco_diff END AS bowl_eco_diff) FROM fm)"""
_NULL_COLS = ["team1_win_rate", "team2_win_rate", "bowl_eco_diff"]

ORACLE["A18_null_report_of_damaged_matrix"] = with_ctes(*_FM_MATRIX, _DAMAGED) + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", COUNT(*) - COUNT({c}) AS null_count, {RR(f'(COUNT(*) - COUNT({c})) * 100', 'COUNT(*)', 2)} "
    f"AS null_pct FROM dmg HAVING COUNT(*) > COUNT({c})" for c in _NULL_COLS)

ORACLE["P13_median_fill_applied"] = with_ctes(*_FM_MATRIX, _DAMAGED) + """
SELECT match_id,
  COALESCE(team1_win_rate, (SELECT quantile_cont(CAST(team1_win_rate AS DOUBLE), 0.5) FROM dmg)) AS team1_win_rate,
  COALESCE(bowl_eco_diff, (SELECT quantile_cont(CAST(bowl_eco_diff AS DOUBLE), 0.5) FROM dmg)) AS bowl_eco_diff
FROM dmg"""

ORACLE["M1_M3_scaled_vector"] = with_ctes(*_FM_MATRIX) + "SELECT match_id, 20 AS n, " + ", ".join(
    f"""round((CAST({_FC[k]} AS DOUBLE) - (SELECT avg(CAST({_FC[k]} AS DOUBLE)) FROM sp WHERE is_train))
  / (SELECT CASE WHEN stddev_pop(CAST({_FC[k]} AS DOUBLE)) = 0 THEN 1.0 ELSE stddev_pop(CAST({_FC[k]} AS DOUBLE)) END
     FROM sp WHERE is_train), 6) AS z{k}""" for k in (0, 7, 19)) + " FROM sp"

ORACLE["M13_better_of_two_scores"] = with_ctes(*_FM_MATRIX, """pairs AS (
  SELECT p.score AS sp_, n.score AS sn_ FROM tst p, tst n WHERE p.team1_won = 1 AND n.team1_won <> 1)""", """aucs AS (
  SELECT round_even(avg(CASE WHEN sp_ > sn_ THEN 1.0 WHEN sp_ = sn_ THEN 0.5 ELSE 0.0 END), 3) AS a,
         round_even(avg(CASE WHEN 1.0 - sp_ > 1.0 - sn_ THEN 1.0 WHEN 1.0 - sp_ = 1.0 - sn_ THEN 0.5 ELSE 0.0 END), 3) AS b
  FROM pairs)""") + """
SELECT CASE WHEN b > a THEN 'reversed' ELSE 'form' END AS better_model, a AS auc_form, b AS auc_reversed FROM aucs"""

ORACLE["S1_S3_csv_history_typed"] = with_ctes(CTE_MATCHES, CTE_DELIVERIES) + """
SELECT match_id, ball, batting_team, batter, bowler, batsman_runs, total_runs FROM deliveries
WHERE NOT (match_id % 97 = 0 AND ball = 1)"""

ORACLE["S2_K4_csv_history_rejects"] = with_ctes(CTE_MATCHES, CTE_DELIVERIES) + """
SELECT 'history' AS source, 'Cannot coerce batsman_runs: x' AS error_message, match_id FROM deliveries
WHERE match_id % 97 = 0 AND ball = 1"""

ORACLE["S7_S8_K5_K6_replaced_table"] = with_ctes(CTE_MATCHES) + """
SELECT match_id, name, upper(status) AS status, true AS first_load, false AS second_load FROM matches"""

ORACLE["P9_card_of_one_match"] = with_ctes(*STATS_BASE) + """
SELECT role, player_name, team, CASE role WHEN 'batting' THEN runs ELSE wickets END AS points FROM player_stats
WHERE match_id = (SELECT MAX(match_id) FROM matches WHERE winner <> '')
  AND (role = 'batting' AND balls_faced > 0 OR role = 'bowling' AND overs_bowled > 0)"""

ORACLE["F21_live_prompts"] = with_ctes(*STATS_BASE, _INNINGS) + """
SELECT i.match_id, concat_ws(chr(10),
  'Describe the state of a running cricket match in one sentence of thirty words or fewer, from this sheet alone.', '',
  'fixture: ' || team1 || ' v ' || team2,
  'batting: ' || replace(inning_name, ' innings', '') || ', ' || runs || ' for ' || wickets || ' after ' || o || '.' || b || ' overs',
  'chance of winning, percent: ' || team1 || ' 55.5, ' || team2 || ' 44.5',
  CASE WHEN i.match_id % 2 = 1 THEN 'runs an over: 8.12 needed, 7.50 so far' ELSE '' END, '',
  'Name the score of the batting side and how the chances stand. Lively wording, true to the numbers.') AS prompt
FROM inn i JOIN matches m ON m.match_id = i.match_id WHERE status NOT IN ('completed', 'Completed', 'Result')"""

ORACLE["C20_matrix_quality_report"] = with_ctes(*_FM_MATRIX, _DAMAGED) + """
SELECT 'size' AS section, 'rows' AS item, CAST(COUNT(*) AS DOUBLE) AS value FROM dmg
UNION ALL SELECT 'target', CAST(team1_won AS VARCHAR), CAST(COUNT(*) AS DOUBLE) FROM dmg GROUP BY team1_won
UNION ALL SELECT 'nulls', 'team1_win_rate', CAST(COUNT(*) AS DOUBLE) FROM dmg WHERE team1_win_rate IS NULL HAVING COUNT(*) > 0
UNION ALL SELECT 'nulls', 'bowl_eco_diff', CAST(COUNT(*) AS DOUBLE) FROM dmg WHERE bowl_eco_diff IS NULL HAVING COUNT(*) > 0
UNION ALL SELECT 'violations', 'v4_team1_win_rate_range', CAST(COUNT(*) AS DOUBLE) FROM dmg
  WHERE team1_win_rate IS NULL OR team1_win_rate NOT BETWEEN 0 AND 1
UNION ALL SELECT 'violations', 'v4_team2_win_rate_range', CAST(COUNT(*) AS DOUBLE) FROM dmg WHERE team2_win_rate NOT BETWEEN 0 AND 1
UNION ALL SELECT 'violations', 'v5_team1_streak_range', CAST(COUNT(*) AS DOUBLE) FROM dmg WHERE team1_streak NOT BETWEEN -10 AND 10
UNION ALL SELECT 'violations', 'v6_duplicate_match_id', CAST(COUNT(*) - COUNT(DISTINCT match_id) AS DOUBLE) FROM dmg
UNION ALL SELECT 'violations', 'v7_target_domain', CAST(COUNT(*) AS DOUBLE) FROM dmg WHERE team1_won NOT IN (0, 1)
UNION ALL SELECT 'violations', 'v7_h2h_complement', CAST(COUNT(*) AS DOUBLE) FROM dmg
  WHERE round(team1_h2h_win_rate + team2_h2h_win_rate, 2) <> 1.0"""

ORACLE["T7_scores_and_rejects"] = with_ctes(*_FM_MATRIX, _DAMAGED) + f"""
SELECT match_id, team1, team2, CASE WHEN why = '' THEN {RND('(0.5 + win_rate_diff / 2.0) * 100.0', 1)} END AS team1_win_prob,
       CASE WHEN why = '' THEN {RND('(1.0 - (0.5 + win_rate_diff / 2.0)) * 100.0', 1)} END AS team2_win_prob,
       CASE WHEN why = '' THEN 'form' END AS model_used, NULLIF(why, '') AS error_message
FROM (SELECT * REPLACE (CASE WHEN match_id % 29 = 0 THEN ' ' WHEN match_id % 31 = 0 THEN team1 ELSE team2 END AS team2),
        concat_ws('; ', CASE WHEN match_id % 29 = 0 THEN 'Unknown team: team2' END,
                  CASE WHEN match_id % 29 <> 0 AND match_id % 31 = 0 THEN 'Team plays itself' END,
                  CASE WHEN match_id % 17 = 0 THEN 'Missing feature: team1_win_rate' END,
                  CASE WHEN match_id % 5 = 0 THEN 'Missing feature: bowl_eco_diff' END) AS why FROM dmg) x"""

# the objective is convex: the gradient vanishes at the optimum, for every feature
ORACLE["M5_logistic_certificate"] = "SELECT UNNEST(" + repr(["intercept", *_FC]) + ") AS feature, true AS optimal"
ORACLE["T6_exact_quota_stream"] = ORACLE["W10_request_quota"]
ORACLE["C11_live_features_from_day_states"] = ORACLE["C11_live_features"]

ORACLE["L5_correlation_head_tail"] = f"""
WITH c AS (SELECT feature, corr FROM ({ORACLE["A19_feature_correlations"]}) x)
SELECT * FROM (SELECT *, 'top' AS "end" FROM c ORDER BY corr DESC NULLS LAST, feature LIMIT 5) a
UNION ALL SELECT * FROM (SELECT *, 'bottom' FROM c ORDER BY corr ASC NULLS FIRST, feature LIMIT 5) b"""
