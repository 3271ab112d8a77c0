"""Match tables derived from the driver's tables, by the same SQL text in Spark and in the DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from matchstats.operators.matches import BOX

#: Box-score figures of a side as functions of the game number k and an offset; null in every 17th game.
_FIGURES = {
    "fgm": "30 + (k*3 + {o})%18", "fga": "75 + (k + {o})%23", "fg3m": "8 + (k*5 + {o})%10", "fg3a": "25 + (k + {o})%15", "ftm": "10 + (k*7 + {o})%15",
    "fta": "25 + (k + {o})%7", "oreb": "6 + (k*11 + {o})%9", "dreb": "28 + (k*13 + {o})%12", "ast": "18 + (k*17 + {o})%15", "tov": "9 + (k*19 + {o})%11",
}


def _box(side: str, o: int) -> str:
    fig = {n: f"({e.format(o=o)})" for n, e in _FIGURES.items()}
    fig |= {"reb": f"({fig['oreb']} + {fig['dreb']})"}
    fig |= {p: f"(CAST({fig[a]} AS DOUBLE) / {fig[b]})" for p, a, b in (("fg_pct", "fgm", "fga"), ("fg3_pct", "fg3m", "fg3a"), ("ft_pct", "ftm", "fta"))}
    return ", ".join(f"CASE WHEN k%17 = 0 THEN NULL ELSE {fig[b]} END AS {side}_{b}" for b in BOX)


#: Views by name: their SQL over the driver's tables and over earlier views.
VIEWS = {
    "games": f"""SELECT game_id, game_date, pool_id, home_team_id, away_team_id,
  CASE WHEN k%97 = 5 THEN NULL ELSE hs END AS home_score, CASE WHEN k%97 = 5 THEN NULL ELSE aws END AS away_score, {_box('home', 0)}, {_box('away', 5)}
FROM (SELECT o_orderkey AS game_id, CAST(o_orderdate AS DATE) AS game_date, CAST(floor(o_custkey/30.0) AS BIGINT) AS pool_id, o_custkey AS home_team_id,
  CAST(floor(o_custkey/30.0) AS BIGINT)*30 + (o_custkey%30 + 1 + o_orderkey%29)%30 AS away_team_id, 80 + CAST(floor(o_totalprice) AS BIGINT)%61 AS hs,
  80 + (o_orderkey*7 + CAST(floor(o_totalprice/100) AS BIGINT))%61 AS aws, o_orderkey AS k FROM orders) AS o""",
    "teams": """SELECT c_custkey AS team_id, concat('City', CAST(c_custkey AS VARCHAR(20)), ' Club', CAST(c_custkey%50 AS VARCHAR(20))) AS full_name,
  concat('T', CAST(c_custkey AS VARCHAR(20))) AS abbreviation, c_nationkey FROM customer""",
    "team_logs": """SELECT game_id AS GAME_ID, game_date AS GAME_DATE, season AS SEASON, team_id AS TEAM_ID, pts AS PTS, matchup AS MATCHUP, wl AS WL, pm AS PLUS_MINUS FROM (
  SELECT game_id, game_date, CAST(year(game_date) AS VARCHAR(20)) AS season, home_team_id AS team_id, home_score AS pts, concat('T', CAST(home_team_id AS VARCHAR(20)), ' vs. T', CAST(away_team_id AS VARCHAR(20))) AS matchup,
    CASE WHEN home_score > away_score THEN 'W' ELSE 'L' END AS wl, home_score - away_score AS pm FROM games WHERE game_id%103 <> 0
  UNION ALL SELECT game_id, game_date, CAST(year(game_date) AS VARCHAR(20)), away_team_id, away_score, concat('T', CAST(away_team_id AS VARCHAR(20)), CASE WHEN game_id%107 = 0 THEN ' vs. T' ELSE ' @ T' END, CAST(home_team_id AS VARCHAR(20))),
    CASE WHEN away_score > home_score THEN 'W' ELSE 'L' END, away_score - home_score FROM games WHERE game_id%101 <> 0) AS l""",
    "box_logs": "SELECT game_id AS GAME_ID, game_date AS GAME_DATE, CAST(year(game_date) AS VARCHAR(20)) AS SEASON, pool_id, home_team_id AS TEAM_ID, concat('T', CAST(home_team_id AS VARCHAR(20))) AS TEAM_ABBREVIATION, concat('T', CAST(home_team_id AS VARCHAR(20)), ' vs. T', CAST(away_team_id AS VARCHAR(20))) AS MATCHUP, home_score AS PTS, "
    + ", ".join(f"home_{b} AS {b.upper()}" for b in BOX) + " FROM games UNION ALL SELECT game_id, game_date, CAST(year(game_date) AS VARCHAR(20)), pool_id, away_team_id, concat('T', CAST(away_team_id AS VARCHAR(20))), concat('T', CAST(away_team_id AS VARCHAR(20)), ' @ T', CAST(home_team_id AS VARCHAR(20))), away_score, "
    + ", ".join(f"away_{b}" for b in BOX) + " FROM games",
    "predictions": """SELECT game_id, game_date, CAST(game_date AS TIMESTAMP) AS prediction_date, CASE WHEN game_id%11 = 0 THEN away_team_id ELSE home_team_id END AS home_id, CASE WHEN game_id%11 = 0 THEN home_team_id ELSE away_team_id END AS away_id,
  (1 + game_id%97)/99.0E0 AS predicted_home_prob, 1 - (1 + game_id%97)/99.0E0 AS predicted_away_prob, 0.5E0 + (game_id%50)/100.0E0 AS confidence,
  CASE WHEN game_id%5 = 0 THEN NULL ELSE 1.2E0 + (game_id%40)/20.0E0 END AS home_odds, CASE WHEN game_id%7 = 0 THEN NULL ELSE 1.2E0 + (game_id%30)/20.0E0 END AS away_odds,
  CASE WHEN game_id%3 = 0 OR home_score IS NULL THEN NULL WHEN (home_score > away_score) <> (game_id%11 = 0) THEN 'home' ELSE 'away' END AS actual_winner FROM games""",
    "quotes": """SELECT l_orderkey AS game_id, concat('book', CAST(l_suppkey%7 AS VARCHAR(20))) AS bookmaker, max(1.05E0 + l_quantity/20) AS home, max(1.05E0 + (51 - l_quantity)/20) AS away FROM lineitem GROUP BY l_orderkey, l_suppkey%7""",
    "player_logs": """SELECT l_partkey AS player_id, l_suppkey AS team_id, l_orderkey AS game_id, CAST(l_shipdate AS DATE) AS game_date, l_linenumber AS line, l_quantity AS points, l_discount*100 AS rebounds, l_tax*100 AS assists, l_discount AS fg_pct, floor(l_extendedprice/1000.0) AS minutes FROM lineitem""",
    "posts": "SELECT event_id AS post_id, user_id AS account, ts AS posted_at FROM events",
    "injuries": """SELECT user_id%30 AS team_id, concat('P', CAST(event_id%200 AS VARCHAR(20))) AS player_name, CASE event_type WHEN 'error' THEN 'Out' WHEN 'click' THEN 'DNP - rest' WHEN 'view' THEN 'Day-To-Day' ELSE 'Questionable' END AS status,
  event_id%3 = 0 AS is_starter, event_id%10 = 0 AS is_star, ts AS fetched_at FROM events""",
    "cache": "SELECT event_type AS cache, user_id AS key, value AS payload, ts AS cached_at, ts + INTERVAL 24 HOURS AS expires_at FROM events",
    "bets": "SELECT event_id AS id, user_id AS account, ts AS created_at, value AS stake, 1.5E0 + (event_id%10)/10.0E0 AS odds, CASE WHEN event_id%3 = 0 THEN value*(1.5E0 + (event_id%10)/10.0E0) ELSE 0.0E0 END AS actual_payout, event_type = 'signup' AS is_reset FROM events WHERE event_type IN ('purchase', 'click', 'signup')",
    "arenas": "SELECT c_custkey AS team_id, -60.0E0 + 5*c_nationkey AS lat, -170.0E0 + 13*c_nationkey AS lon, c_nationkey%4 AS tz_offset FROM customer WHERE c_custkey%19 <> 0",
}
_AFTER = {"team_logs": ["games"], "box_logs": ["games"], "predictions": ["games"]}
_TABLES = {"games": ["orders"], "teams": ["customer"], "quotes": ["lineitem"], "player_logs": ["lineitem"], "arenas": ["customer"]}


#: Keys that a view's table is dealt by at first, so that neither the view's own grouping nor one of its results by that key
#: deals it anew.
_DEALT = {"quotes": "l_orderkey"}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of VIEWS over the tables of a folder."""
    for table in _TABLES.get(name, [] if name in _AFTER else ["events"]):
        rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        (rows.repartition(_DEALT[name]) if name in _DEALT else rows).createOrReplaceTempView(table)
    for before in _AFTER.get(name, []):
        view(spark, sf_dir, before).createOrReplaceTempView(before)
    return spark.sql(VIEWS[name])


def with_views(sql: str, *names: str, recursive: bool = False, more: str = "") -> str:
    """An oracle statement: the named views (and what they need) as common tables before `sql`."""
    wanted: list[str] = []
    for n in names:
        wanted += [x for x in [*_AFTER.get(n, []), n] if x not in wanted]
    tables = ",\n".join(f"{n} AS ({VIEWS[n].replace('INTERVAL 24 HOURS', 'INTERVAL 24 HOUR')})" for n in wanted)
    return f"WITH {'RECURSIVE ' * recursive}{tables}{',' * bool(more)}\n{more}\n{sql}"


def r6(expression: str, name: str | None = None, digits: int = 6) -> str:
    """An SQL expression rounded to six places, without negative zeros."""
    return f"round({expression}, {digits}) + 0.0 AS {name or expression.split('.')[-1]}"


def exact(sql: str) -> str:
    """The statement without the rounding that r6() adds."""
    end = " + 0.0 AS "
    while (at := sql.find(end)) >= 0:
        depth, i = 0, at - 1
        while True:
            depth += {")": 1, "(": -1}.get(sql[i], 0)
            if not depth:
                break
            i -= 1
        inside = sql[i + 1 : at - 1].rpartition(",")[0]
        sql = sql[: i - len("round")] + f"({inside}) AS " + sql[at + len(end) :]
    return sql


def rounded(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    """All double columns rounded to six (or the given) places, whole numbers as long."""
    from pyspark.sql import functions as F

    return df.select(*[(F.round(c, digits.get(c, 6)) + F.lit(0.0)).alias(c) if k == "double" else F.col(c).cast("long").alias(c) if k in ("int", "smallint") else F.col(c) for c, k in df.dtypes])


#: Team rows of the games view, for oracles.
TEAM_ROWS = (
    "t AS (SELECT pool_id, game_id, game_date, home_team_id AS team_id, away_team_id AS opponent_id, 1 AS is_home, home_score AS pts, away_score AS opp_pts, "
    "CASE WHEN home_score > away_score THEN 1 WHEN home_score IS NOT NULL THEN 0 END AS win, "
    + ", ".join(f"home_{b} AS {b}, away_{b} AS opp_{b}" for b in BOX)
    + " FROM games UNION ALL SELECT pool_id, game_id, game_date, away_team_id, home_team_id, 0, away_score, home_score, "
    "CASE WHEN home_score > away_score THEN 0 WHEN home_score IS NOT NULL THEN 1 END, "
    + ", ".join(f"away_{b}, home_{b}" for b in BOX)
    + " FROM games)"
)
