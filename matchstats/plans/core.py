"""Queries of the match, window and Elo operators.  Oracles are written the naive way: join on earlier dates, rank, cut."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchstats.operators import elo, matches, windows
from matchstats.operators.windows import DEFAULTS
from matchstats.plans.views import TEAM_ROWS, r6, rounded, view, with_views

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, **digits: int):
    """Registers a query under its function's name, with its oracle.  digits: places of a column whose values often end
    in a 5 at the seventh, which the two engines round differently."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir), digits)
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "games")


def team_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches.team_rows(games(spark, sf_dir))


def before(n: int, where: str = "TRUE", keys: str = "team_id") -> str:
    """Common tables d (asked rows) and p (earlier rows, rn = 1 for the latest, cut to n)."""
    on = " AND ".join(f"d.{k} = h.{k}" for k in keys.split(", "))
    part = ", ".join(f"d.{k}" for k in keys.split(", "))
    return (
        f"d AS (SELECT DISTINCT {keys}, game_date FROM t), p AS (SELECT * FROM (SELECT {part}, d.game_date AS asked, h.* EXCLUDE ({keys}, game_date), h.game_date AS played, "
        f"row_number() OVER (PARTITION BY {part}, d.game_date ORDER BY h.game_date DESC, h.game_id DESC) AS rn FROM d JOIN t h ON {on} AND h.game_date < d.game_date WHERE {where}) WHERE rn <= {n})"
    )


_PAIRED = ["game_id", "game_date", "home_team_id", "away_team_id", "home_score", "away_score", "home_win", "point_differential"]


@query(with_views("SELECT GAME_ID AS game_id, GAME_DATE AS game_date, min(CASE WHEN MATCHUP LIKE '% vs. %' THEN TEAM_ID END) AS home_team_id, min(CASE WHEN MATCHUP LIKE '% @ %' THEN TEAM_ID END) AS away_team_id, "
    "CAST(coalesce(sum(CASE WHEN MATCHUP LIKE '% vs. %' THEN PTS END), 0) AS BIGINT) AS home_score, CAST(coalesce(sum(CASE WHEN MATCHUP LIKE '% @ %' THEN PTS END), 0) AS BIGINT) AS away_score, "
    "CAST(coalesce(sum(CASE WHEN MATCHUP LIKE '% vs. %' THEN PTS END), 0) > coalesce(sum(CASE WHEN MATCHUP LIKE '% @ %' THEN PTS END), 0) AS BIGINT) AS home_win, "
    "CAST(coalesce(sum(CASE WHEN MATCHUP LIKE '% vs. %' THEN PTS END), 0) - coalesce(sum(CASE WHEN MATCHUP LIKE '% @ %' THEN PTS END), 0) AS BIGINT) AS point_differential "
    "FROM team_logs GROUP BY GAME_ID, GAME_DATE HAVING count(*) = 2 AND sum(CASE WHEN MATCHUP LIKE '% vs. %' THEN 1 ELSE 0 END) = 1 AND sum(CASE WHEN MATCHUP LIKE '% @ %' THEN 1 ELSE 0 END) = 1", "team_logs"))  # fmt: skip
def pair_games(spark, sf_dir):
    return matches.pair_games(view(spark, sf_dir, "team_logs")).select(*_PAIRED)


@query(with_views("SELECT h.GAME_ID AS game_id, h.GAME_DATE AS game_date, h.TEAM_ID AS home_team_id, a.TEAM_ID AS away_team_id, h.PTS AS home_score, a.PTS AS away_score, CAST(h.PTS > a.PTS AS BIGINT) AS home_win, h.PTS - a.PTS AS point_differential "
    "FROM (SELECT * FROM team_logs WHERE MATCHUP LIKE '%vs.%' QUALIFY row_number() OVER (PARTITION BY GAME_ID ORDER BY TEAM_ID DESC) = 1) h JOIN team_logs a ON h.GAME_ID = a.GAME_ID AND a.MATCHUP NOT LIKE '%vs.%' WHERE h.PTS > 0 AND a.PTS IS NOT NULL", "team_logs"))  # fmt: skip
def pair_games_lenient(spark, sf_dir):
    return matches.pair_games(view(spark, sf_dir, "team_logs"), strict=False).select(*_PAIRED)


_FULL = [*matches.BOX]


@query(with_views("SELECT h.GAME_ID AS game_id, h.GAME_DATE AS game_date, h.SEASON AS season, h.pool_id, h.TEAM_ID AS home_team_id, a.TEAM_ID AS away_team_id, h.TEAM_ABBREVIATION AS home_team, a.TEAM_ABBREVIATION AS away_team, coalesce(h.PTS, 0) AS home_score, coalesce(a.PTS, 0) AS away_score, "
    + ", ".join(r6(f"CAST({k}.{b.upper()} AS DOUBLE)", f"{s}_{b}") for s, k in (("home", "h"), ("away", "a")) for b in _FULL) + " FROM box_logs h JOIN box_logs a ON h.GAME_ID = a.GAME_ID AND h.MATCHUP LIKE '% vs. %' AND a.MATCHUP LIKE '% @ %'", "box_logs"))
def pair_full_games(spark, sf_dir):
    """Games with season, pool, names and both box scores."""
    g = matches.pair_games(view(spark, sf_dir, "box_logs"))
    box = [F.col(f"{s}_{b}").cast("double").alias(f"{s}_{b}") for s in ("home", "away") for b in _FULL]
    return g.select("game_id", "game_date", "season", "pool_id", "home_team_id", "away_team_id", "home_team", "away_team", "home_score", "away_score", *box)


@query(with_views("SELECT GAME_ID, TEAM_ID, CASE WHEN MATCHUP LIKE '%vs.%' THEN PTS WHEN WL = 'W' THEN PTS - abs(PLUS_MINUS) ELSE PTS + abs(PLUS_MINUS) END AS home_score, "
    "CASE WHEN MATCHUP NOT LIKE '%vs.%' THEN PTS WHEN WL = 'W' THEN PTS - abs(PLUS_MINUS) ELSE PTS + abs(PLUS_MINUS) END AS away_score FROM team_logs", "team_logs"))  # fmt: skip
def score_from_one_row(spark, sf_dir):
    return matches.score_from_one_row(view(spark, sf_dir, "team_logs"))


@query(with_views("SELECT 'completed' AS status, count(*) AS n FROM games WHERE home_score IS NOT NULL AND away_score IS NOT NULL AND (home_score > 0 OR away_score > 0) UNION ALL SELECT 'scheduled', count(DISTINCT game_id) FROM games WHERE home_score IS NULL OR home_score = 0", "games"))
def game_status(spark, sf_dir):
    g = games(spark, sf_dir)
    both = matches.completed(g).select(F.lit("completed").alias("status")).unionAll(matches.scheduled(g).select(F.lit("scheduled").alias("status")))
    return both.groupBy("status").agg(F.count("*").alias("n"))


@query(with_views("SELECT game_id, game_date FROM games WHERE game_date >= DATE '1997-01-01' AND game_date < DATE '1998-03-01'", "games"))
def date_window(spark, sf_dir):
    return matches.date_window(games(spark, sf_dir), "1997-01-01", "1998-03-01").select("game_id", "game_date")


@query("SELECT DISTINCT CAST(year(o_orderdate) AS BIGINT) AS y, CAST(year(o_orderdate) AS VARCHAR) || '-' || substr(CAST(year(o_orderdate) + 1 AS VARCHAR), 3, 2) AS season FROM orders")
def season_label(spark, sf_dir):
    return games(spark, sf_dir).select(F.year("game_date").alias("y")).distinct().withColumn("season", matches.season_label(F.col("y")))


_FORMATS = ["strftime(o_orderdate, '%Y-%m-%d')", "strftime(o_orderdate, '%Y/%m/%d')", "strftime(o_orderdate, '%m/%d/%Y')", "'soon'"]


@query("SELECT o_orderkey AS game_id, CASE WHEN o_orderkey%4 < 3 THEN CAST(o_orderdate AS DATE) END AS parsed FROM orders")
def parse_date(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k = F.col("o_orderkey") % 4
    text = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 1, F.date_format("o_orderdate", "yyyy/MM/dd")).when(k == 2, F.date_format("o_orderdate", "MM/dd/yyyy")).otherwise("soon")
    return o.select(F.col("o_orderkey").alias("game_id"), matches.parse_date(text).alias("parsed"))


@query(with_views("SELECT game_id, game_date, team_id, opponent_id, is_home::BIGINT AS is_home, pts, opp_pts, win::BIGINT AS win, fga, opp_fga FROM t", "games", more=TEAM_ROWS))
def team_perspective(spark, sf_dir):
    return team_rows(spark, sf_dir).select("game_id", "game_date", "team_id", "opponent_id", "is_home", "pts", "opp_pts", "win", "fga", "opp_fga")


_POSS = "0.5*((fga + 0.4E0*fta - 1.07E0*(oreb/(oreb + opp_dreb + 1.0E0))*(fga - fgm) + tov) + (opp_fga + 0.4E0*opp_fta - 1.07E0*(opp_oreb/(opp_oreb + dreb + 1.0E0))*(opp_fga - opp_fgm) + opp_tov))"
_FORM = {
    "win_pct": "avg(win)", "ppg": "avg(pts)", "opp_ppg": "avg(opp_pts)", "point_diff": "avg(pts - opp_pts)", "fg_pct": "avg(fg_pct)", "fg3_pct": "avg(fg3_pct)", "ft_pct": "avg(ft_pct)",
    "reb": "avg(reb)", "ast": "avg(ast)", "tov": "avg(tov)", "opp_fg3_pct": "avg(opp_fg3_pct)", "offensive_rating": f"avg(CASE WHEN {_POSS} > 0 THEN pts*100.0E0/({_POSS}) END)",
    "defensive_rating": f"avg(CASE WHEN {_POSS} > 0 THEN opp_pts*100.0E0/({_POSS}) END)", "pace": f"avg(CASE WHEN {_POSS} > 0 THEN {_POSS} END)",
    "three_point_rate": "avg(fg3a)/avg(fga)", "opp_three_point_rate": "avg(opp_fg3a)/avg(opp_fga)",
}


def _form_sql(n: int) -> str:
    inner = ", ".join(f"{e} AS {k}" for k, e in _FORM.items())
    cols = ", ".join(r6(f"coalesce({k}, {DEFAULTS[k]})", f"last{n}_{k}") for k in _FORM)
    net = r6(f"coalesce(offensive_rating, {DEFAULTS['offensive_rating']}) - coalesce(defensive_rating, {DEFAULTS['defensive_rating']})", f"last{n}_net_rating")
    return with_views(
        f"SELECT d.team_id, d.game_date, {cols}, {net} FROM d LEFT JOIN (SELECT team_id, asked, {inner} FROM p GROUP BY team_id, asked) s ON d.team_id = s.team_id AND d.game_date = s.asked",
        "games", more=f"{TEAM_ROWS}, {before(n, 'h.fga IS NOT NULL AND h.pts IS NOT NULL')}",
    )


def _form(n: int):
    def run(spark, sf_dir):
        return windows.recent_form(team_rows(spark, sf_dir), (n,))

    run.__name__ = f"recent_form_last{n}"
    query(_form_sql(n))(run)


for _n in (3, 5, 10):
    _form(_n)


@query(with_views(f"SELECT game_id, team_id, {r6(_POSS, 'poss')} FROM t", "games", more=TEAM_ROWS))
def possessions(spark, sf_dir):
    return team_rows(spark, sf_dir).select("game_id", "team_id", windows.possessions().alias("poss"))


@query(with_views("SELECT d.team_id, d.is_home::BIGINT AS is_home, d.game_date, " + ", ".join(r6(f"coalesce(avg({e}), {DEFAULTS[k]})", f"split_{k}") for k, e in (("win_pct", "win"), ("ppg", "pts"), ("point_diff", "pts - opp_pts"), ("fg_pct", "fg_pct")))
    + " FROM d LEFT JOIN p ON d.team_id = p.team_id AND d.is_home = p.is_home AND d.game_date = p.asked GROUP BY ALL", "games", more=f"{TEAM_ROWS}, {before(15, 'h.pts IS NOT NULL', 'team_id, is_home')}"))
def venue_split(spark, sf_dir):
    return windows.venue_split(team_rows(spark, sf_dir))


@query(with_views("SELECT a.game_id, " + ", ".join([
        r6("coalesce(avg(w) FILTER (rn <= 10), 0.5)", "h2h_home_win_pct"), "count(rn) FILTER (rn <= 10) AS h2h_total_games", r6("coalesce(avg(hs - aws) FILTER (rn <= 10), 0.0)", "h2h_avg_point_diff"),
        "CAST(coalesce(sum(w) FILTER (rn <= 3), 0) AS BIGINT) AS h2h_last3_home_wins", r6("coalesce(avg(hs) FILTER (rn <= 10), 110.0)", "h2h_home_ppg"), r6("coalesce(avg(aws) FILTER (rn <= 10), 110.0)", "h2h_away_ppg")])
    + " FROM games a LEFT JOIN (SELECT a.game_id, CAST(b.home_score > b.away_score AS INTEGER) AS w, b.home_score AS hs, b.away_score AS aws, row_number() OVER (PARTITION BY a.game_id ORDER BY b.game_date DESC, b.game_id DESC) AS rn FROM games a JOIN games b ON a.pool_id = b.pool_id AND least(a.home_team_id, a.away_team_id) = least(b.home_team_id, b.away_team_id) AND greatest(a.home_team_id, a.away_team_id) = greatest(b.home_team_id, b.away_team_id) AND b.game_date < a.game_date AND b.home_score IS NOT NULL) m ON a.game_id = m.game_id GROUP BY a.game_id", "games"))
def head_to_head(spark, sf_dir):
    return windows.head_to_head(games(spark, sf_dir))


@query(with_views("SELECT d.team_id, d.game_date, coalesce(date_diff('day', max(t.game_date), d.game_date) - 1, 3) AS rest_days, CAST(coalesce(date_diff('day', max(t.game_date), d.game_date) - 1, 3) = 0 AS BIGINT) AS back_to_back FROM (SELECT DISTINCT team_id, game_date FROM t) d LEFT JOIN t ON d.team_id = t.team_id AND t.game_date < d.game_date GROUP BY d.team_id, d.game_date", "games", more=TEAM_ROWS))
def rest_days(spark, sf_dir):
    return windows.rest_days(team_rows(spark, sf_dir))


@query(with_views("SELECT d.team_id, d.game_date, CASE WHEN max(l.win) IS NULL THEN 0 ELSE (2*max(l.win) - 1)*least(15, coalesce(min(p.rn) FILTER (p.win <> l.win) - 1, max(p.rn))) END AS streak FROM d LEFT JOIN p ON d.team_id = p.team_id AND d.game_date = p.asked LEFT JOIN p l ON d.team_id = l.team_id AND d.game_date = l.asked AND l.rn = 1 GROUP BY d.team_id, d.game_date", "games", more=f"{TEAM_ROWS}, {before(16, 'h.win IS NOT NULL')}"))
def streak(spark, sf_dir):
    return windows.streak(team_rows(spark, sf_dir))


@query(with_views("SELECT team_id, game_date, n AS road_trip_length, CAST(n >= 4 AS BIGINT) AS long_road_trip FROM (SELECT d.team_id, d.game_date, CASE WHEN max(p.rn) IS NULL THEN 0 ELSE least(10, coalesce(min(p.rn) FILTER (p.is_home = 1) - 1, max(p.rn))) END AS n FROM d LEFT JOIN p ON d.team_id = p.team_id AND d.game_date = p.asked GROUP BY d.team_id, d.game_date)", "games", more=f"{TEAM_ROWS}, {before(11)}"))
def road_trip(spark, sf_dir):
    return windows.road_trip(team_rows(spark, sf_dir))


@query(with_views("SELECT d.team_id, d.game_date, count(t.game_id) AS games_last_7d FROM (SELECT DISTINCT team_id, game_date FROM t) d LEFT JOIN t ON d.team_id = t.team_id AND t.game_date < d.game_date AND t.game_date >= d.game_date - 7 GROUP BY d.team_id, d.game_date", "games", more=TEAM_ROWS))
def games_last_days(spark, sf_dir):
    return windows.games_last_days(team_rows(spark, sf_dir))


@query(with_views(f"SELECT team_id, CAST(sum(win) AS BIGINT) AS wins, CAST(count(*) - sum(win) AS BIGINT) AS losses, {r6('avg(win)', 'win_pct')}, {r6('avg(pts)', 'ppg')} FROM (SELECT * FROM t WHERE win IS NOT NULL QUALIFY row_number() OVER (PARTITION BY team_id ORDER BY game_date DESC, game_id DESC) <= 15) GROUP BY team_id", "games", more=TEAM_ROWS))
def team_overview(spark, sf_dir):
    return windows.team_overview(team_rows(spark, sf_dir))


@query(with_views("SELECT team_id, game_id, game_date, row_number() OVER (PARTITION BY team_id ORDER BY game_date DESC, game_id DESC) AS rn FROM t QUALIFY rn <= 10", "games", more=TEAM_ROWS))
def latest_games(spark, sf_dir):
    return windows.latest_games(team_rows(spark, sf_dir)).select("team_id", "game_id", "game_date", "rn")


@query(with_views("SELECT home_team_id, away_team_id, game_id, row_number() OVER (PARTITION BY pool_id, least(home_team_id, away_team_id), greatest(home_team_id, away_team_id) ORDER BY game_date DESC, game_id DESC) AS rn FROM games QUALIFY rn <= 5", "games"))
def latest_meetings(spark, sf_dir):
    return windows.latest_meetings(games(spark, sf_dir)).select("home_team_id", "away_team_id", "game_id", "rn")


_ELO = """g AS (SELECT pool_id, game_id, game_date, home_team_id - pool_id*30 + 1 AS hi, away_team_id - pool_id*30 + 1 AS ai, home_team_id, away_team_id, home_score - away_score AS diff,
  row_number() OVER (PARTITION BY pool_id ORDER BY game_date, game_id) AS k FROM games WHERE home_score IS NOT NULL),
s(pool_id, k, st, game_id, hb, ab, delta) AS (
  SELECT DISTINCT pool_id, CAST(0 AS BIGINT), [1500.0::DOUBLE FOR x IN range(30)], CAST(NULL AS BIGINT), 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM g
  UNION ALL SELECT pool_id, k, [CASE WHEN i = hi THEN st[i] + dd WHEN i = ai THEN st[i] - dd ELSE st[i] END FOR i IN range(1, 31)], game_id, st[hi], st[ai], dd FROM (
    SELECT s.pool_id, g.k, s.st, g.game_id, g.hi, g.ai, 20*least(greatest(ln(abs(diff) + 1)*2.2::DOUBLE/((st[hi] - st[ai])*0.001::DOUBLE + 2.2::DOUBLE), 1), 3)*(CASE WHEN diff > 0 THEN 1 ELSE 0 END - 1/(1 + pow(10::DOUBLE, -(st[hi] + 100 - st[ai])/400::DOUBLE))) AS dd
    FROM s JOIN g ON s.pool_id = g.pool_id AND g.k = s.k + 1)),
history AS (SELECT g.pool_id, g.game_id, g.game_date, g.home_team_id AS team_id, hb AS elo_before, hb + delta AS elo_after FROM s JOIN g USING (game_id)
  UNION ALL SELECT g.pool_id, g.game_id, g.game_date, g.away_team_id, ab, ab - delta FROM s JOIN g USING (game_id))"""


def elo_sql(sql: str, more: str = "") -> str:
    return with_views(sql, "games", recursive=True, more=_ELO + (", " + more if more else ""))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elo.elo_history(games(spark, sf_dir))


@query(elo_sql(f"SELECT pool_id, game_id, game_date, team_id, {r6('elo_before')}, {r6('elo_after')} FROM history"))
def elo_history(spark, sf_dir):
    return history(spark, sf_dir)


@query(elo_sql(f"SELECT pool_id, team_id, {r6('arg_max(elo_after, (game_date, game_id))', 'elo')}, max(game_date) AS last_updated FROM history GROUP BY pool_id, team_id"))
def current_elo(spark, sf_dir):
    return elo.current_elo(history(spark, sf_dir))


_CURRENT = "cur AS (SELECT pool_id, team_id, arg_max(elo_after, (game_date, game_id)) AS elo, max(game_date) AS last_updated FROM history GROUP BY pool_id, team_id)"


@query(elo_sql(f"SELECT pool_id, team_id, {r6('elo')}, last_updated, side FROM ((SELECT *, 'top' AS side FROM cur ORDER BY elo DESC, team_id LIMIT 5) UNION ALL (SELECT *, 'bottom' FROM cur ORDER BY elo, team_id LIMIT 5))", _CURRENT))
def elo_extremes(spark, sf_dir):
    return elo.elo_extremes(elo.current_elo(history(spark, sf_dir)))


@query(with_views(f"SELECT game_id, {r6('1/(1 + pow(10::DOUBLE, -(home_score + 100 - away_score)/400::DOUBLE))', 'p')} FROM games", "games"))
def elo_expected(spark, sf_dir):
    return games(spark, sf_dir).select("game_id", elo.elo_expected(F.col("home_score"), F.col("away_score")).alias("p"))


ELO_BEFORE = """b AS (SELECT g.game_id, coalesce(max(hh.elo_before), arg_max(hp.elo_after, (hp.game_date, hp.game_id)), 1500) AS h FROM games g LEFT JOIN history hh ON hh.game_id = g.game_id AND hh.team_id = g.home_team_id LEFT JOIN history hp ON hp.team_id = g.home_team_id AND hp.game_date < g.game_date GROUP BY g.game_id),
c AS (SELECT g.game_id, coalesce(max(hh.elo_before), arg_max(hp.elo_after, (hp.game_date, hp.game_id)), 1500) AS a FROM games g LEFT JOIN history hh ON hh.game_id = g.game_id AND hh.team_id = g.away_team_id LEFT JOIN history hp ON hp.team_id = g.away_team_id AND hp.game_date < g.game_date GROUP BY g.game_id)"""


@query(elo_sql(f"SELECT game_id, {r6('h', 'home_elo')}, {r6('a', 'away_elo')}, {r6('h - a', 'elo_diff')}, {r6('least(greatest(h - a, -200), 200)', 'elo_diff_capped')}, {r6('1/(1 + pow(10::DOUBLE, -(h + 100 - a)/400::DOUBLE))', 'elo_win_prob')} FROM b JOIN c USING (game_id)", ELO_BEFORE))
def elo_features(spark, sf_dir):
    return elo.elo_features(games(spark, sf_dir), history(spark, sf_dir))


@query(elo_sql(f"SELECT pool_id, game_id, game_date, team_id, {r6('elo_before')}, {r6('elo_after')} FROM history WHERE game_date >= DATE '2000-06-01'"))
def update_elo(spark, sf_dir):
    g = games(spark, sf_dir)
    old = elo.elo_history(g.where("game_date < date '2000-06-01'"))
    return elo.update_elo(elo.current_elo(old), g, old)


@query(elo_sql(f"""SELECT d.team_id, d.game_date, {r6('coalesce(avg(o.elo), 1500)', 'avg_opponent_elo')}, {r6('coalesce(avg(o.share), 0.5)', 'opponent_win_pct', 9)}, {r6('least(greatest((coalesce(avg(o.elo), 1500) - 1350)/300, 0), 1)', 'sos_normalized')},
  {r6('least(greatest(coalesce(avg(p.win), 0.5) + (least(greatest((coalesce(avg(o.elo), 1500) - 1350)/300, 0), 1) - 0.5::DOUBLE)*0.3::DOUBLE*(coalesce(avg(p.win), 0.5) - 0.5::DOUBLE), 0), 1)', 'sos_adjusted_win_pct')}
  FROM d LEFT JOIN p ON d.team_id = p.team_id AND d.game_date = p.asked LEFT JOIN o ON o.opponent_id = p.opponent_id AND o.asked = d.game_date GROUP BY d.team_id, d.game_date""",
    TEAM_ROWS + ", " + before(10, "h.win IS NOT NULL") + """, q AS (SELECT DISTINCT opponent_id, asked FROM p),
  o AS (SELECT q.opponent_id, q.asked, coalesce(arg_max(e.elo_after, (e.game_date, e.game_id)), 1500) AS elo, coalesce(avg(t.win), 0.5) AS share FROM q LEFT JOIN t ON t.team_id = q.opponent_id AND t.game_date < q.asked AND t.win IS NOT NULL LEFT JOIN history e ON e.game_id = t.game_id AND e.team_id = t.team_id GROUP BY q.opponent_id, q.asked)"""), opponent_win_pct=9)  # fmt: skip
def strength_of_schedule(spark, sf_dir):
    return windows.strength_of_schedule(team_rows(spark, sf_dir), history(spark, sf_dir))


@query(with_views(f"SELECT d.team_id, d.game_date, arg_max(t.game_id, (t.game_date, t.game_id)) AS last_game FROM (SELECT DISTINCT team_id, game_date FROM t) d LEFT JOIN t ON d.team_id = t.team_id AND t.game_date < d.game_date GROUP BY d.team_id, d.game_date", "games", more=TEAM_ROWS))
def asof_before(spark, sf_dir):
    t = team_rows(spark, sf_dir).select("team_id", "game_date", "game_id")
    return windows.asof_before(t.select("team_id", "game_date").distinct(), t, ["team_id"], "game_date", ["game_id"], "s").select("team_id", "game_date", F.col("s.game_id").alias("last_game"))
