"""Queries of the settlement, metric, odds, context, pick and upsert operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchstats.functions import names, scalars
from matchstats.operators import context, elo, metrics, odds, picks, settle, upserts
from matchstats.operators.features import FEATURES
from matchstats.plans.core import ELO_BEFORE, SQL, elo_sql, query
from matchstats.plans.views import r6, view, with_views

AS_OF = "2000-01-01"
_PLAYED = "home_score IS NOT NULL AND away_score IS NOT NULL AND (home_score > 0 OR away_score > 0)"
#: Predictions with errors, as the metrics need them: settled rows are those with a winner.
_SETTLED = """s AS (SELECT *, CASE WHEN actual_winner IS NULL THEN NULL WHEN (actual_winner = 'home') = (predicted_home_prob > predicted_away_prob) THEN 1 ELSE 0 END AS correct,
  CASE WHEN actual_winner IS NULL THEN NULL ELSE pow(predicted_home_prob - CASE WHEN actual_winner = 'home' THEN 1 ELSE 0 END, 2) END AS prediction_error,
  CASE WHEN actual_winner IS NULL THEN NULL ELSE abs(predicted_home_prob - CASE WHEN actual_winner = 'home' THEN 1 ELSE 0 END) END AS calibration_error FROM predictions)"""


def pred(spark, sf_dir):
    return view(spark, sf_dir, "predictions")


def settled(spark, sf_dir):
    won = F.when(F.col("actual_winner") == "home", 1).otherwise(0)
    known = F.col("actual_winner").isNotNull()
    return pred(spark, sf_dir).withColumns({
        "correct": F.when(known, (won == (F.col("predicted_home_prob") > F.col("predicted_away_prob")).cast("int")).cast("int")),
        "prediction_error": F.when(known, F.pow(F.col("predicted_home_prob") - won, 2)), "calibration_error": F.when(known, F.abs(F.col("predicted_home_prob") - won)),
    })


# Settlement ---------------------------------------------------------------------------------------------------------

_RES = f"res AS (SELECT game_date, home_team_id AS home_id, away_team_id AS away_id, arg_min(home_score, game_id) AS hs, arg_min(away_score, game_id) AS aws FROM games WHERE {_PLAYED} GROUP BY ALL)"


@query(with_views(f"SELECT p.game_id, r.hs AS actual_home_score, r.aws AS actual_away_score, CASE WHEN hs > aws THEN 'home' WHEN hs IS NOT NULL THEN 'away' END AS actual_winner, CAST((hs > aws) = (predicted_home_prob > predicted_away_prob) AS BIGINT) AS correct, {r6('pow(predicted_home_prob - CAST(hs > aws AS INTEGER), 2)', 'prediction_error')}, {r6('abs(predicted_home_prob - CAST(hs > aws AS INTEGER))', 'calibration_error')} FROM predictions p LEFT JOIN res r ON p.game_date = r.game_date AND p.home_id = r.home_id AND p.away_id = r.away_id WHERE actual_winner IS NULL AND p.game_date BETWEEN DATE '{AS_OF}' - 400 AND DATE '{AS_OF}'", "predictions", more=_RES))
def settle_predictions(spark, sf_dir):
    return settle.settle_predictions(pred(spark, sf_dir), view(spark, sf_dir, "games"), AS_OF, 400).select("game_id", "actual_home_score", "actual_away_score", "actual_winner", "correct", "prediction_error", "calibration_error")


@query(with_views(f"SELECT game_id, CASE WHEN same THEN hs ELSE aws END AS actual_home_score, CASE WHEN same THEN aws ELSE hs END AS actual_away_score FROM (SELECT p.game_id, g.home_team_id = p.home_id AS same, g.home_score AS hs, g.away_score AS aws FROM predictions p LEFT JOIN games g ON p.game_date = g.game_date AND {_PLAYED} AND least(home_id, away_id) = least(home_team_id, away_team_id) AND greatest(home_id, away_id) = greatest(home_team_id, away_team_id) QUALIFY row_number() OVER (PARTITION BY p.game_id ORDER BY CASE WHEN g.home_team_id = p.home_id THEN 0 ELSE 1 END, g.game_id) = 1)", "predictions"))
def backfill_scores(spark, sf_dir):
    return settle.backfill_scores(pred(spark, sf_dir), view(spark, sf_dir, "games")).select("game_id", "actual_home_score", "actual_away_score")


@query(with_views(f"SELECT game_id, p.game_date, coalesce(n, 0) AS games_on_date, CASE WHEN n IS NULL THEN 'no game on that date' ELSE 'no match' END AS reason FROM predictions p LEFT JOIN (SELECT game_date, count(*) AS n FROM games WHERE {_PLAYED} GROUP BY 1) c ON p.game_date = c.game_date WHERE actual_winner IS NULL AND NOT EXISTS (SELECT 1 FROM games g WHERE {_PLAYED} AND g.game_date = p.game_date AND g.home_team_id = p.home_id AND g.away_team_id = p.away_id)", "predictions"))
def unsettled_report(spark, sf_dir):
    return settle.unsettled_report(pred(spark, sf_dir), view(spark, sf_dir, "games"))


_KEYS = "k AS (SELECT DISTINCT game_date, CASE WHEN game_id%2 = 0 THEN h.full_name ELSE h.abbreviation END AS home, CASE WHEN game_id%2 = 0 THEN a.full_name ELSE a.abbreviation END AS away FROM games JOIN teams h ON home_team_id = h.team_id JOIN teams a ON away_team_id = a.team_id)"
_CHAIN = lambda s: f"coalesce({s}_odds, CASE WHEN predicted_{s}_prob > 0 THEN round(1/predicted_{s}_prob, 2) END)"


@query(with_views(f"SELECT k.game_date, k.home, k.away, {r6('confidence')}, {r6(_CHAIN('home'), 'home_odds')}, {r6(_CHAIN('away'), 'away_odds')} FROM k LEFT JOIN (SELECT p.*, coalesce(k.home) AS home, k.away AS away FROM k JOIN teams h ON k.home IN (h.full_name, h.abbreviation) JOIN teams a ON k.away IN (a.full_name, a.abbreviation) JOIN predictions p ON p.game_date = k.game_date AND p.home_id = h.team_id AND p.away_id = a.team_id QUALIFY row_number() OVER (PARTITION BY k.game_date, k.home, k.away ORDER BY predicted_home_prob) = 1) f ON f.game_date = k.game_date AND f.home = k.home AND f.away = k.away", "predictions", "teams", more=_KEYS))
def lookup_predictions(spark, sf_dir):
    """The keys of all games."""
    g = view(spark, sf_dir, "games")
    t = view(spark, sf_dir, "teams")
    side = lambda s: t.select(F.col("team_id").alias(f"{s}_team_id"), F.col("full_name").alias(f"{s}_f"), F.col("abbreviation").alias(f"{s}_b"))
    g = g.join(side("home"), "home_team_id").join(side("away"), "away_team_id")
    name = lambda s: F.when(F.col("game_id") % 2 == 0, F.col(f"{s}_f")).otherwise(F.col(f"{s}_b")).alias(s)
    return settle.lookup_predictions(g.select("game_date", name("home"), name("away")).distinct(), pred(spark, sf_dir), t)


@query(SQL["lookup_predictions"])
def lookup_all_predictions(spark, sf_dir):
    """The same, under the name it had while lookup_predictions took some keys only."""
    return lookup_predictions(spark, sf_dir)


@query(with_views("SELECT p.game_id, CASE p.game_id%3 WHEN 0 THEN upper(full_name) WHEN 1 THEN '  ' || abbreviation ELSE 'nobody' END AS name, CASE WHEN p.game_id%3 < 2 THEN team_id END AS team_id FROM predictions p JOIN teams ON home_id = team_id", "predictions", "teams"))
def normalize_team(spark, sf_dir):
    t = view(spark, sf_dir, "teams")
    k = F.col("game_id") % 3
    p = pred(spark, sf_dir).join(t.withColumnRenamed("team_id", "home_id"), "home_id")
    p = p.select("game_id", F.when(k == 0, F.upper("full_name")).when(k == 1, F.concat(F.lit("  "), "abbreviation")).otherwise("nobody").alias("name"))
    return names.normalize_team(p, "name", t)


@query(with_views("SELECT game_id, right_id FROM (SELECT l.game_id, r.game_id AS right_id, row_number() OVER (PARTITION BY l.game_id ORDER BY CASE WHEN l.home = r.home AND l.away = r.away THEN 0 ELSE 1 END, r.game_id) AS rn FROM l LEFT JOIN r ON l.game_date = r.game_date AND (contains(l.home, r.home) OR contains(r.home, l.home)) AND (contains(l.away, r.away) OR contains(r.away, l.away))) WHERE rn = 1", "games",
    more="l AS (SELECT game_id, game_date, 't' || CAST(home_team_id%300 AS VARCHAR) AS home, 't' || CAST(away_team_id AS VARCHAR) AS away FROM games), r AS (SELECT game_id, game_date, 't' || CAST(home_team_id AS VARCHAR) AS home, 't' || CAST(away_team_id AS VARCHAR) AS away FROM games)"))
def fuzzy_match(spark, sf_dir):
    g = view(spark, sf_dir, "games")
    t = lambda c: F.concat(F.lit("T"), c.cast("string"))
    left = g.select("game_id", "game_date", t(F.col("home_team_id") % 300).alias("home"), t(F.col("away_team_id")).alias("away"))
    right = g.select(F.col("game_id").alias("id"), "game_date", t(F.col("home_team_id")).alias("home"), t(F.col("away_team_id")).alias("away"))
    return names.fuzzy_match(left, right, "game_id").select("game_id", "right_id")


@query(with_views("SELECT game_id, name, coalesce(arg_min(f, (k, f)), name) AS full_name, coalesce(arg_min(b, (k, f)), name) AS abbreviation FROM (SELECT nm.game_id, nm.name, t.full_name AS f, t.abbreviation AS b, CASE WHEN lower(trim(nm.name)) IN (lower(full_name), lower(abbreviation)) THEN 0 ELSE 1 END AS k FROM nm LEFT JOIN teams t ON contains(lower(t.full_name), lower(trim(nm.name))) OR contains(lower(trim(nm.name)), lower(t.full_name)) OR lower(trim(nm.name)) = lower(t.abbreviation)) GROUP BY game_id, name", "predictions", "teams",
    more="nm AS (SELECT p.game_id, CASE p.game_id%5 WHEN 0 THEN upper(full_name) WHEN 1 THEN ' ' || abbreviation WHEN 2 THEN 'The ' || full_name || ' of old' WHEN 3 THEN substr(full_name, 1, length(full_name) - 3) ELSE 'nobody ' || abbreviation END AS name FROM predictions p JOIN teams ON home_id = team_id)"))
def resolve_names(spark, sf_dir):
    """Names in another case, abbreviated, within a longer text, cut short, and unknown."""
    t = view(spark, sf_dir, "teams")
    k, full = F.col("game_id") % 5, F.col("full_name")
    name = F.when(k == 0, F.upper(full)).when(k == 1, F.concat(F.lit(" "), "abbreviation")).when(k == 2, F.concat(F.lit("The "), full, F.lit(" of old"))).when(k == 3, F.substring(full, F.lit(1), F.length(full) - 3)).otherwise(F.concat(F.lit("nobody "), "abbreviation"))
    p = pred(spark, sf_dir).join(t.withColumnRenamed("team_id", "home_id"), "home_id").select("game_id", name.alias("name"))
    return names.resolve_names(p, "name", t)


@query(with_views("SELECT game_id, right_id FROM (SELECT l.game_id, r.game_id AS right_id, row_number() OVER (PARTITION BY l.game_id ORDER BY CASE WHEN l.home = r.home AND l.away = r.away THEN 0 ELSE 1 END, r.game_id) AS rn FROM l LEFT JOIN r ON l.game_date = r.game_date AND (contains(l.home, r.home) OR contains(r.home, l.home)) AND (contains(l.away, r.away) OR contains(r.away, l.away))) WHERE rn = 1", "games",
    more="l AS (SELECT game_id, game_date, 't' || CAST(CASE WHEN game_id%2 = 0 THEN away_team_id ELSE home_team_id%300 END AS VARCHAR) AS home, 't' || CAST(CASE WHEN game_id%2 = 0 THEN home_team_id ELSE away_team_id END AS VARCHAR) AS away FROM games), r AS (SELECT game_id, game_date, 't' || CAST(home_team_id AS VARCHAR) AS home, 't' || CAST(away_team_id AS VARCHAR) AS away FROM games UNION ALL SELECT game_id, game_date, 't' || CAST(away_team_id AS VARCHAR), 't' || CAST(home_team_id AS VARCHAR) FROM games)"))
def fuzzy_match_swapped(spark, sf_dir):
    """Half of the left rows name the teams the other way round."""
    g = view(spark, sf_dir, "games")
    t = lambda c: F.concat(F.lit("T"), c.cast("string"))
    even, h, a = F.col("game_id") % 2 == 0, F.col("home_team_id"), F.col("away_team_id")
    left = g.select("game_id", "game_date", t(F.when(even, a).otherwise(h % 300)).alias("home"), t(F.when(even, h).otherwise(a)).alias("away"))
    right = g.select(F.col("game_id").alias("id"), "game_date", t(h).alias("home"), t(a).alias("away"))
    return names.fuzzy_match(left, right, "game_id", swapped=True).select("game_id", "right_id")


_NICK = "CASE c_custkey%4 WHEN 0 THEN 'Los Angeles Lakers' WHEN 1 THEN 'Portland Trail Blazers' WHEN 2 THEN 'NY Knicks' ELSE c_name END"


@query(f"SELECT c_custkey AS id, CASE c_custkey%4 WHEN 0 THEN 'lakers' WHEN 1 THEN 'blazers' WHEN 2 THEN 'knicks' ELSE regexp_extract(lower(c_name), '([^ ]+)$', 1) END AS nickname, CASE c_custkey%4 WHEN 0 THEN 'lal' WHEN 1 THEN 'por' WHEN 2 THEN 'nyk' ELSE lower(trim(c_name)) END AS code FROM customer")
def nicknames(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").withColumn("name", F.expr(_NICK))
    return c.select(F.col("c_custkey").alias("id"), names.nickname(F.col("name")).alias("nickname"), names.keyword_code(F.col("name")).alias("code"))


# Metrics ------------------------------------------------------------------------------------------------------------

_P = f"actual_winner IS NOT NULL AND game_date BETWEEN DATE '{AS_OF}' - {{d}} AND DATE '{AS_OF}'"


def _measures_sql(d: int) -> str:
    m = lambda e, w="TRUE": f"coalesce(round(avg({e}) FILTER ({w}), 4), 0)"
    return f"SELECT count(*) AS total_predictions, CAST(coalesce(sum(correct), 0) AS BIGINT) AS correct_predictions, {m('correct')} AS accuracy, {m('prediction_error')} AS brier_score, {m('calibration_error')} AS calibration_score, {m('confidence')} AS avg_confidence, {m('correct', 'confidence >= 0.7')} AS high_conf_accuracy, {m('correct', 'confidence < 0.7')} AS low_conf_accuracy, {m('correct', 'predicted_home_prob > 0.5')} AS home_bias, {m('correct', 'confidence >= 0.6')} AS favorite_bias FROM s WHERE {_P.format(d=d)}"


@query(with_views(_measures_sql(400), "predictions", more=_SETTLED))
def evaluate_performance(spark, sf_dir):
    return metrics.evaluate_performance(settled(spark, sf_dir), AS_OF, 400)


@query(with_views(f"SELECT DATE '{AS_OF}' AS evaluation_date, DATE '{AS_OF}' - 90 AS period_start, DATE '{AS_OF}' AS period_end, * FROM ({_measures_sql(90)})", "predictions", more=_SETTLED))
def performance_snapshot(spark, sf_dir):
    return metrics.performance_snapshot(metrics.evaluate_performance(settled(spark, sf_dir), AS_OF, 90), AS_OF, 90)


@query(with_views(f"""SELECT r.accuracy < l.accuracy - 0.05 OR r.brier_score > l.brier_score*1.2 OR r.calibration_score > 0.15 OR date_diff('day', DATE '1999-12-20', DATE '{AS_OF}') > 7 AS should_retrain, 'low' AS urgency,
  array_to_string(list_filter([CASE WHEN r.accuracy < l.accuracy - 0.05 THEN 'Accuracy dropped >5% in last 30 days' END, CASE WHEN r.brier_score > l.brier_score*1.2 THEN 'Brier score worsened by 20%' END, CASE WHEN r.total_predictions < 20 THEN 'Insufficient recent predictions (<20)' END,
  CASE WHEN r.calibration_score > 0.15 THEN 'Poor calibration (error > 0.15)' END, 'Last training was 12 days ago'], lambda x: x IS NOT NULL), '; ') AS reasons FROM ({_measures_sql(30)}) r, ({_measures_sql(90)}) l""", "predictions", more=_SETTLED))
def retrain_advice(spark, sf_dir):
    return metrics.retrain_advice(settled(spark, sf_dir), "1999-12-20", AS_OF)


_BIN = "CASE WHEN confidence >= 0.5 AND confidence < 0.6 THEN '50%-60%' WHEN confidence >= 0.6 AND confidence < 0.7 THEN '60%-70%' WHEN confidence >= 0.7 AND confidence < 0.8 THEN '70%-80%' WHEN confidence >= 0.8 AND confidence < 0.9 THEN '80%-90%' WHEN confidence >= 0.9 AND confidence < 1.0 THEN '90%-100%' END"
_CAL = f"SELECT {_BIN} AS bin, avg(confidence) AS c, avg(correct) AS a, count(*) AS n FROM s WHERE correct IS NOT NULL GROUP BY 1 HAVING count(*) >= 3 AND {_BIN} IS NOT NULL"


@query(with_views(f"SELECT bin, {r6('c', 'mean_confidence')}, {r6('a', 'accuracy')}, n, {r6('abs(c - a)', 'gap')}, CASE WHEN abs(c - a) < 0.1 THEN 'OK' WHEN abs(c - a) < 0.2 THEN 'WARNING' ELSE 'BAD' END AS status FROM ({_CAL})", "predictions", more=_SETTLED))
def calibration_table(spark, sf_dir):
    return metrics.calibration_table(settled(spark, sf_dir))


@query(with_views(f"SELECT {r6('sum(abs(c - a)*n)/sum(n)', 'ece')} FROM ({_CAL})", "predictions", more=_SETTLED))
def ece(spark, sf_dir):
    return metrics.ece(settled(spark, sf_dir))


_IN = f"game_date BETWEEN DATE '{AS_OF}' - 30 AND DATE '{AS_OF}'"


@query(with_views(f"SELECT count(*) FILTER ({_IN} AND correct = 1) AS correct, count(*) FILTER ({_IN} AND correct = 0) AS wrong, count(*) FILTER ({_IN} AND actual_winner IS NULL) AS pending, {r6(f'coalesce(avg(correct) FILTER ({_IN}), 0)', 'accuracy')}, count(*) FILTER (actual_winner IS NULL) AS all_pending, min(game_date) FILTER (actual_winner IS NULL) AS first_pending, max(game_date) FILTER (actual_winner IS NULL) AS last_pending FROM s", "predictions", more=_SETTLED))
def status_counts(spark, sf_dir):
    return metrics.status_counts(settled(spark, sf_dir), AS_OF, 30)


@query(with_views(f"SELECT game_date, count(*) AS n, count(*) FILTER (confidence >= 0.7) AS high_confidence, {r6('avg(confidence)', 'avg_confidence', 9)} FROM predictions GROUP BY 1", "predictions"), avg_confidence=9)
def prediction_summary(spark, sf_dir):
    return metrics.prediction_summary(pred(spark, sf_dir))


# Odds ---------------------------------------------------------------------------------------------------------------

_CONS = "c AS (SELECT game_id, avg(home) AS home_odds, avg(away) AS away_odds, max(home) AS best_home, arg_min(bookmaker, (-home, bookmaker)) AS best_home_book, max(away) AS best_away, arg_min(bookmaker, (-away, bookmaker)) AS best_away_book, count(*) AS n_quotes FROM quotes GROUP BY game_id)"


@query(with_views(f"SELECT game_id, {r6('home_odds')}, {r6('away_odds')}, {r6('best_home')}, best_home_book, {r6('best_away')}, best_away_book, {r6('1/home_odds', 'implied_home')}, {r6('1/away_odds', 'implied_away')}, n_quotes FROM c", "quotes", more=_CONS))
def odds_consensus(spark, sf_dir):
    return odds.odds_consensus(view(spark, sf_dir, "quotes"))


_LINE = "l AS (SELECT game_id, best_home AS market_home_ml, best_away AS market_away_ml, round(2*(best_home - best_away), 1) AS market_spread, 220.0 AS market_total, round((1/best_home)/(1/best_home + 1/best_away), 3) AS market_implied_prob FROM c)"


@query(with_views(f"SELECT game_id, {r6('market_home_ml')}, {r6('market_away_ml')}, {r6('market_spread')}, CAST(market_total AS DOUBLE) AS market_total, {r6('market_implied_prob')} FROM l", "quotes", more=_CONS + ", " + _LINE))
def parse_line(spark, sf_dir):
    return odds.lines(odds.odds_consensus(view(spark, sf_dir, "quotes")))


@query(with_views(f"SELECT g.game_id, {r6('coalesce(market_spread, 0)', 'market_spread')}, CAST(coalesce(market_total, 220) AS DOUBLE) AS market_total, {r6('coalesce(market_home_ml, 2)', 'market_home_ml')}, {r6('coalesce(market_away_ml, 2)', 'market_away_ml')}, {r6('coalesce(market_implied_prob, 0.5)', 'market_implied_prob')}, {r6('abs(coalesce(market_home_ml, 2) - coalesce(market_away_ml, 2))', 'market_confidence')} FROM games g LEFT JOIN l USING (game_id)", "games", "quotes", more=_CONS + ", " + _LINE))
def market_features(spark, sf_dir):
    return odds.market_features(view(spark, sf_dir, "games"), odds.lines(odds.odds_consensus(view(spark, sf_dir, "quotes"))))


_STEP = lambda o: f"round(CASE WHEN {o} < 1.5 THEN round({o}, 2) WHEN {o} < 2 THEN round({o}/0.02::DOUBLE)*0.02::DOUBLE WHEN {o} < 3 THEN round({o}/0.05::DOUBLE)*0.05::DOUBLE WHEN {o} < 5 THEN round({o}/0.1::DOUBLE)*0.1::DOUBLE ELSE round({o}/0.25::DOUBLE)*0.25::DOUBLE END, 2)"
_MODEL = f"""n AS (SELECT game_id, least(greatest(predicted_home_prob, 0.05::DOUBLE), 0.95::DOUBLE) AS x, least(greatest(predicted_away_prob, 0.05::DOUBLE), 0.95::DOUBLE) AS y FROM predictions),
b(i, bookmaker, margin) AS (VALUES (0, 'Pinnacle', 0.025::DOUBLE), (1, 'Bet365', 0.045::DOUBLE), (2, 'DraftKings', 0.05::DOUBLE), (3, 'FanDuel', 0.048::DOUBLE), (4, 'BetMGM', 0.052::DOUBLE)),
q AS (SELECT game_id, i, bookmaker, x/(x + y) AS h, y/(x + y) AS a, round(1/((x/(x + y))*(1 + margin/2)), 2) AS ho, round(1/((y/(x + y))*(1 + margin/2)), 2) AS ao FROM n, b),
m AS (SELECT game_id, max({_STEP('ho')}) FILTER (i = 0) AS pinnacle_home, max({_STEP('ao')}) FILTER (i = 0) AS pinnacle_away, max({_STEP('ho')}) AS best_home, arg_min(bookmaker, (-{_STEP('ho')}, i)) AS best_home_book, max({_STEP('ao')}) AS best_away, arg_min(bookmaker, (-{_STEP('ao')}, i)) AS best_away_book, round(1/max(h), 2) AS fair_home, round(1/max(a), 2) AS fair_away FROM q GROUP BY game_id)"""


@query(with_views(f"SELECT game_id, {r6('pinnacle_home')}, {r6('pinnacle_away')}, {r6('best_home')}, best_home_book, {r6('best_away')}, best_away_book, {r6('fair_home')}, {r6('fair_away')} FROM m", "predictions", more=_MODEL))
def model_odds(spark, sf_dir):
    return odds.model_odds(pred(spark, sf_dir))


@query(with_views(f"SELECT game_id, bookmaker, {r6(_STEP('ho'), 'home')}, {r6(_STEP('ao'), 'away')} FROM q", "predictions", more=_MODEL))
def bookmaker_prices(spark, sf_dir):
    return odds.bookmaker_prices(pred(spark, sf_dir)).select("game_id", "bookmaker", "home", "away")


@query(elo_sql(f"SELECT game_id, {r6('pinnacle_home')}, {r6('pinnacle_away')}, {r6('best_home')}, best_home_book, {r6('best_away')}, best_away_book, {r6('fair_home')}, {r6('fair_away')} FROM m",
    ELO_BEFORE + ", pp AS (SELECT game_id, 1/(1 + pow(10::DOUBLE, -(h + 100 - a)/400::DOUBLE)) AS predicted_home_prob, 1 - 1/(1 + pow(10::DOUBLE, -(h + 100 - a)/400::DOUBLE)) AS predicted_away_prob FROM b JOIN c USING (game_id)), " + _MODEL.replace("FROM predictions", "FROM pp").replace("b(i, bookmaker, margin)", "bk(i, bookmaker, margin)").replace("FROM n, b)", "FROM n, bk)")))
def elo_odds(spark, sf_dir):
    """Prices from the ratings before each game."""
    g = view(spark, sf_dir, "games")
    return odds.elo_odds(elo.elo_features(g, elo.elo_history(g)))


@query(with_views(f"SELECT p.game_id, {r6('coalesce(c.home_odds, pinnacle_home)', 'home_odds')}, {r6('coalesce(c.away_odds, pinnacle_away)', 'away_odds')}, CASE WHEN c.home_odds IS NULL THEN 'model' ELSE 'market' END AS odds_source, coalesce(abs(1/c.home_odds - predicted_home_prob) > 0.15, FALSE) AS market_disagrees FROM predictions p LEFT JOIN c USING (game_id) LEFT JOIN m USING (game_id)", "predictions", "quotes", more=_CONS + ", " + _MODEL))
def choose_odds(spark, sf_dir):
    p = pred(spark, sf_dir)
    return odds.choose_odds(p, odds.odds_consensus(view(spark, sf_dir, "quotes")), odds.model_odds(p))


_I = "least(p*1.05::DOUBLE, 0.95::DOUBLE)"


@query(with_views(f"""SELECT game_id, CASE WHEN p <= 0 OR p >= 1 THEN 99.0 ELSE round(1/{_I}, 2) END AS decimal, CASE WHEN p <= 0 OR p >= 1 THEN '98/1' WHEN 1/{_I} - 1 < 1 THEN '1/' || CAST(CAST(round(1/(1/{_I} - 1)) AS INTEGER) AS VARCHAR) ELSE CAST(CAST(round((1/{_I} - 1)*2) AS INTEGER) AS VARCHAR) || '/2' END AS fractional,
  CASE WHEN p <= 0 OR p >= 1 THEN '+9900' WHEN 1/{_I} >= 2 THEN '+' || CAST(CAST(round((1/{_I} - 1)*100) AS INTEGER) AS VARCHAR) ELSE CAST(CAST(round(-100/(1/{_I} - 1)) AS INTEGER) AS VARCHAR) END AS american, CASE WHEN p > 0 AND p < 1 THEN round({_I}*100, 1) END AS implied_probability FROM (SELECT game_id, CASE game_id%50 WHEN 0 THEN 0.0 WHEN 1 THEN 1.0 ELSE predicted_home_prob END AS p FROM predictions)""", "predictions"))
def betting_odds(spark, sf_dir):
    p = F.expr("CASE game_id%50 WHEN 0 THEN 0D WHEN 1 THEN 1D ELSE predicted_home_prob END")
    return pred(spark, sf_dir).select("game_id", scalars.betting_odds(p).alias("o")).select("game_id", "o.*")


@query(with_views(f"SELECT game_id, {r6('CASE WHEN predicted_home_prob <= 0 OR predicted_home_prob >= 1 THEN 99.0 ELSE round(1/predicted_home_prob, 2) END', 'fair')}, round(100/home_odds, 1) AS market_probability, round((predicted_home_prob - 1/home_odds)*100, 1) + 0.0 AS value_diff, predicted_home_prob - 1/home_odds > 0.05 AS has_value, CASE WHEN predicted_home_prob - 1/home_odds > 0.05 THEN 'BET' ELSE 'PASS' END AS recommendation, CASE WHEN home_odds >= 2 THEN '+' || CAST(CAST(trunc((home_odds - 1)*100) AS INTEGER) AS VARCHAR) ELSE CAST(CAST(trunc(-100/(home_odds - 1)) AS INTEGER) AS VARCHAR) END AS american FROM predictions WHERE home_odds IS NOT NULL", "predictions"))
def value_bets(spark, sf_dir):
    p = pred(spark, sf_dir).where("home_odds is not null")
    v = scalars.value_bet(F.col("predicted_home_prob"), F.col("home_odds"))
    return p.select("game_id", scalars.fair_odds(F.col("predicted_home_prob")).alias("fair"), v.alias("v"), scalars.to_american(F.col("home_odds")).alias("american")).select("game_id", "fair", "v.*", "american")


# Context ------------------------------------------------------------------------------------------------------------

_KM = scalars.haversine_sql("o", "d")


def _travel_sql(origin: str) -> str:
    km, zones = f"coalesce({_KM}, 0)", "coalesce(abs(d.tz_offset - o.tz_offset), 0)"
    source = "(SELECT game_id, home_team_id, away_team_id AS origin_id FROM games)" if origin == "home" else (
        "(SELECT g.game_id, g.home_team_id, coalesce((SELECT arg_max(b.home_team_id, (b.game_date, b.game_id)) FROM games b WHERE (b.home_team_id = g.away_team_id OR b.away_team_id = g.away_team_id) AND (b.game_date, b.game_id) < (g.game_date, g.game_id)), g.away_team_id) AS origin_id FROM games g)")
    return with_views(f"SELECT g.game_id, round({km}, 1) AS away_travel_distance, CAST({zones} AS BIGINT) AS away_time_zones_crossed, round(0.6::DOUBLE*least({km}/4000, 1) + 0.4::DOUBLE*{zones}/3, 3) AS away_travel_fatigue_index FROM {source} g LEFT JOIN arenas o ON o.team_id = g.origin_id LEFT JOIN arenas d ON d.team_id = g.home_team_id", "games", "arenas")


@query(_travel_sql("home"))
def travel_features(spark, sf_dir):
    return context.travel_features(view(spark, sf_dir, "games"), view(spark, sf_dir, "arenas"))


@query(_travel_sql("previous"))
def travel_from_previous(spark, sf_dir):
    return context.travel_features(view(spark, sf_dir, "games"), view(spark, sf_dir, "arenas"), origin="previous")


_NOW = "2024-01-15 12:00:00"


@query(with_views(f"SELECT team_id, player_name, status, is_starter, is_star, fetched_at FROM injuries WHERE fetched_at > TIMESTAMP '{_NOW}' - INTERVAL 6 HOUR AND fetched_at <= TIMESTAMP '{_NOW}' QUALIFY row_number() OVER (PARTITION BY team_id, player_name ORDER BY fetched_at DESC, status DESC) = 1", "injuries"))
def injuries_in_force(spark, sf_dir):
    return context.injuries_in_force(view(spark, sf_dir, "injuries"), _NOW)


@query(with_views("SELECT account, post_id, posted_at FROM posts QUALIFY row_number() OVER (PARTITION BY account ORDER BY posted_at DESC, post_id DESC) = 1", "posts"))
def latest_snapshot(spark, sf_dir):
    return context.latest_snapshot(view(spark, sf_dir, "posts"), ["account"], "posted_at")


_COUNTS = "ic AS (SELECT team_id, count(*) FILTER (is_starter) AS injured_starters, max(CAST(is_star AS INTEGER)) AS star_injured, count(*) AS total_out FROM injuries WHERE regexp_matches(lower(status), 'out|dnp') GROUP BY team_id)"


@query(with_views("SELECT team_id, injured_starters, CAST(star_injured AS BIGINT) AS star_injured, total_out FROM ic", "injuries", more=_COUNTS))
def injury_counts(spark, sf_dir):
    return context.injury_counts(view(spark, sf_dir, "injuries"))


@query(with_views("SELECT game_id, coalesce(h.injured_starters, 0) AS home_injured_starters, CAST(coalesce(h.star_injured, 0) AS BIGINT) AS home_star_injured, coalesce(2*h.injured_starters + 3*h.star_injured, 0) AS home_injury_impact, coalesce(a.injured_starters, 0) AS away_injured_starters, CAST(coalesce(a.star_injured, 0) AS BIGINT) AS away_star_injured, coalesce(2*a.injured_starters + 3*a.star_injured, 0) AS away_injury_impact, coalesce(2*a.injured_starters + 3*a.star_injured, 0) - coalesce(2*h.injured_starters + 3*h.star_injured, 0) AS injury_differential FROM games LEFT JOIN ic h ON h.team_id = home_team_id LEFT JOIN ic a ON a.team_id = away_team_id", "games", "injuries", more=_COUNTS))
def injury_features(spark, sf_dir):
    return context.injury_features(view(spark, sf_dir, "games"), context.injury_counts(view(spark, sf_dir, "injuries")))


@query(with_views("SELECT player_name, contains(lower(player_name), 'p11') OR contains(lower(player_name), '77') AS is_star, count(*) AS n FROM injuries GROUP BY ALL", "injuries"))
def flag_stars(spark, sf_dir):
    return context.flag_stars(view(spark, sf_dir, "injuries"), ["P11", "77"]).groupBy("player_name", "is_star").agg(F.count("*").alias("n"))


_MEANS = "avg(points) AS ppg, avg(rebounds) AS rpg, avg(assists) AS apg, avg(fg_pct) AS fg, avg(minutes) AS mins, count(*) AS games_played"
_SHOW = f"{r6('ppg')}, {r6('rpg', digits=7)}, {r6('apg', digits=7)}, {r6('fg', 'fg_pct', 9)}, {r6('mins', 'minutes')}, games_played"


@query(with_views(f"SELECT player_id, {_SHOW} FROM (SELECT player_id, {_MEANS} FROM player_logs GROUP BY 1)", "player_logs"), fg_pct=9, rpg=7, apg=7)
def player_stats(spark, sf_dir):
    return context.player_recent_stats(view(spark, sf_dir, "player_logs"))


@query(with_views(f"SELECT player_id, {_SHOW} FROM (SELECT player_id, {_MEANS} FROM (SELECT * FROM player_logs QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY game_date DESC, game_id DESC, line DESC, points DESC, minutes DESC) <= 10) GROUP BY 1)", "player_logs"), fg_pct=9, rpg=7, apg=7)
def player_recent_stats(spark, sf_dir):
    return context.player_recent_stats(view(spark, sf_dir, "player_logs"), 10)


_ROSTER = f"ro AS (SELECT DISTINCT player_id, team_id FROM player_logs), st AS (SELECT player_id, {_MEANS} FROM player_logs GROUP BY 1)"


def _roster(spark, sf_dir):
    """Each player's teams and figures; a player's teams are dealt once, by the key they are joined on."""
    logs = view(spark, sf_dir, "player_logs")
    return logs.select("player_id", "team_id").repartition("player_id").distinct(), context.player_recent_stats(logs)


@query(with_views(f"SELECT team_id, {r6('sum(ppg)', 'team_ppg_players')}, {r6('sum(rpg)', 'team_rpg_players')}, {r6('sum(apg)', 'team_apg_players')}, {r6('avg(fg)', 'avg_fg_pct_players', 9)}, {r6('max(ppg)', 'top_scorer_ppg')}, {r6('max(apg)', 'top_playmaker_apg')}, count(*) AS active_players FROM ro JOIN st USING (player_id) GROUP BY team_id", "player_logs", more=_ROSTER), avg_fg_pct_players=9)
def team_player_stats(spark, sf_dir):
    return context.team_player_stats(*_roster(spark, sf_dir))


@query(with_views(f"SELECT team_id, row_number() OVER (PARTITION BY team_id ORDER BY round(ppg, 9) DESC, player_id) AS rank, player_id, {r6('ppg')} FROM ro JOIN st USING (player_id) QUALIFY rank <= 10", "player_logs", more=_ROSTER))
def top_scorers(spark, sf_dir):
    rosters, stats = _roster(spark, sf_dir)
    return context.top_scorers(rosters, stats.withColumn("ppg", F.round("ppg", 9)))


_LAST = "lr AS (SELECT account, max((created_at, id)) AS r FROM bets WHERE is_reset GROUP BY account)"


@query(with_views(f"SELECT b.account, count(*) AS bets, {r6('sum(stake)', 'wagered')}, {r6('sum(actual_payout)', 'won')}, {r6('sum(stake*odds)', 'potential')}, {r6('1000 - sum(stake) + sum(actual_payout)', 'balance')} FROM bets b LEFT JOIN lr USING (account) WHERE NOT is_reset AND (r IS NULL OR (created_at, id) > r) GROUP BY b.account", "bets", more=_LAST))
def ledger_totals(spark, sf_dir):
    return context.ledger_totals(view(spark, sf_dir, "bets"))


@query(with_views(f"SELECT account, id, {r6('1000 + sum(actual_payout - stake) OVER (PARTITION BY account, k ORDER BY created_at, id ROWS UNBOUNDED PRECEDING)', 'balance')} FROM (SELECT b.*, (SELECT count(*) FROM bets r WHERE r.account = b.account AND r.is_reset AND (r.created_at, r.id) <= (b.created_at, b.id)) AS k FROM bets b WHERE NOT is_reset)", "bets"))
def running_balance(spark, sf_dir):
    return context.running_balance(view(spark, sf_dir, "bets"))


@query(with_views(f"SELECT cache, count(*) AS entries, count(*) FILTER (expires_at < TIMESTAMP '{_NOW}') AS expired FROM cache GROUP BY cache", "cache"))
def cache_stats(spark, sf_dir):
    return context.cache_stats(view(spark, sf_dir, "cache"), _NOW)


@query(with_views(f"SELECT cache, key, count(*) AS n FROM cache WHERE expires_at >= TIMESTAMP '{_NOW}' GROUP BY ALL", "cache"))
def drop_expired(spark, sf_dir):
    return context.drop_expired(view(spark, sf_dir, "cache"), _NOW).groupBy("cache", "key").agg(F.count("*").alias("n"))


@query(with_views(f"SELECT account, count(*) FILTER (d) AS posts_24h, greatest(0, 17 - count(*) FILTER (d)) AS remaining, {r6(f'(epoch(TIMESTAMP {chr(39)}{_NOW}{chr(39)}) - floor(epoch(min(posted_at) FILTER (d))))/3600', 'oldest_hours')} FROM (SELECT *, posted_at >= TIMESTAMP '{_NOW}' - INTERVAL 24 HOUR AS d FROM posts WHERE posted_at <= TIMESTAMP '{_NOW}' AND posted_at > TIMESTAMP '{_NOW}' - INTERVAL 48 HOUR) GROUP BY account", "posts"))
def quota_24h(spark, sf_dir):
    return context.quota_24h(view(spark, sf_dir, "posts"), _NOW)


# Picks --------------------------------------------------------------------------------------------------------------

_ODDS = lambda s: f"coalesce({s}_odds, CASE WHEN predicted_{s}_prob > 0 THEN round(1/predicted_{s}_prob, 2) ELSE 99.0 END)"


@query(with_views(f"SELECT game_date, game_id, {r6('confidence')}, {r6('odds')} FROM (SELECT *, CASE WHEN predicted_home_prob > predicted_away_prob THEN {_ODDS('home')} ELSE {_ODDS('away')} END AS odds FROM predictions) WHERE odds > 1.3 QUALIFY row_number() OVER (PARTITION BY game_date ORDER BY confidence DESC, game_id) = 1", "predictions"))
def best_pick(spark, sf_dir):
    return picks.best_pick(pred(spark, sf_dir))


@query(with_views(f"SELECT game_id, game_date, CASE WHEN actual_winner IS NULL THEN 'pending' WHEN correct = 1 THEN 'correct' ELSE 'wrong' END AS status, date_diff('day', game_date, DATE '{AS_OF}') AS days_ago FROM s WHERE {_IN} ORDER BY game_date DESC, prediction_date DESC, game_id LIMIT 50", "predictions", more=_SETTLED))
def recent_predictions(spark, sf_dir):
    return picks.recent_predictions(settled(spark, sf_dir), AS_OF, 30)


@query(with_views(f"SELECT game_id, home_id, away_id, {r6(_ODDS('home'), 'home_odds')}, {r6(_ODDS('away'), 'away_odds')}, actual_winner FROM predictions WHERE game_date = DATE '{AS_OF}'", "predictions"))
def results_report(spark, sf_dir):
    return picks.results_report(pred(spark, sf_dir), AS_OF)


@query(with_views(f"SELECT game_id, {r6('confidence')}, {r6(_ODDS('home'), 'home_odds')}, {r6(_ODDS('away'), 'away_odds')} FROM predictions WHERE game_date = DATE '{AS_OF}'", "predictions"))
def today_report(spark, sf_dir):
    return picks.today_report(pred(spark, sf_dir), AS_OF)


_SITUATION = "SELECT game_id, predicted_home_prob, predicted_away_prob, confidence, CAST(game_id%9 AS INTEGER) - 4 AS home_streak, CAST(game_id%11 AS INTEGER) - 5 AS away_streak, (game_id%61)*10.0E0 - 300 AS elo_diff, (game_id%31)*100.0E0 AS away_travel_distance, CAST(game_id%3 = 0 AS INTEGER) AS home_back_to_back, CAST(game_id%4 = 0 AS INTEGER) AS away_back_to_back FROM predictions"


@query(with_views(f"""SELECT game_id, {r6('least(greatest(h/(h + a), 0.01), 0.99)', 'home_prob')}, {r6('least(greatest(a/(h + a), 0.01), 0.99)', 'away_prob')}, CASE WHEN least(greatest(h/(h + a), 0.01), 0.99) > 0.5 THEN 'home' ELSE 'away' END AS pick,
  array_to_string(list_filter([CASE WHEN r1 THEN 'hot road team' END, CASE WHEN r2 THEN 'cold home team' END, CASE WHEN r3 THEN 'travel fatigue' END, CASE WHEN r4 THEN 'large rating gap' END, CASE WHEN r5 THEN 'home back-to-back' END], lambda x: x IS NOT NULL), '; ') AS adjustments
  FROM (SELECT *, h3 + l AS h, a3 - l AS a FROM (SELECT *, CASE WHEN r4 THEN CASE WHEN h3 > 0.5 THEN -0.05::DOUBLE ELSE 0.05::DOUBLE END ELSE 0 END + CASE WHEN r5 THEN -0.06::DOUBLE ELSE 0 END AS l FROM (SELECT *, predicted_home_prob + sh AS h3, predicted_away_prob - sh AS a3 FROM (
  SELECT *, CASE WHEN r1 THEN -0.1::DOUBLE ELSE 0 END + CASE WHEN r2 THEN -0.08::DOUBLE ELSE 0 END + CASE WHEN r3 THEN 0.15::DOUBLE ELSE 0 END AS sh FROM (
  SELECT *, away_streak >= 4 AND abs(elo_diff) < 100 AS r1, home_streak <= -3 AND abs(elo_diff) < 150 AS r2, away_travel_distance > 2000 AND away_back_to_back = 1 AS r3, abs(elo_diff) > 200 AS r4, home_back_to_back = 1 AND away_back_to_back = 0 AS r5 FROM si)))))""", "predictions", more=f"si AS ({_SITUATION})"))
def adjust_probabilities(spark, sf_dir):
    pred(spark, sf_dir).createOrReplaceTempView("predictions")
    return picks.adjust_probabilities(spark.sql(_SITUATION)).select("game_id", "home_prob", "away_prob", "pick", "adjustments")


_WARN = "SELECT game_id, predicted_home_prob AS home_prob, confidence, CASE WHEN game_id%4 = 0 THEN NULL ELSE (1 + game_id%89)/91.0E0 END AS market_home_prob, 1400.0E0 + game_id%211 AS home_elo, 1400.0E0 + game_id%197 AS away_elo, (game_id%11)/10.0E0 AS home_form, (game_id%7)/6.0E0 AS away_form FROM predictions"
_PCT = lambda c: f"CAST(CAST(round(({c})*100) AS INTEGER) AS VARCHAR) || '%'"
_GAP = "abs(home_prob - market_home_prob)"
_RULES = [
    (0, f"{_GAP} > 0.25", f"'Model disagrees with market by ' || {_PCT(_GAP)}"), (1, f"{_GAP} > 0.15 AND {_GAP} <= 0.25", f"'Model disagrees with market by ' || {_PCT(_GAP)}"),
    (1, "confidence > 0.7 AND (home_prob > 0.5) <> (market_home_prob > 0.5)", f"'High confidence (' || {_PCT('confidence')} || ') on market underdog'"),
    (2, "(home_elo - away_elo > 30) <> (home_form - away_form > 0.15) AND abs(home_elo - away_elo) > 50", "'Recent form contradicts season strength'"),
    (2, "confidence < 0.55", f"'Low model confidence (' || {_PCT('confidence')} || ')'"), (2, "home_prob BETWEEN 0.45 AND 0.55", "'Very close game (near 50-50)'"),
    (1, "market_home_prob IS NULL AND (home_prob > 0.8 OR home_prob < 0.2)", f"'Extreme confidence (' || {_PCT('home_prob')} || ') without market validation'"), (2, "abs(home_elo - away_elo) < 20", "'Teams are evenly matched by Elo'"),
]


@query(with_views("SELECT game_id, row_number() OVER (PARTITION BY game_id ORDER BY s, i) - 1 AS pos, CASE s WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'WARNING' ELSE 'INFO' END AS level, message FROM (" + " UNION ALL ".join(f"SELECT game_id, {s} AS s, {i} AS i, {m} AS message FROM w WHERE {c}" for i, (s, c, m) in enumerate(_RULES)) + ")", "predictions", more=f"w AS ({_WARN})"))
def prediction_warnings(spark, sf_dir):
    pred(spark, sf_dir).createOrReplaceTempView("predictions")
    return picks.prediction_warnings(spark.sql(_WARN))


_M = ["predicted_home_prob", "(game_id%13)/13.0E0", "(game_id%17)/17.0E0", "(game_id%19)/19.0E0"]
_AVG = f"(({' + '.join(_M)})/4)"
_VAR = f"(({' + '.join(f'pow({m} - {_AVG}, 2)' for m in _M)})/4)"
_D = "abs(predicted_home_prob - 0.5::DOUBLE)"


@query(with_views(f"SELECT game_id, {r6(f'least(greatest(0.6::DOUBLE*(1 - sqrt({_VAR})) + 0.4::DOUBLE*{_D}*2, 0), 0.85)', 'plain')}, {r6(f'least(greatest(0.3::DOUBLE*(1 - sqrt({_VAR})) + 0.15::DOUBLE*{_D}*2 + 0.2::DOUBLE*(1 - abs({_M[0]} - {_M[1]})) + 0.15::DOUBLE*(1 - abs(predicted_home_prob - {_AVG})) + 0.2::DOUBLE*(1 - 4*{_VAR}), 0), 1)', 'enhanced')}, CASE WHEN {_D} > 0.2 THEN 'high' WHEN {_D} > 0.1 THEN 'medium' ELSE 'low' END AS quality, CASE WHEN confidence >= 0.7 THEN 'High' WHEN confidence >= 0.6 THEN 'Medium' ELSE 'Low' END AS badge FROM predictions", "predictions"))
def confidence(spark, sf_dir):
    models, p = [F.expr(m) for m in _M], F.col("predicted_home_prob")
    return pred(spark, sf_dir).select("game_id", picks.confidence(models, p, 0.85).alias("plain"), picks.enhanced_confidence(models, p).alias("enhanced"), picks.quality(p).alias("quality"), picks.badge(F.col("confidence")).alias("badge"))


@query(with_views(f"SELECT game_id, {r6(f'least(greatest(0.3::DOUBLE*(1 - sqrt({_VAR})) + 0.15::DOUBLE*{_D}*2 + 0.2::DOUBLE*(1 - abs({_M[0]} - {_M[1]})) + 0.15::DOUBLE*(1 - abs(predicted_home_prob - {_AVG})) + 0.2::DOUBLE*(1 - 4*{_VAR}), 0), 0.85)', 'enhanced')}, {_D} >= 0.52 - 0.5 AS should_predict FROM predictions", "predictions"))
def prediction_quality(spark, sf_dir):
    """The capped confidence, and whether the game is predicted at all."""
    models, p = [F.expr(m) for m in _M], F.col("predicted_home_prob")
    return pred(spark, sf_dir).select("game_id", picks.enhanced_confidence(models, p, 0.85).alias("enhanced"), picks.should_predict(p).alias("should_predict"))


# Upserts and exports ------------------------------------------------------------------------------------------------

_UPD = "SELECT game_id + CASE WHEN game_id%20 = 0 THEN 10000000 ELSE 0 END AS game_id, home_team_id, away_team_id, CASE WHEN game_id%15 = 0 THEN NULL ELSE 100 + game_id%7 END AS home_score, 100 + game_id%5 AS away_score FROM games WHERE game_id%5 = 0"


@query(with_views("SELECT coalesce(u.game_id, g.game_id) AS game_id, coalesce(u.home_team_id, g.home_team_id) AS home_team_id, coalesce(u.home_score, g.home_score) AS home_score, coalesce(u.away_score, g.away_score) AS away_score, home_fga, CASE WHEN coalesce(u.home_score, g.home_score) IS NOT NULL AND coalesce(u.away_score, g.away_score) IS NOT NULL THEN CAST(coalesce(u.home_score, g.home_score) > coalesce(u.away_score, g.away_score) AS BIGINT) END AS home_win FROM games g FULL JOIN (SELECT * FROM upd WHERE home_score IS NOT NULL) u ON g.game_id = u.game_id", "games", more=f"upd AS ({_UPD})"))
def upsert_games(spark, sf_dir):
    g = view(spark, sf_dir, "games")
    g.createOrReplaceTempView("games")
    return upserts.upsert_games(g, spark.sql(_UPD)).select("game_id", "home_team_id", "home_score", "away_score", "home_fga", "home_win")


@query(with_views("SELECT account, post_id, posted_at FROM (SELECT *, 0 AS n FROM posts WHERE post_id%2 = 0 UNION ALL SELECT *, 1 FROM posts WHERE post_id%2 = 1) QUALIFY row_number() OVER (PARTITION BY account ORDER BY posted_at DESC, n DESC) = 1", "posts"))
def replace_rows(spark, sf_dir):
    p = view(spark, sf_dir, "posts")
    return upserts.replace_rows(p.where("post_id % 2 = 0"), p.where("post_id % 2 = 1"), ["account"], "posted_at")


_NEW = "nw AS (SELECT game_date, home_id, away_id, 0.6::DOUBLE AS ph, 0.4::DOUBLE AS pa, home_odds, away_odds, game_id FROM predictions WHERE game_id%6 = 0), st AS (SELECT * FROM predictions WHERE actual_winner IS NOT NULL)"


@query(with_views(f"SELECT game_id, game_date, home_id, away_id, {r6('predicted_home_prob')}, {r6('home_odds')}, {r6('away_odds')}, actual_winner FROM predictions p WHERE (actual_winner IS NOT NULL OR game_date NOT IN (SELECT game_date FROM nw)) AND NOT EXISTS (SELECT 1 FROM nw WHERE nw.game_date = p.game_date AND nw.home_id = p.home_id AND nw.away_id = p.away_id) UNION ALL SELECT game_id, game_date, home_id, away_id, ph, round(coalesce(home_odds, round(1/ph, 2)), 6), round(coalesce(away_odds, round(1/pa, 2)), 6), (SELECT max(actual_winner) FROM st WHERE st.game_date = nw.game_date AND st.home_id = nw.home_id AND st.away_id = nw.away_id) FROM nw", "predictions", more=_NEW))
def upsert_predictions(spark, sf_dir):
    p = pred(spark, sf_dir)
    new = p.where("game_id % 6 = 0").withColumns({"predicted_home_prob": F.lit(0.6), "predicted_away_prob": F.lit(0.4)})
    return upserts.upsert_predictions(p, new).select("game_id", "game_date", "home_id", "away_id", "predicted_home_prob", "home_odds", "away_odds", "actual_winner")


@query(with_views(f"SELECT game_id, game_date FROM predictions WHERE NOT (actual_winner IS NULL AND game_date < DATE '{AS_OF}')", "predictions"))
def drop_stale_pending(spark, sf_dir):
    return upserts.drop_stale_pending(pred(spark, sf_dir), AS_OF).select("game_id", "game_date")


@query(with_views("SELECT game_id, game_id%37 = 0 AS published, CASE WHEN game_id%37 = 0 THEN TIMESTAMP '2024-02-01 08:00:00' END AS published_at FROM games", "games"))
def mark_published(spark, sf_dir):
    g = view(spark, sf_dir, "games")
    return upserts.mark_published(g, g.where("game_id % 37 = 0"), "2024-02-01 08:00:00").select("game_id", "published", "published_at")


@query(with_views(f"SELECT replace(a.full_name || '_vs_' || h.full_name || '_' || strftime(game_date, '%Y-%m-%d'), ' ', '_') AS id, a.full_name || ' @ ' || h.full_name AS matchup, h.full_name AS home_team, a.full_name AS away_team, {r6('predicted_home_prob')}, {r6(_CHAIN('home'), 'home_odds')}, {r6(_CHAIN('away'), 'away_odds')}, {r6('confidence')}, game_date, game_date = DATE '{AS_OF}' AS today FROM predictions JOIN teams h ON home_id = h.team_id JOIN teams a ON away_id = a.team_id WHERE actual_winner IS NULL AND game_date BETWEEN DATE '{AS_OF}' AND DATE '{AS_OF}' + 1", "predictions", "teams"))
def export_games(spark, sf_dir):
    return upserts.export_games(pred(spark, sf_dir), view(spark, sf_dir, "teams"), AS_OF)


_LABEL = "array_to_string(list_transform(string_split(f, '_'), lambda x: CASE x " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in scalars.LABELS.items()) + " ELSE upper(left(x, 1)) || lower(substr(x, 2)) END), ' ')"


@query(f"SELECT n_nationkey AS id, f AS name, {_LABEL} AS label FROM nation, (SELECT unnest({FEATURES!r}) AS f)")
def feature_labels(spark, sf_dir):
    """The labels of all features, for each row of a table."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("id"), F.explode(F.array(*[F.lit(f) for f in FEATURES])).alias("name"))
    return n.select("id", "name", scalars.feature_label(F.col("name")).alias("label"))


@query(with_views(f"SELECT game_date, count(*) AS total, list(replace(a.full_name || '_vs_' || h.full_name || '_' || strftime(game_date, '%Y-%m-%d'), ' ', '_') ORDER BY confidence DESC, replace(a.full_name || '_vs_' || h.full_name || '_' || strftime(game_date, '%Y-%m-%d'), ' ', '_')) AS ids FROM predictions JOIN teams h ON home_id = h.team_id JOIN teams a ON away_id = a.team_id WHERE actual_winner IS NULL AND game_date BETWEEN DATE '{AS_OF}' AND DATE '{AS_OF}' + 1 GROUP BY game_date", "predictions", "teams"))
def export_document(spark, sf_dir):
    flat = upserts.export_games(pred(spark, sf_dir), view(spark, sf_dir, "teams"), AS_OF)
    return upserts.export_document(flat).select("game_date", "total", F.col("games.id").alias("ids"))


@query("SELECT n_name AS name, upper(left(lower(n_name), 1)) || lower(substr(n_name, 2)) || ' L10 PPG %' AS label FROM nation WHERE NOT contains(n_name, '_')")
def feature_label(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").where("n_name not like '%\\\\_%'")
    return n.select(F.col("n_name").alias("name"), scalars.feature_label(F.concat(F.lower("n_name"), F.lit("_last10_ppg_pct"))).alias("label"))


