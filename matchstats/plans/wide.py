"""Queries of the feature projections, the wide table, sources and the model."""

from __future__ import annotations

from functools import lru_cache

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from matchstats.operators import context, elo, features, model, picks
from matchstats.plans import analysis
from matchstats.plans.core import SQL, elo_sql, games, history, query
from matchstats.plans.views import exact, r6, view, with_views
from matchstats.sources import documents, tables
from matchstats.sources.folders import shared_folder, written

_BASE = [f"last{n}_{f}" for n in (3, 5, 10) for f in ("win_pct", "ppg", "opp_ppg", "point_diff", "fg_pct", "fg3_pct", "reb", "ast", "tov", "offensive_rating", "defensive_rating", "net_rating", "pace", "three_point_rate", "opp_fg3_pct")]


def _value(i: int, name: str) -> str:
    k = f"((game_id*{7 + 2*i} + {i})%{41 + i})"
    return f"{k}/{41 + i}.0E0" if "pct" in name or "rate" in name else f"80.0E0 + {k}/2.0E0" if "diff" not in name and "net" not in name else f"{k}/2.0E0 - 10"


#: Forms of both sides as functions of the game's number: input of the projections.
FORMS = (
    "SELECT game_id, game_date, " + ", ".join(f"{_value(2*i + j, n)} AS {s}_{n}" for i, n in enumerate(_BASE) for j, s in enumerate(("home", "away")))
    + ", 1400.0E0 + game_id%211 AS home_elo, 1400.0E0 + game_id%197 AS away_elo, (game_id%211 - game_id%197) + 0.0E0 AS elo_diff, CAST(game_id%19 AS INTEGER) - 9 AS home_streak, CAST(game_id%17 AS INTEGER) - 8 AS away_streak, "
    "CAST(game_id%4 AS INTEGER) AS home_rest_days, CAST(game_id%5 AS INTEGER) AS away_rest_days, (game_id%23)/22.0E0 AS away_travel_fatigue_index, (game_id%29)/28.0E0 AS home_team_home_win_pct, (game_id%31)/30.0E0 AS away_team_road_win_pct, game_id%2 = 0 AS home_pick, (game_id%37)/36.0E0 AS elo_win_prob, "
    "80.0E0 + game_id%43 AS home_team_home_ppg, 80.0E0 + game_id%47 AS away_team_road_ppg, (game_id%53)/2.0E0 - 13 AS home_team_home_point_diff, (game_id%59)/2.0E0 - 15 AS away_team_road_point_diff, (game_id%61)/61.0E0 AS home_team_home_fg_pct, "
    "(game_id%67)/67.0E0 AS away_team_road_fg_pct, CAST(game_id%4 - game_id%5 AS INTEGER) AS rest_advantage, CAST(game_id%4 = 0 AS INTEGER) AS home_back_to_back, CAST(game_id%5 = 0 AS INTEGER) AS away_back_to_back, "
    "CASE WHEN game_id%71 = 0 THEN NULL ELSE (game_id%71)/70.0E0 END AS h2h_home_win_pct, CAST(game_id%11 AS INTEGER) AS h2h_total_games, (game_id%73)/2.0E0 - 18 AS h2h_avg_point_diff, 80.0E0 + game_id%79 AS h2h_home_ppg, 80.0E0 + game_id%83 AS h2h_away_ppg FROM games"
)


def forms(spark, sf_dir):
    games(spark, sf_dir).createOrReplaceTempView("games")
    return spark.sql(FORMS)


def _forms_sql(columns: str, more: str = "") -> str:
    return with_views(f"SELECT game_id, {columns} FROM f", "games", more=f"f AS ({FORMS})" + more)


_MOM = {}
for _s in ("home", "away"):
    _MOM |= {
        f"{_s}_form_acceleration": f"({_s}_last3_win_pct - {_s}_last5_win_pct)*2", f"{_s}_recent_scoring_surge": f"{_s}_last3_point_diff - {_s}_last5_point_diff", f"{_s}_defensive_trend": f"({_s}_last5_defensive_rating - {_s}_last3_defensive_rating)/10",
        f"{_s}_net_rating_surge": f"{_s}_last3_net_rating - {_s}_last10_net_rating", f"{_s}_momentum": f"{_s}_last5_win_pct - {_s}_last10_win_pct", f"{_s}_ultra_momentum": f"{_s}_last3_win_pct - {_s}_last10_win_pct",
    }
_U = "((home_last3_win_pct - home_last10_win_pct) - (away_last3_win_pct - away_last10_win_pct))"
_MOM |= {"momentum_diff": "(home_last5_win_pct - home_last10_win_pct) - (away_last5_win_pct - away_last10_win_pct)", "home_scoring_trend": "home_last5_ppg - home_last10_ppg", "ultra_momentum_diff": _U, "momentum_clash": f"CASE WHEN {_U}*elo_diff < 0 THEN abs({_U}) ELSE 0 END"}


@query(_forms_sql(", ".join(r6(e, n) for n, e in _MOM.items())))
def momentum(spark, sf_dir):
    return features.momentum(forms(spark, sf_dir)).select("game_id", *_MOM)


_W = {f"{s}_weighted_{o}": f"0.35::DOUBLE*{s}_last3_{n} + 0.35::DOUBLE*{s}_last5_{n} + 0.3::DOUBLE*{s}_last10_{n}" for s in ("home", "away") for o, n in (("recent_form", "win_pct"), ("net_rating", "net_rating"))}
_W |= {f"weighted_{o}_differential": f"({_W['home_weighted_' + k]}) - ({_W['away_weighted_' + k]})" for o, k in (("form", "recent_form"), ("net_rating", "net_rating"))}


@query(_forms_sql(", ".join(r6(e, n) for n, e in _W.items())))
def weighted_form(spark, sf_dir):
    return features.weighted_form(forms(spark, sf_dir)).select("game_id", *_W)


_D = {f"{n}_diff": f"home_last10_{n} - away_last10_{n}" for n in "ppg point_diff fg_pct fg3_pct reb ast tov win_pct offensive_rating defensive_rating pace three_point_rate".split()}
_D |= {f"{s}_net_rating": f"{s}_last10_ppg/100 - {s}_last10_opp_ppg/100" for s in ("home", "away")} | {f"{s}_tov_rate": f"{s}_last10_tov/{s}_last10_ppg" for s in ("home", "away")}
_D |= {"net_rating_diff": f"({_D['home_net_rating']}) - ({_D['away_net_rating']})", "tov_rate_diff": f"{_D['home_tov_rate']} - {_D['away_tov_rate']}", "three_point_defense_diff": "away_last10_opp_fg3_pct - home_last10_opp_fg3_pct", "home_split_diff": "home_team_home_win_pct - away_team_road_win_pct"}


@query(_forms_sql(", ".join(r6(e, n) for n, e in _D.items()) + ", CAST(abs(home_last10_pace - away_last10_pace) > 5 AS BIGINT) AS pace_mismatch"))
def differentials(spark, sf_dir):
    return features.differentials(forms(spark, sf_dir)).select("game_id", *_D, "pace_mismatch")


_B = lambda e: f"CAST({e} AS BIGINT)"
_HOT = {s: f"({s}_streak >= 3 AND {s}_last3_win_pct >= 0.67)" for s in ("home", "away")}
_COLD = {s: f"({s}_streak <= -3 AND {s}_last3_win_pct <= 0.33)" for s in ("home", "away")}
_LOG = {s: f"sign({s}_streak)*ln(1 + abs({s}_streak))" for s in ("home", "away")}


#: Interactions; those in _COUNTED are whole numbers.
_INTER = {
    "streak_log_diff": _LOG["home"] + " - " + _LOG["away"], "elo_momentum_interaction": "elo_diff*(home_streak - away_streak)/10", "elo_travel_interaction": "abs(elo_diff)*away_travel_fatigue_index/100",
    **{f"{s}_streak_log": _LOG[s] for s in ("home", "away")},
}
_COUNTED = {
    "streak_diff": "CAST(home_streak - away_streak AS BIGINT)", "hot_hand_diff": f"{_B(_HOT['home'])} - {_B(_HOT['away'])}", "hot_away_underdog": _B("away_streak >= 4 AND abs(elo_diff) < 100"),
    "cold_home_favorite": _B("home_streak <= -3 AND abs(elo_diff) < 150"), "upset_potential": _B(_HOT["away"] + " AND " + _COLD["home"] + " AND abs(elo_diff) > 50 AND abs(elo_diff) < 200"),
    "elo_streak_conflict": "CAST(CASE WHEN elo_diff > 50 AND home_streak <= -2 THEN -1 WHEN elo_diff < -50 AND away_streak <= -2 THEN 1 WHEN elo_diff > 50 AND away_streak >= 3 THEN -1 WHEN elo_diff < -50 AND home_streak >= 3 THEN 1 ELSE 0 END AS BIGINT)",
}
for _s in ("home", "away"):
    _COUNTED |= {f"{_s}_on_win_streak": _B(f"{_s}_streak >= 3"), f"{_s}_hot_hand": _B(_HOT[_s]), f"{_s}_cold_streak": _B(_COLD[_s]), f"{_s}_regression_likely": _B(f"abs({_s}_streak) >= 5")}


@query(_forms_sql(", ".join([*[r6(e, n) for n, e in _INTER.items()], *[f"{e} AS {n}" for n, e in _COUNTED.items()]])))
def interactions(spark, sf_dir):
    f = features.interactions(forms(spark, sf_dir))
    cols = [f"{s}_{n}" for s in ("home", "away") for n in ("on_win_streak", "streak_log", "hot_hand", "cold_streak", "regression_likely")]
    return f.select("game_id", *cols, "streak_diff", "streak_log_diff", "hot_hand_diff", "elo_momentum_interaction", "hot_away_underdog", "cold_home_favorite", "elo_travel_interaction", "elo_streak_conflict", "upset_potential")


_ON = lambda m, d: _B(f"month(game_date) = {m} AND day(game_date) = {d}")


@query(with_views(f"""SELECT game_id, isodow(game_date) - 1 AS day_of_week, {_B('isodow(game_date) >= 6')} AS is_weekend, {_ON(12, 25)} AS is_christmas, {_ON(12, 26)} AS is_day_after_christmas, {_ON(12, 31)} AS is_new_years_eve, {_ON(1, 1)} AS is_new_years_day,
  {_B('month(game_date) = 1 AND ((isodow(game_date) = 1 AND day(game_date) BETWEEN 15 AND 21) OR (isodow(game_date) = 7 AND day(game_date) BETWEEN 14 AND 20) OR (isodow(game_date) = 6 AND day(game_date) BETWEEN 13 AND 19))')} AS is_mlk_weekend, month(game_date) AS month, {_B('month(game_date) IN (3, 4)')} AS is_late_season, {_B('month(game_date) IN (10, 11)')} AS is_early_season FROM games""", "games"))
def calendar_features(spark, sf_dir):
    return features.calendar_features(games(spark, sf_dir).select("game_id", "game_date")).drop("game_date")


_PLAYED = "SELECT game_id, game_date, pool_id FROM games WHERE home_score IS NOT NULL"


@query(with_views(f"SELECT game_id, pool_id, {r6('w/avg(w) OVER ()', 'sample_weight')} FROM (SELECT *, exp(-0.001::DOUBLE*date_diff('day', game_date, max(game_date) OVER ())) AS w FROM (SELECT *, row_number() OVER (PARTITION BY pool_id ORDER BY game_date, game_id) AS rn FROM ({_PLAYED})) WHERE rn > 30)", "games"))
def training_set(spark, sf_dir):
    g = games(spark, sf_dir)
    return features.training_set(g.withColumn("home_win", (F.col("home_score") > F.col("away_score")).cast("int"))).select("game_id", "pool_id", "sample_weight")


@query(with_views("SELECT k AS fold, CASE WHEN i < n - (5 - k)*(n // 6) - 10 THEN 'train' ELSE 'test' END AS part, game_id FROM (SELECT game_id, row_number() OVER (ORDER BY game_date, game_id) - 1 AS i, count(*) OVER () AS n FROM games), range(5) t(k) WHERE i < n - (5 - k)*(n // 6) - 10 OR (i >= n - (5 - k)*(n // 6) AND i < n - (4 - k)*(n // 6))", "games"))
def time_folds(spark, sf_dir):
    return features.time_folds(games(spark, sf_dir))


_RADAR = {}
for _s in ("home", "away"):
    _p = f"{_s}_last10_"
    _RADAR |= {f"{_s}_win": f"{_p}win_pct*100", f"{_s}_off": f"({_p}offensive_rating - 90)/0.4::DOUBLE", f"{_s}_def": f"100 - ({_p}defensive_rating - 90)/0.4::DOUBLE", f"{_s}_three": f"{_p}fg3_pct*250", f"{_s}_reb": f"{_p}reb", f"{_s}_elo_scaled": f"({_s}_elo - 1400)/3"}


@query(_forms_sql(", ".join(r6(e, n) for n, e in _RADAR.items())))
def radar_values(spark, sf_dir):
    return features.radar_values(forms(spark, sf_dir))


def _shown_sql(v: str, name: str) -> str:
    """The text of a compared value, as DuckDB writes it."""
    has = lambda *parts: any(p in name for p in parts)
    one = f"printf('%.1f', {v})"
    if has("_pct", "prob"):
        text = f"CASE WHEN {v} BETWEEN 0 AND 1 THEN printf('%.1f', {v}*100) || '%' WHEN {v} BETWEEN 0 AND 100 THEN {one} || '%' ELSE {one} END"
    elif has("rating", "pace"):
        text = one
    elif has("elo"):
        text = f"printf('%.0f', {v})"
    elif has("back_to_back"):
        text = f"CASE WHEN {v} = 1 THEN 'Yes' ELSE 'No' END"
    else:
        text = one if has("ppg", "reb", "ast", "tov", "point_diff", "streak", "rest_days", "total_games") else f"printf('%.2f', {v})"
    return f"CASE WHEN {v} IS NULL THEN 'N/A' ELSE {text} END"


def _compared_sql(c: str, label: str, h: str, a: str | None) -> str:
    value = lambda n: f"CAST({n or 'NULL'} AS DOUBLE)"
    shown = _shown_sql(value(h), h)
    return f"SELECT game_id, '{c}' AS category, '{label}' AS label, {r6(value(h), 'home_value')}, {r6(value(a), 'away_value')}, {shown} AS home_shown, {_shown_sql(value(a), a) if a else shown} AS away_shown FROM f"


@query(with_views(" UNION ALL ".join(_compared_sql(*row) for row in features.COMPARED), "games", more=f"f AS ({FORMS})"))
def feature_table(spark, sf_dir):
    return features.feature_table(forms(spark, sf_dir))


def _factors_sql() -> str:
    pick = lambda n: f"(CASE WHEN home_pick THEN home_{n} ELSE away_{n} END)"
    other = lambda n: f"(CASE WHEN home_pick THEN away_{n} ELSE home_{n} END)"
    edge = lambda n, s="": f"({s}({pick('last10_' + n)} - {other('last10_' + n)}))"
    rest = f"({pick('rest_days')} - {other('rest_days')})"
    form = lambda side: f"(0.35::DOUBLE*{side('last3_win_pct')} + 0.35::DOUBLE*{side('last5_win_pct')} + 0.3::DOUBLE*{side('last10_win_pct')})"
    name = "(CASE WHEN home_pick THEN 'T' || away_team_id ELSE 'T' || home_team_id END)"
    venue = "(CASE WHEN home_pick THEN home_team_home_win_pct ELSE away_team_road_win_pct END*100)"
    fixed = lambda e, n: f"printf('%.{n}f', {e})"
    net = f"({pick('last10_offensive_rating')} - {pick('last10_defensive_rating')})"
    rules = [
        ("hot_streak", f"{pick('streak')} >= 2", f"{pick('streak')}*10 + {pick('last3_win_pct')}*50", f"'🔥 ' || {pick('streak')} || 'W streak'"),
        ("cold_opponent", f"{other('streak')} <= -2", f"abs({other('streak')})*10 + (100 - {other('last3_win_pct')}*100)*0.5::DOUBLE", f"'❄️ ' || {name} || ' ' || abs({other('streak')}) || 'L streak'"),
        ("rest", f"{rest} >= 1", f"CASE WHEN {other('rest_days')} = 0 THEN {rest}*25 + 20 ELSE {rest}*15 + 5 END", f"CASE WHEN {other('rest_days')} = 0 THEN '😴 ' || {name} || ' on B2B' ELSE '⚡ +' || {rest} || ' days rest' END"),
        ("offense", f"{edge('offensive_rating')} > 0", f"greatest({edge('offensive_rating')}*8, 5)", f"'🔥 +' || {fixed(edge('offensive_rating'), 1)} || ' OffRtg'"),
        ("defense", f"{edge('defensive_rating', '-')} > 0", f"greatest({edge('defensive_rating', '-')}*8, 5)", f"'🛡️ +' || {fixed(edge('defensive_rating', '-'), 1)} || ' DefRtg edge'"),
        ("three_pt", f"{edge('fg3_pct')} > 0", f"greatest({edge('fg3_pct')}*100*6, 4)", f"'🎯 +' || {fixed(edge('fg3_pct') + '*100', 1)} || '% from 3'"),
        ("home_split", "home_pick", f"greatest(({venue} - 40)*1.5::DOUBLE, 5)", f"'🏠 ' || {fixed(venue, 0)} || '% home W%'"), ("road_split", "NOT home_pick", f"greatest({venue}*1.2::DOUBLE, 5)", f"'✈️ ' || {fixed(venue, 0)} || '% road W%'"),
        ("form", "TRUE", f"greatest(abs({form(pick)} - {form(other)})*100*1.2::DOUBLE, 8)", f"'📈 L3: ' || {fixed(pick('last3_win_pct') + '*100', 0)} || '%'"),
        ("elo", "TRUE", "greatest(abs(home_elo - away_elo)*0.2::DOUBLE, 6)", f"'📊 ELO ' || {fixed(pick('elo'), 0)}"),
        ("net_rating", "TRUE", f"greatest(abs({edge('offensive_rating')} - {edge('defensive_rating')})*3, 7)", f"'⚔️ Net: ' || printf('%+.1f', {net})"),
    ]
    rows = " UNION ALL ".join(f"SELECT game_id, {i} AS i, '{n}' AS category, round(CAST({e} AS DOUBLE), 6) AS strength, {t} AS summary FROM f WHERE {c}" for i, (n, c, e, t) in enumerate(rules))
    return with_views(f"SELECT game_id, row_number() OVER (PARTITION BY game_id ORDER BY strength DESC, i) AS rank, category, strength, summary FROM ({rows}) QUALIFY rank <= 5", "games", more=f"f AS (SELECT f.*, g.home_team_id, g.away_team_id FROM ({FORMS}) f JOIN games g USING (game_id))")


@query(_factors_sql())
def supporting_factors(spark, sf_dir):
    names = games(spark, sf_dir).select("game_id", *[F.concat(F.lit("T"), f"{s}_team_id").alias(f"{s}_team") for s in ("home", "away")])
    return picks.supporting_factors(features.weighted_form(forms(spark, sf_dir)).join(names, "game_id"))


#: Means of shares, which often end in a 5 at the seventh place.
_LONG = {"home_opponent_win_pct": 9, "away_opponent_win_pct": 9}


def _features_sql() -> str:
    """The wide table from the oracles of its blocks, whose rounding is taken out, and the projections above."""
    block = lambda name: f"({exact(SQL[name])})"
    form = ["win_pct", "ppg", "opp_ppg", "point_diff", "fg_pct", "fg3_pct", "ft_pct", "reb", "ast", "tov", "opp_fg3_pct", "offensive_rating", "defensive_rating", "pace", "three_point_rate", "net_rating"]
    schedule = ["avg_opponent_elo", "opponent_win_pct", "sos_normalized", "sos_adjusted_win_pct"]
    split, players = ["win_pct", "ppg", "point_diff", "fg_pct"], features.PLAYERS
    by_team = {"r": ("rest_days", ["rest_days", "back_to_back"]), "k": ("streak", ["streak"]), "w": ("road_trip", ["road_trip_length", "long_road_trip"]), "d": ("games_last_days", ["games_last_7d"]), "q": ("strength_of_schedule", schedule)}
    by_team |= {f"f{n}": (f"recent_form_last{n}", [f"last{n}_{c}" for c in form]) for n in (3, 5, 10)}
    by_game = {
        "e": ("elo_features", ["home_elo", "away_elo", "elo_diff", "elo_diff_capped", "elo_win_prob"]), "h": ("head_to_head", [f"h2h_{c}" for c in "home_win_pct total_games avg_point_diff last3_home_wins home_ppg away_ppg".split()]),
        "c": ("calendar_features", "day_of_week is_weekend is_christmas is_day_after_christmas is_new_years_eve is_new_years_day is_mlk_weekend month is_late_season is_early_season".split()),
        "t": ("travel_features", ["away_travel_distance", "away_time_zones_crossed", "away_travel_fatigue_index"]), "i": ("injury_features", [c for c in features.FEATURES if "injur" in c]),
        "m": ("market_features", ["market_spread", "market_total", "market_home_ml", "market_implied_prob", "market_confidence"]),
    }
    tables = {**{a: block(n) for a, (n, _) in {**by_team, **by_game}.items()}, "v": block("venue_split"), "p": block("team_player_stats")}
    columns, joins = ["g.game_id", "g.game_date", "g.pool_id", "CAST(home_score > away_score AS BIGINT) AS home_win"], []
    for s, home, place in (("home", 1, "home_team_home"), ("away", 0, "away_team_road")):
        for a, (_, names) in by_team.items():
            joins.append(f"LEFT JOIN b_{a} {s}_{a} ON {s}_{a}.team_id = g.{s}_team_id AND {s}_{a}.game_date = g.game_date")
            columns += [f"{s}_{a}.{n} AS {s}_{n}" for n in names]
        joins.append(f"LEFT JOIN b_v {s}_v ON {s}_v.team_id = g.{s}_team_id AND {s}_v.game_date = g.game_date AND {s}_v.is_home = {home}")
        joins.append(f"LEFT JOIN b_p {s}_p ON {s}_p.team_id = g.{s}_team_id")
        columns += [f"{s}_v.split_{n} AS {place}_{n}" for n in split] + [f"coalesce({s}_p.{n}, 0) AS {s}_{n}" for n in players]
    for a, (_, names) in by_game.items():
        joins.append(f"LEFT JOIN b_{a} {a} ON {a}.game_id = g.game_id")
        columns += [f"{a}.{n}" for n in names]
    difference = {"rest_advantage": "rest_days", "schedule_density_diff": "games_last_7d", "sos_differential": "sos_normalized", "avg_opponent_elo_differential": "avg_opponent_elo", "sos_adjusted_form_differential": "sos_adjusted_win_pct"}
    made = {**_MOM, **_W, **_D, **_INTER, **_COUNTED, **{n: f"home_{c} - away_{c}" for n, c in difference.items()}, "pace_mismatch": "CAST(abs(home_last10_pace - away_last10_pace) > 5 AS BIGINT)"}
    whole = {*_COUNTED, *by_game["c"][1], "pace_mismatch", "rest_advantage", "schedule_density_diff", "h2h_total_games", "h2h_last3_home_wins", "away_road_trip_length", "away_long_road_trip"}
    whole |= {f"{s}_{n}" for s in ("home", "away") for n in ("rest_days", "back_to_back", "games_last_7d", "streak")}
    show = [f"CAST({made.get(n, n)} AS BIGINT) AS {n}" if n in whole else r6(f"CAST({made.get(n, n)} AS DOUBLE)", n, _LONG.get(n, 6)) for n in features.FEATURES]
    wide = ", ".join(f"b_{a} AS MATERIALIZED {t}" for a, t in tables.items()) + f", f AS MATERIALIZED (SELECT {', '.join(columns)} FROM games g {' '.join(joins)})"
    return with_views(f"SELECT game_id, game_date, pool_id, home_win, {', '.join(show)} FROM f", "games", more=wide)


@query(_features_sql(), **_LONG)
def build_features(spark, sf_dir):
    teams = [analysis.team_player_stats(spark, sf_dir), context.injury_counts(view(spark, sf_dir, "injuries")).drop("total_out"), view(spark, sf_dir, "arenas")]
    return features.build_features(games(spark, sf_dir), extras=[analysis.market_features(spark, sf_dir)], teams=teams)


@query(_forms_sql(f"{r6('home_elo')}, 0.0::DOUBLE AS no_such_feature, {r6('away_last10_ppg')}"))
def align_features(spark, sf_dir):
    f = forms(spark, sf_dir).withColumn("game_id", F.col("game_id").cast("double"))
    return features.align_features(f, ["game_id", "home_elo", "no_such_feature", "away_last10_ppg"]).withColumn("game_id", F.col("game_id").cast("long"))


@query(_forms_sql(f"{r6('CASE WHEN game_id%10 = 0 THEN NULL ELSE home_elo END', 'home_elo')}, CASE WHEN game_id%10 = 0 THEN 0 ELSE 2 END AS n"))
def features_json(spark, sf_dir):
    f = tables.features_to_json(forms(spark, sf_dir), ["home_elo", "away_elo"])
    text = F.when(F.col("game_id") % 10 == 0, F.when(F.col("game_id") % 20 == 0, "{broken")).otherwise(F.col("features_json"))
    return f.select("game_id", tables.feature_from_json(text, "home_elo").alias("home_elo"), F.size(tables.features_from_json(text)).alias("n"))


@query(with_views("SELECT SEASON || '-' || lpad(CAST((CAST(SEASON AS INTEGER) + 1)%100 AS VARCHAR), 2, '0') AS SEASON, count(*) AS n, sum(PTS)::BIGINT AS pts, count(DISTINCT TEAM_ID) AS teams FROM team_logs GROUP BY ALL", "team_logs"))
def read_team_logs(spark, sf_dir):
    """All seasons (few), written to a folder each and read by the operator."""
    logs = view(spark, sf_dir, "team_logs")
    path = shared_folder(spark, "logs")
    logs.withColumn("year", F.col("SEASON")).drop("SEASON").write.partitionBy("year").parquet(path)
    years = sorted(r["SEASON"] for r in logs.select("SEASON").distinct().collect())
    every = tables.read_team_logs(spark, {f"{y}-{(int(y) + 1) % 100:02d}": f"{path}/year={y}" for y in years})
    return every.groupBy("SEASON").agg(F.count("*").alias("n"), F.sum("PTS").alias("pts"), F.count_distinct("TEAM_ID").alias("teams"))


@query(with_views("SELECT SEASON || '-' || lpad(CAST((CAST(SEASON AS INTEGER) + 1)%100 AS VARCHAR), 2, '0') AS SEASON, count(*) AS n, sum(PTS)::BIGINT AS pts FROM team_logs GROUP BY ALL", "team_logs"))
def read_all_team_logs(spark, sf_dir):
    """The seasons found in the logs (few) as one table; the newest lacks a column."""
    logs = view(spark, sf_dir, "team_logs")
    years = sorted(r["SEASON"] for r in logs.select("SEASON").distinct().collect())
    parts = {f"{y}-{(int(y) + 1) % 100:02d}": logs.where(F.col("SEASON") == y) for y in years}
    last = max(parts)
    every = tables.union_seasons(parts | {last: parts[last].drop("WL")})
    return every.groupBy("SEASON").agg(F.count("*").alias("n"), F.sum("PTS").alias("pts"))


def _schedule(spark, sf_dir):
    """The games as schedule documents, one a pool and date."""
    side = lambda s: F.struct(F.concat(F.lit("T"), f"{s}_team_id").alias("teamTricode"), F.coalesce(F.col(f"{s}_score").cast("string"), F.lit("-")).alias("score")).alias(f"{s}Team")
    game = F.struct(F.col("game_id").alias("gameId"), F.when(F.col("game_id") % 13 != 0, F.when(F.col("home_score").isNull(), 1).otherwise(3)).alias("gameStatus"), side("home"), side("away"))
    days = games(spark, sf_dir).groupBy("pool_id", "game_date").agg(F.collect_list(game).alias("games"))
    day = F.struct(F.date_format("game_date", "MM/dd/yyyy 00:00:00").alias("gameDate"), "games")
    return documents.flatten_schedule(days.select(F.struct(F.array(day).alias("gameDates")).alias("leagueSchedule")))


_SCHEDULE = "SELECT CAST(game_id AS VARCHAR) AS game_id, game_date, CAST(CASE WHEN game_id%13 <> 0 THEN CASE WHEN home_score IS NULL THEN 1 ELSE 3 END END AS BIGINT) AS status, 'T' || home_team_id AS home_code, 'T' || away_team_id AS away_code, home_score, away_score FROM games"


@query(with_views(_SCHEDULE, "games"))
def flatten_schedule(spark, sf_dir):
    return _schedule(spark, sf_dir)


@query(with_views(f"SELECT game_id, game_date, coalesce(h.full_name, home_code) AS home_team, coalesce(a.full_name, away_code) AS away_team, home_score, away_score FROM ({_SCHEDULE}) LEFT JOIN teams h ON h.abbreviation = home_code AND h.team_id%7 <> 0 LEFT JOIN teams a ON a.abbreviation = away_code AND a.team_id%7 <> 0 WHERE home_score IS NOT NULL AND away_score IS NOT NULL AND NOT (home_score = 0 AND away_score = 0) AND (status IS NULL OR status = 3)", "games", "teams"))
def final_results(spark, sf_dir):
    """Every seventh team is in no dictionary."""
    return documents.final_results(_schedule(spark, sf_dir), view(spark, sf_dir, "teams").where("team_id % 7 <> 0"))


@query(with_views(f"SELECT 'H' || game_id AS home_team, 'A' || game_id AS away_team, lower(bookmaker) AS bookmaker, {r6('home')}, {r6('away')} FROM quotes WHERE bookmaker <> 'book3'", "quotes"))
def flatten_quotes(spark, sf_dir):
    """A document a game; one bookmaker has no price of the away side, and each has another market too."""
    q = view(spark, sf_dir, "quotes")
    outcome = lambda name, price: F.struct(F.concat(F.lit(name), "game_id").alias("name"), price.alias("price"))
    both = F.array(outcome("A", F.col("away")), outcome("H", F.col("home")))
    h2h = F.when(F.col("bookmaker") == "book3", F.slice(both, 2, 1)).otherwise(both)
    markets = F.array(F.struct(F.lit("totals").alias("key"), both.alias("outcomes")), F.struct(F.lit("h2h").alias("key"), h2h.alias("outcomes")))
    docs = q.groupBy("game_id").agg(F.collect_list(F.struct(F.upper("bookmaker").alias("key"), markets.alias("markets"))).alias("bookmakers"))
    docs = docs.select(F.concat(F.lit("H"), "game_id").alias("home_team"), F.concat(F.lit("A"), "game_id").alias("away_team"), F.lit("t").alias("commence_time"), "bookmakers")
    return documents.flatten_quotes(docs).drop("commence_time")


@query(with_views(f"SELECT CAST(game_id AS VARCHAR) AS matchup, actual_winner AS pick, {r6('confidence')} FROM predictions", "predictions"))
def append_log(spark, sf_dir):
    """Two appends to a log of its own, the second of them repeated, read back."""
    path = shared_folder(spark, "log")
    p = view(spark, sf_dir, "predictions").select("game_id", F.col("game_id").cast("string").alias("matchup"), F.col("actual_winner").alias("pick"), "confidence")
    for k in (0, 1, 1):
        tables.append_log(p.where(F.col("game_id") % 2 == k).drop("game_id"), path, f"run-{k}")
    return tables.read_log(spark, path).select("matchup", "pick", "confidence")


@query("SELECT page_id, 'P' || page_id AS player_name, 'T' || page_id%30 AS team, 'knee' AS injury_type, CASE WHEN page_id%2 = 0 THEN 'Out' ELSE 'Day-To-Day' END AS status FROM pages")
def injury_rows(spark, sf_dir):
    """An injury table before each page; its rows of fewer cells and those of the page drop out."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    cells = F.concat(F.lit("<table><tr><th>only</th></tr><tr><td> P"), "page_id", F.lit("</td><td>T"), (F.col("page_id") % 30).cast("string"), F.lit("<td>knee</td><td>"), F.when(F.col("page_id") % 2 == 0, "Out").otherwise("Day-To-Day"), F.lit("</tr></table>"))
    return documents.injury_rows(documents.html_table_rows(p.select("page_id", F.concat(cells, "html").alias("html"))))


@query("SELECT page_id, 'book ' || page_id AS bookmaker, 1.5::DOUBLE AS home, CAST(page_id%7 AS DOUBLE) AS away FROM pages WHERE page_id%3 <> 0")
def html_table_rows(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    table = F.concat(F.lit("<table><tr><th>Book</th><th>Home</th><th>Away</th></tr><tr><td> book "), "page_id", F.lit("</td><td>1.5</td><td>"), F.when(F.col("page_id") % 3 == 0, "n/a").otherwise((F.col("page_id") % 7).cast("string")), F.lit("</td></tr></table>"))
    return documents.odds_rows(documents.html_table_rows(p.select("page_id", F.concat(table, "html").alias("html"))))


_SCALED = ["home_elo", "away_elo", "elo_diff", "home_streak", "home_last10_ppg", "away_last10_fg_pct"]


@query(_forms_sql(", ".join(r6(f"(CAST({n} AS DOUBLE) - avg({n}) OVER ())/stddev_samp({n}) OVER ()", n) for n in _SCALED)))
def feature_pipeline(spark, sf_dir):
    """Assembled and standardised features."""
    rows = forms(spark, sf_dir)
    x = vector_to_array(F.col("_x"))
    return Pipeline(stages=model.feature_pipeline(_SCALED)).fit(rows).transform(rows).select("game_id", *[x[i].alias(n) for i, n in enumerate(_SCALED)])


@query(with_views(f"SELECT game_id, {r6('1/(1 + exp(-ln(p/(1 - p))/1.7::DOUBLE))', 'p')} FROM (SELECT game_id, least(greatest(predicted_home_prob, 1e-7), 1 - 1e-7) AS p FROM predictions)", "predictions"))
def apply_temperature(spark, sf_dir):
    return view(spark, sf_dir, "predictions").select("game_id", model.apply_temperature(F.col("predicted_home_prob"), 1.7).alias("p"))


_CALIBRATED = "w AS (SELECT predicted_home_prob AS p, CASE WHEN actual_winner = 'home' THEN 1 ELSE 0 END AS y FROM predictions WHERE actual_winner IS NOT NULL)"


def _won(spark, sf_dir):
    return view(spark, sf_dir, "predictions").where("actual_winner is not null").select(F.col("predicted_home_prob").alias("p"), (F.col("actual_winner") == "home").cast("double").alias("home_win"))


@query(with_views(f"SELECT p, {r6('max(low)', 'calibrated')} FROM (SELECT m.p, a.i, min((b.t - coalesce(z.t, 0))/(b.n - coalesce(z.n, 0))) AS low FROM k m JOIN k a ON a.i <= m.i JOIN k b ON b.i >= m.i LEFT JOIN k z ON z.i = a.i - 1 GROUP BY m.p, a.i) GROUP BY p", "predictions",
    more=_CALIBRATED + ", k AS (SELECT p, row_number() OVER (ORDER BY p) AS i, CAST(sum(t) OVER (ORDER BY p) AS DOUBLE) AS t, CAST(sum(n) OVER (ORDER BY p) AS DOUBLE) AS n FROM (SELECT round(p, 6) AS p, sum(y) AS t, count(*) AS n FROM w GROUP BY ALL))"))
def fit_isotonic(spark, sf_dir):
    """The calibrated probability at each probability there is; the oracle takes the largest of the smallest means."""
    rows = _won(spark, sf_dir).withColumn("p", F.round("p", 6))
    return model.apply_isotonic(model.fit_isotonic(rows), rows.select("p", F.col("p").alias("calibrated")).distinct(), "calibrated")


@query(with_views("SELECT round(1/least(greatest(b, 0.1), 10), 2) AS temperature FROM s WHERE it = 40", "predictions", recursive=True,
    more=_CALIBRATED + """, k AS (SELECT list(ln(p/(1 - p))) AS z, list(n) AS n, list(t) AS t FROM (SELECT p, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS t FROM w GROUP BY p)),
  s(it, b) AS (SELECT 0, 0.0::DOUBLE UNION ALL SELECT it + 1, b + list_sum(list_transform(range(1, len(z) + 1), lambda i: z[i]*(t[i] - n[i]/(1 + exp(-b*z[i])))))/list_sum(list_transform(range(1, len(z) + 1), lambda i: n[i]*z[i]*z[i]/(1 + exp(-b*z[i]))*(1 - 1/(1 + exp(-b*z[i])))))
    FROM s, k WHERE it < 40)"""))  # fmt: skip
def fit_temperature(spark, sf_dir):
    """The temperature; the oracle finds it by Newton's method."""
    return spark.createDataFrame([(round(model.fit_temperature(_won(spark, sf_dir)), 2),)], "temperature double")


_AS_OF = "2001-08-05"


@query(elo_sql(f"SELECT t.team_id, {r6('elo')}, date_diff('day', last_updated, DATE '{_AS_OF}') AS days_old, coalesce(date_diff('day', last_updated, DATE '{_AS_OF}') > 30, TRUE) AS stale FROM (SELECT home_team_id AS team_id FROM games UNION SELECT away_team_id FROM games) t LEFT JOIN cur USING (team_id)", "cur AS (SELECT team_id, arg_max(elo_after, (game_date, game_id)) AS elo, max(game_date) AS last_updated FROM history GROUP BY team_id)"))
def elo_freshness(spark, sf_dir):
    return context.elo_freshness(elo.current_elo(history(spark, sf_dir)), games(spark, sf_dir), _AS_OF, 30)


@lru_cache(maxsize=2)
def _stack(session: str, sf_dir: str):
    """The stack of a session's tables: both model queries ask for the same one, which is trained once."""
    return _trained(SparkSession.active(), sf_dir)


def _trained(spark, sf_dir):
    """All features of each game and a stack trained on them, with the operator's folds and learners."""
    rows = written(build_features(spark, sf_dir), "features")
    return rows, model.train_stack(features.training_set(rows), features.FEATURES)


@query()
def train_stack(spark, sf_dir):
    """The out-of-fold accuracy, the temperature and the strongest factors of a trained stack."""
    _, m = _stack(spark.sparkContext.applicationId, sf_dir)
    rows = [(n, float(s), d, float(m.fold_accuracy), float(m.temperature)) for n, s, d in model.top_factors(m)]
    return spark.createDataFrame(rows, "feature string, share double, direction string, fold_accuracy double, temperature double")


@query()
def score_games(spark, sf_dir):
    rows, m = _stack(spark.sparkContext.applicationId, sf_dir)
    return model.score(m, rows)
