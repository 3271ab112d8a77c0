"""The wide feature table, training sets and views of features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchstats.operators import context, elo, windows
from matchstats.operators.matches import BOX, team_rows
from matchstats.sources.folders import written

SIDES = ("home", "away")
_LAST = {
    10: "win_pct ppg opp_ppg point_diff fg_pct fg3_pct ft_pct reb ast tov offensive_rating defensive_rating net_rating pace three_point_rate opp_fg3_pct",
    5: "win_pct ppg point_diff fg_pct tov offensive_rating defensive_rating net_rating pace",
    3: "win_pct point_diff net_rating offensive_rating defensive_rating",
}
PLAYERS = "team_ppg_players team_rpg_players team_apg_players avg_fg_pct_players top_scorer_ppg top_playmaker_apg active_players".split()


def _both(names: str | list[str]) -> list[str]:
    return [f"{s}_{n}" for s in SIDES for n in (names.split() if isinstance(names, str) else names)]


#: The features in their fixed order.
FEATURES = [
    *"home_elo away_elo elo_diff elo_diff_capped elo_win_prob".split(),
    *[f"{s}_last{n}_{f}" for n in (10, 5, 3) for s in SIDES for f in _LAST[n].split()],
    *_both("form_acceleration recent_scoring_surge defensive_trend net_rating_surge"),
    *_both("weighted_recent_form weighted_net_rating"), "weighted_form_differential", "weighted_net_rating_differential",
    *_both("sos_normalized avg_opponent_elo sos_adjusted_win_pct opponent_win_pct"), "sos_differential", "avg_opponent_elo_differential", "sos_adjusted_form_differential",
    *[f"{p}_{f}" for p in ("home_team_home", "away_team_road") for f in ("win_pct", "ppg", "point_diff", "fg_pct")],
    *[f"h2h_{f}" for f in "home_win_pct total_games avg_point_diff last3_home_wins home_ppg away_ppg".split()],
    *"home_rest_days away_rest_days rest_advantage home_back_to_back away_back_to_back day_of_week is_weekend is_christmas is_day_after_christmas".split(),
    *"is_new_years_eve is_new_years_day is_mlk_weekend month is_late_season is_early_season home_games_last_7d away_games_last_7d".split(),
    *"schedule_density_diff away_road_trip_length away_long_road_trip home_streak away_streak home_on_win_streak away_on_win_streak".split(),
    *[f"{f}_diff" for f in "ppg point_diff fg_pct fg3_pct reb ast tov win_pct home_split streak".split()],
    "home_net_rating", "away_net_rating", *[f"{f}_diff" for f in "net_rating offensive_rating defensive_rating pace three_point_rate three_point_defense".split()],
    *"pace_mismatch home_tov_rate away_tov_rate tov_rate_diff home_momentum away_momentum momentum_diff home_scoring_trend home_ultra_momentum".split(),
    *"away_ultra_momentum ultra_momentum_diff momentum_clash elo_momentum_interaction hot_away_underdog cold_home_favorite elo_travel_interaction".split(),
    *"home_streak_log away_streak_log streak_log_diff home_hot_hand away_hot_hand hot_hand_diff home_cold_streak away_cold_streak".split(),
    *"home_regression_likely away_regression_likely elo_streak_conflict upset_potential".split(),
    *_both(PLAYERS), "away_travel_distance", "away_time_zones_crossed", "away_travel_fatigue_index",
    *"home_injured_starters away_injured_starters home_star_injured away_star_injured home_injury_impact away_injury_impact injury_differential".split(),
    *"market_spread market_total market_home_ml market_implied_prob market_confidence".split(),
]


def _with(df: DataFrame, **columns: str) -> DataFrame:
    """Adds columns given as SQL expressions."""
    return df.withColumns({k: F.expr(v) for k, v in columns.items()})


def momentum(f: DataFrame) -> DataFrame:
    """Form acceleration, surges, trends and momentum of both sides."""
    for s in SIDES:
        f = _with(f, **{
            f"{s}_form_acceleration": f"({s}_last3_win_pct - {s}_last5_win_pct) * 2", f"{s}_recent_scoring_surge": f"{s}_last3_point_diff - {s}_last5_point_diff",
            f"{s}_defensive_trend": f"({s}_last5_defensive_rating - {s}_last3_defensive_rating) / 10", f"{s}_net_rating_surge": f"{s}_last3_net_rating - {s}_last10_net_rating",
            f"{s}_momentum": f"{s}_last5_win_pct - {s}_last10_win_pct", f"{s}_ultra_momentum": f"{s}_last3_win_pct - {s}_last10_win_pct",
        })
    f = _with(f, momentum_diff="home_momentum - away_momentum", home_scoring_trend="home_last5_ppg - home_last10_ppg", ultra_momentum_diff="home_ultra_momentum - away_ultra_momentum")
    return _with(f, momentum_clash="CASE WHEN ultra_momentum_diff * elo_diff < 0 THEN abs(ultra_momentum_diff) ELSE 0D END")


def weighted_form(f: DataFrame) -> DataFrame:
    """Form and net rating of the last 3, 5 and 10 games, weighted 0.35, 0.35 and 0.3."""
    for s in SIDES:
        for out, name in (("recent_form", "win_pct"), ("net_rating", "net_rating")):
            f = _with(f, **{f"{s}_weighted_{out}": f"0.35D * {s}_last3_{name} + 0.35D * {s}_last5_{name} + 0.3D * {s}_last10_{name}"})
    return _with(f, weighted_form_differential="home_weighted_recent_form - away_weighted_recent_form", weighted_net_rating_differential="home_weighted_net_rating - away_weighted_net_rating")


def differentials(f: DataFrame) -> DataFrame:
    """Home less away figures, ratings by 100 points, turnover rates, pace mismatch."""
    f = _with(f, **{f"{n}_diff": f"home_last10_{n} - away_last10_{n}" for n in "ppg point_diff fg_pct fg3_pct reb ast tov win_pct offensive_rating defensive_rating pace three_point_rate".split()})
    for s in SIDES:
        part = lambda n: f"CASE WHEN {s}_last10_{n} > 0 THEN {s}_last10_{n} / 100 ELSE 1.1D END"  # noqa: B023, E731
        f = _with(f, **{f"{s}_net_rating": f"{part('ppg')} - {part('opp_ppg')}", f"{s}_tov_rate": f"CASE WHEN {s}_last10_ppg > 0 THEN {s}_last10_tov / {s}_last10_ppg ELSE 0.15D END"})
    f = _with(f, net_rating_diff="home_net_rating - away_net_rating", tov_rate_diff="home_tov_rate - away_tov_rate", three_point_defense_diff="away_last10_opp_fg3_pct - home_last10_opp_fg3_pct", pace_mismatch="CAST(abs(pace_diff) > 5 AS INT)")
    return _with(f, home_split_diff="home_team_home_win_pct - away_team_road_win_pct") if "home_team_home_win_pct" in f.columns else f


def interactions(f: DataFrame, compat: bool = False) -> DataFrame:
    """Streak, rating and travel interactions.  compat: the travel interaction is always 0."""
    f = _with(f, **{f"{s}_on_win_streak": f"CAST({s}_streak >= 3 AS INT)" for s in SIDES}, **{f"{s}_streak_log": f"signum({s}_streak) * ln(1 + abs({s}_streak))" for s in SIDES},
        **{f"{s}_hot_hand": f"CAST({s}_streak >= 3 AND {s}_last3_win_pct >= 0.67D AS INT)" for s in SIDES}, **{f"{s}_cold_streak": f"CAST({s}_streak <= -3 AND {s}_last3_win_pct <= 0.33D AS INT)" for s in SIDES},
        **{f"{s}_regression_likely": f"CAST(abs({s}_streak) >= 5 AS INT)" for s in SIDES})
    return _with(
        f, streak_diff="home_streak - away_streak", streak_log_diff="home_streak_log - away_streak_log", hot_hand_diff="home_hot_hand - away_hot_hand",
        elo_momentum_interaction="elo_diff * (home_streak - away_streak) / 10", hot_away_underdog="CAST(away_streak >= 4 AND abs(elo_diff) < 100 AS INT)",
        cold_home_favorite="CAST(home_streak <= -3 AND abs(elo_diff) < 150 AS INT)", elo_travel_interaction="0D" if compat else "abs(elo_diff) * away_travel_fatigue_index / 100",
        elo_streak_conflict="CASE WHEN elo_diff > 50 AND home_streak <= -2 THEN -1 WHEN elo_diff < -50 AND away_streak <= -2 THEN 1 WHEN elo_diff > 50 AND away_streak >= 3 THEN -1 WHEN elo_diff < -50 AND home_streak >= 3 THEN 1 ELSE 0 END",
        upset_potential="CAST(away_hot_hand = 1 AND home_cold_streak = 1 AND abs(elo_diff) > 50 AND abs(elo_diff) < 200 AS INT)",
    )


def calendar_features(g: DataFrame) -> DataFrame:
    """Weekday (Monday 0), season phase and holidays of game_date."""
    third = "date_add(next_day(date_sub(make_date(year(game_date), 1, 1), 1), 'MON'), 14)"
    on = lambda m, d: f"CAST(month(game_date) = {m} AND day(game_date) = {d} AS INT)"
    return _with(
        g, day_of_week="weekday(game_date)", is_weekend="CAST(weekday(game_date) >= 5 AS INT)", is_christmas=on(12, 25), is_day_after_christmas=on(12, 26), is_new_years_eve=on(12, 31), is_new_years_day=on(1, 1),
        is_mlk_weekend=f"CAST(game_date BETWEEN date_sub({third}, 2) AND {third} AS INT)", month="month(game_date)", is_late_season="CAST(month(game_date) IN (3, 4) AS INT)", is_early_season="CAST(month(game_date) IN (10, 11) AS INT)",
    )


#: The most games of a pool that one task sorts and holds to (pools_are_closed).
POOL_GAMES = 200_000
_DIFFERENCES = {
    "rest_advantage": "home_rest_days - away_rest_days", "schedule_density_diff": "home_games_last_7d - away_games_last_7d", "sos_differential": "home_sos_normalized - away_sos_normalized",
    "avg_opponent_elo_differential": "home_avg_opponent_elo - away_avg_opponent_elo", "sos_adjusted_form_differential": "home_sos_adjusted_win_pct - away_sos_adjusted_win_pct",
}


def pools_are_closed(games: DataFrame) -> bool:
    """Whether each team plays in one pool only, and no pool has over POOL_GAMES games.  This runs a job."""
    sides = games.select(F.struct("pool_id").alias("pool"), F.explode(F.array("home_team_id", "away_team_id")).alias("team_id"))
    teams = sides.groupBy("team_id").agg(F.min("pool").alias("pool"), F.max("pool").alias("other"), F.count("*").alias("n"))
    pools = teams.groupBy("pool").agg(F.bool_and(F.col("pool") == F.col("other")).alias("closed"), F.sum("n").alias("n"))
    closed, most = pools.agg(F.bool_and("closed"), F.max("n")).first()
    return bool(closed) and most <= 2 * POOL_GAMES


def form_table(games: DataFrame, history: DataFrame | None = None, extras: list[DataFrame] = (), teams: list[DataFrame] = ()) -> DataFrame:
    """Ratings, forms, splits, rest, streaks and schedules of both sides of each game, with the columns of extras (tables of
    one row a game) and, as home_... and away_..., of teams (tables of one row a team).

    Ratings are those of history, or without it of the games themselves; then, if the pools are closed, everything of a pool
    stays in one partition (_pool_table).  Else there are three shuffles: by team for the frames of all features, by team for
    the ratings and shares of the team itself and of its last opponents, and by game, where both sides meet.  Head-to-head
    figures take two more.
    """
    if history is None and pools_are_closed(games):
        return _pool_table(games, extras, teams)
    out = _team_table(games, elo.elo_history(games) if history is None else history)
    for e in [*extras, *[context.by_side(games, x) for x in teams]]:
        out = out.join(e, "game_id", "left")
    return out


def _side_columns(rows: DataFrame, side: str, f: str) -> dict[str, Column]:
    """A side's columns from its struct of team features."""
    place = "home_team_home" if side == "home" else "away_team_road"
    names = [c for c in rows.schema["f"].dataType.names if not c.startswith("split_")]
    return {f"{side}_{c}": F.col(f"{f}.{c}") for c in names} | {f"{place}_{c}": F.col(f"{f}.split_{c}") for c in windows.SPLIT}


def _team_table(games: DataFrame, history: DataFrame) -> DataFrame:
    """form_table by teams, for any pools and ratings."""
    t = team_rows(games)
    rows = windows.team_features(t)
    keys = ["game_date", "game_id", "is_home"]
    own = rows.select("team_id", *keys, F.struct("pool_id", "team_id", "opponent_id", "pts", "opp_pts", "f", "last.own").alias("own"))
    opponents = rows.select(*keys, F.posexplode("last.opponents").alias("pos", "team_id"))
    found = windows.lookups(own.unionByName(opponents, allowMissingColumns=True), t, history)
    side = {s: F.col("is_home") == (s == "home").__int__() for s in SIDES}
    mine = F.col("pos").isNull()
    both = found.groupBy("game_id").agg(
        F.first("game_date").alias("game_date"),
        *[F.first(F.when(mine & c, F.struct("own", F.coalesce("elo_here", "elo", F.lit(elo.START)).alias("elo"))), ignorenulls=True).alias(s) for s, c in side.items()],
        *[F.collect_list(F.when(~mine & c, F.struct("pos", "elo", "share"))).alias(f"_{s}") for s, c in side.items()],
    )
    columns = {}
    for s in SIDES:
        columns |= _side_columns(rows, s, f"{s}.own.f")
        columns |= {f"{s}_{c}": v for c, v in windows.schedule_columns(F.col(f"_{s}"), F.col(f"{s}.own.own")).items()}
    columns |= elo.rating_columns(F.col("home.elo"), F.col("away.elo"))
    game = {"pool_id": "pool_id", "home_team_id": "team_id", "away_team_id": "opponent_id", "home_score": "pts", "away_score": "opp_pts"}
    out = both.select("game_id", "game_date", *[F.col(f"home.own.{c}").alias(n) for n, c in game.items()], *[c.alias(n) for n, c in columns.items()])
    out = out.join(windows.head_to_head(games), "game_id", "left")
    return _with(out, **_DIFFERENCES)


def _joined(tables: list[DataFrame], key: str) -> DataFrame:
    """The rows of all tables by a key, one row a key."""
    out = tables[0]
    for t in tables[1:]:
        out = out.join(t, key, "full")
    return out


def _pool_table(games: DataFrame, extras: list[DataFrame], teams: list[DataFrame]) -> DataFrame:
    """form_table for closed pools: all that is known of a pool meets in one shuffle, as slim as the games are, and no table of
    features is dealt anew.

    Ratings and schedules come as a row a game, extras likewise, team tables as a row a team without a game; the first two
    meet their game by one sort, head-to-head figures take another, the frames by team a third, and both sides meet in the last.
    """
    kind = lambda df, k, keys=None, name=None: (df.select(*keys, F.struct(*[c for c in df.columns if c not in keys]).alias(name)) if name else df).withColumn("_kind", F.lit(k))
    box = [f"{s}_{b}" for s in SIDES for b in BOX if f"{s}_{b}" in games.columns]
    rows = kind(games.select("pool_id", "game_id", "game_date", "home_team_id", "away_team_id", "home_score", "away_score", *box), 3)
    rated = elo.rated_schedules(games, 10, windows.START_SHARE).withColumns({c: F.col(c).cast(games.schema[c].dataType) for c in ("pool_id", "game_id")})
    parts = [kind(rated, 1, ["pool_id", "game_id"], "_rated")]
    if extras:
        more = _joined(extras, "game_id").join(games.select("game_id", "pool_id"), "game_id")
        parts.append(kind(more, 2, ["pool_id", "game_id"], "_extra"))
    if teams:
        own = games.select("pool_id", F.explode(F.array("home_team_id", "away_team_id")).alias("team_id")).distinct()
        parts.append(kind(_joined(teams, "team_id").join(own, "team_id"), 0, ["pool_id", "team_id"], "_team").withColumnRenamed("team_id", "home_team_id"))
    for p in parts:
        rows = rows.unionByName(p, allowMissingColumns=True)
    here = Window.partitionBy("pool_id", "game_id").orderBy("_kind").rowsBetween(Window.unboundedPreceding, 0)
    found = ["_rated", *["_extra"] * bool(extras)]
    n = int(games.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # asked for: else slim partitions are put together, and a row is much work
    rows = rows.repartition(n, "pool_id").withColumns({c: F.last(c, ignorenulls=True).over(here) for c in found}).where("_kind in (0, 3)")
    own = ["_team"] * bool(teams)
    t = team_rows(windows.with_meetings(rows), ("_h2h", *found, *own), ("_kind",)).where("_kind = 3 or is_home = 1")
    if teams:  # a row without a date comes first
        so_far = Window.partitionBy("pool_id", "team_id").orderBy("game_date", "game_id").rowsBetween(Window.unboundedPreceding, 0)
        t = t.withColumn("_team", F.first("_team", ignorenulls=True).over(so_far))
    t = windows.team_features(t, more=("_kind", "_h2h", *found, *own)).where("_kind = 3")
    side = {s: F.when(F.col("is_home") == (s == "home").__int__(), F.struct("team_id", "pts", "f", *own, *(["_h2h", *found] if s == "home" else []))) for s in SIDES}
    both = t.groupBy("pool_id", "game_id").agg(F.first("game_date").alias("game_date"), *[F.first(c, ignorenulls=True).alias(s) for s, c in side.items()])
    columns = {"home_team_id": F.col("home.team_id"), "away_team_id": F.col("away.team_id"), "home_score": F.col("home.pts"), "away_score": F.col("away.pts")}
    for s in SIDES:
        columns |= _side_columns(t, s, f"{s}.f")
        columns |= {f"{s}_{c}": v for c, v in windows.schedule_of(*[F.col(f"home._rated.{s}_{c}") for c in ("opponents", "share", "own")]).items()}
        columns |= {f"{s}_{c}": F.col(f"{s}._team.{c}") for k in own for c in t.schema[k].dataType.names}
    columns |= elo.rating_columns(F.col("home._rated.home_elo"), F.col("home._rated.away_elo"))
    columns |= {c: F.col(f"home.{k}.{c}") for k in ("_h2h", *found[1:]) for c in t.schema[k].dataType.names}
    return _with(both.select("game_id", "game_date", "pool_id", *[c.alias(n) for n, c in columns.items()]), **_DIFFERENCES)


def build_features(games: DataFrame, history: DataFrame | None = None, extras: list[DataFrame] = (), compat: bool = False, teams: list[DataFrame] = ()) -> DataFrame:
    """game_id, game_date, pool_id, home_win and FEATURES in order.

    extras are tables of one row a game (game_id) with player, travel, injury or market columns, teams tables of one row a team
    (team_id) with player figures, injury counts or arenas; what none of them has is 0 (market columns: a line without
    information).
    """
    f = form_table(games, history, extras, teams)
    if "home_star_injured" in f.columns and "injury_differential" not in f.columns:
        f = context.injury_columns(f)
    if "home_lat" in f.columns and "away_travel_distance" not in f.columns:
        f = f.withColumns(context.travel_columns("away_", "home_"))
    zero = {c: F.lit(0.0) for c in [*_both(PLAYERS), "away_travel_distance", "away_time_zones_crossed", "away_travel_fatigue_index"] + [c for c in FEATURES if "injur" in c]}
    zero |= {"market_spread": F.lit(0.0), "market_total": F.lit(220.0), "market_home_ml": F.lit(2.0), "market_implied_prob": F.lit(0.5), "market_confidence": F.lit(0.0)}
    f = f.withColumns({c: F.coalesce(F.col(c), v) if c in f.columns else v for c, v in zero.items()})
    f = calendar_features(interactions(differentials(weighted_form(momentum(f))), compat))
    win = F.when(F.col("home_score").isNotNull() & F.col("away_score").isNotNull(), (F.col("home_score") > F.col("away_score")).cast("int"))
    return f.select("game_id", "game_date", "pool_id", win.alias("home_win"), *FEATURES)


def align_features(df: DataFrame, names: list[str]) -> DataFrame:
    """Exactly the named columns as doubles: missing ones and nulls are 0, others are dropped."""
    have = set(df.columns)
    return df.select(*[F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) if n in have else F.lit(0.0).alias(n) for n in names])


def missing_features(df: DataFrame, names: list[str]) -> list[str]:
    """The names that align_features() has to fill up with zeros, as no column is called so."""
    have = set(df.columns)
    return [n for n in names if n not in have]


def training_set(features: DataFrame, burn_in: int = 30, decay: float = 0.001) -> DataFrame:
    """Played games without each pool's first burn_in ones, with weights exp(-decay * days to the newest game) whose mean
    is 1.  The newest date and the mean are one row of aggregates."""
    w = Window.partitionBy("pool_id").orderBy("game_date", "game_id")
    rows = features.where("home_win is not null").withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") > burn_in).drop("_rn")
    newest = rows.agg(F.max("game_date").alias("_newest"))
    rows = rows.join(F.broadcast(newest)).withColumn("_w", F.exp(-decay * F.datediff("_newest", "game_date")))  # one row
    mean = rows.agg(F.avg("_w").alias("_mean"))
    return rows.join(F.broadcast(mean)).withColumn("sample_weight", F.col("_w") / F.col("_mean")).drop("_w", "_mean", "_newest")  # one row


def row_numbers(df: DataFrame, order: list[str]) -> DataFrame:
    """Adds row_index (from 0) in the given order, of which no two rows may be equal, without a window over all rows.

    Spark deals the rows to ranges of the order; each range is numbered for itself and starts where those before it end.  The
    ranges are written first, so that counting and numbering see the same ones; their counts are a row each on the driver.
    """
    parts = written(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = sorted(parts.groupBy("_part").agg(F.count("*")).collect())
    starts, n = [], 0
    for part, count in counts:
        starts.append((part, n))
        n += count
    starts = df.sparkSession.createDataFrame(starts, "_part int, _start long")
    rows = parts.withColumn("_rn", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    return rows.join(F.broadcast(starts), "_part").withColumn("row_index", F.col("_start") + F.col("_rn") - 1).drop("_part", "_start", "_rn")  # a row for each range


def time_folds(df: DataFrame, n_splits: int = 5, gap: int = 10) -> DataFrame:
    """(fold, part, game_id) of n expanding splits by date: test parts of n // (splits + 1) rows, a gap of rows before
    them left out, everything earlier is for training."""
    rows = row_numbers(df.select("game_id", "game_date"), ["game_date", "game_id"])
    total = df.agg(F.count("*").alias("n"))
    rows = rows.join(F.broadcast(total)).withColumn("size", F.floor(F.col("n") / (n_splits + 1)))  # one row
    rows = rows.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
    start = F.col("n") - (n_splits - F.col("fold")) * F.col("size")
    part = F.when(F.col("row_index") < start - gap, "train").when((F.col("row_index") >= start) & (F.col("row_index") < start + F.col("size")), "test")
    return rows.withColumn("part", part).where("part is not null").select("fold", "part", "game_id")


#: The comparison table's categories, with (home column, away column or None, label) of each row.
_COMPARED = {
    "Elo & Ratings": [
        ("home_elo", "away_elo", "Elo Rating (Team Strength)"),
        ("elo_diff", None, "Elo Difference (Home - Away)"),
        ("elo_win_prob", None, "Elo-Based Win Probability"),
    ],
    "Recent Form (Last 10)": [
        ("home_last10_win_pct", "away_last10_win_pct", "Win Percentage"),
        ("home_last10_offensive_rating", "away_last10_offensive_rating", "Offensive Rating (Points per 100 Possessions)"),
        ("home_last10_defensive_rating", "away_last10_defensive_rating", "Defensive Rating (Opp Points per 100 Poss)"),
        ("home_last10_net_rating", "away_last10_net_rating", "Net Rating (Off - Def)"),
        ("home_last10_pace", "away_last10_pace", "Pace (Possessions per Game)"),
        ("home_last10_fg3_pct", "away_last10_fg3_pct", "3-Point Shooting Percentage"),
        ("home_last10_opp_fg3_pct", "away_last10_opp_fg3_pct", "Opponent 3PT% Allowed (Perimeter Defense)"),
        ("home_last10_ppg", "away_last10_ppg", "Points Per Game"),
        ("home_last10_opp_ppg", "away_last10_opp_ppg", "Opponent Points Per Game"),
        ("home_last10_fg_pct", "away_last10_fg_pct", "Field Goal Percentage"),
        ("home_last10_reb", "away_last10_reb", "Rebounds Per Game"),
        ("home_last10_ast", "away_last10_ast", "Assists Per Game"),
        ("home_last10_tov", "away_last10_tov", "Turnovers Per Game"),
    ],
    "Recent Form (Last 5)": [
        ("home_last5_win_pct", "away_last5_win_pct", "Win Percentage"),
        ("home_last5_ppg", "away_last5_ppg", "Points Per Game"),
        ("home_last5_point_diff", "away_last5_point_diff", "Average Point Differential"),
        ("home_last5_fg_pct", "away_last5_fg_pct", "Field Goal Percentage"),
    ],
    "Home/Away Splits": [
        ("home_team_home_win_pct", "away_team_road_win_pct", "Win Percentage (Home vs Road)"),
        ("home_team_home_ppg", "away_team_road_ppg", "Points Per Game (Home vs Road)"),
        ("home_team_home_point_diff", "away_team_road_point_diff", "Point Differential (Home vs Road)"),
        ("home_team_home_fg_pct", "away_team_road_fg_pct", "Field Goal % (Home vs Road)"),
    ],
    "Situational": [
        ("home_rest_days", "away_rest_days", "Days of Rest"),
        ("rest_advantage", None, "Rest Advantage (Home - Away Days)"),
        ("home_streak", "away_streak", "Current Win/Loss Streak"),
        ("home_back_to_back", "away_back_to_back", "Playing Back-to-Back?"),
    ],
    "Head-to-Head": [
        ("h2h_home_win_pct", None, "Home Team H2H Win Percentage"),
        ("h2h_total_games", None, "Total Head-to-Head Games Played"),
        ("h2h_avg_point_diff", None, "Average Point Differential in H2H"),
        ("h2h_home_ppg", "h2h_away_ppg", "Points Per Game in H2H Matchups"),
    ],
}
#: (category, label, home column, away column or None) of the comparison table.
COMPARED = [(category, label, home, away) for category, rows in _COMPARED.items() for home, away, label in rows]


def decimal_text(c: Column, places: int, signed: bool = False) -> Column:
    """A number with so many places, an exact half rounded to the even digit, with a sign if asked for."""
    text = F.translate(F.format_number(c.cast("double"), places), ",", "")
    return F.when(text.startswith("-"), text).otherwise(F.concat(F.lit("+"), text)) if signed else text


def shown_value(c: Column, name: str) -> Column:
    """A value as the comparison table shows it, by the kind of feature that its name tells."""
    places = lambda n, v=c: decimal_text(v, n)
    has = lambda *parts: any(p in name for p in parts)
    if has("_pct", "prob"):
        text = F.when(c.between(0, 1), F.concat(places(1, c * 100), F.lit("%"))).when(c.between(0, 100), F.concat(places(1), F.lit("%"))).otherwise(places(1))
    elif has("rating", "pace"):
        text = places(1)
    elif has("elo"):
        text = places(0)
    elif has("ppg", "reb", "ast", "tov", "point_diff", "streak", "rest_days", "total_games"):
        text = places(1)
    elif has("back_to_back"):
        text = F.when(c == 1, "Yes").otherwise("No")
    else:
        text = places(2)
    return F.when(c.isNull() | F.isnan(c), "N/A").otherwise(text)


def feature_table(f: DataFrame) -> DataFrame:
    """A row for each game and compared feature: category, label, home_value, away_value, and home_shown and away_shown as
    text (N/A where there is no value).  A row about both sides at once, which has no away column, shows its text twice."""

    def row(category: str, label: str, home: str, away: str | None) -> Column:
        value = lambda n: F.col(n).cast("double") if n and n in f.columns else F.lit(None).cast("double")
        h, a = value(home), value(away)
        shown = shown_value(h, home)
        return F.struct(
            F.lit(category).alias("category"), F.lit(label).alias("label"), h.alias("home_value"), a.alias("away_value"), shown.alias("home_shown"),
            (shown_value(a, away) if away else shown).alias("away_shown"),
        )

    return f.select("game_id", F.explode(F.array(*[row(*r) for r in COMPARED])).alias("r")).select("game_id", "r.*")


def radar_values(f: DataFrame) -> DataFrame:
    """Last-10 figures of both sides scaled to about 0 ... 100."""
    out = {}
    for s in SIDES:
        p = f"{s}_last10_"
        out |= {
            f"{s}_win": f"{p}win_pct * 100", f"{s}_off": f"({p}offensive_rating - 90) / 0.4D", f"{s}_def": f"100 - ({p}defensive_rating - 90) / 0.4D",
            f"{s}_three": f"{p}fg3_pct * 250", f"{s}_reb": f"{p}reb", f"{s}_elo_scaled": f"({s}_elo - 1400) / 3",
        }
    return f.select("game_id", *[F.expr(e).alias(n) for n, e in out.items()])
