"""Features as they stood strictly before a date.

One mechanism serves all: rows of a key stand in one partition, sorted once by date and game, and running figures over the
games that count are read off as they stood before the first row of each date.  So each feature takes one shuffle and one sort
however many frames it has, and team_features() takes one of each for all of a team's features.
Two games on one date never see each other, and dates without a game (a schedule) can be asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a team without history gets.
DEFAULTS = {
    "win_pct": 0.5, "ppg": 110.0, "opp_ppg": 110.0, "point_diff": 0.0, "fg_pct": 0.45, "fg3_pct": 0.35, "ft_pct": 0.78, "reb": 44.0,
    "ast": 25.0, "tov": 14.0, "opp_fg3_pct": 0.35, "offensive_rating": 110.0, "defensive_rating": 110.0, "net_rating": 0.0,
    "pace": 100.0, "three_point_rate": 0.35, "opp_three_point_rate": 0.35,
}


def _order(by: list[str]):
    return Window.partitionBy(*by).orderBy("game_date", "game_id")


def _past(keys: list[str], date: str = "game_date", first: int = Window.unboundedPreceding):
    """All rows of a key on earlier dates (from `first` days before on)."""
    return Window.partitionBy(*keys).orderBy(F.unix_date(date)).rangeBetween(first, -1)


def asof_before(left: DataFrame, history: DataFrame, keys: list[str], date: str, order: list[str], name: str) -> DataFrame:
    """left with a struct column `name`: the last row of history (by date, then order) strictly before left's date.

    history's other columns make up the struct; left may have several rows of a (key, date).  A null key has no history.
    """
    values = [c for c in history.columns if c not in [*keys, date]]
    known = history.where(" and ".join(f"`{k}` is not null" for k in keys))
    known = known.select(*keys, date, F.struct(*values).alias(name), F.struct(date, *order).alias("_at"))
    both = left.withColumn("_left", F.lit(True)).unionByName(known, allowMissingColumns=True)
    return both.withColumn(name, F.max_by(name, "_at").over(_past(keys, date))).where("_left").drop("_left", "_at")


def _dealt(t: DataFrame, keys: list[str], dates: DataFrame | None = None) -> DataFrame:
    """The rows of t dealt by keys, each asking for its own date (_ask).  With `dates`, their (team_id, game_date) are asked for
    instead: rows of their own, without a game, so that they come first on their date and count nowhere."""
    if dates is None:
        return t.withColumn("_ask", F.lit(True)).repartition(*keys)
    more = dates.select("team_id", "game_date").distinct().withColumn("_ask", F.lit(True))
    return t.withColumn("_ask", F.lit(False)).unionByName(more, allowMissingColumns=True).repartition(*keys)


def _first_of_date(by: list[str]):
    """From the first row of a key's date on: that row stands before all games of the date."""
    return Window.partitionBy(*by, "game_date").orderBy("game_id").rowsBetween(Window.unboundedPreceding, 0)


def _once(df: DataFrame, keys: list[str]) -> DataFrame:
    """One asked row for each date of a key: the first, before which stand all games of earlier dates and no others."""
    n = F.row_number().over(Window.partitionBy(*keys, "game_date").orderBy("game_id"))
    return df.withColumn("_n", n).where("_n = 1 and _ask").drop("_n", "_ask")


def possessions(prefix: str = "", other: str = "opp_") -> Column:
    """Mean of both teams' possession estimates; null if any figure is missing."""

    def one(a: str, b: str) -> Column:
        c = lambda n: F.col(n).cast("double")
        share = c(f"{a}oreb") / (c(f"{a}oreb") + c(f"{b}dreb") + 1)
        return c(f"{a}fga") + 0.4 * c(f"{a}fta") - 1.07 * share * (c(f"{a}fga") - c(f"{a}fgm")) + c(f"{a}tov")

    return 0.5 * (one(prefix, other) + one(other, prefix))


#: An opponent's rating and share of wins before its first game.
START_ELO, START_SHARE = 1500.0, 0.5
#: Means over a team's last games, as quotients of means.
_FORM = {
    "win_pct": "win", "ppg": "pts", "opp_ppg": "opp_pts", "point_diff": "pts - opp_pts", "fg_pct": "fg_pct", "fg3_pct": "fg3_pct", "ft_pct": "ft_pct", "reb": "reb", "ast": "ast", "tov": "tov",
    "opp_fg3_pct": "opp_fg3_pct", "offensive_rating": "CASE WHEN _poss > 0 THEN pts * 100D / _poss END", "defensive_rating": "CASE WHEN _poss > 0 THEN opp_pts * 100D / _poss END",
    "pace": "CASE WHEN _poss > 0 THEN _poss END", "three_point_rate": ("fg3a", "fga"), "opp_three_point_rate": ("opp_fg3a", "opp_fga"),
}
BOXED = "fga is not null and pts is not null"
SPLIT = {"win_pct": "win", "ppg": "pts", "point_diff": "pts - opp_pts", "fg_pct": "fg_pct"}


def _totals(terms: list[str], counted: Column, by: list[str]) -> Column:
    """The sums and counts of some terms over all counted rows so far, as a struct; null in a row that does not count.  Those of
    the last n rows are the difference to the totals n rows before, so no row is summed twice, however many n there are."""
    so_far = _order(by).rowsBetween(Window.unboundedPreceding, 0)
    value = lambda e: F.when(counted, F.expr(e))
    each = lambda i, e: (F.sum(value(e).cast("double")).over(so_far).alias(f"s{i}"), F.count(value(e)).over(so_far).alias(f"c{i}"))
    return F.when(counted, F.struct(*[c for i, e in enumerate(terms) for c in each(i, e)]))


def _mean_since(i: int, now: str, before: str) -> Column:
    """The mean of term i between two totals; null without any."""
    part = lambda k, x: F.coalesce(F.col(f"{x}.{k}{i}"), F.lit(0))
    n = part("c", now) - part("c", before)
    return F.when(n > 0, (part("s", now) - part("s", before)) / n)


def _back(column: str, n: int, by: list[str]) -> Column:
    """The n-th value before the row that is not null."""
    return F.expr(f"lag({column}, {n}) IGNORE NULLS OVER (PARTITION BY {', '.join(by)} ORDER BY game_date, game_id)")


def _with_means(df: DataFrame, by: list[str], *asked: tuple[str, Column, tuple[int, ...], dict]) -> DataFrame:
    """Adds structs of the means (or quotients of two) of the last n counted rows before each row, for each n, as last{n}_...:
    one for each asked (name, counted, ns, means).  All of them take one pass for the totals and one for those n rows before."""
    totals, back, structs = {}, {}, {}
    for name, counted, ns, means in asked:
        terms = list(dict.fromkeys(e for m in means.values() for e in ([m] if isinstance(m, str) else m)))
        at = {e: i for i, e in enumerate(terms)}
        totals[f"{name}_now"] = _totals(terms, counted, by)
        back |= {f"{name}_end": _back(f"{name}_now", 1, by), **{f"{name}_ago{n}": _back(f"{name}_now", n + 1, by) for n in ns}}
        columns = []
        for n in ns:
            mean = lambda e: _mean_since(at[e], f"{name}_end", f"{name}_ago{n}")  # noqa: B023, E731
            columns += [(mean(m) if isinstance(m, str) else mean(m[0]) / mean(m[1])).alias(f"last{n}_{c}") for c, m in means.items()]
        structs[name] = F.struct(*columns)
    return df.withColumns(totals).withColumns(back).withColumns(structs).drop(*totals, *back)


def _form(ns: tuple[int, ...]) -> tuple[str, Column, tuple[int, ...], dict]:
    """Asks for _form: the means of _FORM over the last n rows with a box score before each row, for each n."""
    return "_form", F.expr(BOXED), ns, _FORM


def _form_columns(ns: tuple[int, ...]) -> dict[str, Column]:
    out = {f"last{n}_{name}": F.coalesce(F.col(f"_form.last{n}_{name}"), F.lit(DEFAULTS[name])) for n in ns for name in _FORM}
    return out | {f"last{n}_net_rating": out[f"last{n}_offensive_rating"] - out[f"last{n}_defensive_rating"] for n in ns}


def recent_form(t: DataFrame, ns: tuple[int, ...] = (3, 5, 10), dates: DataFrame | None = None) -> DataFrame:
    """last{n}_... features of each (team_id, game_date) of `dates` (those of t): means over a team's last n games with
    a box score before the date; without any, DEFAULTS.  Ratings and pace are means of games with possessions above 0.
    """
    rows = _dealt(t, ["team_id"], dates).withColumn("_poss", possessions())
    out = _once(_with_means(rows, ["team_id"], _form(ns)), ["team_id"])
    return out.select("team_id", "game_date", *[c.alias(n) for n, c in _form_columns(ns).items()])


SCORED = "pts is not null and opp_pts is not null"


def _split_columns(n: int) -> dict[str, Column]:
    return {c: F.coalesce(F.col(f"_split.last{n}_{c}"), F.lit(DEFAULTS[c])) for c in SPLIT}


def venue_split(t: DataFrame, n: int = 15) -> DataFrame:
    """split_... of each (team_id, is_home, game_date): a team's last n games at home, or on the road, before the date."""
    keys = ["team_id", "is_home"]
    out = _once(_with_means(_dealt(t, keys), keys, ("_split", F.expr(SCORED), (n,), SPLIT)), keys)
    return out.select("team_id", "is_home", "game_date", *[c.alias(f"split_{name}") for name, c in _split_columns(n).items()])


def head_to_head(games: DataFrame, n: int = 10) -> DataFrame:
    """h2h_... of each game: the two teams' last n meetings before its date; "home" is the home side of the past game."""
    pair = {"t1": F.least("home_team_id", "away_team_id"), "t2": F.greatest("home_team_id", "away_team_id")}
    w = Window.partitionBy("pool_id", "t1", "t2").orderBy("game_date", "game_id")
    wide, last3 = w.rowsBetween(-(n - 1), 0), w.rowsBetween(-2, 0)
    won = (F.col("home_score") > F.col("away_score")).cast("int")
    played = games.where("home_score is not null and away_score is not null").withColumns(pair)
    rows = played.select(
        "pool_id", "t1", "t2", "game_date", "game_id", F.avg(won).over(wide).alias("home_win_pct"), F.count("*").over(wide).alias("total_games"),
        F.avg(F.col("home_score") - F.col("away_score")).over(wide).alias("avg_point_diff"), F.sum(won).over(last3).alias("last3_home_wins"),
        F.avg("home_score").over(wide).alias("home_ppg"), F.avg("away_score").over(wide).alias("away_ppg"),
    )
    out = asof_before(games.select("game_id", "pool_id", "game_date", "home_team_id", "away_team_id").withColumns(pair), rows, ["pool_id", "t1", "t2"], "game_date", ["game_id"], "s")
    return out.select("game_id", *[F.coalesce(F.col(f"s.{c}"), F.lit(v)).alias(f"h2h_{c}") for c, v in _MEETINGS.items()])


#: What two teams that have not met get.
_MEETINGS = {"home_win_pct": 0.5, "total_games": 0, "avg_point_diff": 0.0, "last3_home_wins": 0, "home_ppg": 110.0, "away_ppg": 110.0}


def with_meetings(games: DataFrame, n: int = 10) -> DataFrame:
    """games, which are dealt by pool_id, with _h2h, a struct of what head_to_head gives, by running totals of one more sort."""
    pair = ["pool_id", "_t1", "_t2"]
    played = F.expr("home_score is not null and away_score is not null")
    means = {"home_win_pct": "CAST(home_score > away_score AS INT)", "avg_point_diff": "home_score - away_score", "home_ppg": "home_score", "away_ppg": "away_score"}
    df = games.withColumns({"_t1": F.least("home_team_id", "away_team_id"), "_t2": F.greatest("home_team_id", "away_team_id")})
    df = _with_means(df, pair, ("_met", played, (3, n), means)).withColumn("_n", F.count(F.when(played, 1)).over(_order(pair).rowsBetween(Window.unboundedPreceding, -1)))
    found = {c: F.col(f"_met.last{n}_{c}") for c in means}
    found |= {"total_games": F.least("_n", F.lit(n)), "last3_home_wins": F.round(F.col("_met.last3_home_win_pct") * F.least("_n", F.lit(3))).cast("long")}
    found = F.struct(*[F.coalesce(found[c], F.lit(v)).alias(f"h2h_{c}") for c, v in _MEETINGS.items()])
    return df.withColumn("_h2h", F.first(found).over(_first_of_date(pair))).drop("_t1", "_t2", "_met", "_n")


def rest_days(t: DataFrame, default: int = 3) -> DataFrame:
    """rest_days and back_to_back (0 or 1) of each (team_id, game_date): days without a game before it."""
    days = t.select("team_id", "game_date").distinct()
    before = F.lag("game_date").over(Window.partitionBy("team_id").orderBy("game_date"))
    days = days.withColumn("rest_days", F.coalesce(F.datediff("game_date", before) - 1, F.lit(default)))
    return days.withColumn("back_to_back", (F.col("rest_days") == 0).cast("int"))


def _with_runs(df: DataFrame, by: list[str], *asked: tuple[str, str, Column, Column]) -> DataFrame:
    """Adds, for each asked (name, value, counted, length), the length of the run of equal values ({name}_run, and {name}_value) that
    ends with the last counted row before each row (gaps and islands)."""
    w = _order(by)
    earlier, so_far = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    at, runs = {}, {}
    for name, value, counted, _ in asked:
        at |= {f"{name}_value": F.last(F.when(counted, F.col(value)), ignorenulls=True).over(earlier), f"{name}_at": F.count(F.when(counted, 1)).over(so_far)}
        begins = F.when(counted & ~F.col(f"{name}_value").eqNullSafe(F.col(value)), F.col(f"{name}_at"))
        runs[f"{name}_run"] = F.col(f"{name}_at") - counted.cast("int") - F.last(begins, ignorenulls=True).over(earlier) + 1
    return df.withColumns(at).withColumns(runs).withColumns({name: length for name, _, _, length in asked}).drop(*at, *runs)


def _streak(cap: int) -> tuple[str, str, Column, Column]:
    return "_streak", "win", F.col("win").isNotNull(), F.least("_streak_run", F.lit(cap)) * (2 * F.col("_streak_value") - 1)


def _trip(cap: int) -> tuple[str, str, Column, Column]:
    return "_trip", "is_home", F.lit(True), F.when(F.col("_trip_value") == 0, F.least("_trip_run", F.lit(cap))).otherwise(0)


def streak(t: DataFrame, cap: int = 15) -> DataFrame:
    """Signed streak of each (team_id, game_date): wins or losses in a row before the date, at most cap; 0 without any."""
    out = _once(_with_runs(_dealt(t, ["team_id"]), ["team_id"], _streak(cap)), ["team_id"])
    return out.select("team_id", "game_date", F.coalesce("_streak", F.lit(0)).alias("streak"))


def road_trip(t: DataFrame, cap: int = 10) -> DataFrame:
    """Away games in a row before each (team_id, game_date), at most cap, and long_road_trip (from 4 on)."""
    out = _once(_with_runs(_dealt(t, ["team_id"]), ["team_id"], _trip(cap)), ["team_id"])
    return out.select("team_id", "game_date", F.coalesce("_trip", F.lit(0)).alias("road_trip_length")).withColumn("long_road_trip", (F.col("road_trip_length") >= 4).cast("int"))


def games_last_days(t: DataFrame, days: int = 7) -> DataFrame:
    """Games of a team on the `days` days before each (team_id, game_date)."""
    w = Window.partitionBy("team_id").orderBy(F.unix_date("game_date")).rangeBetween(-days, -1)
    return t.select("team_id", "game_date", F.count("game_id").over(w).alias(f"games_last_{days}d")).distinct()


def team_overview(t: DataFrame, n: int = 15) -> DataFrame:
    """Record, win share and points of a team's last n played games (shares of the games there are)."""
    order = Window.partitionBy("team_id").orderBy(F.col("game_date").desc(), F.col("game_id").desc())
    last = t.where("win is not null").withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= n)
    return last.groupBy("team_id").agg(F.sum("win").alias("wins"), (F.count("*") - F.sum("win")).alias("losses"), F.avg("win").alias("win_pct"), F.avg("pts").alias("ppg"))


def lookups(asked: DataFrame, t: DataFrame, history: DataFrame) -> DataFrame:
    """The asked rows (team_id, game_date, game_id and others) with the team's share (of wins) and elo before the date, and
    elo_here, its rating before the very game game_id.  Asked rows, games and ratings of a team meet in one shuffle; asked rows
    come first on their date, so share and elo are running figures of one sort."""
    games = t.where("win is not null").select("team_id", "game_date", F.col("win").alias("_win"))
    ratings = history.select("team_id", "game_date", "game_id", F.col("elo_after").alias("_after"), F.col("elo_before").alias("_here"))
    both = asked.withColumn("_asked", F.lit(True)).unionByName(games, allowMissingColumns=True).unionByName(ratings, allowMissingColumns=True).repartition("team_id")
    so_far = Window.partitionBy("team_id").orderBy("game_date", F.col("_asked").isNull(), "game_id").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumns({"share": F.avg("_win").over(so_far), "elo": F.last("_after", ignorenulls=True).over(so_far), "elo_here": F.max("_here").over(Window.partitionBy("team_id", "game_id"))})
    return both.where("_asked").drop("_asked", "_win", "_after", "_here")


def _with_opponents(df: DataFrame, n: int) -> DataFrame:
    """Adds _last: the opponents of the last n played games before each row, the oldest first, and the win share in them."""
    df = df.withColumn("_met", F.when(F.col("win").isNotNull(), F.struct("opponent_id", "win")))
    df = df.withColumn("_last", F.filter(F.array(*[_back("_met", k, ["team_id"]) for k in range(n, 0, -1)]), lambda x: x.isNotNull()))
    won = F.aggregate("_last", F.lit(0).cast("long"), lambda s, x: s + x["win"])
    opponents = F.filter(F.transform("_last", lambda x: x["opponent_id"]), lambda x: x.isNotNull())
    return df.withColumn("_last", F.struct(opponents.alias("opponents"), F.try_divide(won, F.size("_last")).alias("own"))).drop("_met")


def schedule_columns(found: Column, own: Column) -> dict[str, Column]:
    """Schedule strength from the opponents' (pos, elo, share), averaged in the order of the games, and the team's share."""
    rows = F.array_sort(found)
    mean = lambda name, default: F.try_divide(F.aggregate(rows, F.lit(0.0), lambda s, x: s + F.coalesce(x[name], F.lit(default))), F.size(rows))
    return schedule_of(mean("elo", START_ELO), mean("share", START_SHARE), own)


def schedule_of(elo: Column, share: Column, own: Column) -> dict[str, Column]:
    """Schedule strength from the opponents' mean rating and share (null without any) and the team's share."""
    elo, own = F.coalesce(elo, F.lit(START_ELO)), F.coalesce(own, F.lit(0.5))
    sos = F.least(F.greatest((elo - 1350) / 300, F.lit(0.0)), F.lit(1.0))
    adjusted = own + (sos - 0.5) * 0.3 * (own - 0.5)
    return {
        "avg_opponent_elo": elo, "opponent_win_pct": F.coalesce(share, F.lit(START_SHARE)), "sos_normalized": sos,
        "sos_adjusted_win_pct": F.least(F.greatest(adjusted, F.lit(0.0)), F.lit(1.0)),
    }


def strength_of_schedule(t: DataFrame, history: DataFrame, n: int = 10) -> DataFrame:
    """Schedule strength of each (team_id, game_date) over its last n games before the date.

    Of each opponent the rating and the win share over all its games as of that date count, so the at most n opponents
    are listed and looked up.  Defaults: rating 1500, win share 0.5.

    A row for each opponent goes to it and back, into a field for its place in the list, so that sums go in the order of the
    games and no list is built or sorted.  A date without opponents goes to the team itself: rows without a key would all meet
    in one task.
    """
    lists = _once(_with_opponents(_dealt(t, ["team_id"]), n), ["team_id"])
    asked = lists.select("team_id", "game_date", "_last.own", F.posexplode_outer("_last.opponents").alias("pos", "_opponent"))
    asked = asked.select(F.col("team_id").alias("_team"), "game_date", F.lit(None).cast("long").alias("game_id"), "own", "pos", F.coalesce("_opponent", "team_id").alias("team_id"))
    default = {"elo": START_ELO, "share": START_SHARE}
    fields = [F.max(F.when(F.col("pos") == k, F.coalesce(c, F.lit(v)))).alias(f"{c}{k}") for c, v in default.items() for k in range(n)]
    found = lookups(asked, t, history).select("_team", "game_date", "own", "pos", *default).repartition("_team")
    found = found.groupBy(F.col("_team").alias("team_id"), "game_date").agg(F.max("own").alias("own"), F.count("pos").alias("_n"), *fields)
    mean = lambda c: F.try_divide(sum((F.coalesce(f"{c}{k}", F.lit(0.0)) for k in range(n)), F.lit(0.0)), F.col("_n"))
    return found.select("team_id", "game_date", *[c.alias(k) for k, c in schedule_of(mean("elo"), mean("share"), F.col("own")).items()])


def team_features(t: DataFrame, ns: tuple[int, ...] = (3, 5, 10), form: tuple[int, int, int, int, int, int] = (15, 15, 10, 7, 3, 10), more: tuple[str, ...] | None = None) -> DataFrame:
    """Every row of t (game_id, game_date, team_id, is_home, opponent_id, pool_id, pts, opp_pts) with f, a struct of all
    features of its team before its date that recent_form, rest_days, streak, road_trip, games_last_days and venue_split
    (for its side) give, and last: the opponents of the last games and the win share in them.

    All frames stand on one shuffle and one sort by team; a date's games all get what its first row knows.  form has split
    games, caps of streak and trip, days, default rest, schedule games.  Where t is dealt by pool_id and teams play in no other
    pool, `more` names further columns to keep: then nothing is dealt anew, and there is no last.
    """
    split, cap, trip, days, rest, schedule = form
    team, home = ["team_id"] if more is None else ["pool_id", "team_id"], F.col("is_home") == 1
    df = (t.repartition("team_id") if more is None else t).withColumn("_poss", possessions())
    df = _with_means(df, team, _form(ns), *[(f"_split{k}", F.expr(SCORED) & c, (split,), SPLIT) for k, c in ((1, home), (0, ~home))])
    df = _with_runs(df, team, _streak(cap), _trip(trip))
    df = _with_opponents(df, schedule) if more is None else df.withColumn("_last", F.lit(None).cast("int"))
    df = df.withColumn("_rest", F.datediff("game_date", F.lag("game_date").over(_order(team))) - 1)
    week = F.expr(f"count(game_id) OVER (PARTITION BY {', '.join(team)} ORDER BY game_date RANGE BETWEEN {days} PRECEDING AND 1 PRECEDING)")
    known = F.first(F.struct("_form", "_split1", "_split0", "_streak", "_trip", "_rest", "_last")).over(_first_of_date(team))
    keep = ["pool_id", "game_id", "game_date", "team_id", "opponent_id", "is_home", "pts", "opp_pts", *(more or [])]
    df = df.select(*keep, known.alias("_known"), week.alias("_games"))
    df = df.select(*keep, *[f"_known.{c}" for c in ("_form", "_streak", "_trip", "_rest")], F.when(home, F.col("_known._split1")).otherwise(F.col("_known._split0")).alias("_split"), F.col("_known._last").alias("last"), "_games")
    gap, away = F.coalesce("_rest", F.lit(rest)), F.coalesce("_trip", F.lit(0))
    f = {
        **_form_columns(ns), "rest_days": gap, "back_to_back": (gap == 0).cast("int"), "streak": F.coalesce("_streak", F.lit(0)), "road_trip_length": away, "long_road_trip": (away >= 4).cast("int"),
        f"games_last_{days}d": F.col("_games"), **{f"split_{k}": c for k, c in _split_columns(split).items()},
    }
    return df.select(*keep, F.struct(*[c.alias(k) for k, c in f.items()]).alias("f"), *(["last"] if more is None else []))


def latest_games(t: DataFrame, n: int = 10) -> DataFrame:
    """Each team's n latest games."""
    order = Window.partitionBy("team_id").orderBy(F.col("game_date").desc(), F.col("game_id").desc())
    return t.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= n)


def latest_meetings(games: DataFrame, n: int = 5) -> DataFrame:
    """The n latest games of each pair of teams."""
    order = Window.partitionBy("pool_id", F.least("home_team_id", "away_team_id"), F.greatest("home_team_id", "away_team_id")).orderBy(F.col("game_date").desc(), F.col("game_id").desc())
    return games.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= n)
