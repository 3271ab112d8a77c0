"""Building games from team logs, splitting them into team rows, and selecting them."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Box-score columns of a side, without its prefix.
BOX = ("fgm", "fga", "fg_pct", "fg3m", "fg3a", "fg3_pct", "ftm", "fta", "ft_pct", "oreb", "dreb", "reb", "ast", "tov")


def pair_games(logs: DataFrame, strict: bool = True) -> DataFrame:
    """One row for each game of the team logs (two rows a game), by one partial aggregation.

    Strict: exactly two rows, one with ` vs. ` (home) and one with ` @ ` (away); missing points count 0.
    Lenient: the row with `vs.` is the home side, another row the away side; games without points are dropped.
    What the logs have of SEASON, pool_id (else all games are of pool 0), TEAM_ABBREVIATION and the box score comes along.
    """
    have = {c.upper(): c for c in logs.columns}
    box = [b for b in (*BOX, "stl", "blk") if b.upper() in have]
    extra = {"team": "TEAM_ABBREVIATION"} if "TEAM_ABBREVIATION" in have else {}
    extra |= {b: have[b.upper()] for b in box}
    side = F.struct(F.col("TEAM_ID").alias("team_id"), F.col("PTS").alias("pts"), *[F.col(c).alias(b) for b, c in extra.items()])
    pool = F.min(have["POOL_ID"]) if "POOL_ID" in have else F.lit(0).cast("long")
    season = [F.min("SEASON").alias("season")] if "SEASON" in have else []
    home = F.contains(F.col("MATCHUP"), F.lit(" vs. " if strict else "vs."))
    away = F.contains(F.col("MATCHUP"), F.lit(" @ ")) if strict else ~home
    games = logs.groupBy("GAME_ID").agg(
        F.count("*").alias("n"), F.count_if(home).alias("n_home"), F.count_if(away).alias("n_away"),
        F.max(F.when(home, side)).alias("h"), F.max(F.when(away, side)).alias("a"), F.min("GAME_DATE").alias("game_date"), pool.alias("pool_id"), *season,
    )
    if strict:
        games = games.where("n = 2 and n_home = 1 and n_away = 1")
        points = lambda s: F.coalesce(F.col(f"{s}.pts"), F.lit(0))
    else:
        games = games.where("n_home > 0 and n_away > 0 and h.pts > 0 and a.pts is not null")
        points = lambda s: F.col(f"{s}.pts")
    games = games.select(F.col("GAME_ID").alias("game_id"), "game_date", F.col("h.team_id").alias("home_team_id"), F.col("a.team_id").alias("away_team_id"), points("h").alias("home_score"), points("a").alias("away_score"),
        "pool_id", *[c for c in ("season",) if season], *[F.col(f"{k}.{c}").alias(f"{s}_{c}") for s, k in (("home", "h"), ("away", "a")) for c in extra])
    return games.withColumns({"home_win": (F.col("home_score") > F.col("away_score")).cast("int"), "point_differential": F.col("home_score") - F.col("away_score")})


def score_from_one_row(logs: DataFrame) -> DataFrame:
    """Both scores of a game from one team's row: own points, and the opponent's by result and plus-minus."""
    margin = F.abs(F.col("PLUS_MINUS"))
    other = F.when(F.col("WL") == "W", F.col("PTS") - margin).otherwise(F.col("PTS") + margin)
    home = F.contains(F.col("MATCHUP"), F.lit("vs."))
    return logs.select("GAME_ID", "TEAM_ID", F.when(home, F.col("PTS")).otherwise(other).alias("home_score"), F.when(home, other).otherwise(F.col("PTS")).alias("away_score"))


def completed(games: DataFrame) -> DataFrame:
    """Games with both scores, one of them positive."""
    return games.where("home_score is not null and away_score is not null and (home_score > 0 or away_score > 0)")


def scheduled(games: DataFrame) -> DataFrame:
    """Games without a home score, or with 0."""
    return games.where("home_score is null or home_score = 0").dropDuplicates(["game_id"])


def date_window(df: DataFrame, start: date | str, end: date | str, column: str = "game_date") -> DataFrame:
    """Rows from start (in) to end (out)."""
    return df.where((F.col(column) >= F.lit(str(start)).cast("date")) & (F.col(column) < F.lit(str(end)).cast("date")))


def season_label(year: Column) -> Column:
    """2024 becomes 2024-25."""
    return F.concat_ws("-", year.cast("string"), F.substring((year + 1).cast("string"), 3, 2))


def parse_date(c: Column) -> Column:
    """A date in one of four formats, else null; ambiguous dates are month first."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in ("yyyy-M-d", "yyyy/M/d", "M/d/yyyy", "d/M/yyyy")]).cast("date")


def team_rows(games: DataFrame, more: tuple[str, ...] = (), each: tuple[str, ...] = ()) -> DataFrame:
    """Two rows for each game, one as each team sees it, in one pass: own columns plain, the opponent's with opp_.
    The columns `more` come along in the home side's row, those of `each` in both."""
    both = [b for b in BOX if f"home_{b}" in games.columns]

    def side(own: str, other: str) -> Column:
        own_win = F.when(F.col("home_score") > F.col("away_score"), F.lit(1 if own == "home" else 0)).when(F.col("home_score").isNotNull() & F.col("away_score").isNotNull(), F.lit(0 if own == "home" else 1))
        return F.struct(
            F.col(f"{own}_team_id").alias("team_id"), F.col(f"{other}_team_id").alias("opponent_id"), F.lit(1 if own == "home" else 0).alias("is_home"),
            F.col(f"{own}_score").alias("pts"), F.col(f"{other}_score").alias("opp_pts"), own_win.alias("win"),
            *[F.col(f"{own}_{b}").alias(b) for b in both], *[F.col(f"{other}_{b}").alias(f"opp_{b}") for b in both],
            *[(F.col(c) if own == "home" else F.lit(None).cast(games.schema[c].dataType)).alias(c) for c in more],
        )

    sides = games.select("pool_id", "game_id", "game_date", *each, F.explode(F.array(side("home", "away"), side("away", "home"))).alias("s"))
    return sides.select("pool_id", "game_id", "game_date", *each, "s.*")
