"""Settling predictions against results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchstats.functions.names import normalize_team
from matchstats.operators.matches import completed


def _outcome(df: DataFrame) -> DataFrame:
    """Winner, correctness and errors where scores are known; equal probabilities pick away, a tie is an away win."""
    known = F.col("actual_home_score").isNotNull() & F.col("actual_away_score").isNotNull()
    won = (F.col("actual_home_score") > F.col("actual_away_score")).cast("int")
    picked = (F.col("predicted_home_prob") > F.col("predicted_away_prob")).cast("int")
    return df.withColumns({
        "actual_winner": F.coalesce("actual_winner", F.when(known, F.when(won == 1, "home").otherwise("away"))),
        "correct": F.when(known, (won == picked).cast("int")), "prediction_error": F.when(known, F.pow(F.col("predicted_home_prob") - won, 2)),
        "calibration_error": F.when(known, F.abs(F.col("predicted_home_prob") - won)),
    })


def settle_predictions(pred: DataFrame, games: DataFrame, as_of: str, days: int = 30, teams: DataFrame | None = None) -> DataFrame:
    """Pending predictions of the days up to as_of (both ends in) with the result of the played game of equal date, home
    and away team; without one they stay pending.  With `teams`, names are first looked up in the dictionary."""
    end = F.lit(as_of).cast("date")
    due = pred.where(F.col("actual_winner").isNull() & F.col("game_date").between(F.date_sub(end, days), end))
    if teams is not None:
        for side in ("home", "away"):
            due = normalize_team(due, f"{side}_team", teams, f"{side}_id")
    results = completed(games).select("game_date", F.col("home_team_id").alias("home_id"), F.col("away_team_id").alias("away_id"), "game_id", "home_score", "away_score")
    # Two games of the same teams on a date: the one with the smaller id.
    results = results.groupBy("game_date", "home_id", "away_id").agg(F.min(F.struct("game_id", "home_score", "away_score")).alias("g"))
    out = due.join(results, ["game_date", "home_id", "away_id"], "left")
    out = out.withColumns({"actual_home_score": F.col("g.home_score"), "actual_away_score": F.col("g.away_score")}).drop("g")
    return _outcome(out)


def backfill_scores(pred: DataFrame, games: DataFrame) -> DataFrame:
    """Scores, in the prediction's orientation, from a game of the date between the two teams in either order; only a
    missing winner is filled in.  A game in the prediction's own order comes first."""
    a, b = F.least("home_id", "away_id"), F.greatest("home_id", "away_id")
    results = completed(games).select("game_date", F.least("home_team_id", "away_team_id").alias("_a"), F.greatest("home_team_id", "away_team_id").alias("_b"), F.col("home_team_id").alias("_home"), F.col("game_id").alias("_game"), "home_score", "away_score")
    joined = pred.withColumns({"_a": a, "_b": b}).join(results, ["game_date", "_a", "_b"], "left")
    same = F.col("_home") == F.col("home_id")
    joined = joined.withColumns({"actual_home_score": F.when(same, F.col("home_score")).otherwise(F.col("away_score")), "actual_away_score": F.when(same, F.col("away_score")).otherwise(F.col("home_score"))})
    keep = [c for c in pred.columns if c not in ("actual_home_score", "actual_away_score")]
    best = F.min_by(F.struct(*keep, "actual_home_score", "actual_away_score"), F.struct(F.when(same, 0).otherwise(1), F.col("_game")))
    first = joined.groupBy(F.col("game_id").alias("_key")).agg(best.alias("r")).select("r.*")
    return _outcome(first)


def unsettled_report(pred: DataFrame, games: DataFrame) -> DataFrame:
    """Pending predictions without a played game of the date and teams: how many games the date has, and the reason."""
    played = completed(games)
    keys = played.select("game_date", F.col("home_team_id").alias("home_id"), F.col("away_team_id").alias("away_id"))
    counts = played.groupBy("game_date").agg(F.count("*").alias("games_on_date"))
    rows = pred.where("actual_winner is null").join(keys, ["game_date", "home_id", "away_id"], "left_anti").join(counts, "game_date", "left")
    n = F.coalesce("games_on_date", F.lit(0))
    return rows.select("game_id", "game_date", n.alias("games_on_date"), F.when(n == 0, "no game on that date").otherwise("no match").alias("reason"))


def lookup_predictions(keys: DataFrame, pred: DataFrame, teams: DataFrame) -> DataFrame:
    """The stored prediction of each (game_date, home, away) key, by full names, else by abbreviations, with its
    features_json where predictions have it; odds fall back to round(1 / p, 2).

    The keys are turned into team ids, and only then meet the predictions.
    """
    more = [c for c in ("features_json",) if c in pred.columns]
    texts = F.array(*[F.struct(F.lit(k).alias("by"), F.col(c).alias("text")) for k, c in enumerate(("full_name", "abbreviation"))])
    known = teams.select("team_id", F.explode(texts).alias("t")).select("team_id", "t.*").where("text is not null")
    named = keys.select("game_date", "home", "away").distinct()
    named = named.join(known.select(F.col("text").alias("home"), "by", F.col("team_id").alias("home_id")), "home")
    named = named.join(known.select(F.col("text").alias("away"), "by", F.col("team_id").alias("away_id")), ["away", "by"])
    stored = pred.select("game_date", "home_id", "away_id", F.struct("predicted_home_prob", "predicted_away_prob", "home_odds", "away_odds", "confidence", *more).alias("p"))
    found = named.join(stored, ["game_date", "home_id", "away_id"]).groupBy("game_date", "home", "away")
    found = found.agg(*[F.min(F.when(F.col("by") == k, F.col("p"))).alias(f"p{k}") for k in (0, 1)]).withColumn("p", F.coalesce("p0", "p1"))
    out = keys.join(found.drop("p0", "p1"), ["game_date", "home", "away"], "left")
    odds = lambda s: F.coalesce(F.col(f"p.{s}_odds"), F.when(F.col(f"p.predicted_{s}_prob") > 0, F.round(1 / F.col(f"p.predicted_{s}_prob"), 2)))
    return out.select(*keys.columns, F.col("p.confidence").alias("confidence"), odds("home").alias("home_odds"), odds("away").alias("away_odds"), *[F.col(f"p.{c}").alias(c) for c in more])
