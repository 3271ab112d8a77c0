"""Keyed updates as joins and windows; a result is written as a new table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert_games(games: DataFrame, updates: DataFrame) -> DataFrame:
    """Updates with scores set an existing game's scores and teams (its box score stays) or add a game; updates without a
    score are left out.  Of several updates of a game the latest counts (by updated_at, where updates have it), of equally
    late ones that with the largest scores."""
    keys = [c for c in ("home_team_id", "away_team_id", "home_score", "away_score") if c in updates.columns]
    new = updates.where("home_score is not null and away_score is not null")
    first = [c for c in ("updated_at",) if c in updates.columns] + ["home_score", "away_score"]
    new = new.groupBy("game_id").agg(F.max(F.struct(*first, *[c for c in updates.columns if c not in ("game_id", *first)])).alias("u"))
    both = games.join(new, "game_id", "full_outer")
    changed = set(updates.columns) - {"game_id"}
    out = both.select("game_id", *[(F.coalesce(F.col(f"u.{c}"), F.col(c)) if c in keys else F.coalesce(F.col(c), F.col(f"u.{c}")) if c in changed else F.col(c)).alias(c) for c in games.columns if c != "game_id"])
    won = F.when(F.col("home_score").isNotNull() & F.col("away_score").isNotNull(), (F.col("home_score") > F.col("away_score")).cast("int"))
    return out.withColumn("home_win", won)


def replace_rows(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Whole rows by key: the row of largest `order` wins, new before old among equals."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc(), F.col("_new").desc())
    return both.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_new")


def upsert_predictions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Publishes predictions: unresolved old rows of the new rows' dates go, then the new rows replace by (date, home,
    away).  A settled row keeps its winner, and of scores, correctness and errors what old has; odds fall back to
    round(1 / p, 2)."""
    keys = ["game_date", "home_id", "away_id"]
    dates = new.select("game_date").distinct()
    settled = old.where("actual_winner is not null")
    kept = settled.unionByName(old.where("actual_winner is null").join(dates, "game_date", "left_anti"))
    odds = lambda s: F.coalesce(f"{s}_odds", F.when(F.col(f"predicted_{s}_prob") > 0, F.round(1 / F.col(f"predicted_{s}_prob"), 2)))
    new = new.withColumns({"home_odds": odds("home"), "away_odds": odds("away")})
    result = [c for c in ("actual_winner", "actual_home_score", "actual_away_score", "correct", "prediction_error", "calibration_error") if c in old.columns]
    results = settled.groupBy(*keys).agg(F.max(F.struct(*result)).alias("_r")).select(*keys, "_r.*")
    new = new.drop(*result).join(results, keys, "left").select(old.columns)
    return kept.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def drop_stale_pending(pred: DataFrame, as_of: str) -> DataFrame:
    """Without rows that have no winner and a date before as_of."""
    return pred.where(~(F.col("actual_winner").isNull() & (F.col("game_date") < F.lit(as_of).cast("date"))))


def mark_published(games: DataFrame, ids: DataFrame, at: str) -> DataFrame:
    """published and published_at for the rows whose id is in ids (game_id)."""
    marks = ids.select("game_id").distinct().withColumn("_p", F.lit(True))
    out = games.join(marks, "game_id", "left")
    return out.withColumns({"published": F.coalesce("_p", F.lit(False)), "published_at": F.when(F.col("_p"), F.lit(at).cast("timestamp"))}).drop("_p")


def export_games(pred: DataFrame, teams: DataFrame, on: str) -> DataFrame:
    """Unresolved predictions of a date and the day after, flat: id Away_vs_Home_date, matchup, names, odds with fallback;
    today's games first, then by confidence and names."""
    day = F.lit(on).cast("date")
    rows = pred.where(F.col("actual_winner").isNull() & F.col("game_date").between(day, F.date_add(day, 1)))
    for s in ("home", "away"):
        rows = rows.join(teams.select(F.col("team_id").alias(f"{s}_id"), F.col("full_name").alias(f"{s}_team")), f"{s}_id")
    odds = lambda s: F.coalesce(f"{s}_odds", F.when(F.col(f"predicted_{s}_prob") > 0, F.round(1 / F.col(f"predicted_{s}_prob"), 2)))
    name = F.replace(F.concat("away_team", F.lit("_vs_"), "home_team", F.lit("_"), F.date_format("game_date", "yyyy-MM-dd")), F.lit(" "), F.lit("_"))
    out = rows.select(
        name.alias("id"), F.concat("away_team", F.lit(" @ "), "home_team").alias("matchup"), "home_team", "away_team", "predicted_home_prob", odds("home").alias("home_odds"), odds("away").alias("away_odds"),
        "confidence", "game_date", (F.col("game_date") == day).alias("today"),
    )
    return out.orderBy(F.col("today").desc(), F.col("confidence").desc(), "home_team", "away_team")


def export_document(flat: DataFrame) -> DataFrame:
    """One row a date with the sorted array of its games, to be written as JSON."""
    game = F.struct((-F.col("confidence")).alias("order"), *[c for c in flat.columns if c != "game_date"])
    return flat.groupBy("game_date").agg(F.sort_array(F.collect_list(game)).alias("games"), F.count("*").alias("total"))
