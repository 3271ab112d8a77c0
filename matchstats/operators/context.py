"""Travel, rating freshness, injuries, players, bets and caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchstats.functions.scalars import fatigue, haversine_km


def by_side(games: DataFrame, teams: DataFrame) -> DataFrame:
    """game_id and the columns of both sides' rows of a table of one row a team (team_id), as home_... and away_...; teams
    without a row have nulls."""
    out = games.select("game_id", "home_team_id", "away_team_id")
    for s in ("home", "away"):
        out = out.join(teams.withColumnsRenamed({c: f"{s}_{c}" for c in teams.columns}), f"{s}_team_id", "left")
    return out.drop("home_team_id", "away_team_id")


def travel_columns(origin: str, venue: str) -> dict[str, Column]:
    """The way between two places, each with columns {place}lat, {place}lon and {place}tz_offset; unknown places give zeros."""
    km = F.coalesce(haversine_km(F.col(f"{origin}lat"), F.col(f"{origin}lon"), F.col(f"{venue}lat"), F.col(f"{venue}lon")), F.lit(0.0))
    zones = F.coalesce(F.abs(F.col(f"{venue}tz_offset") - F.col(f"{origin}tz_offset")), F.lit(0))
    return {"away_travel_distance": F.round(km, 1), "away_time_zones_crossed": zones, "away_travel_fatigue_index": F.round(fatigue(km, zones), 3)}


def travel_features(games: DataFrame, arenas: DataFrame, origin: str = "home") -> DataFrame:
    """The away team's way to each game: from its own arena, or (origin "previous") from its previous game's arena;
    unknown arenas give zeros.  Distances are kilometres."""
    g = games.select("game_id", "game_date", "home_team_id", "away_team_id")
    if origin == "previous":
        sides = g.select("game_id", "game_date", F.explode(F.array("home_team_id", "away_team_id")).alias("team_id"), F.col("home_team_id").alias("venue"))
        before = F.lag("venue").over(Window.partitionBy("team_id").orderBy("game_date", "game_id"))
        g = g.join(sides.select("game_id", F.col("team_id").alias("away_team_id"), F.coalesce(before, "team_id").alias("origin_id")), ["game_id", "away_team_id"])
    else:
        g = g.withColumn("origin_id", F.col("away_team_id"))
    place = lambda p, key: arenas.select(F.col("team_id").alias(key), *[F.col(c).alias(p + c) for c in ("lat", "lon", "tz_offset")])
    g = g.join(place("o_", "origin_id"), "origin_id", "left").join(place("d_", "home_team_id"), "home_team_id", "left")
    return g.select("game_id", *[c.alias(n) for n, c in travel_columns("o_", "d_").items()])


def elo_freshness(current: DataFrame, games: DataFrame, as_of: str, max_age: int = 3) -> DataFrame:
    """Every team of the games with its rating, days since the last update and whether that is over max_age days ago."""
    teams = games.select(F.col("home_team_id").alias("team_id")).union(games.select("away_team_id")).distinct()
    age = F.datediff(F.lit(as_of).cast("date"), F.col("last_updated"))
    return teams.join(current.select("team_id", "elo", "last_updated"), "team_id", "left").select("team_id", "elo", age.alias("days_old"), F.coalesce(age > max_age, F.lit(True)).alias("stale"))


def injuries_in_force(injuries: DataFrame, as_of: str, hours: int = 6) -> DataFrame:
    """The latest row of each (team, player) fetched within the hours before as_of."""
    end = F.lit(as_of).cast("timestamp")
    valid = injuries.where((F.col("fetched_at") > end - F.expr(f"INTERVAL {hours} HOURS")) & (F.col("fetched_at") <= end))
    return latest_snapshot(valid, ["team_id", "player_name"], "fetched_at")


def latest_snapshot(df: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """The newest row of each key (by its other columns among equal times)."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(ts, *[c for c in rest if c != ts])).alias("s")).select(*keys, "s.*")


def injury_counts(injuries: DataFrame) -> DataFrame:
    """Per team: starters out, whether a star is out, all players out (status with "out" or "dnp")."""
    out = injuries.where(F.lower("status").rlike("out|dnp"))
    return out.groupBy("team_id").agg(F.count_if("is_starter").alias("injured_starters"), F.max(F.col("is_star").cast("int")).alias("star_injured"), F.count("*").alias("total_out"))


def injury_columns(f: DataFrame) -> DataFrame:
    """Impact (2 a starter, 3 a star) of both sides from injured_starters and star_injured, null or not; differential is away
    less home."""
    for s in ("home", "away"):
        f = f.na.fill(0, [f"{s}_injured_starters", f"{s}_star_injured"])
        f = f.withColumn(f"{s}_injury_impact", 2 * F.col(f"{s}_injured_starters") + 3 * F.col(f"{s}_star_injured"))
    return f.withColumn("injury_differential", F.col("away_injury_impact") - F.col("home_injury_impact"))


def injury_features(games: DataFrame, counts: DataFrame) -> DataFrame:
    """Injured starters, star flag and impact of both sides of each game (injury_columns)."""
    return injury_columns(by_side(games, counts.select("team_id", "injured_starters", "star_injured")))


def flag_stars(injuries: DataFrame, stars: list[str]) -> DataFrame:
    """is_star: the player's name contains one of the names."""
    name = F.lower("player_name")
    return injuries.withColumn("is_star", F.exists(F.array(*[F.lit(s.lower()) for s in stars]), lambda s: F.contains(name, s)))


def player_recent_stats(logs: DataFrame, n: int | None = None) -> DataFrame:
    """Mean points, rebounds, assists, field-goal share and minutes of each player over all games, or the last n."""
    if n is not None:
        order = Window.partitionBy("player_id").orderBy(F.col("game_date").desc(), F.col("game_id").desc(), F.col("line").desc(), F.col("points").desc(), F.col("minutes").desc())
        logs = logs.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= n)
    mean = {"ppg": "points", "rpg": "rebounds", "apg": "assists", "fg_pct": "fg_pct", "minutes": "minutes"}
    return logs.groupBy("player_id").agg(*[F.avg(c).alias(k) for k, c in mean.items()], F.count("*").alias("games_played"))


def team_player_stats(rosters: DataFrame, stats: DataFrame) -> DataFrame:
    """Per team: sums of its players' averages, mean field-goal share, best scorer and playmaker, players with games."""
    rows = rosters.join(stats.where("games_played > 0"), "player_id")
    return rows.groupBy("team_id").agg(
        F.sum("ppg").alias("team_ppg_players"), F.sum("rpg").alias("team_rpg_players"), F.sum("apg").alias("team_apg_players"), F.avg("fg_pct").alias("avg_fg_pct_players"),
        F.max("ppg").alias("top_scorer_ppg"), F.max("apg").alias("top_playmaker_apg"), F.count("*").alias("active_players"),
    )


def player_features(games: DataFrame, stats: DataFrame) -> DataFrame:
    """The player figures of both sides of each game (team_player_stats); teams without players have nulls."""
    return by_side(games, stats)


def top_scorers(rosters: DataFrame, stats: DataFrame, n: int = 10) -> DataFrame:
    """Each team's n best scorers."""
    order = Window.partitionBy("team_id").orderBy(F.col("ppg").desc(), "player_id")
    return rosters.join(stats, "player_id").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("team_id", "rank", "player_id", "ppg")


def ledger_totals(bets: DataFrame, start: float = 1000.0) -> DataFrame:
    """Per account since its last reset: wagered, won, balance (start - wagered + won) and potential payout."""
    reset = Window.partitionBy("account")
    last = F.max(F.when(F.col("is_reset"), F.struct("created_at", "id"))).over(reset)
    now = bets.withColumn("_r", last).where(~F.col("is_reset") & (F.col("_r").isNull() | (F.struct("created_at", "id") > F.col("_r"))))
    t = now.groupBy("account").agg(F.count("*").alias("bets"), F.sum("stake").alias("wagered"), F.sum("actual_payout").alias("won"), F.sum(F.col("stake") * F.col("odds")).alias("potential"))
    return t.withColumn("balance", start - F.col("wagered") + F.col("won"))


def running_balance(bets: DataFrame, start: float = 1000.0) -> DataFrame:
    """Balance of an account after each bet; a reset sets it to the start again."""
    order = Window.partitionBy("account").orderBy("created_at", "id")
    rows = bets.withColumn("_resets", F.count_if("is_reset").over(order)).where(~F.col("is_reset"))
    w = Window.partitionBy("account", "_resets").orderBy("created_at", "id")
    return rows.select("account", "id", (start + F.sum(F.col("actual_payout") - F.col("stake")).over(w)).alias("balance"))


def cache_stats(cache: DataFrame, as_of: str) -> DataFrame:
    """Entries and expired entries of each cache; an entry that expires exactly at as_of is still valid."""
    return cache.groupBy("cache").agg(F.count("*").alias("entries"), F.count_if(F.col("expires_at") < F.lit(as_of).cast("timestamp")).alias("expired"))


def drop_expired(cache: DataFrame, as_of: str) -> DataFrame:
    """Entries that are still valid."""
    return cache.where(F.col("expires_at") >= F.lit(as_of).cast("timestamp"))


def quota_24h(posts: DataFrame, as_of: str, limit: int = 17) -> DataFrame:
    """Per account with a post in the last 48 hours: posts of the last 24 (a post of just 24 hours ago counts), how many
    remain, hours since the oldest of them."""
    end = F.lit(as_of).cast("timestamp")
    near = posts.where((F.col("posted_at") <= end) & (F.col("posted_at") > end - F.expr("INTERVAL 48 HOURS")))
    day = F.col("posted_at") >= end - F.expr("INTERVAL 24 HOURS")
    t = near.groupBy("account").agg(F.count_if(day).alias("posts_24h"), F.min(F.when(day, F.col("posted_at"))).alias("oldest"))
    age = (F.unix_timestamp(end) - F.unix_timestamp("oldest")) / 3600
    return t.select("account", "posts_24h", F.greatest(F.lit(0), limit - F.col("posts_24h")).alias("remaining"), age.alias("oldest_hours"))
