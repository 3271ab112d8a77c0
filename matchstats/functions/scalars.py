"""Column functions: distances, odds, labels.  Rounding is half up, as Spark's round is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance on a sphere of 6371 km."""
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon), 2)
    return 2 * 6371 * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def fatigue(km: Column, zones: Column) -> Column:
    """Travel fatigue from 0 to 1: distance up to 4000 km counts 0.6, time zones 0.4."""
    return 0.6 * F.least(km / 4000, F.lit(1.0)) + 0.4 * zones / 3


def fair_odds(p: Column) -> Column:
    """Decimal odds without margin; 99 outside (0, 1)."""
    return F.when((p <= 0) | (p >= 1), 99.0).otherwise(F.round(1 / p, 2))


def betting_odds(p: Column, margin: float = 0.05) -> Column:
    """(decimal, fractional, american, implied_probability) with a bookmaker's margin, the probability capped at 0.95."""
    out = (p <= 0) | (p >= 1)
    implied = F.least(p * (1 + margin), F.lit(0.95))
    gain = 1 / implied - 1
    whole = lambda c: F.round(c).cast("int").cast("string")
    fractional = F.when(gain < 1, F.concat(F.lit("1/"), whole(1 / gain))).otherwise(F.concat(whole(gain * 2), F.lit("/2")))
    american = F.when(1 / implied >= 2, F.concat(F.lit("+"), whole(gain * 100))).otherwise(whole(-100 / gain))
    return F.struct(
        F.when(out, 99.0).otherwise(F.round(1 / implied, 2)).alias("decimal"), F.when(out, "98/1").otherwise(fractional).alias("fractional"),
        F.when(out, "+9900").otherwise(american).alias("american"), F.when(~out, F.round(implied * 100, 1)).alias("implied_probability"),
    )


def value_bet(p: Column, odds: Column) -> Column:
    """(market_probability, value_diff, has_value, recommendation): value from an edge of over 0.05 on."""
    edge = p - 1 / odds
    return F.struct(
        F.round(100 / odds, 1).alias("market_probability"), F.round(edge * 100, 1).alias("value_diff"), (edge > 0.05).alias("has_value"),
        F.when(edge > 0.05, "BET").otherwise("PASS").alias("recommendation"),
    )


def parse_line(home: Column, away: Column) -> Column:
    """(market_spread, market_total, market_implied_prob) from the best prices, the margin removed; total is always 220."""
    h, a = F.when(home > 0, 1 / home).otherwise(0.5), F.when(away > 0, 1 / away).otherwise(0.5)
    return F.struct(F.round(2 * (home - away), 1).alias("market_spread"), F.lit(220.0).alias("market_total"), F.round(h / (h + a), 3).alias("market_implied_prob"))


def price_increment(odds: Column) -> Column:
    """Odds rounded to the steps bookmakers use."""
    step = lambda s: F.round(odds / s) * s
    return F.when(odds < 1.5, F.round(odds, 2)).when(odds < 2, step(0.02)).when(odds < 3, step(0.05)).when(odds < 5, step(0.1)).otherwise(step(0.25))


def to_american(odds: Column) -> Column:
    """American odds, cut to whole numbers."""
    return F.when(odds >= 2, F.concat(F.lit("+"), ((odds - 1) * 100).cast("int").cast("string"))).otherwise((-100 / (odds - 1)).cast("int").cast("string"))


#: Parts of feature names and how they are shown.
LABELS = {
    "ppg": "PPG", "rpg": "RPG", "apg": "APG", "fg": "FG", "pct": "%", "elo": "Elo", "last10": "L10", "last5": "L5", "win": "Win", "home": "Home",
    "away": "Away", "opp": "Opp", "diff": "Diff", "h2h": "H2H", "reb": "Reb", "ast": "Ast", "tov": "TOV",
}


def feature_label(name: Column) -> Column:
    """home_last10_ppg becomes Home L10 PPG."""
    known = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    return F.array_join(F.transform(F.split(name, "_"), lambda p: F.coalesce(F.try_element_at(known, F.lower(p)), F.concat(F.upper(F.left(p, F.lit(1))), F.lower(F.substring(p, 2, 100))))), " ")


def haversine_sql(a: str, b: str) -> str:
    """The distance between tables a and b (lat, lon) in plain SQL."""
    s = f"pow(sin(radians({b}.lat - {a}.lat)/2), 2) + cos(radians({a}.lat))*cos(radians({b}.lat))*pow(sin(radians({b}.lon - {a}.lon)/2), 2)"
    return f"2*6371*asin(sqrt(least({s}, 1)))"
