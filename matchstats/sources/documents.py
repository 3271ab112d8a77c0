"""Nested documents to flat tables: schedules, odds, HTML tables."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def flatten_schedule(df: DataFrame) -> DataFrame:
    """One row a game of a schedule document, in either layout; scores that are no numbers are null."""
    parts = []
    if "leagueSchedule" in df.columns:
        d = df.select(F.explode("leagueSchedule.gameDates").alias("d")).select("d.gameDate", F.explode("d.games").alias("g"))
        when = F.coalesce(F.try_to_timestamp("gameDate", F.lit("MM/dd/yyyy HH:mm:ss")), F.try_to_timestamp("gameDate", F.lit("MM/dd/yyyy"))).cast("date")
        score = lambda s: F.expr(f"try_cast(g.{s}Team.score AS INT)")
        parts.append(d.select(
            F.col("g.gameId").cast("string").alias("game_id"), when.alias("game_date"), F.expr("try_cast(g.gameStatus AS INT)").alias("status"), F.col("g.homeTeam.teamTricode").alias("home_code"),
            F.col("g.awayTeam.teamTricode").alias("away_code"), score("home").alias("home_score"), score("away").alias("away_score"),
        ))
    if "league" in df.columns:
        g = df.select(F.explode("league.standard").alias("g"))
        none = F.lit(None).cast("int")
        parts.append(g.select(
            F.col("g.gameId").cast("string").alias("game_id"), F.try_to_timestamp("g.startDateEastern", F.lit("yyyyMMdd")).cast("date").alias("game_date"), F.expr("try_cast(g.statusNum AS INT)").alias("status"),
            F.col("g.hTeam.triCode").alias("home_code"), F.col("g.vTeam.triCode").alias("away_code"), none.alias("home_score"), none.alias("away_score"),
        ))
    if not parts:
        raise ValueError("neither leagueSchedule nor league is a column")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def final_results(schedule: DataFrame, teams: DataFrame) -> DataFrame:
    """Finished games (both scores, not 0-0, status null or 3) with team names, or codes where the dictionary has none."""
    rows = schedule.where("home_score is not null and away_score is not null and not (home_score = 0 and away_score = 0) and (status is null or status = 3)")
    for s in ("home", "away"):
        rows = rows.join(teams.select(F.col("abbreviation").alias(f"{s}_code"), F.col("full_name").alias(f"_{s}")), f"{s}_code", "left")
    return rows.select("game_id", "game_date", F.coalesce("_home", "home_code").alias("home_team"), F.coalesce("_away", "away_code").alias("away_team"), "home_score", "away_score")


def flatten_quotes(df: DataFrame) -> DataFrame:
    """(home_team, away_team, commence_time, bookmaker, home, away) of every bookmaker's h2h market with both prices."""
    b = df.select("home_team", "away_team", "commence_time", F.explode("bookmakers").alias("b"))
    m = b.select("home_team", "away_team", "commence_time", F.lower("b.key").alias("bookmaker"), F.explode("b.markets").alias("m")).where("m.key = 'h2h'")
    price = lambda team: F.try_element_at(F.filter("m.outcomes", lambda x: x["name"] == F.col(team)), F.lit(1))["price"].cast("double")
    return m.select("home_team", "away_team", "commence_time", "bookmaker", price("home_team").alias("home"), price("away_team").alias("away")).where("home is not null and away is not null")


class _Rows(HTMLParser):
    """The cell texts of each table row of a page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[list[str]] = []
        self._cell: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self._end_cell()
            self.rows.append([])
        elif tag in ("td", "th"):
            self._end_cell()
            self._cell = []

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr", "table"):
            self._end_cell()

    def handle_data(self, data):
        if self._cell is not None:
            self._cell.append(data)

    def _end_cell(self):
        if self._cell is not None and self.rows:
            self.rows[-1].append(" ".join("".join(self._cell).split()))
        self._cell = None


def table_rows(html: str | None, min_cells: int) -> list[list[str]]:
    parser = _Rows()
    parser.feed(html or "")
    parser.close()
    parser._end_cell()
    return [r for r in parser.rows if len(r) >= min_cells]


def html_table_rows(pages: DataFrame, min_cells: int = 3) -> DataFrame:
    """(page_id, row_no, cells) for the rows of all tables of a page that have at least min_cells cells."""

    def run(frames):
        for pdf in frames:
            rows = [(p, i, r) for p, h in zip(pdf["page_id"], pdf["html"]) for i, r in enumerate(table_rows(h, min_cells))]
            yield pd.DataFrame(rows, columns=["page_id", "row_no", "cells"])

    return pages.select("page_id", "html").mapInPandas(run, f"page_id {dict(pages.dtypes)['page_id']}, row_no int, cells array<string>")


def injury_rows(rows: DataFrame) -> DataFrame:
    """player, team, injury and status from rows of four cells or more."""
    cell = lambda i: F.try_element_at("cells", F.lit(i))
    return rows.where(F.size("cells") >= 4).select("page_id", cell(1).alias("player_name"), cell(2).alias("team"), cell(3).alias("injury_type"), cell(4).alias("status"))


def odds_rows(rows: DataFrame) -> DataFrame:
    """bookmaker, home and away from rows of three cells or more whose prices are numbers."""
    cell = lambda i: F.try_element_at("cells", F.lit(i))
    number = lambda i: F.expr(f"try_cast(try_element_at(cells, {i}) AS DOUBLE)")
    return rows.where(F.size("cells") >= 3).select("page_id", cell(1).alias("bookmaker"), number(2).alias("home"), number(3).alias("away")).where("home is not null and away is not null")
