"""Hand-made cases, properties, documents and streams."""

import datetime as dt
import glob
import json
import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from matchstats.functions import names, scalars
from matchstats.operators import context, elo, features, matches, metrics, model, picks, settle, upserts, windows
from matchstats.plans import streams
from matchstats.sources import documents, tables
from matchstats.streaming import feeds

DAY = dt.date(2024, 1, 1)
BOX = ", ".join(f"{s}_{b} double" for s in ("home", "away") for b in matches.BOX)
SCHEMA = f"game_id long, game_date date, pool_id long, home_team_id long, away_team_id long, home_score long, away_score long, {BOX}"


def make_games(spark, rows):
    """rows: (id, day, home, away, home score, away score, has box)."""
    full = []
    for i, d, h, a, hs, as_, box in rows:
        own = [40.0, 88.0, 0.45, 12.0, 35.0, 0.34, 18.0, 22.0, 0.8, 9.0, 33.0, 42.0, 24.0, 13.0]
        full.append((i, DAY + dt.timedelta(d), 0, h, a, hs, as_, *(own * 2 if box else [None] * 28)))
    return spark.createDataFrame(full, SCHEMA)


def random_games(spark, n=60, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        h, a = r.sample(range(6), 2)
        rows.append((i, r.randrange(20), h, a, r.randrange(80, 130), r.randrange(80, 130), r.random() < 0.8))
    return make_games(spark, rows)


LOG = "GAME_ID string, GAME_DATE date, TEAM_ID long, MATCHUP string, PTS long, WL string, PLUS_MINUS long"


def test_pairing_defects(spark):
    logs = spark.createDataFrame([
        ("one", DAY, 1, "A vs. B", 100, "W", 5), ("ok", DAY, 1, "A vs. B", 100, "W", 5), ("ok", DAY, 2, "B @ A", 95, "L", -5),
        ("three", DAY, 1, "A vs. B", 1, "W", 1), ("three", DAY, 2, "B @ A", 1, "L", 1), ("three", DAY, 3, "B @ A", 1, "L", 1),
        ("two away", DAY, 1, "A @ B", 1, "W", 1), ("two away", DAY, 2, "B @ A", 1, "L", 1), ("null", DAY, 1, "A vs. B", None, "L", 0), ("null", DAY, 2, "B @ A", 90, "W", 0),
    ], LOG)
    got = {r["game_id"]: r for r in matches.pair_games(logs).collect()}
    assert set(got) == {"ok", "null"} and got["ok"]["home_win"] == 1 and got["null"]["home_score"] == 0
    assert {r["game_id"] for r in matches.pair_games(logs, strict=False).collect()} == {"ok", "three"}


def test_same_day_games_do_not_see_each_other(spark):
    g = make_games(spark, [(1, 0, 1, 2, 100, 90, True), (2, 1, 1, 2, 80, 90, True), (3, 1, 2, 1, 70, 90, True), (4, 2, 1, 2, 1, 2, True)])
    t = matches.team_rows(g)
    form = {(r["team_id"], r["game_date"]): r for r in windows.recent_form(t, (10,)).collect()}
    assert form[1, DAY]["last10_win_pct"] == 0.5  # no history
    assert form[1, DAY + dt.timedelta(1)]["last10_win_pct"] == 1.0
    assert form[1, DAY + dt.timedelta(2)]["last10_win_pct"] == pytest.approx(2 / 3)


def test_box_score_window_skips_games_without(spark):
    g = make_games(spark, [(1, 0, 1, 2, 100, 90, True), (2, 1, 1, 2, 80, 90, False), (3, 2, 1, 2, 0, 0, True)])
    form = {(r["team_id"], r["game_date"]): r for r in windows.recent_form(matches.team_rows(g), (3,)).collect()}
    assert form[1, DAY + dt.timedelta(2)]["last3_ppg"] == 100


def test_features_do_not_change_when_later_games_come(spark):
    g = random_games(spark)
    part = g.where("game_date < date '2024-01-12'")
    key = lambda df: {r["game_id"]: r for r in df.where("game_date < date '2024-01-12'").collect()}
    assert key(features.form_table(g, elo.elo_history(g))) == key(features.form_table(part, elo.elo_history(part)))


def test_elo_sums_twin_and_order(spark):
    g = random_games(spark, 80)
    rows = elo.elo_history(g.repartition(5)).collect()
    ratings = {}
    for r in sorted(g.collect(), key=lambda r: (r["game_date"], r["game_id"])):
        h, a = ratings.get(r["home_team_id"], 1500.0), ratings.get(r["away_team_id"], 1500.0)
        d = elo.delta(h, a, r["home_score"] - r["away_score"])
        ratings[r["home_team_id"]], ratings[r["away_team_id"]] = h + d, a - d
    current = {r["team_id"]: r["elo"] for r in elo.current_elo(spark.createDataFrame(rows, elo.HISTORY)).collect()}
    assert current == pytest.approx(ratings) and sum(current.values()) == pytest.approx(1500 * len(current))
    assert elo.delta(1500, 1500, 1) == pytest.approx(20 * (1 - 1 / (1 + 10 ** -0.25)))  # multiplier cut to 1
    assert elo.update_elo(elo.current_elo(spark.createDataFrame(rows, elo.HISTORY)), g, spark.createDataFrame(rows, elo.HISTORY)).count() == 0


def test_feature_names_and_table(spark):
    assert len(features.FEATURES) == len(set(features.FEATURES)) == 203
    g = random_games(spark, 40)
    f = features.build_features(g, elo.elo_history(g))
    assert f.columns == ["game_id", "game_date", "pool_id", "home_win", *features.FEATURES]
    assert f.count() == 40 and f.where(" or ".join(f"`{c}` is null" for c in features.FEATURES)).count() == 0


def test_folds_are_disjoint_with_gap(spark):
    g = random_games(spark, 60)
    order = {r["game_id"]: i for i, r in enumerate(sorted(g.collect(), key=lambda r: (r["game_date"], r["game_id"])))}
    rows = features.time_folds(g, 5, 3).collect()
    for k in range(5):
        train, test = ([order[r["game_id"]] for r in rows if r["fold"] == k and r["part"] == p] for p in ("train", "test"))
        assert len(test) == 10 and min(test) - max(train) == 4


def test_upserts_are_idempotent(spark):
    g = random_games(spark, 20)
    u = spark.createDataFrame([(3, DAY, 0, 9, 8, 101, 99), (500, DAY, 0, 1, 2, None, 5), (501, DAY, 0, 1, 2, 7, 5)], "game_id long, game_date date, pool_id long, home_team_id long, away_team_id long, home_score long, away_score long")
    once = upserts.upsert_games(g, u)
    twice = upserts.upsert_games(once.drop("home_win"), u)
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect())) and once.count() == 21
    row = once.where("game_id = 3").first()
    assert row["home_score"] == 101 and row["home_win"] == 1


PRED = "game_id long, game_date date, home_id long, away_id long, predicted_home_prob double, predicted_away_prob double, confidence double, home_odds double, away_odds double, actual_winner string"


def test_settlement_edges(spark):
    p = spark.createDataFrame([
        (1, DAY, 1, 2, 0.6, 0.4, 0.9, None, None, None), (2, DAY, 3, 4, 0.5, 0.5, 1.0, None, None, None), (3, DAY, 6, 5, 0.7, 0.3, 0.6, None, None, None), (4, DAY, 7, 8, 0.7, 0.3, 0.6, None, None, None),
    ], PRED)
    g = make_games(spark, [(11, 0, 1, 2, 90, 100, True), (12, 0, 3, 4, 100, 100, True), (13, 0, 5, 6, 80, 70, True), (14, 0, 7, 8, 0, 0, True)])
    got = {r["game_id"]: r for r in settle.settle_predictions(p, g, "2024-01-05").collect()}
    assert got[1]["correct"] == 0 and got[2]["correct"] == 1 and got[2]["actual_winner"] == "away" and got[3]["actual_winner"] is None and got[4]["actual_winner"] is None
    swapped = {r["game_id"]: r for r in settle.backfill_scores(p, g).collect()}
    assert (swapped[3]["actual_home_score"], swapped[3]["actual_away_score"]) == (70, 80)
    assert {r["game_id"]: r["reason"] for r in settle.unsettled_report(p, g).collect()} == {3: "no match", 4: "no match"}
    settled = settle.settle_predictions(p, g, "2024-01-05")
    assert metrics.calibration_table(settled, 1).count() == 1  # confidence 1 is in no bin
    assert metrics.evaluate_performance(settled.where("false"), "2024-01-05", 30).first()["accuracy"] == 0


def test_warnings_example(spark):
    row = spark.createDataFrame([(1, 0.8, 0.75, 0.22, 1480.0, 1580.0, 0.7, 0.4)], "game_id long, home_prob double, confidence double, market_home_prob double, home_elo double, away_elo double, home_form double, away_form double")
    assert [(r["level"], r["message"]) for r in picks.prediction_warnings(row).orderBy("pos").collect()] == [
        ("CRITICAL", "Model disagrees with market by 58%"), ("WARNING", "High confidence (75%) on market underdog"), ("INFO", "Recent form contradicts season strength"),
    ]


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    lit = F.lit
    assert one(scalars.haversine_km(lit(0.0), lit(0.0), lit(0.0), lit(180.0))) == pytest.approx(6371 * 3.141592653589793)
    assert one(scalars.fair_odds(lit(0.0))) == 99 and one(scalars.to_american(lit(1.5))) == "-200"
    assert one(names.nickname(lit("Los Angeles Lakers"))) == "lakers" and one(names.keyword_code(lit("Golden State Warriors"))) == "gsw"
    assert one(scalars.feature_label(lit("home_last10_fg_pct"))) == "Home L10 FG %"


def test_names_and_injuries(spark):
    teams = spark.createDataFrame([(1, "Los Angeles Lakers", "LAL"), (2, "LA Clippers", "LAC")], "team_id long, full_name string, abbreviation string")
    df = spark.createDataFrame([("la lakers",), ("Los Angeles Clippers ",), ("lal",), ("x",), (None,)], "name string")
    assert [r["team_id"] for r in names.normalize_team(df.withColumn("i", F.monotonically_increasing_id()), "name", teams).orderBy("i").collect()] == [1, 2, 1, None, None]
    inj = spark.createDataFrame([(1, "Star A", "Out", dt.datetime(2024, 1, 1, 11)), (1, "Star A", "Questionable", dt.datetime(2024, 1, 1, 12)), (1, "B", "out", dt.datetime(2024, 1, 1, 5))], "team_id long, player_name string, status string, fetched_at timestamp")
    assert [(r["player_name"], r["status"]) for r in context.injuries_in_force(inj, "2024-01-01 12:00:00").collect()] == [("Star A", "Questionable")]


def test_documents(spark, tmp_path):
    doc = {"leagueSchedule": {"gameDates": [{"gameDate": "01/02/2024 00:00:00", "games": [{"gameId": "7", "gameStatus": 3, "homeTeam": {"teamTricode": "AAA", "score": 101}, "awayTeam": {"teamTricode": "BBB", "score": 99}}, {"gameId": "8", "gameStatus": 3, "homeTeam": {"teamTricode": "AAA", "score": 0}, "awayTeam": {"teamTricode": "BBB", "score": 0}}]}]}}
    (tmp_path / "s.json").write_text(json.dumps(doc))
    s = documents.flatten_schedule(spark.read.json(str(tmp_path / "s.json")))
    teams = spark.createDataFrame([("Alpha", "AAA")], "full_name string, abbreviation string")
    assert [tuple(r) for r in documents.final_results(s, teams).collect()] == [("7", dt.date(2024, 1, 2), "Alpha", "BBB", 101, 99)]
    old = {"league": {"standard": [{"gameId": "9", "startDateEastern": "20240103", "statusNum": 1, "hTeam": {"triCode": "A"}, "vTeam": {"triCode": "B"}}]}}
    (tmp_path / "o.json").write_text(json.dumps(old))
    assert documents.flatten_schedule(spark.read.json(str(tmp_path / "o.json"))).first()["game_date"] == dt.date(2024, 1, 3)
    odds = {"home_team": "H", "away_team": "A", "commence_time": "t", "bookmakers": [{"key": "BOOK", "markets": [{"key": "h2h", "outcomes": [{"name": "A", "price": 2.5}, {"name": "H", "price": 1.5}]}, {"key": "totals", "outcomes": []}]}, {"key": "half", "markets": [{"key": "h2h", "outcomes": [{"name": "A", "price": 2.5}]}]}]}
    (tmp_path / "q.json").write_text(json.dumps(odds))
    assert [(r["bookmaker"], r["home"], r["away"]) for r in documents.flatten_quotes(spark.read.json(str(tmp_path / "q.json"))).collect()] == [("book", 1.5, 2.5)]
    pages = spark.createDataFrame([(1, "<table><tr><td> P </td><td>T</td><td>knee<td>Out</tr><tr><td>a</td></tr></table>"), (2, None)], "page_id long, html string")
    assert [tuple(r)[1:] for r in documents.injury_rows(documents.html_table_rows(pages)).collect()] == [("P", "T", "knee", "Out")]


def test_tables(spark, tmp_path):
    with pytest.raises(ValueError):
        tables.read_team_logs(spark, {})
    a = spark.createDataFrame([(1, 2)], "GAME_ID long, PTS long")
    a.write.parquet(str(tmp_path / "a"))
    a.drop("PTS").write.parquet(str(tmp_path / "b"))
    assert sorted((r["SEASON"], r["PTS"]) for r in tables.read_team_logs(spark, {"x": str(tmp_path / "a"), "y": str(tmp_path / "b")}).fillna(0).collect()) == [("x", 2), ("y", 0)]
    for run in ("a", "b", "b"):
        tables.append_log(spark.createDataFrame([("m", 0.5)], "matchup string, confidence double"), str(tmp_path / "log"), run)
    assert tables.read_log(spark, str(tmp_path / "log")).count() == 2
    df = spark.createDataFrame([('{"a":1.5,"b":2}',), ("{broken",), (None,), ('{"b":3}',)], "t string")
    both = df.select(tables.feature_from_json("t", "a").alias("x"), F.try_element_at(tables.features_from_json("t"), F.lit("a")).alias("y")).collect()
    assert [r["x"] for r in both] == [1.5, None, None, None] == [r["y"] for r in both]


def _run(df, mode="append"):
    q = df.writeStream.format("memory").queryName(f"q{random.randrange(10**9)}").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return q.sparkSession.table(q.name) if hasattr(q, "sparkSession") else df.sparkSession.table(q.name)


def test_stream_elo_equals_batch(spark, tmp_path):
    g = random_games(spark, 50).select("game_id", "game_date", "pool_id", "home_team_id", "away_team_id", "home_score", "away_score")
    rows = sorted(g.collect(), key=lambda r: (r["game_date"], r["game_id"]))
    for k, part in enumerate((rows[:25], rows[20:25] + rows[25:])):  # the second file replays five games
        spark.createDataFrame(part, g.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(g.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {(r["game_id"], r["team_id"]): r["elo_after"] for r in _run(feeds.stream_elo(stream)).collect()}
    assert got == pytest.approx({(r["game_id"], r["team_id"]): r["elo_after"] for r in elo.elo_history(g).collect()})


def test_stream_cache_quota_settle(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    puts = spark.createDataFrame([("c", 1, t), ("c", 1, t + dt.timedelta(hours=1)), ("c", 2, t)], "cache string, key long, cached_at timestamp")
    puts.write.parquet(str(tmp_path / "c"))
    assert _run(feeds.stream_ttl_cache(spark.readStream.schema(puts.schema).parquet(str(tmp_path / "c")))).count() == 2
    posts = spark.createDataFrame([(1, t + dt.timedelta(hours=h)) for h in range(20)] + [(2, t + dt.timedelta(days=9))], "account long, posted_at timestamp")
    posts.coalesce(1).write.parquet(str(tmp_path / "p"))
    top = _run(feeds.quota_stream(spark.readStream.schema(posts.schema).parquet(str(tmp_path / "p")))).groupBy("account").agg(F.max("posts_24h").alias("n"), F.min("remaining").alias("r")).collect()
    assert [tuple(r) for r in top if r["account"] == 1] == [(1, 20, 0)]
    p = spark.createDataFrame([(1, t), (2, t)], "game_id long, predicted_at timestamp")
    r = spark.createDataFrame([(1, t + dt.timedelta(days=2), 5)], "result_id long, result_ts timestamp, home_score long")
    p.write.parquet(str(tmp_path / "sp")), r.write.parquet(str(tmp_path / "sr"))
    joined = feeds.stream_settle(spark.readStream.schema(p.schema).parquet(str(tmp_path / "sp")), spark.readStream.schema(r.schema).parquet(str(tmp_path / "sr")))
    assert [x["game_id"] for x in _run(joined).collect() if x["home_score"] == 5] == [1]


def test_model(spark, tmp_path):
    r = random.Random(3)
    rows = [(i, DAY + dt.timedelta(i // 4), 0, int(r.random() < (0.85 if (x := r.uniform(-1, 1)) > 0 else 0.15)), x, r.random()) for i in range(240)]
    df = spark.createDataFrame(rows, "game_id long, game_date date, pool_id long, home_win int, a double, b double")
    m = model.train_stack(features.training_set(df), ["a", "b"], n_splits=2, learners=model.base_learners(rounds=2, trees=3))
    assert m.fold_accuracy > 0.7 and 0.1 <= m.temperature <= 10.0001
    assert model.top_factors(m)[0][0] == "a"
    s = model.score(m, df)
    m.save(str(tmp_path / "model"))
    again = model.Stack.load(str(tmp_path / "model"))
    assert [tuple(x) for x in model.score(again, df).orderBy("game_id").collect()] == [tuple(x) for x in s.orderBy("game_id").collect()]
    assert s.count() == 240 and s.where("home_probability between 0 and 1 and confidence <= 0.85").count() == 240
    assert model.fit_isotonic(df.select("home_win", ((F.col("a") + 1) / 2).alias("p"))).boundaries.size > 1


def test_training_weights(spark):
    f = random_games(spark, 50).withColumn("home_win", F.lit(1))
    t = features.training_set(f, burn_in=5)
    assert t.count() == 45 and t.agg(F.avg("sample_weight")).first()[0] == pytest.approx(1)



def test_logs_to_features(spark):
    """Team logs with a box score are paired, rated and turned into features without another table."""
    g = random_games(spark, 40)
    team = lambda s, o, sign: g.select(
        F.col("game_id").cast("string").alias("GAME_ID"), F.col("game_date").alias("GAME_DATE"), F.lit("2023-24").alias("SEASON"), F.col(f"{s}_team_id").alias("TEAM_ID"), F.concat(F.lit("T"), f"{s}_team_id").alias("TEAM_ABBREVIATION"),
        F.concat(F.lit("T"), f"{s}_team_id", F.lit(sign), F.col(f"{o}_team_id")).alias("MATCHUP"), F.col(f"{s}_score").alias("PTS"), *[F.col(f"{s}_{b}").alias(b.upper()) for b in matches.BOX], F.lit(5).alias("STL"), F.lit(3).alias("BLK"))
    paired = matches.pair_games(team("home", "away", " vs. ").unionByName(team("away", "home", " @ ")))
    assert {"season", "pool_id", "home_team", "away_stl", "home_blk"} <= set(paired.columns) and paired.count() == 40
    paired = paired.withColumn("game_id", F.col("game_id").cast("long"))
    want = {r["game_id"]: r for r in features.build_features(g, elo.elo_history(g)).collect()}
    got = {r["game_id"]: r for r in features.build_features(paired, elo.elo_history(paired)).collect()}
    assert got == want


def test_features_equal_their_blocks(spark):
    """The one-pass table has the values of the single operators, for played and scheduled games."""
    g = random_games(spark, 70, seed=4)
    g = g.withColumns({"home_score": F.when(F.col("game_id") % 9 != 0, F.col("home_score")), "away_score": F.when(F.col("game_id") % 9 != 0, F.col("away_score"))})
    h, t = elo.elo_history(g), matches.team_rows(g)
    wide = {r["game_id"]: r for r in features.form_table(g, h).collect()}
    blocks = [windows.recent_form(t), windows.rest_days(t), windows.streak(t), windows.road_trip(t), windows.games_last_days(t), windows.strength_of_schedule(t, h)]
    for rows in ({(r["team_id"], r["game_date"]): r.asDict() for r in b.collect()} for b in blocks):
        for r in wide.values():
            for s in ("home", "away"):
                own = rows[r[f"{s}_team_id"], r["game_date"]]
                assert all(r[f"{s}_{c}"] == pytest.approx(v) for c, v in own.items() if c not in ("team_id", "game_date"))
    split = {(r["team_id"], r["is_home"], r["game_date"]): r for r in windows.venue_split(t).collect()}
    ratings = {r["game_id"]: r for r in elo.elo_features(g, h).collect()}
    for r in wide.values():
        assert r["home_elo"] == pytest.approx(ratings[r["game_id"]]["home_elo"]) and r["away_elo"] == pytest.approx(ratings[r["game_id"]]["away_elo"])
        for place, s, home in (("home_team_home", "home", 1), ("away_team_road", "away", 0)):
            assert all(r[f"{place}_{c}"] == pytest.approx(split[r[f"{s}_team_id"], home, r["game_date"]][f"split_{c}"]) for c in windows.SPLIT)


def test_feature_plan_has_few_shuffles(spark):
    g = random_games(spark, 30)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = features.form_table(g, elo.elo_history(g))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange ") <= 12 and plan.count("MapInArrow") == 1


def test_elo_features_from_current_ratings(spark):
    g = random_games(spark, 30)
    h = elo.elo_history(g)
    now = {r["team_id"]: r["elo"] for r in elo.current_elo(h).collect()}
    for r in elo.elo_features(g, h, "snapshot").join(g, "game_id").collect():
        assert (r["home_elo"], r["away_elo"]) == pytest.approx((now[r["home_team_id"]], now[r["away_team_id"]]))


def test_names_are_resolved(spark):
    teams = spark.createDataFrame([(1, "Boston Celtics", "BOS"), (2, "Los Angeles Lakers", "LAL"), (3, "LA Clippers", "LAC")], "team_id long, full_name string, abbreviation string")
    df = spark.createDataFrame([("boston celtics ",), ("celtics",), ("the Boston Celtics!",), ("lac",), ("LA Lakers",), ("nobody",), ("",), (None,)], "name string").withColumn("i", F.monotonically_increasing_id())
    got = [(r["full_name"], r["abbreviation"]) for r in names.resolve_names(df, "name", teams).orderBy("i").collect()]
    assert got == [("Boston Celtics", "BOS")] * 3 + [("LA Clippers", "LAC"), ("Los Angeles Lakers", "LAL"), ("nobody", "nobody"), ("", ""), (None, None)]


def test_swapped_names_match(spark):
    left = spark.createDataFrame([(1, DAY, "celtics", "lakers"), (2, DAY, "lakers", "celtics"), (3, DAY, "celtics", "bulls"), (4, None, "celtics", "lakers")], "k long, game_date date, home string, away string")
    right = spark.createDataFrame([(7, DAY, "Boston Celtics", "Los Angeles Lakers")], "id long, game_date date, home string, away string")
    assert {r["k"]: r["right_id"] for r in names.fuzzy_match(left, right, "k", swapped=True).collect()} == {1: 7, 2: 7, 3: None, 4: None}
    assert {r["k"]: r["right_id"] for r in names.fuzzy_match(left, right, "k").collect()} == {1: 7, 2: None, 3: None, 4: None}


def test_published_again_and_late_updates(spark):
    old = spark.createDataFrame([(1, DAY, 1, 2, 0.6, 0.4, 0.9, 1.5, 2.5, "home", 101, 99, 1)], PRED + ", actual_home_score long, actual_away_score long, correct int")
    new = old.withColumns({"predicted_home_prob": F.lit(0.3), "actual_winner": F.lit(None).cast("string"), "actual_home_score": F.lit(None).cast("long"), "actual_away_score": F.lit(None).cast("long"), "correct": F.lit(None).cast("int")})
    r = upserts.upsert_predictions(old, new).first()
    assert (r["predicted_home_prob"], r["actual_winner"], r["actual_home_score"], r["actual_away_score"], r["correct"]) == (0.3, "home", 101, 99, 1)
    g = make_games(spark, [(1, 0, 1, 2, None, None, True)])
    u = spark.createDataFrame([(1, 120, 99, dt.datetime(2024, 1, 1)), (1, 101, 99, dt.datetime(2024, 1, 2))], "game_id long, home_score long, away_score long, updated_at timestamp")
    assert upserts.upsert_games(g, u).first()["home_score"] == 101


def test_quota_counts_a_post_of_just_a_day_ago(spark):
    end = dt.datetime(2024, 1, 3)
    posts = spark.createDataFrame([(1, end - dt.timedelta(hours=24)), (1, end - dt.timedelta(hours=24, seconds=1)), (1, end - dt.timedelta(hours=1))], "account long, posted_at timestamp")
    r = context.quota_24h(posts, str(end)).first()
    assert (r["posts_24h"], r["remaining"], r["oldest_hours"]) == (2, 15, 24)


def test_shown_values(spark):
    f = spark.createDataFrame([(1, 1523.6, 0.5123, 7.25, 1, None)], "game_id long, home_elo double, home_last10_win_pct double, home_streak double, home_back_to_back int, away_elo double")
    got = {r["label"]: (r["home_shown"], r["away_shown"]) for r in features.feature_table(f).collect()}
    assert len(features.COMPARED) == features.feature_table(f).count() == 32
    assert got["Elo Rating (Team Strength)"] == ("1524", "N/A") and got["Current Win/Loss Streak"][0] == "7.2" and got["Playing Back-to-Back?"][0] == "Yes" and got["Days of Rest"] == ("N/A", "N/A")


def test_stream_cache_replaces_reads_and_expires(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    at = lambda h: t + dt.timedelta(hours=h)
    batches = [
        [("c", 1, at(0), "old"), ("c", 1, at(1), "new"), ("c", 1, at(2), None), ("c", 2, at(2), None)], [("c", 1, at(0.5), "older"), ("c", 1, at(24.9), None), ("c", 1, at(25), None)],
        [("c", 1, at(26), "again"), ("c", 1, at(27), None)],
    ]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "cache string, key long, at timestamp, payload string").coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    schema = "cache string, key long, at timestamp, payload string"
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    got = sorted(((r["key"], r["at"]), r["payload"]) for r in _run(feeds.stream_cache_reads(stream(), 24, "48 hours")).collect())
    assert got == [((1, at(2)), "new"), ((1, at(24.9)), "new"), ((1, at(25)), None), ((1, at(27)), "again"), ((2, at(2)), None)]
    puts = stream().where("payload is not null").withColumnRenamed("at", "cached_at")
    kept = [(r["payload"], r["cached_at"], r["expires_at"]) for r in _run(feeds.stream_ttl_cache(puts, 24, "48 hours")).collect()]
    assert ("new", at(1), at(25)) in kept and ("again", at(26), at(50)) in kept and not any(p == "older" for p, _, _ in kept)


def test_stream_elo_accounts_for_late_games(spark, tmp_path):
    g = random_games(spark, 30).select("game_id", "game_date", "pool_id", "home_team_id", "away_team_id", "home_score", "away_score")
    rows = sorted(g.collect(), key=lambda r: (r["game_date"], r["game_id"]))
    late = rows.pop(3)
    for i, part in enumerate((rows[:20], rows[20:] + [late, rows[0]])):
        spark.createDataFrame(part, g.schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(g.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    got = _run(feeds.stream_elo(stream)).collect()
    assert [r["game_id"] for r in got if r["elo_after"] is None] == [late["game_id"]] * 2 and len(got) == 60
    want = {(r["game_id"], r["team_id"]): r["elo_after"] for r in elo.elo_history(g.where(f"game_id <> {late['game_id']}")).collect()}
    assert {(r["game_id"], r["team_id"]): r["elo_after"] for r in got if r["elo_after"] is not None} == pytest.approx(want)


def test_stream_elo_continues_after_a_restart(spark, tmp_path):
    """Three micro-batches, each in a query of its own over the same checkpoint."""
    g = random_games(spark, 45).select("game_id", "game_date", "pool_id", "home_team_id", "away_team_id", "home_score", "away_score")
    rows = sorted(g.collect(), key=lambda r: (r["game_date"], r["game_id"]))
    for i, part in enumerate((rows[:15], rows[10:30], rows[30:] + rows[:2])):
        spark.createDataFrame(part, g.schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
        stream = spark.readStream.schema(g.schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        q = feeds.stream_elo(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(got) == 90
    assert {(r["game_id"], r["team_id"]): r["elo_after"] for r in got} == pytest.approx({(r["game_id"], r["team_id"]): r["elo_after"] for r in elo.elo_history(g).collect()})


def test_stream_upserts_rewrite_touched_partitions(spark, tmp_path):
    g = random_games(spark, 12).withColumn("season", F.col("game_id") % 3)
    path = str(tmp_path / "games")
    g.write.partitionBy("season").parquet(path)
    before = {f for f in os.listdir(f"{path}/season=2")}
    updates = [(3, 101, 99, 0), (4, 88, 87, 1), (100, 70, 60, 0), (3, 102, 99, 0), (7, None, 9, 1)]
    for i, u in enumerate(updates):
        spark.createDataFrame([u], "game_id long, home_score long, away_score long, season long").coalesce(1).write.parquet(str(tmp_path / f"u/{i}"))
    stream = spark.readStream.schema("game_id long, home_score long, away_score long, season long").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "u"))
    q = feeds.stream_upsert_games(stream, path).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r["game_id"]: (r["home_score"], r["away_score"]) for r in spark.read.parquet(path).collect()}
    want = {r["game_id"]: (r["home_score"], r["away_score"]) for r in g.collect()} | {3: (102, 99), 4: (88, 87), 100: (70, 60)}
    assert got == want and set(os.listdir(f"{path}/season=2")) == before
    assert spark.read.parquet(f"{path}-batches").agg(F.sum("updates")).first()[0] == 5


def test_elo_history_streams_through_batches(spark):
    """Pools of several Arrow batches, from stored ratings on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        g = random_games(spark, 90).withColumn("pool_id", F.col("home_team_id") % 1)
        first, second = g.where("game_date < date '2024-01-12'"), g.where("game_date >= date '2024-01-12'")
        whole = {(r["game_id"], r["team_id"]): r["elo_after"] for r in elo.elo_history(g).collect()}
        old = elo.elo_history(first)
        rest = elo.elo_history(second, elo.current_elo(old))
        assert {(r["game_id"], r["team_id"]): r["elo_after"] for r in old.unionByName(rest).collect()} == pytest.approx(whole)
        assert 0 < rest.count() < 180
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_names_with_a_common_beginning_do_not_all_meet(spark):
    cities = [f"city {a}{b}{c} club" for a in "bcdfgh" for b in "aeiou" for c in "klmnrs"]
    teams = spark.createDataFrame([(i, n, f"T{i}") for i, n in enumerate(cities)], "team_id long, full_name string, abbreviation string")
    asked = spark.createDataFrame([(n[:8],) for n in cities] + [(n + " 1901",) for n in cities], "name string")
    met = names.meetings(asked, "name", teams, "full_name").count()
    assert met < len(cities) * 2 * len(cities) / 10
    got = {r["name"]: r["full_name"] for r in names.resolve_names(asked, "name", teams).collect()}
    assert got == {**{n[:8]: n for n in cities}, **{n + " 1901": n for n in cities}}


def test_row_numbers_have_no_window_over_all_rows(spark):
    df = spark.createDataFrame([(i * 37 % 101, i % 3) for i in range(101)], "a long, b long").repartition(5)
    out = features.row_numbers(df, ["b", "a"])
    rows = sorted((r["b"], r["a"], r["row_index"]) for r in out.collect())
    assert [r[2] for r in rows] == list(range(101))
    assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()


def test_regression_weighs_the_penalty_against_the_sum_of_losses(spark):
    """The fitted coefficients minimise half their squares plus PENALTY times the weighted sum of losses."""
    import numpy as np
    from pyspark.ml.linalg import Vectors

    r = np.random.default_rng(0)
    x = r.normal(size=(300, 3))
    y, w = (x @ [1.0, -0.5, 0.2] + r.normal(size=300) > 0).astype(float), r.uniform(0.5, 1.5, 300)
    df = spark.createDataFrame([(Vectors.dense(a), float(b), float(c)) for a, b, c in zip(x, y, w)], ["_x", "home_win", "sample_weight"])
    fit = model.penalised(model.base_learners()["logistic"], float(w.sum())).fit(df)
    b, c = np.zeros(3), 0.0
    for _ in range(50):  # Newton's method
        p = 1 / (1 + np.exp(-(x @ b + c)))
        one = np.column_stack([x, np.ones(300)])
        g = model.PENALTY * one.T @ (w * (p - y)) + np.append(b, 0)
        h = model.PENALTY * (one * (w * p * (1 - p))[:, None]).T @ one + np.diag([1, 1, 1, 0])
        step = np.linalg.solve(h, g)
        b, c = b - step[:3], c - step[3]
    assert fit.coefficients.toArray() == pytest.approx(b, abs=1e-4) and fit.intercept == pytest.approx(c, abs=1e-4)


def test_stack_trains_as_a_plain_loop_does(spark):
    """Folds, weights and accuracy of fits side by side against one fit after another."""
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array

    r = random.Random(4)
    rows = [(i, DAY + dt.timedelta(i // 2), r.random() * 4 - 2, r.random(), 0.5 + r.random()) for i in range(240)]
    df = spark.createDataFrame([(i, d, int(a + r.gauss(0, 1) > 0), w, a, b) for i, d, a, b, w in rows], "game_id long, game_date date, home_win int, sample_weight double, a double, b double")
    learners = {n: model.base_learners(steps=k)["logistic"] for n, k in (("first", 100), ("second", 2))}
    for n, learner in learners.items():
        learner.setProbabilityCol(f"_p_{n}").setRawPredictionCol(f"_r_{n}").setPredictionCol(f"_y_{n}")
    stack = model.train_stack(df, ["a", "b"], 3, 5, learners, meta_steps=5)
    folds, accuracy = features.time_folds(df, 3, 5), []
    for k in range(3):
        train, test = (df.join(folds.where((F.col("fold") == k) & (F.col("part") == p)).select("game_id"), "game_id") for p in ("train", "test"))
        weight = train.agg(F.sum("sample_weight")).first()[0]
        fit = Pipeline(stages=[*model.feature_pipeline(["a", "b"]), *(model.penalised(x, weight) for x in learners.values())]).fit(train)
        out = fit.transform(test).select("home_win", ((vector_to_array("_p_first")[1] + vector_to_array("_p_second")[1]) / 2).alias("p")).collect()
        accuracy.append(sum((x["p"] > 0.5) == x["home_win"] for x in out) / len(out))
    assert stack.fold_accuracy == pytest.approx(sum(accuracy) / 3) and stack.fold_accuracy > 0.7
    assert 0.1 <= stack.temperature <= 10 and len(stack.base.stages) == 4


def test_quota_changes_at_posts_and_when_they_grow_old(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    hours = [0, 1, 1, 5, 24, 26, 30, 100, 200]
    for i, part in enumerate((hours[:4], hours[4:7], hours[7:8], hours[8:])):
        spark.createDataFrame([("a", t + dt.timedelta(hours=h)) for h in part], "account string, posted_at timestamp").coalesce(1).write.parquet(str(tmp_path / f"{i}"))
    stream = spark.readStream.schema("account string, posted_at timestamp").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    got = _run(feeds.quota_changes(stream, "1 hour", 3)).collect()
    hour = lambda r: (r["as_of"] - t).total_seconds() / 3600
    at_posts = {hour(r): (r["posts_24h"], r["remaining"], r["oldest_hours"]) for r in got if r["at_post"]}
    want = {}
    for h in set(hours):
        near = [x for x in hours if h - 24 <= x <= h]
        want[float(h)] = (len(near), max(0, 3 - len(near)), float(h - min(near)))
    assert at_posts == want
    aged = {round(hour(r) - 24): r["posts_24h"] for r in got if not r["at_post"]}
    assert aged == {h: sum(h + 24 + 1e-9 >= x > h for x in hours) for h in (0, 1, 5, 24, 26, 30, 100)}


def test_a_team_feature_takes_one_shuffle_and_one_sort(spark):
    """A task holds the rows of one sort, not of several at once, and no second row for each asked date."""
    t = matches.team_rows(spark.createDataFrame(_days(), _GAME))
    for df in (windows.streak(t), windows.road_trip(t), windows.venue_split(t), windows.recent_form(t, (3, 10))):
        plan = df._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
        assert (plan.count("Sort ["), plan.count("Exchange "), "Union" in plan) == (1, 1, False), plan


def test_features_of_asked_dates(spark):
    t = matches.team_rows(spark.createDataFrame(_days(), _GAME))
    days = [dt.date(2024, 1, 2), dt.date(2024, 1, 3), dt.date(2025, 1, 1)]
    asked = spark.createDataFrame([(1, d) for d in days for _ in range(2)], "team_id long, game_date date")
    got = {r["game_date"]: r["last3_ppg"] for r in windows.recent_form(t, (3,), asked).collect()}
    assert got == {days[0]: 100.0, days[1]: 105.0, days[2]: 105.0}


_GAME = "pool_id long, game_id long, game_date date, home_team_id long, away_team_id long, home_score long, away_score long, " + ", ".join(f"{s}_{b} double" for s in ("home", "away") for b in matches.BOX)


def _days():
    """Two teams; on the first day one game, on the second two, on the third one without a box score."""
    box = [1.0] * 2 * len(matches.BOX)
    games = [(1, 1, 1, 2, 100, 90), (2, 2, 1, 2, 110, 120), (3, 2, 2, 1, 70, 105)]
    rows = [(0, i, dt.date(2024, 1, d), h, a, x, y, *box) for i, d, h, a, x, y in games]
    return [*rows, (0, 4, dt.date(2024, 1, 3), 1, 2, 10, 20, *[None] * len(box))]


def test_a_quota_group_counts_each_account_for_itself(spark, tmp_path):
    """Calls of the state are per group of accounts; times far apart don't run into each other."""
    t, far = dt.datetime(2024, 1, 1), dt.datetime(1970, 1, 2)
    rows = [(i, t + dt.timedelta(hours=5 * i + h)) for i in range(40) for h in (0, 1, 1, 30)] + [(i, far) for i in range(3)]
    spark.createDataFrame(rows, "account long, posted_at timestamp").coalesce(1).write.parquet(str(tmp_path / "p"))
    frame = pd.DataFrame([(a, int((x - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1))) for a, x in rows], columns=["account", "at"])
    got = feeds._Quota(17, "bigint").rows(frame.drop_duplicates().reset_index(drop=True), frame, True)
    want = {(a, x): sum(a == b and x - 86_400_000_000 <= y <= x for b, y in frame.itertuples(index=False)) for a, x in frame.itertuples(index=False)}
    assert dict(zip(zip(got["account"], got["as_of"].astype("int64")), got["posts_24h"])) == want
    assert _run(feeds.quota_changes(spark.readStream.schema("account long, posted_at timestamp").parquet(str(tmp_path / "p")), "1 hour", 3)).where("at_post").count() == len(set(rows))


def test_streamed_files_grow_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(streams, "FILE_ROWS", 10)
    seen = streams.streamed(spark.range(300), "grown")
    assert seen.isStreaming
    n = spark.read.option("recursiveFileLookup", True).parquet(glob.glob(f"{spark.conf.get('spark.checkpoint.dir')[7:]}/*/grown-*")[0]).inputFiles()
    assert len(n) == 30


def test_names_meet_by_the_rarer_one(spark):
    """Forty rows a date share a short home name; each right row meets only the row that has its away name, too."""
    left = spark.createDataFrame([(i, dt.date(2024, 1, 1), "T", f"away {i} x") for i in range(100, 140)], "k long, game_date date, home string, away string")
    right = spark.createDataFrame([(i, dt.date(2024, 1, 1), f"T{i}", f"away {i}") for i in range(100, 140)], "id long, game_date date, home string, away string")
    got = names.fuzzy_match(left, right, "k")
    assert {r["k"]: r["right_id"] for r in got.collect()} == {i: i for i in range(100, 140)}
    low = lambda df, c, n: df.select("game_date", F.lower(F.trim(c)).alias(n))
    # No pair is made but to match: before, the numbers' common parts met.
    aways = names.contained(low(left, "away", "a"), "a", low(right, "away", "b"), "b", ["game_date"])
    assert aways.count() == 40


def test_long_texts_hold_short_ones(spark):
    left = spark.createDataFrame([("x" * 70 + "team" + "y" * 70,), ("tea",), ("",), (None,)], "a string")
    right = spark.createDataFrame([("team",), ("z" * 65 + "tea",), ("none",), ("",)], "b string")
    got = {tuple(r) for r in names.contained(left, "a", right, "b").collect()}
    assert got == {(a, b) for (a,) in left.collect() for (b,) in right.collect() if a and b and (a in b or b in a)} and len(got) == 3
    assert names.contained(left, "a", right.where("false"), "b").count() == 0


def test_schedule_strength_builds_no_lists_and_keeps_a_key(spark, monkeypatch):
    """Lookups take one sort by team and no struct; opponents' figures meet without lists; dates without opponents have a key."""
    g = random_games(spark, 60, seed=6)
    t, h = matches.team_rows(g), elo.elo_history(g).localCheckpoint()
    asked, own = [], windows.lookups
    monkeypatch.setattr(windows, "lookups", lambda a, *rest: asked.append(a) or own(a, *rest))
    out = windows.strength_of_schedule(t, h)
    plan = out._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    assert "ObjectHashAggregate" not in plan and "collect_list" not in plan and "max_by" not in plan, plan
    assert asked[0].where("team_id is null").count() == 0 and asked[0].where("pos is null").count() == t.select("team_id").distinct().count()
    first = out.where("avg_opponent_elo = 1500 and opponent_win_pct = 0.5 and sos_adjusted_win_pct = 0.5")
    assert first.join(t.groupBy("team_id").agg(F.min("game_date").alias("game_date")), ["team_id", "game_date"]).count() == asked[0].where("pos is null").count()


def test_lookups_see_only_earlier_dates(spark):
    g = random_games(spark, 80, seed=7)
    t, h = matches.team_rows(g), elo.elo_history(g)
    asked = t.select("team_id", "game_date", "game_id").unionByName(t.select("team_id", F.date_add("game_date", 1).alias("game_date"), F.lit(None).cast("long").alias("game_id")))
    games, ratings = [r for r in t.collect() if r["win"] is not None], h.collect()
    for r in windows.lookups(asked, t, h).collect():
        won = [x["win"] for x in games if x["team_id"] == r["team_id"] and x["game_date"] < r["game_date"]]
        rated = [(x["game_date"], x["game_id"], x["elo_after"]) for x in ratings if x["team_id"] == r["team_id"] and x["game_date"] < r["game_date"]]
        here = [x["elo_before"] for x in ratings if (x["team_id"], x["game_id"]) == (r["team_id"], r["game_id"])]
        assert (r["share"], r["elo"], r["elo_here"]) == (sum(won) / len(won) if won else None, max(rated)[2] if rated else None, here[0] if here else None)


def test_a_fit_is_not_scattered_over_small_tasks(spark):
    """65 MB of vectors are one task: a task of a fit sends on a histogram of every node, whatever rows it has."""
    names = [f"f{i}" for i in range(203)]
    rows = spark.range(40_000, numPartitions=8).select(F.lit(1).alias("home_win"), F.lit(1.0).alias("sample_weight"), *[(F.col("id") % (i + 2)).cast("double").alias(n) for i, n in enumerate(names)])
    _, x, weight = model._vectors(rows, names)
    assert (x.rdd.getNumPartitions(), x.count(), weight) == (1, 40_000, 40_000.0)
    x.unpersist()


def _teams_and_lines(spark):
    teams = [spark.createDataFrame([(k, 100.0 + k, k) for k in range(1, 6)], "team_id long, team_ppg_players double, active_players long"), spark.createDataFrame([(k, k % 3, k % 2) for k in range(2, 8)], "team_id long, injured_starters long, star_injured int")]
    teams.append(spark.createDataFrame([(k, 30.0 + k, -100.0 + 5 * k, k % 4) for k in range(1, 5)], "team_id long, lat double, lon double, tz_offset int"))
    return teams, [spark.createDataFrame([(k, 1.5 + k) for k in range(1, 200, 3)], "game_id long, market_spread double")]


def test_closed_pools_give_the_same_table_in_one_shuffle(spark):
    """All that is known of a pool meets in one shuffle of games (the ratings take another), not in shuffles of features; the rows
    are those of the path by teams, for played and scheduled games, ties, games of one date and rows without figures."""
    g = random_games(spark, 90, seed=11)
    g = g.withColumns({c: F.when(F.col("game_id") % 9 != 0, F.when(F.col("game_id") % 13 == 0, 100).otherwise(F.col(c))) for c in ("home_score", "away_score")})
    teams, extras = _teams_and_lines(spark)
    got, want = features.form_table(g, None, extras, teams), features.form_table(g, elo.elo_history(g), extras, teams)
    assert sorted(got.dtypes) == sorted(want.dtypes)
    key = lambda df: {r["game_id"]: r.asDict() for r in df.collect()}
    assert key(got) == key(want) and len(key(got)) == 90
    assert got.where("home_lat is null").count() and got.where("market_spread is null").count()
    plan = features.form_table(g)._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    assert plan.count("Exchange ") == 2, plan


def test_open_or_large_pools_go_by_teams(spark, monkeypatch):
    g = random_games(spark, 60, seed=12)
    crossed = g.withColumn("pool_id", F.col("game_id") % 2)
    assert features.pools_are_closed(g) and not features.pools_are_closed(crossed)
    key = lambda df: {r["game_id"]: r.asDict() for r in df.collect()}
    assert key(features.form_table(crossed)) == key(features.form_table(crossed, elo.elo_history(crossed)))
    assert not features.pools_are_closed(g.withColumn("pool_id", F.when(F.col("game_id") > 20, F.col("pool_id"))))
    monkeypatch.setattr(features, "POOL_GAMES", 10)
    assert not features.pools_are_closed(g) and not features.pools_are_closed(g.where("false"))


def test_team_tables_equal_tables_of_games(spark):
    g = random_games(spark, 50, seed=13)
    teams, extras = _teams_and_lines(spark)
    games = [context.player_features(g, teams[0]), context.injury_features(g, teams[1]), context.travel_features(g, teams[2])]
    key = lambda df: {r["game_id"]: r.asDict() for r in df.collect()}
    want = key(features.build_features(g, elo.elo_history(g), [*extras, *games]))
    assert key(features.build_features(g, None, extras, teams=teams)) == want == key(features.build_features(g, elo.elo_history(g), extras, teams=teams))
    assert len({r["away_travel_distance"] for r in want.values()}) > 3 and len({r["injury_differential"] for r in want.values()}) > 2


def test_cache_asks_a_group_of_keys_at_once(spark, tmp_path, monkeypatch):
    """A micro-batch makes a call for each group of keys; answers (micro-batches that overlap) and puts in force (state that goes
    between them) are those of a plain loop over each key's events, for equal times and null keys, too."""
    monkeypatch.setattr(feeds, "BUCKETS", 3)
    r, t = random.Random(5), dt.datetime(2024, 1, 1)
    keys = [None, *range(2**53 + 1, 2**53 + 12)]
    schema = "cache string, key long, at timestamp, payload string"
    stream = lambda reads: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / f"{reads}"))
    life, answers, shown = dt.timedelta(hours=24), [], []
    for reads in (True, False):
        now = {}
        for b in range(3):
            rows = [(r.choice("ab"), r.choice(keys), t + dt.timedelta(hours=30 * b + r.randrange(40 if reads else 29)), r.choice([None, "x", "y", "z"])) for _ in range(250 if reads else 60)]
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"{reads}/{b}"))
            touched = {}
            for c, k, at, p in sorted(rows, key=lambda x: (x[2], x[3] is None, x[3] or "")):
                if p is None:
                    held = now.get((c, k))
                    answers += [(c, k, at, held[0] if held and held[1] <= at < held[1] + life else None)] if reads else []
                elif (c, k) not in now or at >= now[c, k][1]:
                    now[c, k] = (p, at)
                if p is not None:
                    touched[c, k] = now[c, k]
            shown += [] if reads else [(c, k, p, at, at + life) for (c, k), (p, at) in touched.items()]
    order = lambda rows: sorted((tuple(map(str, x)) for x in rows))
    assert order(_run(feeds.stream_cache_reads(stream(True), 24, "100 hours")).collect()) == order(answers)
    puts = feeds.stream_ttl_cache(stream(False).where("payload is not null").withColumnRenamed("at", "cached_at"), 24)
    assert order(_run(puts).collect()) == order(shown)
    plan = puts._jdf.queryExecution().analyzed().toString()
    assert "TransformWithState" in plan and "pmod(xxhash64(cache" in plan
