"""That the queries take all features, folds and rows."""

import inspect

from matchstats.operators import features, model
from matchstats.plans import registry, wide
from matchstats.plans.views import view

SF = "/root/testdata/sf0.001"
TRAIN = model.train_stack


def test_model_queries_train_the_whole_stack(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(model, "train_stack", lambda df, names, **more: asked.append((df.columns, names, more)))
    rows, _ = wide._trained(spark, SF)
    columns, names, more = asked[0]
    assert names == features.FEATURES and more == {} and set(names) <= set(columns) and {"train_stack", "score_games"} <= set(registry.QUERIES)
    defaults = inspect.signature(TRAIN).parameters
    assert defaults["n_splits"].default == 5 and defaults["meta_steps"].default == 500
    own = model.base_learners()
    assert [(own[n].getMaxIter(), own[n].getMaxDepth()) for n in ("boosted", "boosted_second")] == [(200, 5)] * 2
    assert (own["forest"].getNumTrees(), own["forest"].getMaxDepth(), own["logistic"].getMaxIter()) == (200, 10, 1000)


def test_wide_table_has_players_travel_injuries_and_market(spark):
    q = lambda name: registry.QUERIES[name](spark, SF)
    wide_rows = {r["game_id"]: r for r in q("build_features").collect()}
    assert len(wide_rows) == spark.read.parquet(f"{SF}/orders.parquet").count()
    for name in ("travel_features", "injury_features", "market_features"):
        own = [r.asDict() for r in q(name).collect()]
        same = [c for c in own[0] if c in features.FEATURES]
        assert len(same) >= 3 and len(own) == len(wide_rows)
        assert all(abs(wide_rows[r["game_id"]][c] - r[c]) < 2e-6 for r in own for c in same)
    players = {r["team_id"]: r for r in q("team_player_stats").collect()}
    for r in wide.games(spark, SF).select("game_id", "home_team_id", "away_team_id").collect():
        for s in ("home", "away"):
            team = players.get(r[f"{s}_team_id"])
            assert all(abs(wide_rows[r["game_id"]][f"{s}_{c}"] - (team[c] if team else 0)) < 2e-6 for c in features.PLAYERS)
    varied = [c for c in [f"{s}_{c}" for s in ("home", "away") for c in features.PLAYERS] + [c for c in features.FEATURES if "injur" in c or "travel" in c or "market_" in c] if len({r[c] for r in wide_rows.values()}) > 1]
    assert "elo_travel_interaction" in varied and len(varied) >= 28, varied


def test_lookup_takes_the_keys_of_all_games(spark):
    games = wide.games(spark, SF)
    teams = {r["c_custkey"] for r in spark.read.parquet(f"{SF}/customer.parquet").collect()}
    keys = {(r["game_date"], r["home_team_id"], r["away_team_id"], r["game_id"] % 2) for r in games.collect() if {r["home_team_id"], r["away_team_id"]} <= teams}
    assert registry.QUERIES["lookup_all_predictions"](spark, SF).count() == len(keys)
    assert "game_id%5 = 0)" not in registry.SQL["lookup_all_predictions"]


def test_team_logs_of_all_seasons_are_read(spark):
    rows = registry.QUERIES["read_all_team_logs"](spark, SF).collect()
    years = {r["y"] for r in wide.games(spark, SF).selectExpr("year(game_date) AS y").distinct().collect()}
    assert {int(r["SEASON"][:4]) for r in rows} == years and len(rows) == len(years) > 2
    assert sum(r["n"] for r in rows) == view(spark, SF, "team_logs").count()
