import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from tallyboard.operators import history, model, outcomes
from tallyboard.plans import daily
from tallyboard.plans import fixtures as fx
from tallyboard.session import stage
from tallyboard.sources import writers

SF = "/root/testdata/sf0.001"
SMALL = {"n_trees": 3, "max_depth": 3}


@pytest.fixture(scope="module")
def features(spark):
    return stage(history.feature_set(fx.games(spark, SF), fx.venues(spark, SF)), "test-features")


def test_forecasts_fill_every_open_game(spark, features):
    fitted = model.train_scores(features, **SMALL)
    scored = model.score_games(features, fitted)
    assert scored.count() == features.count()
    assert scored.where("homeTeamScore IS NULL OR awayTeamScore IS NULL OR lastPeriod IS NULL").count() == 0
    assert scored.where("homeTeamScore = awayTeamScore").exceptAll(features).count() == 0
    played = features.where("homeTeamScore IS NOT NULL")
    assert played.exceptAll(scored.select(played.columns)).count() == 0


def test_same_seed_gives_same_rows_and_a_saved_model_too(spark, features, tmp_path):
    first = model.train_scores(features, **SMALL)
    again = model.train_scores(features, **SMALL)
    path = str(tmp_path / "model")
    first.write().overwrite().save(path)
    loaded = PipelineModel.load(path)
    want = model.predict(first, features).select("gameId", "homeTeamScore_predicted")
    for other in (again, loaded):
        assert want.exceptAll(model.predict(other, features).select(want.columns)).count() == 0


def test_holdout_has_all_games_of_the_season(spark, features):
    row = model.holdout_metrics(features, "20002001", **SMALL).first()
    played = features.where("seasonName = '20002001' AND homeTeamScore IS NOT NULL").count()
    assert row["games"] == played and row["mse"] > 0 and 0 <= row["accuracy"] <= 1


def test_feature_list(features):
    names = model.feature_columns(features)
    assert names == sorted(names) and not set(names) & set(model.NOT_FEATURES)
    assert len(names) == len(features.columns) - 3


def test_codes_of_very_many_labels(spark):
    df = spark.range(150_000).select(F.when(F.col("id") % 10 != 3, F.col("id").cast("string")).alias("name"))
    out = model.encode_columns(df, ["name"])
    assert out.where("name IS NULL").select("nameCode").distinct().collect() == [(135_000.0,)]
    named = out.where("name IS NOT NULL")
    bounds = named.agg(F.min("nameCode"), F.max("nameCode"), F.count_distinct("nameCode")).first()
    assert tuple(bounds) == (0.0, 134_999.0, 135_000)
    rows = sorted(named.where("nameCode % 1000 = 0").collect(), key=lambda r: r.nameCode)
    assert [r.name for r in rows] == sorted(r.name for r in rows)


def test_fitting_refuses_more_labels_than_allowed(spark, features):
    with pytest.raises(ValueError):
        model.train_scores(features, max_labels=3, **SMALL)


def test_shares_of_several_seasons(spark):
    rows = [(i, season, team, seed, 1) for i in range(2) for season in ("a", "b") for team, seed in (("X", "div_1"), ("Y", "missed"))]
    table = spark.createDataFrame(rows, "iteration int, seasonName string, teamName string, playoffSeed string, roundsWon int")
    whole = {r.teamName: r["div_1_%"] for r in outcomes.outcome_probabilities(table).collect()}
    assert whole == {"X": 100.0, "Y": 0.0}
    apart = outcomes.outcome_probabilities(table, by=["seasonName"]).collect()
    assert {(r.seasonName, r.teamName, r["playoff_%"]) for r in apart} == {(s, t, p) for s in "ab" for t, p in (("X", 100.0), ("Y", 0.0))}
    teams = spark.createDataFrame([("X",), ("Z",)], "teamName string")
    known = {(r.seasonName, r.teamName): r.div_1 for r in outcomes.seed_probabilities(table, teams, ["seasonName"]).collect()}
    assert known == {("a", "X"): 2, ("b", "X"): 2, ("a", "Z"): 0, ("b", "Z"): 0}


def test_whole_run(spark):
    games = fx.timed_games(spark, SF).drop("gameDate", "gameTimeEST")
    scored, _ = daily.forecast_season(games, fx.venues(spark, SF), as_of="2001-03-01", **SMALL)
    assert scored.where("lastPeriod IS NULL").count() == 0
    table, pairs = daily.playoff_picture(scored, fx.teams(spark, SF), wins_needed=2)
    assert table.count() == 7 * 20 and pairs.count() == 7 * 8


def test_only_due_seasons_are_rebuilt(spark, tmp_path):
    path = str(tmp_path / "features")
    log = fx.games(spark, SF).withColumn("lastPeriod", F.coalesce("lastPeriod", F.lit("REG")))
    venues = fx.venues(spark, SF)
    first = daily.refresh_features(log, venues, path)
    assert first.count() == log.count()
    # Scores of an old and of the latest season change; only the latter is due.
    changed = log.withColumn("homeTeamScore", F.lit(8.0))
    rows = daily.refresh_features(changed, venues, path).groupBy("seasonName").agg(F.max("homeTeamScore").alias("top"))
    tops = {r["seasonName"]: r["top"] for r in rows.collect()}
    assert tops["20012002"] == 8.0 and tops["19951996"] < 8.0


def test_feature_names_as_text(spark, features, tmp_path):
    path = str(tmp_path / "names")
    writers.write_feature_names(model.feature_columns(features), spark, path)
    assert [r["value"] for r in spark.read.text(path).collect()] == model.feature_columns(features)


def test_evaluation_run(spark):
    snapshots = fx.snapshots(spark, SF).withColumn("kind", F.lit("regularseason"))
    games, days = daily.evaluate_snapshots(snapshots, fx.games(spark, SF), fx.odds(spark, SF), "1996-01-01", "1999-01-01")
    total = games.agg(F.sum("winnings")).first()[0]
    last = days.orderBy(F.desc("gameDate")).first()["runningReturn"]
    assert abs(total - last) < 1e-6


def test_outcome_run(spark):
    table, rings = daily.outcome_report(fx.outcomes(spark, SF), fx.teams(spark, SF))
    assert table.count() == 20 and rings.count() == 20 * len(outcomes.RINGS)


def test_runs_share_what_is_made_of_the_features(spark, features, monkeypatch):
    fits, fit = [], model.Pipeline.fit

    def counted(self, *args):
        fits.append(len(self.getStages()))
        return fit(self, *args)

    monkeypatch.setattr(model.Pipeline, "fit", counted)
    season = features.where("homeTeamScore IS NOT NULL").first()["seasonName"]
    every = model.holdout_metrics(features, season, runs=2, seed=5, n_trees=2, max_depth=2).first()
    assert len(fits) == 1
    one, two = (model.holdout_metrics(features, season, seed=s, n_trees=2, max_depth=2).first() for s in (5, 6))
    assert every["games"] == one["games"] and abs(every["mse"] - (one["mse"] + two["mse"]) / 2) < 1e-9
