"""Whole runs put together from the operators."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyboard.operators import bracket, evaluate, history, model, outcomes, refresh, standings
from tallyboard.session import stage
from tallyboard.sources import readers, store, writers


def refresh_features(log: DataFrame, venues: DataFrame, path: str, **options) -> DataFrame:
    """The stored feature sets after rebuilding only the seasons that need it.

    `log` has local dates. A season is taken from the store under `path` if it
    is there, complete, and not the latest one.
    """
    spark = log.sparkSession
    try:
        cached = spark.read.parquet(path).select(F.col("seasonName").cast("string"))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        cached = log.select("seasonName").limit(0)
    # Staged, because the store is read for it and then written to.
    due = stage(refresh.seasons_to_refresh(log, cached).select("seasonName"), "due_seasons")
    features = history.feature_set(log.join(due, "seasonName", "left_semi"), venues, **options)
    writers.write_by_season(features, path)
    return spark.read.schema(features.schema).parquet(path)


def refresh_features_by_content(log: DataFrame, venues: DataFrame, path: str, **options) -> DataFrame:
    """The stored feature sets after rebuilding the seasons whose games, or the venues, have changed.

    Each stored season carries the fingerprint of what it was made from, so a
    correction in a finished season is found, and an unchanged one is never rebuilt. Seasons that
    the log no longer has go.
    """
    spark = log.sparkSession
    places = refresh.season_fingerprints(venues.withColumn("seasonName", F.lit(""))).drop("seasonName").first()
    now = {r["seasonName"]: [*r[1:], *(places or [])] for r in refresh.season_fingerprints(log).collect()}
    version = store.latest(spark, path)
    have = {e["season"]: e["source"] for e in version["seasons"]} if version else {}
    due = [s for s, found in now.items() if have.get(s) != found]
    gone = [s for s in have if s not in now]
    if due or gone or version is None:
        fresh = spark.createDataFrame([(s,) for s in due], "_due string")
        features = history.feature_set(log.join(F.broadcast(fresh), log["seasonName"].eqNullSafe(fresh["_due"]), "left_semi"), venues, **options)
        version = store.replace_seasons(spark, path, features, due + gone, now)
    return store.read(spark, path, version)


def forecast_season(
    log: DataFrame,
    venues: DataFrame,
    as_of: str | None = None,
    fitted: PipelineModel | None = None,
    **forest,
) -> tuple[DataFrame, PipelineModel]:
    """Feature set with forecasts for all open games, and the model that made them.

    `log` has UTC start times. With `as_of`, results from that date on are hidden
    first. Features of open games rest on what is known, not on other forecasts.
    """
    known = refresh.mask_as_of(log, as_of) if as_of else log
    # Training reads the features several times, so they are stored once.
    features = stage(history.feature_set(refresh.local_time(known), venues), "features")
    fitted = fitted or model.train_scores(features, **forest)
    return model.score_games(features, fitted), fitted


def playoff_picture(
    scored: DataFrame, teams: DataFrame, wins_needed: int = 4, scenario: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Final standings and first-round pairs with the state of their series."""
    table = standings.standings(scored, teams, scenario)
    pairs = bracket.first_round(table, scenario)
    state = bracket.series_state(scored, wins_needed, scenario)
    return table, bracket.bracket_results(pairs, state, scenario)


def scenario_probabilities(
    games: DataFrame, teams: DataFrame, wins_needed: int = 4, scenario: str = "iteration"
) -> tuple[DataFrame, DataFrame]:
    """From whole logs of many scenarios to outcome percentages by season and team, and the brackets of all
    four rounds behind them.

    All scenarios go through standings, pairs and rounds together, keyed by scenario and season. A series
    that its log doesn't decide has no winner, and the place in the next round stays empty.
    """
    table = stage(standings.standings(games, teams, scenario), "table")
    state = stage(bracket.series_state(games, wins_needed, scenario), "state")
    pairs, rounds = bracket.first_round(table, scenario), []
    for number in (2, 3, 4, None):
        # A round has at most eight rows of a scenario's season; the next one reads it and so does the tally.
        rounds.append(stage(bracket.bracket_results(pairs, state, scenario), "round"))
        if number:
            pairs = bracket.next_round(rounds[-1], number, scenario)
    columns = [scenario, "seasonName", "round", "slot", "team1", "team2", "team1Wins", "team2Wins", "decided", "winner"]
    results = rounds[0].select(*columns)
    for other in rounds[1:]:
        results = results.unionByName(other.select(*columns))
    reached = outcomes.scenario_outcomes(table, results, scenario)
    return outcomes.outcome_probabilities(reached, by=["seasonName"], scenario=scenario), results


def evaluate_snapshots(
    snapshots: DataFrame, actual: DataFrame, odds: DataFrame, since: str, until: str
) -> tuple[DataFrame, DataFrame]:
    """Return of every forecast game in [since, until), and per day with a running total."""
    chosen = readers.read_snapshots(snapshots, since, until)
    compared = evaluate.snapshot_accuracy(chosen, actual)
    games = evaluate.game_returns(evaluate.with_odds(compared, odds))
    return games, evaluate.daily_returns(games)


def outcome_report(scenarios: DataFrame, teams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Outcome percentages of all teams, and their ring shares."""
    table = outcomes.outcome_probabilities(scenarios, teams)
    return table, outcomes.ring_shares(table)
